"""Mixing sources to target weights.

Words are summed per source; a target is the source's weighted share of all words, at
most REPEAT_LIMIT times its own words, with the excess shared again by weight; rate =
target / words. A document is taken floor(rate) times, plus once more where a uniform
number seeded by its id is below the fraction. Only (source, words, documents) is
shuffled before the verdicts are joined back, so a source with a third of all rows is
one partial aggregate per task.

The fixed point is found in closed form: capped sources are a prefix of the order by
3 x words / weight, so running sums over the table of sources, by range partitions, give the
level; no task sees all sources. The rates are joined back by broadcast while they are few,
salted beyond.

Defined results: null text has no words; null source is a source, last in order; a
source without words has target 0 and its documents are not taken; null doc_id draws as
the empty id; repeated rows draw alike; an empty table gives no rows;
extra columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, n_words, own_columns, positions, running, table

WEIGHTS = (5, 2, 1)
REPEAT_LIMIT = 3
SEED = 17


def draw(key: Column, seed: int) -> Column:
    """Uniform in [0, 1), from 52 bits of md5; the same in every engine and run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = REPEAT_LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source. Sums are whole numbers, so any order of adding gives the same."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = positions(sums, [F.col("source").asc_nulls_last()], "sources", "place")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int")).cast("long")
    ranked = placed.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    run = running(ranked, ["ratio", "place"], ["source_size", "weight"], "levels")
    whole = run.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()  # two numbers
    level = (F.lit(whole["words"]) - limit * F.col("before_source_size")).cast("double") / (F.lit(whole["weight"]) - F.col("before_weight")).cast("double")
    run = run.withColumn("level", level).withColumn("capped", limit * F.col("source_size") <= F.col("weight") * F.col("level"))
    first = run.where(~F.col("capped")).agg(F.min(F.struct("ratio", "place", "level")).alias("f")).first()["f"]  # one row
    share = F.col("weight").cast("double") * F.lit(first["level"] if first else 0.0)
    return run.select("source", "source_size", F.when(F.col("capped"), (limit * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def copies(documents: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, limit: int = REPEAT_LIMIT) -> DataFrame:
    """(row, mix): the columns of ``documents`` as one struct; size, source_size, target and copies as another."""
    rows = own_columns(documents).withColumn("size", n_words(F.col("row.text")))
    rates = targets(rows.select(F.col("row.source").alias("source"), "size"), weights, limit)
    joined = look_up(rows, F.col("row.source"), rates.select(F.col("source").alias("key"), F.struct("source_size", "target").alias("found")))
    rate = F.when(F.col("found.source_size") > 0, F.col("found.target") / F.col("found.source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    n = (whole + F.when(draw(F.col("row.doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("int")
    return joined.select("row", F.struct("size", "found.source_size", "found.target", n.alias("copies")).alias("mix"))


def mix(documents: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, limit: int = REPEAT_LIMIT) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``documents``."""
    taken = copies(documents, seed, weights, limit).where("mix.copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("copy")).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).cast("long").alias("taken"))


OP9_SQL = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), r as (
  select *, row_number() over (order by source asc nulls last) - 1 as place from s
), w as (
  select *, ([5, 2, 1])[(place % 3 + 1)::int]::bigint as weight from r
), c as (
  select *, sum(source_size) over ()::bigint as total,
    (sum(source_size) over o - source_size)::bigint as words_before,
    (sum(weight) over () - sum(weight) over o + weight)::bigint as weight_left
  from w window o as (order by source_size::double / weight::double, place rows between unbounded preceding and current row)
), l as (
  select *, (total - {REPEAT_LIMIT} * words_before)::double / weight_left::double as level from c
), f as (
  select *, {REPEAT_LIMIT} * source_size <= weight * level as capped from l
), t as (
  select source, source_size,
    case when capped then ({REPEAT_LIMIT} * source_size)::double
      else weight::double * (select arg_min(level, source_size::double / weight::double) from f where not capped) end as target
  from f
), j as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size::double else 0.0 end as rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / {1 << 52}::double as u
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from j
"""
