"""Host-level quality rules.

Rules run on each text; failures are summed per host (the ``source`` of a document),
failure rates are shrunk by a beta prior whose mean and strength come from the hosts
themselves (method of moments), and a host whose shrunk rate of any rule reaches
HOST_LIMIT is rejected; the verdict is joined back to its documents.

Native expressions only: words, windows and lines are arrays of one row, counted by
sorting 64-bit hashes of the row's own windows. Texts are measured once; the counts are
written to the shared folder and used for both the sums and the join. They are far smaller
than the texts, so they are gathered into a file a core or a file for each FILE_INPUT bytes of
the input, whichever is more (a file a shuffle partition at most): the many tasks over the
texts leave no file each. Sums per host are
partial in every task, so a host with a third of all rows is no hot group; only rejected
hosts are joined back, by broadcast while they are few and salted beyond.

Repeated windows are looked for by the number of distinct window hashes; only texts that
have some are sorted to place them.

Defined results: null text has no words and fails; null source is a host of its own;
rows are judged one by one, so repeated rows and ids give the same verdict each; an empty
table gives no rows; extra columns, whatever their names, stay (``reject`` keeps the columns
of its input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, files_for, let, look_up, materialise, own_columns, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of words in repeated windows above which a document fails.
REPEAT_PERCENT = 50
#: A host is rejected when more than half of its documents are expected to fail a rule.
HOST_LIMIT = 0.5
RULES = ("too_short", "repetitive", "symbols", "dup_lines")


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^\\x20\\x09-\\x0D]"))

    def repeats(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

        def covered(h: Column) -> Column:
            keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            found = let(keyed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
            return F.aggregate(found, F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + 2).alias("end"), (a["n"] + i + 2 - F.greatest(a["end"], i - 1)).alias("n")), lambda a: a["n"])

        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("c"), repeats(w).cast("long").alias("r")))
    by_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    return F.transform(
        F.array(by_words), lambda b: F.struct(b["n"].alias("n_words"), b["c"].alias("word_chars"), symbols.alias("n_symbols"), by_lines.alias("n_dup_lines"), b["r"].alias("n_repeat_words"))
    )[0]


def failures(m: str) -> dict[str, Column]:
    """Rule -> failed, from the measures in struct column ``m``."""
    n = F.col(f"{m}.n_words")
    return {
        "too_short": n < MIN_WORDS,
        "repetitive": 100 * F.col(f"{m}.n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 10 * F.col(f"{m}.n_symbols") > n,
        "dup_lines": 5 * F.col(f"{m}.n_dup_lines") > n,
    }


def base_failed(m: str) -> Column:
    f = failures(m)
    return f["too_short"] | f["repetitive"]


def rejected_hosts(measured: DataFrame) -> DataFrame:
    """(host) rejected by any rule, from (host, m)."""
    flags = [F.sum(f.cast("long")).alias(rule) for rule, f in failures("m").items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *flags)
    by_rule = hosts.select("host", "n", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "failed"))
    rate = F.col("failed") / F.col("n")
    spread = by_rule.groupBy("rule").agg((F.sum("failed") / F.sum("n")).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inv"))
    # The rates' variance holds sampling noise of mean (1 - mean) / n; what is left is the prior's.
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("var") - noise * F.col("inv"), F.lit(1e-9))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), noise / between - 1))
    prior = spread.select("rule", (F.col("mean") * strength).alias("a"), ((1 - F.col("mean")) * strength).alias("b"))
    shrunk = by_rule.join(F.broadcast(prior), "rule").withColumn("rate", (F.col("failed") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b")))
    return shrunk.where(F.col("rate") >= HOST_LIMIT).select("host").distinct()


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, host, m, base_failed, kept): one row for each row of ``documents``."""
    rows = documents.select("doc_id", F.col("source").alias("host"), measures(F.col("text")).alias("m"))
    measured = materialise(rows.repartition(files_for(documents)), "quality")
    shut = rejected_hosts(measured).select(F.col("host").alias("key"), F.struct(F.lit(True).alias("shut")).alias("found"))
    marked = look_up(measured.withColumn("base_failed", base_failed("m")), F.col("host"), shut)
    return marked.select("doc_id", "host", "m", "base_failed", (~F.col("base_failed") & F.col("found").isNull()).alias("kept"))


def reject(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with its columns. Rows are measured once and held with their counts for the second look."""
    measured = materialise(own_columns(documents).withColumn("m", measures(F.col("row.text"))), "measured")
    shut = rejected_hosts(measured.select(F.col("row.source").alias("host"), "m")).select(F.col("host").alias("key"), F.struct(F.lit(True).alias("shut")).alias("found"))
    return look_up(measured.where(~base_failed("m")), F.col("row.source"), shut).where("found is null").select("row.*")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


OP4_SQL = f"""
with d as (
  select row_number() over () as k, doc_id, source, coalesce(text, '') as text from documents
), w as (
  select k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols
  from d
), g as (
  select k, i, w[i:i + 2] as gram from (select k, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
), c as (
  select k, i, count(*) over (partition by k, gram) as n from g
), r as (
  select k, count(distinct i + o)::bigint as n_repeat_words from c, (values (0), (1), (2)) v(o) where n >= 2 group by k
), m as (
  select d.doc_id, d.source, len(w.w)::bigint as n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::bigint as word_chars,
    w.n_symbols::bigint as n_symbols, (len(w.l) - len(list_distinct(w.l)))::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0) as n_repeat_words
  from d join w using (k) left join r using (k)
), f as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from m
), h as (
  select source, count(*) as n, unnest(['too_short', 'repetitive', 'symbols', 'dup_lines']) as rule,
    unnest([sum((n_words < {MIN_WORDS})::int), sum((100 * n_repeat_words > {REPEAT_PERCENT} * n_words)::int),
            sum((10 * n_symbols > n_words)::int), sum((5 * n_dup_lines > n_words)::int)]) as failed
  from m group by source
), p as (
  select rule, sum(failed)::double / sum(n)::double as mean, var_pop(failed::double / n) as v, avg(1.0::double / n) as inv from h group by rule
), q as (
  select rule, mean, greatest(1.0, least(1e6, mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1)) as strength from p
), b as (
  select distinct source from h join q using (rule) where (failed + mean * strength) / (n + strength) >= {HOST_LIMIT}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from b where b.source is not distinct from f.source) as kept
from f
"""
