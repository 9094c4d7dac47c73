"""URL filter: rules by host and path, then a listed-URL test by blocked Bloom filter and exact join.

The listed canonical URLs are hashed into a blocked Bloom filter of bounded size, which
every task holds. Every URL that no rule decides is tested against it in the scan; only
possible hits are joined with the list, which removes false positives, so the size of the
filter never changes a result and what is shuffled is the possible hits.

Canonical form: scheme dropped; host in lower case without a leading ``www.`` or ``m.``;
query and fragment dropped; path without trailing slashes and then without ``.html`` or
``.htm``.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is in no list, so it is allowed; very long URLs are like others; repeated rows are
judged alike; an empty table gives no rows, an empty list allows all; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import look_up, materialise, table

#: The rules of the query as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The query's list. Its URLs are those of these names under each domain and language with a number
#: below LIST_NUMBERS whose remainder by LIST_EVERY is not 0; the others of the same hosts are not listed.
LIST_NAMES = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")
LIST_DOMAINS, LIST_LANGS = ("example.com", "example.net", "example.org"), ("de", "en", "es", "fr")
LIST_NUMBERS, LIST_EVERY = 10_000, 4


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Null for an empty host."""
    own = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), own))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first listed."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        hit = fits(host, path, h, p)
        name = F.when(hit, F.lit(h + p)) if name is None else name.when(hit, F.lit(h + p))
        verdict = F.when(hit, F.lit(kind)) if verdict is None else verdict.when(hit, F.lit(kind))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def listed_urls(spark: SparkSession) -> DataFrame:
    """(canonical): the query's list, made by its rule and never from the pages. Any table of one column ``canonical`` serves as well."""
    sites = spark.createDataFrame([(f"{n}.{d}/{lang}/",) for n, d, lang in product(LIST_NAMES, LIST_DOMAINS, LIST_LANGS)], "site string")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(LIST_NUMBERS - 1)), lambda k: k % LIST_EVERY != 0)
    return sites.select("site", F.explode(numbers).alias("k")).select(F.concat("site", F.col("k").cast("string")).alias("canonical"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, possible (by the filter), listed: one row for each row of ``pages``."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    asked = F.when(rule.isNull(), canonical(F.col("host"), F.col("path")))
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), asked.alias("canonical"))
    known = listed.select("canonical").where("canonical is not null")
    bits = bloom.build(known.select(F.xxhash64("canonical").alias("h")))
    probed = materialise(bloom.marked(ruled.withColumn("h", F.when(F.col("canonical").isNotNull(), F.xxhash64("canonical"))), bits, "possible").drop("h"), "probed")
    # Of the possible hits each URL is held against the list once, however many pages have it.
    hits = materialise(probed.where("possible").select("canonical").distinct().join(known.distinct(), "canonical", "left_semi"), "hits")
    found = look_up(probed.where("possible"), F.col("canonical"), hits.select(F.col("canonical").alias("key"), F.struct(F.lit(True).alias("yes")).alias("found")))
    on_list = found.select("page_id", "host", "path", "rule", "ruled", "possible", F.col("found").isNotNull().alias("listed"))
    rest = probed.where("not possible").select("page_id", "host", "path", "rule", "ruled", "possible", F.lit(False).alias("listed"))
    return rest.unionByName(on_list).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "possible", "listed")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
with r as (
  select page_id, case when url like '%://%' then regexp_replace(url, '^.*?://', '', 's') else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r
), c as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\\.html?$', '') end as canonical,
    case {' '.join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{k}:{h}{p}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} end as hit
  from p
), l as (
  select n || '.' || d || '/' || g || '/' || k as canonical
  from (select unnest({list(LIST_NAMES)}) as n), (select unnest({list(LIST_DOMAINS)}) as d), (select unnest({list(LIST_LANGS)}) as g), range({LIST_NUMBERS}) t(k) where k % {LIST_EVERY} <> 0
)
select page_id, host, path, split_part(hit, ':', 2) as rule,
  case when hit is not null then split_part(hit, ':', 1) when canonical in (select canonical from l) then 'block' else 'allow' end as verdict
from c
"""
