"""URL filters by a sort-merge range join of reversed-host keys with nested rule intervals.

A rule (host, path) becomes a key ``reversed host, \\x01, path``; all keys that begin with it form one interval. Each url
gives a key for its host and for every parent domain, so "the rule fits its host and all subdomains" turns into "the rule's
key is a prefix of one of the url's keys". Keys and rules are dealt to ranges of key space; a rule goes to every range
that its interval touches. Each range is sorted and swept once with a stack of the rules that are open: intervals of
prefixes nest, so the top of the stack is the longest rule. Memory is the depth of the nesting, not the number of rules.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Rules of the registered query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT_VERDICT = "allow"
#: Keys that are looked at for each range when the ranges are chosen. It steers balance only.
SAMPLE_PER_RANGE = 50

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null or without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _range_bounds(keys: DataFrame, n: int) -> list[str]:
    """At most n-1 keys that part the table into ranges of about one size, from a sample of bounded size."""
    total = keys.count()
    if n < 2 or not total:
        return []
    share = min(1.0, n * SAMPLE_PER_RANGE / total)
    found = sorted(r[0].encode() for r in keys.sample(share, seed=7).collect())
    return [x.decode() for x in dict.fromkeys(found[len(found) * i // n] for i in range(1, n))] if found else []


def _deal(bounds: list[bytes], is_rule: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the range of each key; a rule is repeated for every range that its interval touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pid = [], []
            for i, k in enumerate(batch.column("key").to_pylist()):
                k = k.encode()
                lo = bisect_right(bounds, k)
                hi = bisect_right(bounds, k + b"\xff") if is_rule else lo  # no UTF-8 key has a byte 0xff
                row += [i] * (hi - lo + 1)
                pid += range(lo, hi + 1)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int32())) for c in batch.columns), pa.array(pid, pa.int32())], names=[*batch.schema.names, "pid"])

    return run


_ROW = "key string, kind int, host string, path string, rule string, verdict string"
_FOUND = "host string, path string, rule string, verdict string, size int, host_size int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more ranges, sorted by range, key and kind (rules first): the longest open rule of each url key."""
    stack: list[tuple[str, str, str, int, int]] = []
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for key, kind, host, path, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "host", "path", "rule", "verdict")), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict, len(host) + len(path), len(host)))
            elif stack:
                for column, x in zip(out, (host, path, *stack[-1][1:]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in out[:4]), *(pa.array(x, pa.int32()) for x in out[4:])], names=[x.split()[0] for x in _FOUND.split(", ")])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages (page_id, url) and rules (verdict, host, path) to page_id, host, path, rule, verdict; one row a page.

    The longest rule (host and path together) that fits wins; of equal length that of the longer host; of the same host
    and path a block. Without a rule: rule null and the default verdict. A null url or one without :// has an empty host
    and path. Repeated pages and repeated rules are fine, as are an empty table on either side and urls of any length.
    Only page_id and url are read of pages, so other names may clash.
    """
    spark = pages.sparkSession
    n = common.partitions(spark)
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    # Each different (host, path) once, with a key for the host and each parent domain. The full host ends the key, so
    # that keys differ and ranges can part the many urls that share a parent domain and a path.
    labels = F.split("host", r"\.", -1)
    urls = parts.select("host", "path").distinct().select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, i, F.size(labels))), "."))).alias("domain"))
    points = common.saved(urls.select(F.concat("domain", F.lit("\x01"), "path", F.lit("\x00"), "host").alias("key"), "host", "path"), "url-keys")
    bounds = [x.encode() for x in _range_bounds(points.select("key"), n)]
    flat = F.lit(None).cast("string")
    dealt_points = points.select("key", F.lit(1).alias("kind"), "host", "path", flat.alias("rule"), flat.alias("verdict")).mapInArrow(_deal(bounds, False), _ROW + ", pid int")
    clean = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    dealt_rules = clean.select(F.concat(_reversed(F.col("host")), F.lit("\x01"), "path").alias("key"), F.lit(0).alias("kind"), "host", "path", F.concat("host", "path").alias("rule"), "verdict").mapInArrow(_deal(bounds, True), _ROW + ", pid int")
    swept = dealt_points.unionByName(dealt_rules).repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "key", "kind").drop("pid").mapInArrow(_sweep, _FOUND)
    best = swept.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = """
WITH r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(verdict, length(h || p)), 'allow') AS verdict
FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""
