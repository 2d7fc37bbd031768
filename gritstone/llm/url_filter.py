"""URL rules as a sort-merge range join.

A host's labels are reversed and each closed by a dot, so ``www.example.net`` is ``net.example.www.`` and a rule for a
host fits the keys that start with its own: one interval of the sorted keys. Intervals of hosts are nested or apart.
Keys are cut into ranges by quantiles of (key, path, id), so that one host with very many pages spreads over several
ranges; a rule goes to the ranges that its interval meets. Within a range, rules and pages sorted together are swept
once, with a stack of the rules whose interval holds the current key. From the stack's top, the longest host first,
the rule with the longest path that the page's path starts with decides.

The rule table is split and shuffled like the pages and never broadcast. A range gets, besides the rules that start in
it, only those whose interval holds its first key: the rules of that key's own parent hosts.

Cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated urls and ids are judged
each; rules given twice count once (allow before block); without rules every verdict is the default; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.common import clipped

RULE, PAGE = 0, 1
#: Ends the interval of a key: no byte of UTF-8 text is larger.
TOP = "\U0010ffff"
#: Quantiles of the keys that the driver holds: at most this many ranges.
MAX_RANGES = 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the text has them; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, key and kind (rules first), rules of a key in any order."""
    place, stack = None, []  # stack: (key, {path: (verdict, name)}, path lengths), each key inside the one below it
    for batch in batches:
        out = []
        for where, key, kind, path, page, host, verdict in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "kind", "path", "id", "host", "verdict")), strict=True):
            if where != place:
                place, stack = where, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == RULE:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                paths = stack[-1][1]
                if paths.get(path, ("block",))[0] == "block":
                    paths[path] = (verdict, host + path)
                    stack[-1][2].add(len(path))
                continue
            found = None
            for _, paths, lengths in reversed(stack):
                for n in sorted(lengths, reverse=True):
                    if n <= len(path) and (found := paths.get(path[:n])):
                        break
                if found:
                    break
            out.append((page, host, path, found[1] if found else None, found[0] if found else default))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kind = batch.schema.field("id").type
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (kind, *[pa.string()] * 4), strict=True)], names=["id", "host", "path", "rule", "verdict"])


def _cuts(orders: DataFrame, ranges: int) -> list[str]:
    """Cuts into about equal ranges, from a sample of some 20 keys a range. They decide balance only, not results."""
    ranges = min(ranges, MAX_RANGES)
    rows = orders.count()
    sample = sorted(r["o"] for r in orders.sample(min(1.0, 20 * ranges / max(rows, 1)), 7).collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def filter_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every page; rules: host, path, verdict ('allow' or 'block')."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    pages = clipped(pages, id_col, url_col).toDF("id", "url").select("id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    rules = clipped(rules, "host", "path", "verdict").distinct().withColumn("key", host_key(F.col("host")))
    # the cuts are whole order keys: host key, path, id
    order = F.concat_ws("\x01", "key", "path", F.format_string("%020d", F.coalesce(F.expr("try_cast(id AS bigint)"), F.lit(0).cast("bigint"))))
    cuts = _cuts(pages.select(order.alias("o")), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("int")
    def below(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_left(cuts, k))

    spread = rules.withColumn("range", F.explode(F.sequence(below(F.col("key")), below(F.concat("key", F.lit(TOP))))))
    nothing = F.lit(None)
    both = pages.select(below(order).alias("range"), "key", F.lit(PAGE).alias("kind"), "path", "id", "host", nothing.cast("string").alias("verdict")).unionByName(
        spread.select("range", "key", F.lit(RULE).alias("kind"), "path", nothing.cast(pages.schema["id"].dataType).alias("id"), "host", "verdict")
    )
    sorted_rows = both.repartition("range").sortWithinPartitions("range", "key", "kind")
    kind = pages.schema["id"].dataType.simpleString()
    return sorted_rows.mapInArrow(lambda batches: _sweep(batches, default), f"id {kind}, host string, path string, rule string, verdict string")


def op5(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    return filter_urls(pages, rules).withColumnRenamed("id", "page_id")


OP5_SQL = """
WITH parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
    SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM parts
), named AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
    SELECT n.page_id, n.host, n.path, r.rule_host || r.rule_path AS rule, coalesce(r.rule_verdict, 'allow') AS verdict,
           row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC NULLS LAST) AS place
    FROM named n LEFT JOIN rules r ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
)
SELECT page_id, host, path, rule, verdict FROM fits WHERE place = 1
"""
