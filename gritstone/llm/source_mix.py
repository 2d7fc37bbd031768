"""Mixing sources to target weights: whole repetitions, and one Bernoulli copy for the rest, with DataFrame functions only.

1. Words and rows are summed per source (partial sums before the shuffle).
2. Sources stand in the order of their names, null last, and weigh as a cycle of weights says or as a table gives them.
   A source's target is its weight's share of all words, at most `cap` times its own words; what the cap leaves goes to
   the others by weight. The share of a unit of weight is the root of sum(least(cap * size, weight * share)) = all words,
   found by Newton's method: each round is one aggregate over the sources, fixes every source that stands at its cap at
   the present share, and deals the rest anew; shares only rise, so the first round that fixes no more has the root.
3. A document's rate is target / words of its source. It is taken floor(rate) times, and once more if a number in [0, 1)
   from the SHA-256 of seed and id is below the rest of the rate. Runs agree, whatever the partitions.

Sources are joined to documents by name. Names that many documents have, of which there are few by count, are broadcast;
the others meet in a shuffle, so neither a hot source nor very many sources gather in a task or at the driver.

Cases: a null text has no words; a null source is a source, and weighs as the last; a source without words has target 0
and rate 0; a null id hashes as the word null; repeated rows and ids are separate documents that draw the same number; an
empty table gives no rows; extra columns stay in `mixed` and are left out of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.common import free_name, join_hot, written

#: Java's names for the characters that separate words: U+0020 and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]++[{SPACE}]*+"
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """How many words a text has; each becomes one letter, so no list of them is made."""
    letters = F.ltrim(F.regexp_replace(text, WORD, "x"), F.lit(SPACES))
    return F.coalesce(F.length(letters), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _named(source: Column) -> Column:
    """A join key that is never null and sorts as the names do, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _weighed(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """sources with `weight`: their place in the order of names, modulo the cycle's length, chooses it.

    Sources are sorted within ranges of names; a range goes on where those before it end, of which the driver sees sizes.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = written(sources.repartitionByRange(parts, "name").withColumn("range", F.spark_partition_id()), "sources")
    sizes = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())
    starts = sources.sparkSession.createDataFrame([(r, sum(n for _, n in sizes[:k])) for k, (r, _) in enumerate(sizes)], "range int, before bigint")
    ranged = ranged.join(F.broadcast(starts), "range")  # a row per range
    place = F.row_number().over(Window.partitionBy("range").orderBy("name")) - 1 + F.col("before")
    return ranged.withColumn("weight", F.get(F.array(*map(F.lit, cycle)), F.pmod(place, F.lit(len(cycle))).cast("int")).cast("bigint")).drop("range", "before")


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """sources (name, size, weight, ...) with `target`, a double."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total, rest, weights = sources.agg(F.sum(exact("size")), F.sum(exact("size")), F.sum(exact("weight"))).first()
    total, rest, weights, fixed = int(total or 0), int(rest or 0), int(weights or 0), -1
    while weights:
        capped = exact("size") * F.lit(cap * weights).cast("decimal(38,0)") <= exact("weight") * F.lit(rest).cast("decimal(38,0)")
        # at the root already where the round finds the sources that the last one found
        full, left, count = sources.agg(F.sum(F.when(capped, exact("size"))), F.sum(F.when(~capped, exact("weight"))), F.count(F.when(capped, 1))).first()
        if count == fixed:
            break
        fixed, rest, weights = count, total - cap * int(full or 0), int(left or 0)
    if not weights:  # without words every source stands at its cap of nothing
        return sources.withColumn("target", (F.col("size") * cap).cast("double"))
    capped = exact("size") * F.lit(cap * weights).cast("decimal(38,0)") <= exact("weight") * F.lit(rest).cast("decimal(38,0)")
    return sources.withColumn("target", F.when(capped, (F.col("size") * cap).cast("double")).otherwise(F.col("weight").cast("double") * float(rest) / float(weights)))


def _mixed(sized: DataFrame, cycle: tuple[int, ...], weights: DataFrame | None, cap: int, seed: int) -> DataFrame:
    """sized (key, name, size, any more) with source_size, target and copies."""
    sums = sized.groupBy("name").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    if weights is None:
        weighed, _ = written(_weighed(sums, cycle), "sources")
    else:
        given = weights.select(_named(weights["source"]).alias("name"), weights["weight"].cast("bigint").alias("weight"))
        weighed, _ = written(sums.join(given, "name", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0))), "sources")
    aimed = targets(weighed, cap).select("name", F.col("size").alias("source_size"), "target", "rows")
    total = aimed.agg(F.sum("rows")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    more = uniform(F.col("key"), seed) < F.col("rate") - F.floor("rate")
    joined = join_hot(sized, aimed, "name", "rows", total).withColumn("rate", rate)
    return joined.withColumn("copies", F.floor("rate").cast("bigint") + more.cast("bigint"))


def mixed(docs: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), weights: DataFrame | None = None, cap: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns and `copy`, counted from 0.

    weights (source, weight) replaces the cycle; a source that it doesn't name weighs nothing and is left out.
    """
    held = {c: free_name(docs, c) for c in ("key", "name", "size", "copy")}
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("key"), _named(docs[source_col]).alias("name"), word_count(docs[text_col]).alias("size"))
    taken = _mixed(rows, cycle, weights, cap, seed).where("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias(held["copy"]))


def mix_plan(docs: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), weights: DataFrame | None = None, cap: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target and copies of every document; words are counted once and written, without the texts."""
    rows = docs.select(docs[id_col].alias("key"), _named(docs[source_col]).alias("name"), word_count(docs[text_col]).alias("size"))
    sized, _ = written(rows, "sizes")
    return _mixed(sized, cycle, weights, cap, seed).select(F.col("key").alias("id"), "size", "source_size", "target", "copies")


def op11(docs: DataFrame) -> DataFrame:
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
-- sources from the one that reaches its cap first; one stays free where its share of what is left is below the cap
o AS (SELECT *, 3 * sum(size) OVER w - 3 * size AS before, sum(weight) OVER () - sum(weight) OVER w + weight AS weights, sum(size) OVER () AS total
      FROM s WINDOW w AS (ORDER BY size * 6 // weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, 3 * size * weights <= (total - before) * weight AS capped FROM o),
f AS (SELECT any_value(total) - coalesce(sum(3 * size) FILTER (WHERE capped), 0) AS rest, sum(weight) FILTER (WHERE NOT capped) AS weights FROM c),
t AS (SELECT source, size, CASE WHEN capped THEN (3 * size)::DOUBLE ELSE weight::DOUBLE * f.rest::DOUBLE / f.weights::DOUBLE END AS target FROM c, f),
r AS (SELECT d.doc_id, d.size, t.size::BIGINT AS source_size, target, CASE WHEN t.size > 0 THEN target / t.size::DOUBLE ELSE 0 END AS rate,
             ('0x' || sha256('11:' || doc_id)[1:13])::BIGINT::DOUBLE / 4503599627370496 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM r"""
