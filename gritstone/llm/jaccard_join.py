"""Exact Jaccard self-join on word shingles through a token-group matrix, down to connected components.

1. A signature per document: the number of its distinct shingles and a hash of their set. Equal sets form one class,
   and only classes are compared, so copies cost nothing further.
2. Which shingles are shared: every (shingle, class) goes to the bucket of its shingle, packed into binary columns; a
   bucket sends back those that two classes have. A class of n shingles can have a partner only if at least 80 % of n
   are shared, so all others are done. A shingle that a task has met often is known to be shared: beyond FREQUENT_TEXTS
   of its classes there, the task marks the shingle at its bucket and sends the other classes past it, so that no bucket
   gathers the holders of a very frequent one. Counters name the shingle they count, so what is sent past is marked.
3. Similar classes meet in groups by the least hash of their shared shingles (large groups are dealt into chunks) and
   are linked there; links make components.
4. The token-group matrix: a group is a chunk of one component, its row the union of the prefixes of its members. Two
   groups of different components that share a prefix shingle, with enough shingles left from there on, are a candidate pair; a pair is opened only if some
   member's overlap with the other group's token union reaches what a link needs, and one link is enough.

Shingles of unique classes come first in the order that prefixes use, the others follow from rare to frequent (by powers
of two of how many classes have them, the marked ones last), then by hash; any two sets that
reach the threshold share a shingle among the first n - ceil(0.8 n) + 1. Sets are compared by 64-bit hashes. The groups
that share a prefix shingle nevertheless are paired chunk by chunk, so that no task pairs all groups of one shingle.

Cases: null, empty or wordless texts have an empty set and are linked with nothing; fewer words than a shingle make one
shingle of them all; repeated rows and ids are separate documents of one class; an empty table gives no rows; extra
columns are left out; a null id takes part, and its component is the least id that is not null (null if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.llm.common import clipped, free_name, join_hot, key_width, packed_keys, slices_with_texts, text_slices, unpacked_keys, written
from gritstone.llm.components import connected_components
from gritstone.llm.words import GRAM_CODE, U, gram_hashes, mix, words_of

#: Shingles a bucket receives on average, and members of a group.
BUCKET_SHINGLES, GROUP_MEMBERS = 600_000, 128
REQUEST_BYTES = 2 << 20
#: Shingles of a class that follow each other in a request, and rows that may be broadcast.
RUN, BROADCAST_ROWS = 255, 100_000
#: A task's classes with one shingle that go to its bucket, per COUNTED shingles of the task, and its counters for them.
#: A shingle that loses its counter to others is not taken for frequent, which costs time but no link.
FREQUENT_TEXTS, COUNTED, COUNTERS = 32, 1 << 25, 1 << 21
#: How frequent a shingle is: a power of two of its classes, or MARKED.
MARKED = 255
#: Groups of one token that are paired in one task.
CHUNK_GROUPS = 1000


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least integer overlap that a set of n shingles needs with any partner: ceil(percent * n / 100)."""
    return (n * percent + 99) // 100


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, text after text: their hashes and bounds per text."""
    words = words_of(texts)
    hashes = words.hashes()
    shingles, at = gram_hashes(hashes, words.doc, width)
    doc = words.doc[at]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < width))
    if len(short):
        index = np.flatnonzero(np.isin(words.doc, short))
        place = index - words.bounds[words.doc[index]]
        total = np.zeros(len(words.per_doc), U)
        np.add.at(total, words.doc[index], hashes[index] * GRAM_CODE[place])
        shingles = np.concatenate([shingles, mix(total[short] + words.per_doc[short].astype(U))])
        doc = np.concatenate([doc, short])
    order = np.argsort(mix(shingles + doc.astype(U) * U(0xA24BAED4963EE407)))
    order = order[np.argsort(doc[order], kind="stable")]
    shingles, doc = shingles[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    shingles, doc = shingles[first], doc[first]
    return shingles, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_keys(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(shingles) + 1, U)
    np.cumsum(mix(shingles ^ U(0x8BB84B93962EACC9)), out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U)).view(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            shingles, bounds = shingle_sets(batch.column(1), width)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(bounds)), pa.array(set_keys(shingles, bounds))], names=["id", "n_shingles", "class"])

    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    return rows.mapInArrow(sign, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles bigint, class bigint")


class Frequent:
    """How often a task has met shingles: of those that share a counter the counter names one, found by majority vote."""

    def __init__(self, counters: int):
        self.owner, self.count = np.zeros(counters, U), np.zeros(counters, np.int64)

    def met(self, shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Count distinct shingles that are met `size` times each. Returns how often each was counted before; -1: unknown.

        A count never exceeds how often its shingle came since it last took its counter, starting from 0.
        """
        slot = (mix(shingles) % U(len(self.owner))).astype(np.int64)
        named = (self.owner[slot] == shingles) & (self.count[slot] > 0)
        before = np.where(named, self.count[slot], -1)
        order = np.lexsort((size, slot))
        first = _starts(slot[order])
        own, at = slot[order[first]], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        largest = order[np.append(first[1:], len(order)) - 1]
        left = self.count[own] + np.bincount(at, np.where(named, size, -size)[order]).astype(np.int64)
        taken = (left < 0) & ~named[largest]
        self.count[own] = np.where(taken, size[largest], np.maximum(left, 0))
        self.owner[own[taken]] = shingles[largest[taken]]
        before[largest[taken]] = 0
        return before


def _requests(docs: DataFrame, width: int, buckets: int, text_col: str) -> DataFrame:
    """bucket, known, classes and their counts, shingles; packed, shingles class after class.

    known is -1 in ordinary requests and -2 in those that mark shingles as frequent; else it is the bucket of shingles known
    to be shared, sent elsewhere. A class comes again after RUN of its shingles, so that a count takes one byte.
    """
    bytes_each = key_width(buckets)

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, frequent, counted = [], Frequent(COUNTERS), 0

        def emit(bucket, known, classes, doc, keys):
            starts = _starts(doc)
            ends = np.append(starts[1:], len(doc))
            if (ends - starts).max() > RUN:
                starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(starts, ends, strict=True)])
            counts = np.diff(np.append(starts, len(doc))).astype("u1")
            rows.append((bucket, known, classes[doc[starts]].tobytes(), counts.tobytes(), packed_keys(keys, bytes_each)))

        for batch in text_slices(batches, "text", REQUEST_BYTES):
            shingles, bounds = shingle_sets(batch.column(0), width)
            classes = set_keys(shingles, bounds)
            doc = np.repeat(np.arange(len(classes)), np.diff(bounds))
            once = np.zeros(len(classes), bool)
            once[np.unique(classes, return_index=True)[1]] = True
            shingles, doc = shingles[once[doc]], doc[once[doc]]
            if not len(doc):
                continue
            if counted > COUNTED:
                frequent, counted = Frequent(COUNTERS), 0
            counted += len(doc)
            order = np.argsort(shingles)
            first = _starts(shingles[order])
            size = np.diff(np.append(first, len(order)))
            before = frequent.met(shingles[order[first]], size)
            nth = np.empty(len(doc), np.int64)  # how often the task has met the shingle before; -1: it is not counted
            nth[order] = np.where(np.repeat(before, size) >= 0, np.repeat(before - first, size) + np.arange(len(order)), -1)
            bucket, rest = (shingles % U(buckets)).astype(np.int64), shingles // U(buckets)
            for known, at in ((-1, nth < FREQUENT_TEXTS), (-2, nth == FREQUENT_TEXTS), (None, nth > FREQUENT_TEXTS)):
                by = np.flatnonzero(at)
                by = by[np.argsort(bucket[by], kind="stable")]
                edges = np.append(_starts(bucket[by]), len(by))
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    at, own = by[a:b], int(bucket[by[a]])
                    if known is None:
                        emit(buckets + (int(classes[0]) + k) % buckets, own, classes, doc[at], rest[at])
                    else:
                        emit(own, known, classes, doc[at], rest[at])
            for at in range(0, len(rows), 256):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256], strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "known", "classes", "counts", "keys"])
            rows.clear()

    return docs.select(docs[text_col].alias("text")).mapInArrow(request, "bucket int, known int, classes binary, counts binary, keys binary")


def _arrays(table: pa.Table, **kinds: str) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()}


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _shared(requests: DataFrame, buckets: int) -> DataFrame:
    """What each bucket found to be shared by two classes or more, packed by the place that gathers a class."""
    bytes_each = key_width(buckets)

    def lookup(table: pa.Table) -> pa.Table:
        held = _arrays(table, classes="<i8", counts="u1")
        packed = table.column("keys").to_pylist()
        per_row = [len(x) // bytes_each for x in packed]
        known, bucket = (np.repeat(np.array(table.column(c).to_pylist(), np.int64), per_row) for c in ("known", "bucket"))
        cls = np.repeat(held["classes"], held["counts"])
        key = np.concatenate([unpacked_keys(x, bytes_each) for x in packed]) * U(buckets) + np.where(known >= 0, known, bucket).astype(U)
        sure, level = known >= 0, np.full(len(key), MARKED, np.uint8)
        asked = np.flatnonzero(~sure)
        if len(asked):
            asked = asked[np.argsort(key[asked])]
            first = _starts(key[asked])
            size = np.diff(np.append(first, len(asked)))
            marked = np.minimum.reduceat(known[asked], first) == -2
            two = marked | (np.minimum.reduceat(cls[asked], first) != np.maximum.reduceat(cls[asked], first))
            sure[asked] = np.repeat(two, size)
            level[asked] = np.repeat(np.where(marked, MARKED, np.log2(size)), size)
        key, cls, level = key[sure], cls[sure], level[sure]
        place = cls % buckets
        order = np.lexsort((cls, place))
        key, cls, place, level = key[order], cls[order], place[order], level[order]
        edges, rows = np.append(_starts(place), len(place)), []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first = _starts(cls[a:b])
            rows.append((int(place[a]), cls[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype("<u4").tobytes(), key[a:b].tobytes(), level[a:b].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["place", "classes", "counts", "shingles", "levels"])

    return requests.groupBy("bucket").applyInArrow(lookup, "place int, classes binary, counts binary, shingles binary, levels binary")


def _gathered(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """class, n, shingles (from rare to frequent) of the classes whose shared shingles are enough for a link; sizes: place, class, n."""

    def gather(table: pa.Table, sizes: pa.Table) -> pa.Table:
        held = _arrays(table, classes="<i8", counts="<u4", shingles="<u8", levels="u1")
        cls, key = np.repeat(held["classes"], held["counts"]), held["shingles"]
        order = np.lexsort((key, held["levels"], cls))
        cls, key = cls[order], key[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        cls, key = cls[once], key[once]
        sizes = sizes.sort_by("class")
        n = sizes.column("n").to_numpy()[np.searchsorted(sizes.column("class").to_numpy(), cls)] if len(cls) else np.zeros(0, np.int64)
        edges = np.append(_starts(cls), len(cls))
        chosen = [(int(cls[a]), int(n[a]), key[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a >= needed(n[a], percent)]
        columns = list(zip(*chosen, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["class", "n", "shingles"])

    return shared.groupBy("place").cogroup(sizes.groupBy("place")).applyInArrow(gather, "class bigint, n bigint, shingles binary")


def _links(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    if not percent * max(n_a, n_b) <= 100 * min(n_a, n_b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (n_a + n_b - both)


class _Cluster:
    """Linked members with the union of their tokens."""

    def __init__(self, member):
        self.members, self.union = [member], member[2]

    def opens(self, member, percent: int) -> bool:
        """Whether the overlap with the token union reaches what any link of the member needs."""
        return len(np.intersect1d(self.union, member[2], assume_unique=True)) >= needed(member[1], percent)

    def take(self, other: _Cluster) -> None:
        self.members += other.members
        self.union = np.union1d(self.union, other.union)


def link_within(members: list[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Each linked (class, n, shingles) of one group with the least class that links connect it to here, by token unions of
    what is connected so far. Stars instead of the links themselves, which may form long chains."""
    clusters: list[_Cluster] = []
    for member in members:
        met, apart = [], []
        for cluster in clusters:
            linked = cluster.opens(member, percent) and any(_links(m[2], m[1], member[2], member[1], percent) for m in reversed(cluster.members))
            (met if linked else apart).append(cluster)
        own = _Cluster(member)
        for cluster in met:
            cluster.take(own)
            own = cluster
        clusters = [*apart, own]
    for cluster in clusters:
        least = min(m[0] for m in cluster.members)
        yield from ((m[0], least) for m in cluster.members if m[0] != least)


def _group_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links within groups; rows: group, class, n, shingles, all rows of a group in one task and together."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def found():
            links = list(link_within(members, percent)) if len(members) > 1 else []
            return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for g, c, n, shingles in zip(*(batch.column(x).to_pylist() for x in ("group", "class", "n", "shingles")), strict=True):
                if g != group:
                    yield found()
                    group, members = g, []
                members.append((c, n, np.frombuffer(shingles, U)))
        yield found()

    return rows.select("group", "class", "n", "shingles").mapInArrow(link, "a bigint, b bigint")


def _candidates(docs: DataFrame, signed: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """class, n, shingles (those shared with any other class, from rare to frequent) of the classes that may have a partner."""
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // BUCKET_SHINGLES))
    sizes = signed.select("class", F.col("n_shingles").alias("n")).distinct().withColumn("place", F.pmod("class", F.lit(buckets)).cast("int"))
    return _gathered(_shared(_requests(docs, width, buckets, text_col).repartition(buckets, "bucket"), buckets), sizes, percent)


def jaccard_links(docs: DataFrame, signed: DataFrame, *, width: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """(a, b): edges between classes that connect exactly what Jaccard links connect.

    What the groups link comes as stars, from its components, so that those of the result take few rounds more.
    """
    spark = docs.sparkSession
    survivors, _ = written(_candidates(docs, signed, width, percent, text_col), "candidates")

    @F.pandas_udf("array<bigint>")
    def least_hashes(shingles):
        return shingles.map(lambda x: [int(mix(np.frombuffer(x, U) ^ U(salt)).min().view(np.int64)) for salt in (0x1F83D9AB, 0x5BE0CD19)])

    keyed = survivors.withColumn("least", F.explode(least_hashes("shingles")))
    large, _ = written(keyed.groupBy("least").agg(F.count("*").alias("held")).where(F.col("held") > GROUP_MEMBERS), "large-groups")
    if large.count() <= BROADCAST_ROWS:  # else shingles are shuffled once more
        large = F.broadcast(large)
    chunk = F.pmod(F.xxhash64("class", "least"), F.ceil(F.coalesce("held", F.lit(1)) / GROUP_MEMBERS))  # other chunks for either hash
    chunked = keyed.join(large, "least", "left").withColumn("group", F.xxhash64("least", chunk))
    near, _ = written(_group_links(chunked.repartition("group").sortWithinPartitions("group", "n", "class"), percent), "links")
    component = connected_components(near)

    placed = survivors.select("class").join(component.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    places, _ = written(placed, "places")
    members = places.groupBy("component").agg(F.count("*").alias("size")).withColumn("held", F.col("size"))
    chunk = F.pmod(F.xxhash64("class"), F.ceil(F.col("held") / GROUP_MEMBERS))
    named = join_hot(places, members, "component", "size", places.count()).select("class", "component", F.xxhash64("component", chunk).alias("group"))
    grouped, _ = written(survivors.join(named, "class"), "groups")
    return component.toDF("a", "b").union(_matrix_links(grouped, percent))


def _matrix_links(grouped: DataFrame, percent: int) -> DataFrame:
    """Links between groups of different components that share a prefix shingle."""

    @F.pandas_udf("array<bigint>")
    def prefix(shingles, n):
        def first(x, n):
            held = np.frombuffer(x, U)
            return held[: max(0, len(held) - int(needed(n, percent)) + 1)].view(np.int64).tolist()

        return shingles.combine(n, first)

    held = F.octet_length("shingles") / 8
    rows = grouped.select(F.posexplode(prefix("shingles", "n")).alias("at", "token"), "group", "component", "n", held.cast("bigint").alias("held"))
    # rest: the most shingles that a member has from here on; a pair's first common shingle bounds its overlap by them
    matrix = rows.groupBy("token", "group", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("held") - F.col("at")).alias("rest"))
    matrix, _ = written(matrix, "matrix")
    mixed = matrix.groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("size")).where("first <> last").select("token", "size", F.ceil(F.col("size") / CHUNK_GROUPS).alias("chunks"))
    matrix = join_hot(matrix, mixed, "token", "size", matrix.count()).withColumn("chunk", F.pmod(F.xxhash64("group"), F.col("chunks")))
    # a pair of groups meets in the cell of its chunks, the lower chunk to the left
    cells = (F.sequence(F.col("chunk"), F.col("chunks") - 1), F.sequence(F.lit(0).cast("bigint"), F.col("chunk")))
    left, right = (matrix.select("token", F.explode(other).alias("other"), *(F.col(c).alias(f"{c}_{k}") for c in ("chunk", "group", "component", "low", "high", "rest"))) for k, other in zip("ab", cells, strict=True))
    overlap = F.least("rest_a", "rest_b")
    meet = (left["token"] == right["token"]) & (left["other"] == F.col("chunk_b")) & (F.col("chunk_a") == right["other"])
    near = (F.col("component_a") != F.col("component_b")) & ((F.col("chunk_a") < F.col("chunk_b")) | (F.col("component_a") < F.col("component_b")))
    near = near & (F.col("low_a") * percent <= F.col("high_b") * 100) & (F.col("low_b") * percent <= F.col("high_a") * 100)
    near = near & (100 * overlap >= percent * (F.col("low_a") + F.col("low_b") - overlap))
    ends = F.least("group_a", "group_b").alias("group_a"), F.greatest("group_a", "group_b").alias("group_b")
    pairs, _ = written(left.join(right, meet).where(near).select(*ends).distinct(), "pairs")
    packed = grouped.join(pairs.select(F.col("group_a").alias("group")).union(pairs.select("group_b")).distinct(), "group", "left_semi").groupBy("group").agg(F.collect_list(F.struct("class", "n", "shingles")).alias("members"))

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                a, b = ([(m["class"], m["n"], np.frombuffer(m["shingles"], U)) for m in batch.column(c)[row].as_py()] for c in (0, 1))
                union = np.unique(np.concatenate([m[2] for m in b]))
                for x in a:
                    if len(np.intersect1d(union, x[2], assume_unique=True)) >= needed(x[1], percent) and (y := next((y for y in b if _links(x[2], x[1], y[2], y[1], percent)), None)):
                        links.append((x[0], y[0]))
                        break
            yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(packed.toDF("group_a", "members_a"), "group_a").join(packed.toDF("group_b", "members_b"), "group_b")
    return written(both.select("members_a", "members_b").mapInArrow(open_pairs, "a bigint, b bigint"), "links")[0]


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signatures, written, and (class, component, holders): a component is the least class that links reach."""
    signed, _ = written(signatures(docs, width, id_col, text_col), "signatures")
    component = connected_components(jaccard_links(docs, signed.where("n_shingles > 0"), width=width, percent=percent, text_col=text_col))
    classes = signed.where("n_shingles > 0").groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("holders"))
    placed = classes.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    return signed, written(placed, "classes")[0]


def near_duplicate_components(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component: the least id that links reach."""
    signed, placed = _labelled(docs, width, percent, id_col, text_col)
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = join_hot(placed, least, "component", "size", placed.count()).select("class", "component_id", "holders")
    found = join_hot(signed.where("n_shingles > 0"), named, "class", "holders", signed.count())
    alone = signed.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    return found.unionByName(alone).select("id", "n_shingles", F.col("component_id").alias("component"))


def distinct_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: of the rows with the least id (nulls last) one with the least class.

    Documents without words are linked with nothing, so all of them stay, repeated rows too. Where several rows have that
    id and class, any one stays.
    """
    signed, placed = _labelled(docs, width, percent, id_col, text_col)
    # a class's rows with its least id stand for it; of a component's classes one stands for all
    order = F.struct(F.col("least").isNull().alias("gone"), "least", "class")
    heads = placed.groupBy("component").agg(F.min(order).alias("head")).select(F.xxhash64("head.least", "head.class").alias("key"))
    number, key = free_name(docs, "class"), free_name(docs, "key")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their class, null where there are no words; of equal (id, class) in a slice only the first."""
        for batch, texts in slices_with_texts(batches, text_col):
            shingles, bounds = shingle_sets(texts, width)
            held = [c if n else None for c, n in zip(set_keys(shingles, bounds).tolist(), np.diff(bounds).tolist(), strict=True)]
            ids, seen, keep = batch.column(batch.schema.get_field_index(id_col)).to_pylist(), set(), []
            for k, pair in enumerate(zip(ids, held, strict=True)):
                if pair[1] is None or pair not in seen:
                    keep.append(k)
                    seen.add(pair)
            out = batch.append_column(number, pa.array(held, pa.int64()))
            yield out if len(keep) == out.num_rows else out.take(pa.array(keep, pa.int64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(number, T.LongType())])
    rows = docs.mapInArrow(sign, schema)
    flag = free_name(docs, "first")
    keyed = rows.withColumn(key, F.when(F.col(number).isNotNull(), F.xxhash64(id_col, number)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    met = keyed.join(heads.select(F.col("key").alias(key), F.lit(True).alias(flag)), key, "left")
    kept = met.where(F.col(number).isNull() | F.col(flag))
    repeated = signed.where("n_shingles > 0").groupBy("id", "class").agg(F.count("*").alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicate_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
