import re
from collections import defaultdict

import numpy as np
import pytest

from gritstone.llm import jaccard_join as J
from gritstone.llm.components import connected_components
from tests.llm.fixtures import clashing, empty_documents, odd_documents


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for a, b in {(a, b) for held in holders.values() for a in held for b in held if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.op7(docs.sparkSession, docs).collect()}
    assert got == brute(rows)
    return got


def near_copies(seed, families, copies):
    """Families of edited copies, chained edits, and a passage that half of all texts share."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 3000))
    passage = " ".join(word() for _ in range(60))
    out = []
    for _ in range(families):
        base = [word() for _ in range(int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, copies))):
            if rng.random() < 0.7:
                base = list(base)
                base[int(rng.integers(0, len(base)))] = word()
            out.append(" ".join(base) + (" " + passage if rng.random() < 0.5 else ""))
    return [(int(k), t) for k, t in enumerate(rng.permutation(np.array(out, object)))]


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_tables(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet").repartition(3), "empty": lambda: empty_documents(spark)}[which]()
    got = check(docs)
    assert which != "sf" or len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("group", [256, 3])
def test_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(J, "GROUP_MEMBERS", group)
    monkeypatch.setattr(J, "BUCKET_SHINGLES", 500)
    docs = spark.createDataFrame(near_copies(group, 60, 12), "doc_id bigint, text string").repartition(4)
    got = check(docs)
    assert len({c for _, c in got.values()}) < len(got)


def test_frequent_shingles_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT_TEXTS", 3)
    check(spark.createDataFrame(near_copies(9, 40, 10), "doc_id bigint, text string").repartition(5))


def test_matrix_links_what_groups_missed(spark):
    """The matrix alone must connect classes that share no group."""
    rows = near_copies(4, 30, 8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = J.signatures(docs, 5).where("n_shingles > 0")
    from pyspark.sql import functions as F

    alone = J._candidates(docs, signed, 5, 80, "text").withColumn("component", F.col("class")).withColumn("group", F.xxhash64("class"))
    parts = {r["node"]: r["component"] for r in connected_components(J._matrix_links(alone, 80)).collect()}
    first = {}
    for r in signed.collect():
        first.setdefault(parts.get(r["class"], r["class"]), []).append(r["id"])
    got = {d: min(ids) for ids in first.values() for d in ids}
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_keys_give_the_same_links(spark, monkeypatch):
    """Every key is hot, every token's groups are cut into chunks, every shingle met twice is frequent."""
    from gritstone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    for name, value in {"GROUP_MEMBERS": 2, "CHUNK_GROUPS": 2, "FREQUENT_TEXTS": 1, "COUNTERS": 64, "BUCKET_SHINGLES": 700}.items():
        monkeypatch.setattr(J, name, value)
    check(spark.createDataFrame(near_copies(21, 25, 8), "doc_id bigint, text string").repartition(4))


@pytest.mark.parametrize("counters", [1, 16, 4096, 1 << 21])
def test_shingles_that_share_a_counter_are_not_taken_for_frequent(spark, monkeypatch, counters):
    """One task meets a long common passage often; pairs at exactly 80 % are split over two tasks."""
    monkeypatch.setattr(J, "COUNTERS", counters)
    rng = np.random.default_rng(3)
    word = lambda: "v" + str(rng.integers(0, 10**9))
    passage = " ".join(word() for _ in range(3000))
    left, right = [f"{word()} {passage}" for _ in range(100)], []
    for _ in range(600):
        words = [word() for _ in range(13)]  # 9 shingles each, 8 of them in both: 8 of 10
        left.append(" ".join(words))
        right.append(" ".join([*words[:-1], word()]))
    rows = list(enumerate(left + right))
    halves = [spark.createDataFrame(part, "doc_id bigint, text string").coalesce(1) for part in (rows[: len(left)], rows[len(left) :])]
    got = {r["doc_id"]: r["component_id"] for r in J.op7(spark, halves[0].union(halves[1])).collect()}
    assert all(got[len(left) + k] == 100 + k for k in range(600))
    assert {got[k] for k in range(100)} == {0}


def test_counters_never_count_too_much():
    """What a counter has counted is at most what came, and a shingle above the limit has crossed it before."""
    rng, limit = np.random.default_rng(8), 5
    for counters in (1, 3, 50):
        frequent, came, marked = J.Frequent(counters), {}, set()
        for _ in range(400):
            shingles, size = np.unique(rng.zipf(1.4, rng.integers(1, 30)) % 200 + 1, return_counts=True)
            for x, n, before in zip(shingles.tolist(), size.tolist(), frequent.met(shingles.astype(np.uint64), size).tolist()):
                assert before <= came.get(x, 0)
                if before > limit:
                    assert x in marked
                elif before >= 0 and before + n > limit:
                    marked.add(x)
                came[x] = came.get(x, 0) + n
    assert marked


def test_one_document_of_each_group_stays(spark):
    """Repeated rows, repeated and null ids, wordless texts, and columns named as the operator's own."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, a, 0), (1, a, 1), (1, b, 2), (2, a, 3), (2, "solo", 4), (3, b, 5), (None, "solo", 6), (None, "x y z", 7), (None, "x y z", 8), (5, None, 9), (5, None, 10), (None, "", 11)]
    docs = spark.createDataFrame([(*r, "p", "q", "r") for r in rows], "doc_id int, text string, class int, key string, __first string, first string").repartition(3)
    kept = J.distinct_documents(docs)
    assert kept.schema == docs.schema
    held = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert held == sorted([(False, 1, a), (False, 1, b), (False, 2, "solo"), (True, 0, "x y z"), (False, 5, ""), (False, 5, ""), (True, 0, "")])


@pytest.mark.parametrize("buckets", [1, 3, 255, 257, 65537, 1 << 24])
def test_keys_keep_all_bits(buckets):
    from gritstone.llm.common import key_width, packed_keys, unpacked_keys

    hashes = np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False)
    hashes[:2] = 0, (1 << 64) - 1
    width = key_width(buckets)
    rest = unpacked_keys(packed_keys(hashes // np.uint64(buckets), width), width)
    assert np.array_equal(rest * np.uint64(buckets) + hashes % np.uint64(buckets), hashes)
