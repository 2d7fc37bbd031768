import re

import numpy as np
import pyarrow as pa
import pytest

from gritstone.llm import decontamination as D
from tests.llm.fixtures import clashing, empty_documents, odd_documents


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def distance(item, words):
    """Least word edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for k, x in enumerate(item):
        new = [k + 1]
        for j, w in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def brute(docs, items, ratio=0.2):
    """Texts without a word pair of an item have lost every pair, so more than a fifth of its words."""
    out = {}
    for k, text in items:
        item = words_of(text)
        if len(item) < 5:
            out |= {(d, k): 0 for d, t in docs if item and any(words[j : j + len(item)] == item for words in [words_of(t)] for j in range(len(words)))}
            continue
        edits = int(ratio * len(item) + 1e-9)
        pairs = set(zip(item, item[1:]))
        for d, t in docs:
            words = words_of(t)
            if sum(p in pairs for p in zip(words, words[1:])) >= max(1, len(item) - 1 - 2 * edits) and (n := distance(item, words)) <= edits:
                out[d, k] = n
    return out


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def planted(n, seed):
    """Texts with edited items (0 to 30 % of the words) at random places."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(int(rng.zipf(1.3)) % 3000)
    items = [(k, " ".join(word() for _ in range(int(rng.integers(5, 60))))) for k in range(25)]
    docs = []
    for d in range(n):
        item = items[int(rng.integers(25))][1].split()
        for _ in range(int(rng.integers(0, max(2, 0.3 * len(item))))):
            at = int(rng.integers(len(item))) if item else 0
            item[at : at + int(rng.integers(0, 2))] = [word()] * int(rng.integers(0, 2))
        before, after = ([word() for _ in range(int(rng.integers(0, 80)))] for _ in range(2))
        docs.append((d, " ".join([*before, *item, *after])))
    return docs, items


def test_edited_items_reach_the_recall(spark):
    docs, items = planted(600, 1)
    want = brute(docs, items)
    found = D.find_leaks(clashing(spark.createDataFrame(docs, "doc_id bigint, text string")), spark.createDataFrame(items, "item_id bigint, text string"), block_items=10).collect()
    got = {(r["id"], r["item_id"]): r["distance"] for r in found}
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want) > 250
    held, text = dict(docs), dict(items)
    for r in found:
        assert distance(words_of(text[r["item_id"]]), words_of(held[r["id"]][r["start"] : r["end"]])) <= r["distance"]


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_tables(spark, sf, which):
    docs = {"odd": lambda: odd_documents(spark), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet"), "empty": lambda: empty_documents(spark)}[which]()
    items = spark.read.parquet(f"{sf}/benchmark.parquet") if which != "odd" else spark.createDataFrame([(1, "word word word word word"), (2, None), (3, ""), (4, "one two three four five six"), (5, "SOLO"), (6, "two three"), (7, "two three"), (8, "three four five six"), (9, "five six seven")], "item_id smallint, text string")
    want = brute(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.op9(docs, items).collect()}
    assert got == want and (want or which == "empty")
    kept = D.clean_documents(clashing(docs), items).select("doc_id", "text")
    assert sorted(r[0] for r in kept.collect()) == sorted(d for d, _ in rows(docs, "doc_id", "text") if d not in {k for k, _ in want})


def test_no_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_leaks(docs, items).count() == 0 and D.clean_documents(docs, items).count() == docs.count()


def test_few_edits_keep_most_of_a_walk():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    rows, n = D.padded_rows([words, np.delete(words, 30)])
    shares = [np.not_equal(*D.walks(rows, n, np.full(2, s), 180)).mean() for s in range(50)]
    assert np.median(shares) < 0.2 < (rows[0] != rows[1]).mean()


def test_edit_distances_match_plain_ones():
    rng = np.random.default_rng(4)
    items, regions = rng.integers(0, 4, (200, 7)).astype(np.uint64), rng.integers(0, 4, (200, 15)).astype(np.uint64)
    got, _ = D.edit_distances(items, regions)
    assert got.tolist() == [distance(i.tolist(), r.tolist()) for i, r in zip(items, regions)]


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string"])
def test_item_ids_keep_their_type(spark, kind):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (None, "x y"), (None, "x y")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "b c d e f"), (2, "x y"), (3, "y")], "item_id int, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    found = D.find_leaks(docs, items)
    assert dict(found.dtypes)["item_id"] == kind
    assert sorted((r["id"] or 0, int(r["item_id"]), r["start"], r["end"]) for r in found.collect()) == [(0, 2, 0, 3), (0, 3, 2, 3), (1, 1, 2, 11)]


def test_lengths_that_miss_the_recall_are_searched_whole(spark, monkeypatch):
    docs, items = planted(120, 2)
    want = brute(docs, items)
    monkeypatch.setattr(D, "MAX_REPEATS", 8)
    classes, _, _ = D.item_classes([t for _, t in items], 0.2, 1.0)
    assert {own.repeats for own in classes} & {0}
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), recall=1.0).collect()
    assert {(r["id"], r["item_id"]): r["distance"] for r in found} == want


def test_too_many_edits_are_an_error():
    with pytest.raises(ValueError):
        D.item_classes(["a b c d e"], 0.5, 0.9)


def test_what_is_broadcast_follows_the_items_words():
    import pickle

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(5, 200)))) for _ in range(1000)]
    held = D.item_classes(texts, 0.2, 0.99)
    assert len(pickle.dumps(D.Searcher(*held), protocol=4)) < 120 * sum(len(t.split()) for t in texts)


def test_a_very_long_item(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 4_000)]
    item = " ".join(words[:1500])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2")], "doc_id int, text string")
    assert [tuple(r)[:3] for r in D.find_leaks(docs, spark.createDataFrame([(4, item)], "item_id int, text string")).collect()] == [(1, 4, 0)]
