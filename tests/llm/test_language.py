import zlib

import numpy as np
import pyarrow as pa
import pytest

from gritstone.llm import language_id as L
from tests.llm.fixtures import clashing, empty_documents, odd_documents


def test_grams_follow_the_texts():
    texts = ["", "ab", "Hello,  World", "é\0\0x", "12 34", "\U0001f600 abc"]
    grams, doc, has = L.text_grams(pa.array(texts, pa.large_string()))
    assert has.tolist() == [bool(any(c.isalpha() for c in t)) for t in texts]
    alone = [L.text_grams(pa.array([t], pa.large_string()))[0].tolist() for t in texts]
    assert [grams[doc == k].tolist() for k in range(len(texts))] == alone
    assert len(alone[2]) == len(" hello world ") - 3


def test_filters_return_all_languages_and_correct_counts():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, 20000, dtype=np.uint64) for _ in range(9)]
    sets[1][:5000] = sets[0][:5000]
    filters = L.BitSlicedFilters(sets)
    assert all((filters.masks(s) >> k & 1).all() for k, s in enumerate(sets))
    other = rng.integers(0, 1 << 63, 200000, dtype=np.uint64)
    assert np.abs(filters.counts(other, np.zeros(len(other), int), 1)).max() < 150
    assert abs(filters.counts(sets[0], np.zeros(20000, int), 1)[0, 1] - 5000) < 60


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_tables(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"), "empty": lambda: empty_documents(spark)}[which]()
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", "lang").collect()}
    got = L.op2(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    if which == "sf":
        held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
        assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held)


def grams(text):
    """Lower-case 4-grams, runs of other signs as one space, padded."""
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(out.split()) + " "
    return [padded[k : k + 4] for k in range(len(padded) - 3)]


def test_predictions_by_exact_sets(spark, sf):
    """Plain sets of each language's most frequent n-grams instead of filters: the same language wherever the lead is
    more than false positives could make up, and nearly the same score."""
    from collections import Counter

    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    counts = {}
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text or ""))
    top = {k: {g for g, _ in c.most_common(L.PROFILE)} for k, c in counts.items()}
    texts, close, gap = {d: t or "" for d, t, _ in rows}, 0, []
    for r in L.op2(spark, docs).collect():
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            continue
        found = {k: sum(g in held for g in grams(text)) for k, held in top.items()}
        first, second = sorted(found.values(), reverse=True)[:2]
        if first - second > 0.02 * len(grams(text)) + 2:
            assert r["lang_pred"] == max(found, key=found.get), (found, text[:60])
            gap.append(abs(r["score"] - first / sum(found.values())))
        else:
            close += 1
    assert close < 0.05 * len(rows) and np.mean(gap) < 0.01
