import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gritstone.llm import interpolated_lm as L
from tests.llm.fixtures import clashing, empty_documents, odd_documents


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    """Base scores by the formula, model scores from plain dictionaries and the same EM."""
    part = {d: zlib.crc32(str(d).encode()) % 7 for d, _ in rows}
    one, two, rest1, rest2 = Counter(), Counter(), Counter(), Counter()
    for d, text in rows:
        if part[d] != 2:
            t = tokens(text)
            one.update(t)
            two.update(zip([None, *t], t))
            if part[d] != 3:
                rest1.update(t)
                rest2.update(zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    held = Counter()
    for d, text in rows:
        if part[d] == 3:
            t = tokens(text)
            for h, w in zip([None, *t], t):
                c = np.array([rest1[h]])
                level = (L._context(c), L._level(np.array([rest2[h, w]]) / max(rest1[h], 1)), L._level(np.array([rest1[w]]) / max(1, sum(rest1.values()))))
                held[tuple(int(x[0]) for x in level)] += 1
    cols = [np.array(c, np.int64) for c in zip(*held)] or [np.zeros(0, np.int64)] * 3
    weights = L.learn_weights(*cols, np.array(list(held.values()), np.int64), 1 / (v + 1))
    out = {}
    for d, text in rows:
        t = tokens(text)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip([None, *t], t):
            a = weights[L._context(np.array([one[h]]))[0]]
            score += math.log10(a[0] * two[h, w] / max(one[h], 1) + a[1] * one[w] / max(n, 1) + a[2] / (v + 1))
        out[d] = (part[d] == 2, len(t), sum(one[w] > 0 for w in t), n, base, score)
    return out


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_scores(spark, sf, which, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 200_000)
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet").repartition(3), "empty": lambda: empty_documents(spark)}[which]()
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: tuple(r)[1:] for r in L.op6(spark, docs).collect()}
    assert got.keys() == want.keys()
    for d in got:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], rel=1e-9, abs=1e-9)
    if which == "sf":
        held = [x for x in got.values() if x[0]]
        assert sum(x[5] for x in held) > sum(x[4] for x in held)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    # a context whose bigram estimate is right 70 % of the time, else the unigram one
    right = rng.random(20000) < 0.7
    level2, level1 = np.where(right, 4, -1), np.where(right, 60, 16)
    w = L.learn_weights(np.full(20000, 5), level2, level1, np.ones(20000), 1e-9)
    assert abs(w[5, 0] - 0.7) < 0.02 and abs(w[5].sum() - 1) < 1e-9 and np.allclose(w[9], w[5])


def test_counts_beyond_32_bits(spark):
    """Two blocks with three billion of one word each, and a few of another."""
    from gritstone.llm.common import key_width, packed_keys

    keys = np.array([3, 9], np.uint64)
    schema = "bucket int, block bigint, kind int, words int, keys binary, counts binary"
    rows = [(0, block, kind, 2, packed_keys(keys, key_width(1)), np.array([3_000_000_000, 5], "<u4").tobytes()) for block, kind in ((1, L.REST), (2, L.FOLD), (3, L.HELD_OUT))]
    got = {r["block"]: r for r in L._answers(spark.createDataFrame(rows, schema), 1).collect()}
    assert (got[-1]["n"], got[-1]["n_fold"], got[-1]["v"]) == (6_000_000_010, 3_000_000_005, 2)
    for block in (1, 2, 3):
        assert L.unpacked_counts(got[block]["training"], 2).tolist() == [6_000_000_000, 10]
    assert L.unpacked_counts(got[2]["fold"], 2).tolist() == [3_000_000_000, 5]
    for held in ([], [0], [2**32 - 1], [2**32], [1, 2**40]):
        assert L.unpacked_counts(L.packed_counts(np.array(held, np.int64)), len(held)).tolist() == held
