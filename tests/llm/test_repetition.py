import re

import numpy as np
import pyarrow as pa
import pytest

from gritstone.llm import repetition as R
from gritstone.llm.words import words_of
from tests.llm.fixtures import clashing, empty_documents, odd_documents


def longest_repeats(words):
    n, out = len(words), {}
    for i in range(n):
        most = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            most = max(most, k)
        if most >= 3:
            out[i] = most
    return out


def test_suffix_array_finds_the_longest_repeats():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), n)) for n in rng.integers(0, 40, 300)] + ["a " * 50, "", "a b c a b c"]
    words = words_of(pa.array(texts, pa.large_string()))
    found = R.maximal_repeats(words.hashes(False), words.doc)
    got = [{} for _ in texts]
    for at, length in zip(found.at.tolist(), found.length.tolist(), strict=True):
        doc = words.doc[at]
        got[doc][at - int(words.bounds[doc])] = length
    assert got == [longest_repeats(t.split()) for t in texts]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = {}
    for k in range(n - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_base_counts(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet"), "empty": lambda: empty_documents(spark)}[which]()
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = R.op10(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(rows[r["doc_id"]]), r
        assert not (r["base_failed"] and r["kept"])


def test_verdict_follows_repeats(spark):
    plain = " ".join(f"w{k}" for k in range(300))
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(1, plain), (2, f"{plain} {passage} {plain.replace('w', 'v')} {passage}"), (3, f"{plain} w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (4, " ".join([plain[:700]] * 2))]
    got = {r["doc_id"]: (r["kept"], r["longest_repeat"]) for r in R.op10(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == (True, 0) and got[2] == (False, 120) and got[3] == (True, 10) and not got[4][0]


def verdict(text, min_words=8, max_covered=0.4, max_repeat=100):
    """Every pair of positions: how long what starts there is the same."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, most = len(words), [0] * len(words)
    same = [[0] * (n + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, i, -1):
            if words[i] == words[j]:
                same[i][j] = same[i + 1][j + 1] + 1
                most[i], most[j] = max(most[i], same[i][j]), max(most[j], same[i][j])
    covered = {i + k for i in range(n) if most[i] >= min_words for k in range(most[i])}
    longest = max((m for m in most if m >= 3), default=0)
    return len(covered), longest, not base(text)[-1] and len(covered) <= max_covered * n and longest <= max_repeat


@pytest.mark.parametrize("which", ["made", "sf"])
def test_whole_verdict_by_brute_force(spark, sf, which):
    if which == "made":
        rng, rows = np.random.default_rng(15), []
        for k in range(150):
            words = [f"w{x}" for x in rng.integers(0, 60 if k % 3 else 3000, rng.integers(40, 260))]
            for _ in range(int(rng.integers(0, 4))):
                a, n, b = int(rng.integers(0, len(words))), int(rng.integers(3, 130)), int(rng.integers(0, len(words)))
                words = words[:b] + words[a : a + n] + words[b:]
            rows.append((k, "".join(w + str(rng.choice([" ", "\n", "  "])) for w in words)))
    else:
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 6000").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    texts, kept = dict(rows), 0
    for r in R.op10(docs).collect():
        assert (r["covered_words"], r["longest_repeat"], r["kept"]) == verdict(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        kept += r["kept"]
    assert 0 < kept < len(rows)
    assert {r["doc_id"] for r in R.good_documents(docs).collect()} == {d for d, t in rows if verdict(t)[2]}
