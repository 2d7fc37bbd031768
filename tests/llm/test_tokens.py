import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gritstone.llm import packing, token_files
from gritstone.llm.common import scratch_path
from gritstone.llm.tokens import PieceTokenizer
from tests.llm.fixtures import clashing, empty_documents, odd_documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path):
    rng, whole, own = np.random.default_rng(3), library(path), PieceTokenizer(path)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", " \n", "'s", "'", "1", "12", ".", ",", "!!", " ", "\t", "x́", "İ", "漢字", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "E", "re", "ª", "́", "\x1f", " "]
    for n in rng.integers(0, 12, 3000):
        text = "".join(rng.choice(parts, n))
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == whole(text), repr(text)


def expected(rows, path):
    whole, start, out = library(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*whole(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_token_files_read_back(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet").repartition(3), "empty": lambda: empty_documents(spark)}[which]()
    got = sorted(tuple(r)[:4] for r in token_files.op1(spark, docs, WORD).collect())
    assert got == expected(rows_of(docs), WORD)


def test_sequences_and_masks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    directory = scratch_path(spark, "test")
    index = token_files.write_token_files(docs, directory, WORD, sequence_length=128).collect()
    total, shards = 0, {r["shard"] for r in index}
    for k in shards:
        reader = token_files.ShardReader(directory, k)
        rows = sum(b.num_rows for b in reader.batches)
        tokens = sum(r["n_tokens"] for r in index if r["shard"] == k)
        assert rows == -(-tokens // 128)
        for row in range(rows):
            ids, mask = reader.sequence(row)
            assert len(ids) == len(mask) == 128
            assert np.array_equal(np.concatenate(list(reader.tokens(row * 128, 128))), ids)
            total += sum(mask.to_pylist())
        assert all(not x for x in mask.to_pylist()[(tokens - 1) % 128 + 1 :])
    assert total == sum(r["n_tokens"] for r in index)


def test_shards_end_where_they_are_full(spark, sf, monkeypatch, tmp_path):
    """Small shards give the same documents, each whole within one, and no shard goes on beyond the document that fills it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = lambda df: sorted((r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())
    token_files.write_token_files(docs, f"file://{tmp_path}/large", WORD, sequence_length=128)
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 1000)
    index = token_files.write_token_files(docs, f"file://{tmp_path}/small", WORD, sequence_length=128).collect()
    assert rows(token_files.read_documents(spark, f"file://{tmp_path}/small")) == rows(token_files.read_documents(spark, f"file://{tmp_path}/large"))
    last = {}
    for r in sorted(index, key=lambda r: (r["shard"], r["position"])):
        assert r["position"] < 1000
        last[r["shard"]] = r["position"] + r["n_tokens"]
    assert len(last) > 20
    by_task = {}
    for k in sorted(last):
        by_task.setdefault(k // token_files.SHARDS_PER_TASK, []).append(last[k])
    assert all(n >= 1000 for held in by_task.values() for n in held[:-1])


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_packing_is_whole_and_tight(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet").repartition(3), "empty": lambda: empty_documents(spark)}[which]()
    got = packing.pack_documents(docs, BYTE).collect()
    whole = library(BYTE)
    want = {d: np.array([*whole(t), 2], "<u4") for d, t in rows_of(docs)}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for d, ids in want.items():
        found = sorted(pieces[d])
        assert [p[0] for p in found] == list(range(-(-len(ids) // 1024)))
        assert b"".join(p[3] for p in found) == ids.tobytes()
        assert [p[1] for p in found] == [sum(q[2] for q in found[:k]) for k in range(len(found))]
        assert all(p[2] == 1024 for p in found[1:])
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(map(len, want.values())) // 1024) * 1.02 + 1


def test_plan_uses_exact_complements():
    plan = packing.plan_sequences({1000: 3, 24: 1, 12: 4, 8: 3, 4: 1, 512: 3}, 1024)
    used = defaultdict(int)
    for parts, times in plan:
        assert sum(parts) <= 1024
        for x in parts:
            used[x] += times
    assert used == {1000: 3, 24: 1, 12: 4, 8: 3, 4: 1, 512: 3}
    assert sum(t for p, t in plan) == 5


def test_tightest_plan_is_whole_and_no_longer_than_others():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 1025), 200, replace=False), rng.integers(1, 6, 200))}
        used, plan = defaultdict(int), packing.tightest_plan(dict(counts), 1024)
        for parts, times in plan:
            assert sum(parts) <= 1024
            for x in parts:
                used[x] += times
        assert used == counts
        sizes = [sum(t for _, t in packing.plan_sequences(dict(counts), 1024, most)) for most in (1, 2, 3)]
        assert sum(t for _, t in plan) == min(sizes)


@pytest.mark.parametrize("which", ["balanced", "thirds", "dense", "sparse"])
def test_plan_leaves_no_exact_complement(which):
    rng = np.random.default_rng(12)
    ends = {k: 1 for k in range(1, 7)} | {424 - k: 1 for k in range(1, 7)}
    counts = {
        "balanced": ends | {600: 50, 200: 44, 224: 44, 300: 50},
        "thirds": {k: 1 for k in range(1, 20)} | {341: 40, 342: 20, 400: 30},
        "dense": {k: int(n) for k, n in enumerate(rng.integers(1, 40, 1023), 1)},
        "sparse": {int(k): int(n) for k, n in zip(rng.choice(np.arange(150, 1000), 90, replace=False), rng.integers(1, 500, 90))},
    }[which]
    used, rest = defaultdict(int), defaultdict(int)
    plan = packing.plan_sequences(dict(counts), 1024)
    for parts, times in plan:
        assert sum(parts) <= 1024 and times > 0
        for x in parts:
            used[x] += times
            if sum(parts) < 1024 or len(parts) > 4:
                rest[x] += times
    assert used == counts
    fits = lambda parts: all(parts.count(x) <= rest[x] for x in parts)
    pairs = [(a, b) for a in rest for b in rest if a <= b and fits((a, b))]
    by_sum = defaultdict(list)
    for p in pairs:
        by_sum[sum(p)].append(p)
    assert not any(a == 1024 or rest.get(1024 - a) and fits((a, 1024 - a)) for a in list(rest))
    assert not any(rest.get(c := 1024 - sum(p), 0) and fits((*p, c)) for p in pairs)
    assert not any(fits((*p, *q)) for p in pairs for q in by_sum.get(1024 - sum(p), ()))
    if which == "balanced":
        assert sum(t for _, t in plan) == 67


def test_white_space_that_goes_through_the_library():
    """Every pair of spaces and line ends and every other white space gives the library's ids, in texts of ASCII and beyond."""
    import numpy as np
    import public_tokenizers

    from gritstone.llm import tokens

    held = tokens.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(tokens._ODD_ASCII) < set(tokens._ODD_SPACE)  # an ASCII text is searched for these alone
    for gap in (*tokens._DOUBLE, *tokens._ODD_SPACE, " ", "\n"):
        for text in (f"one{gap}two words", f"été{gap}two", f"你{gap}好 x"):
            assert np.frombuffer(held.encode(text), held.dtype).tolist() == held.whole(text), repr(text)
