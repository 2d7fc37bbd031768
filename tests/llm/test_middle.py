import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from gritstone.llm import fill_in_middle as M
from tests.llm.fixtures import SCHEMA, clashing, empty_documents, odd_documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, percent=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return key, n, form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


def run(df, **options):
    return sorted((tuple(r) for r in M.fill_in_middle(df, **options).collect()), key=str)


def table(spark, rows):
    return clashing(spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)).repartition(3)


def texts(seed, n, longest=60):
    rng = random.Random(seed)
    signs = ["a", "ü", "\U0001f600", " ", "\n", "\t", "\x0b", " ", "\x00", "<", "P", ">", " "]
    return [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, longest)))) for k in range(n)]


def test_brute_force(spark):
    rows = texts(1, 400) + [(1000 + k, t) for k, t in enumerate(("", " ", "\n \t", "x", " x", "x ", None, "a<P>b", "<S>", "<M", "<p> y z", "P>", "<<S >"))]
    for percent, spm in ((50, 80), (100, 0), (100, 100), (0, 50)):
        assert run(table(spark, rows), percent=percent, percent_spm=spm) == sorted((brute(k, t, percent, spm) for k, t in rows), key=str)


def test_texts_of_many_chunks(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(["wörd", " ", "  ", "\n", "x" * rng.randint(1, 9000)]) for _ in range(300))) for k in range(20)]
    rows += [(50, " " * 20000), (51, "y" * 20000), (52, "z " * 900000), (53, " q" * 4096), (54, "q " * 4096)]
    assert run(table(spark, rows), percent=100) == sorted((brute(k, t, 100) for k, t in rows), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunks_find_every_rank(chunk):
    held = [t.encode() for _, t in texts(3, 60)]
    chunks = M.Chunks(np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])]), chunk)
    for doc, raw in enumerate(held):
        tokens = TOKEN.findall(raw.decode())
        assert chunks.tokens[doc] == len(tokens)
        byte, chars = chunks.place(np.full(len(tokens) + 1, doc), np.arange(len(tokens) + 1))
        want = ["".join(tokens[:k]) for k in range(len(tokens) + 1)]
        assert (byte - chunks.bounds[doc]).tolist() == [len(w.encode()) for w in want] and chars.tolist() == [len(w) for w in want]


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_documents(spark).collect()] + [(None, "a b c d"), (None, "a b c d"), (4, "again and again"), (4, "again and again")]
    assert run(table(spark, rows)) == sorted((brute(k, t) for k, t in rows), key=str)
    assert run(empty_documents(spark)) == []
    with pytest.raises(ValueError):
        M.fill_in_middle(empty_documents(spark), percent=101)


def test_restored(spark):
    rows = texts(4, 300) + [(900, "ends <"), (901, "<P"), (902, "S> M>"), (903, "< < <")]
    for percent in (0, 100):
        held = M.fill_in_middle(table(spark, rows), percent=percent)
        got = held.select("id", M.restored(held["output"], held["form"]).alias("text")).collect()
        assert {r["id"]: r["text"] for r in got} == dict(rows)


def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, M.op13(spark.read.parquet(f"{sf}/documents.parquet")).collect())) == sorted(c.execute(M.OP13_SQL).fetchall())
