import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from gritstone.llm import pii, repetition
from tests.llm import test_decontamination, test_jaccard, test_repetition
from tests.llm.fixtures import clashing, empty_documents, odd_documents
from tests.llm.test_tokens import BYTE, library

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(rows, items):
    """The stages one by one over plain tuples (doc_id, text)."""
    good = []
    for d, text in rows:
        counts = repetition.verdicts(pa.array([text or ""], pa.large_string()), 8, 0.4, 100)
        assert bool(counts["base_failed"][0]) == test_repetition.base(text)[5]
        if counts["kept"][0]:
            good.append((d, text))
    first = {d for d, (_, c) in test_jaccard.brute(good).items() if c == d}
    apart = [x for x in good if x[0] in first]
    leaks = {d for d, _ in test_decontamination.brute(apart, items)}
    clean = [x for x in apart if x[0] not in leaks]
    field = pii.trained_field()
    return {d: pii.masked_text(text, pii.all_spans(field, pa.array([text], pa.large_string()))[1][0]) for d, text in clean}


def test_run_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want, whole = brute(docs, items), library(BYTE)
    assert 0 < len(want) < len(docs)
    got = {}
    for r in C.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"])))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in got.items()} == {d: np.array([*whole(t), 2], "<u4").tobytes() for d, t in want.items()}


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_stages_keep_columns(spark, sf, make):
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, clashing(make(spark)), sf)
        assert out.columns[:5] == COLUMNS, name
        assert out.schema == clashing(make(spark)).schema, name
        out.collect()
    C.STAGES[-1][1](spark, clashing(make(spark)), sf).collect()


def test_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is C.run
