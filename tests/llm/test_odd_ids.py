"""Repeated rows, repeated ids with other texts, and null ids: every row is a document of its own."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gritstone.llm import decontamination, fill_in_middle, interpolated_lm, jaccard_join, language_id, packing, pii, repetition, secret_scan, source_mix, token_files
from tests.llm.fixtures import SCHEMA, clashing

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
ROWS = [
    (1, f"{WORDS} one. mail a.b@c.de", "en", "a", None),
    (1, f"{WORDS} one. mail a.b@c.de", "en", "a", None),
    (1, "another text under the same number, with password = hunter2hunter2", "en", "b", 3),
    (None, f"{WORDS} two", "de", None, None),
    (None, f"{WORDS} two", "de", None, None),
    (None, None, None, None, None),
    (None, "", "en", "b", 0),
    (4, None, "en", "b", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA)).repartition(3)


def run(spark, docs, which):
    return {
        "op1": lambda: token_files.op1(spark, docs, public_tokenizers.path("word_bpe_49k.json")),
        "op2": lambda: language_id.op2(spark, docs),
        "op3": lambda: pii.op3(docs),
        "op4": lambda: packing.op4(spark, docs, public_tokenizers.path("byte_bpe_50k.json")),
        "op6": lambda: interpolated_lm.op6(spark, docs),
        "op7": lambda: jaccard_join.op7(spark, docs),
        "op8": lambda: secret_scan.op8(docs),
        "op10": lambda: repetition.op10(docs),
        "op11": lambda: source_mix.op11(docs),
        "op13": lambda: fill_in_middle.op13(docs),
    }[which]()


@pytest.mark.parametrize("which", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op10", "op11", "op13"])
def test_every_row_is_a_document(spark, docs, which):
    rows = run(spark, docs, which).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    if which in ("op2", "op3", "op6", "op8", "op10", "op11", "op13"):
        # equal rows have equal results
        held = Counter(tuple(r) for r in rows)
        assert max(n for r, n in held.items() if r[0] == 1) == 2 and max(n for r, n in held.items() if r[0] is None) >= 2
    if which == "op1":
        assert sorted(r["start"] for r in rows) == [sum(sorted_n) for sorted_n in ([x["n_tokens"] for x in sorted(rows, key=lambda x: x["start"])][:k] for k in range(len(rows)))]
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None] * 4 + [1] * 3 + [4]
    if which == "op7":
        assert {r["component_id"] for r in rows if r["doc_id"] == 1} == {1}


def test_leaks_are_found_under_any_id(spark, docs):
    items = spark.createDataFrame([(7, f"{WORDS} one"), (None, WORDS), (7, None)], "item_id bigint, text string")
    clean = decontamination.clean_documents(docs, items).select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter((r[0], r[1]) for r in ROWS if not (r[1] or "").startswith(WORDS))


def test_masks_and_rules_keep_every_row(spark, docs):
    assert pii.masked(docs).count() == len(ROWS)
    assert source_mix.mixed(docs).where(F.col("doc_id").isNull()).count() >= 2
    assert repetition.good_documents(docs).count() <= len(ROWS)
