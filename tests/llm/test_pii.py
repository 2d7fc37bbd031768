import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from gritstone.llm import pii as P
from gritstone.llm.pii_examples import KINDS, labelled_examples
from tests.llm.fixtures import SCHEMA, clashing, empty_documents, odd_documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) for d in digits[-1::-2]] + [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_match_plain_ones():
    rng = np.random.default_rng(8)
    parts = ["a", "b.", "@", "@a.b", "x@y.zz", ".", "..", "1", "12", "1.2.3.4", "300.1.1.1", "255.0.00255.1", "4111 1111 1111 1111", "4111-1111-1111-111", "+1 (555) 555-1234", "+", "-", " ", "(", "é", "_", "%", "@@", "a@b-.c", "0" * 30]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        assert P.pattern_spans(text) == plain_spans(text), text


def test_viterbi_and_gradient_against_all_labellings():
    from itertools import product

    field, rng = P.ChainField(), np.random.default_rng(2)
    features = rng.integers(0, 50, (3, 3, P.N_FEATURES))
    field.states[:50], field.steps[:] = rng.normal(size=(50, len(P.LABELS))) * 0.4, rng.normal(size=field.steps.shape)
    scores, steps = field._scores(features)
    value = lambda s, y: steps[0, y[0]] + steps[y[-1], 0] + sum(steps[a, b] for a, b in zip(y, y[1:])) + sum(s[t, b] for t, b in enumerate(y))
    every = list(product(range(len(P.LABELS)), repeat=3))
    for s, got in zip(scores, field.decode(features).tolist()):
        assert tuple(got) == max(every, key=lambda y: value(s, y))
    labels = np.array([[0, 1, 2], [0, 0, 3], [5, 0, 0]])
    likelihood, states, moves = field.gradient(features, labels)
    want = sum(value(s, tuple(y)) - np.logaddexp.reduce([value(s, z) for z in every]) for s, y in zip(scores, labels.tolist()))
    assert likelihood == pytest.approx(want)
    for held, grad, at in ((field.states, states, (int(features[0, 0, 0]), 1)), (field.steps, moves, (1, 2)), (field.steps, moves, (0, 0))):
        held[at] += 1e-5
        assert (field.gradient(features, labels)[0] - likelihood) / 1e-5 == pytest.approx(grad[at], abs=1e-3)
        held[at] -= 1e-5


def test_held_out_examples():
    rows = labelled_examples(400, 99)
    _, got = P.all_spans(P.trained_field(), pa.array([t for t, _ in rows], pa.large_string()))
    right = sum(sorted(a) == sorted(b) for a, (_, b) in zip(got, rows))
    assert right > 0.88 * len(rows)


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_tables(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet"), "empty": lambda: empty_documents(spark)}[which]()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = P.op3(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in base) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    assert which != "sf" or any(r["spans"] for r in got)


def test_masked(spark):
    text = "Écris à jo@ex.org ou\n(555) 555-1234, card 4111111111111111!!"
    docs = spark.createDataFrame([(1, text, "fr", "s", len(text)), (2, None, None, None, None), (3, "nothing 12 here", "en", "s", 15)], SCHEMA)
    got = {r["doc_id"]: r for r in P.masked(docs).collect()}
    assert got[1]["text"] == "Écris à <EMAIL> ou\n<PHONE>, card <CARD>!!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "nothing 12 here" and got[3]["n_chars"] == 15


def test_masked_needs_no_length_column(spark):
    docs = spark.createDataFrame([(1, "write to ann@example.org now", 5), (1, "write to ann@example.org now", 5), (None, None, None), (3, "", 0)], "doc_id int, text string, size int")
    out = P.masked(docs)
    assert out.schema == docs.schema
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "write to <EMAIL> now", 5)] * 2 + [(None, None, None), (3, "", 0)]))
    sized = P.masked(docs, length_col="size").where("doc_id = 1").first()
    assert sized["size"] == len("write to <EMAIL> now")
