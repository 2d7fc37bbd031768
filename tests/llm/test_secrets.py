import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import secret_scan as S
from tests.llm.fixtures import clashing, empty_documents, odd_documents

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_patterns(spark):
    rng = np.random.default_rng(6)
    parts = ["token", "SECRET", "api_key", "apikey", "Password", "=", ":", " ", "'", '"', "abcdefgh", "ab12", "é", "\U0001f600", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef0123456789abcdef", "f", "Z", "\n", "-", "."]
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in S.op8(docs).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(filter(None, joined(want).split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_tables(spark, sf, which):
    docs = {"odd": lambda: clashing(odd_documents(spark)), "sf": lambda: spark.read.parquet(f"{sf}/documents.parquet"), "empty": lambda: empty_documents(spark)}[which]()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = S.op8(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(joined(plain_spans(texts[r["doc_id"]])).encode()).hexdigest()


def test_normal_tail(spark):
    from statistics import NormalDist

    z = [x / 7 for x in range(-30, 60)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", S.upper_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - (1 - NormalDist().cdf(r["z"]))) < 2e-7 for r in got)


def test_noise_is_uniform_and_words_are_not(spark):
    rng = np.random.default_rng(9)
    noise = [(name, "".join(rng.choice(list(alphabet), n))) for name, _, alphabet in S.ENCODINGS for n in rng.integers(24, 60, 400)]
    words = [("words", "".join(rng.choice(["the", "and", "tion", "ing", "er", "on", "re", "that"], 12))) for _ in range(300)]
    rows = spark.createDataFrame(noise + words, "name string, s string").select("name", S.battery(F.col("s"), S.encoding(F.col("s")))).collect()
    p = {name: np.array([r[1] for r in rows if r[0] == name]) for name in {r[0] for r in rows}}
    assert (p.pop("words") < 0.01).mean() > 0.95
    for name, held in p.items():
        assert 0.4 < (held > 0.5).mean() < 0.65 and (held < 0.05).mean() < 0.12, name


def test_planted_noise_is_found(spark):
    rng = np.random.default_rng(10)
    alphabet, words = list(S.ENCODINGS[6][2]), ["the", "and", "tion", "ing", "er", "on", "re", "that", "Of", "In"]
    rows, noise = [], set()
    for k in range(1200):
        value = "".join(rng.choice(alphabet, 30)) if k % 3 == 0 else "".join(rng.choice(words, 11))
        noise |= {k} if k % 3 == 0 else set()
        rows.append((k, f"some text {value} and more"))
    got = {r["doc_id"] for r in S.op8(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if "random" in r["spans"]}
    assert len(got & noise) > 0.85 * len(noise) and len(got - noise) < 0.1 * len(got)


def test_noise_in_thin_strata_is_accepted(spark):
    rng = np.random.default_rng(11)
    rows = [(f"n{n}-{i}:{k}", float(p)) for k in (4, 5, 8) for n in (1, 2, 4, 8, 32) for i in range(400 // n) for p in rng.random(n)]
    limits = {r["stratum"]: r["bin"] / S.BINS for r in S.thresholds(spark.createDataFrame(rows, "stratum string, p double"), 0.05).collect()}
    for k, share in ((4, 0.7), (5, 0.9), (8, 0.9)):
        for n in (1, 2, 4, 8, 32):
            held = [p >= limits.get(s, 2) for s, p in rows if s.startswith(f"n{n}-") and s.endswith(f":{k}")]
            assert np.mean(held) > share, (k, n, np.mean(held))


def test_words_in_thin_strata_are_not(spark):
    words = [("words:5", p / 1000) for p in range(40)] + [("short:4", p / 1000) for p in range(150)]
    # one string above the cut among so many words may well be a word
    crowd = [("crowd:4", 0.001)] * 300 + [("crowd:4", 0.35)]
    got = S.thresholds(spark.createDataFrame(words + crowd, "stratum string, p double"), 0.05).collect()
    assert not got


def test_one_random_string_is_found(spark):
    rng = np.random.default_rng(14)
    alphabet = list(S.ENCODINGS[6][2])
    found = 0
    # true noise falls below the cut once in twenty times
    for n in (32, 40, 70, 130):
        value = "".join(rng.choice(alphabet, n))
        docs = [(1, f"see {value} there"), (2, "plain text"), (3, "someCamelCaseNamesAreJoinedInThisVeryLongWord")]
        spans = {r["doc_id"]: r["spans"] for r in S.op8(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert not spans[2] and not spans[3]
        p = spark.createDataFrame([(value,)], "s string").select(S.battery(F.col("s"), S.encoding(F.col("s")))).first()[0]
        assert spans[1] == (f"random:4:{4 + n}" if p >= 0.05 else ""), p
        found += p >= 0.05
    assert found >= 3


def test_a_text_with_many_matches(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("0123456789abcdef"), int(rng.integers(30, 36)))) for _ in range(5000)]
    text = " é ".join(words)
    row = S.op8(spark.createDataFrame([(1, text), (1, text)], "doc_id int, text string")).collect()
    assert len(row) == 2 and row[0]["n_hex"] == len(plain_spans(text))
    assert all(r["base_sha256"] == hashlib.sha256(joined(plain_spans(text)).encode()).hexdigest() for r in row)


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoded(value):
    return next((name, alphabet) for name, pattern, alphabet in S.ENCODINGS if re.search(pattern, value))


def plain_battery(value):
    """The four tests by their definitions, and Fisher's combination."""
    name, alphabet = encoded(value)
    size, n = len(alphabet), len(value)
    squares = sum(value.count(c) ** 2 for c in set(value))
    p = [tail((squares * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    place = [alphabet.index(c) + 1 - (size + 1) / 2 for c in value]
    runs = 1 + sum((a < 0) != (b < 0) for a, b in zip(place, place[1:]))
    p.append(min(1, 2 * tail(abs((runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)))))
    p.append(min(1, 2 * tail(abs(sum(a * b for a, b in zip(place, place[1:])) / ((size * size - 1) / 12 * math.sqrt(n - 1))))))
    parts = [(sum(c in part for c in value), len(set(alphabet) & set(part))) for part in (S._DIGITS, S._LOWER, S._UPPER, "+/")]
    parts = [(o, k) for o, k in parts if k]
    if len(parts) > 1:
        x = sum((o - n * k / size) ** 2 * size / (n * k) for o, k in parts)
        p.append({2: lambda: min(1, 2 * tail(math.sqrt(x))), 3: lambda: math.exp(-x / 2), 4: lambda: min(1, 2 * tail(math.sqrt(x))) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)}[len(parts)]())
    x = -sum(math.log(max(v, 1e-300)) for v in p)
    return name, min(1, math.exp(-x) * sum(x**k / math.factorial(k) for k in range(len(p))))


def test_battery_by_its_definitions(spark):
    rng = np.random.default_rng(16)
    values = ["".join(rng.choice(list(alphabet), int(rng.integers(20, 200)))) for _, _, alphabet in S.ENCODINGS for _ in range(60)]
    values += ["internationalizationOfWords", "a" * 30, "0123456789" * 3, "ab" * 40, "Z" * 25, "some/path/to/a/file/name"]
    rows = spark.createDataFrame([(v,) for v in values], "s string").select("s", S.encoding(F.col("s"))["name"].alias("name"), S.battery(F.col("s"), S.encoding(F.col("s"))).alias("p")).collect()
    for r in rows:
        name, p = plain_battery(r["s"])
        assert r["name"] == name and math.isclose(r["p"], p, rel_tol=2e-3, abs_tol=2e-6), (r["s"], r["p"], p)


def test_thresholds_by_plain_counting(spark):
    """The least bin whose acceptance keeps the rate: by twice the strings above one half, or by the fixed tails."""
    rng = np.random.default_rng(17)
    rows = []
    for k in (4, 5, 6):
        for which, (noise, words) in enumerate(((500, 3000), (40, 900), (3, 50), (0, 400), (2000, 0), (300, 10))):
            p = np.concatenate([rng.random(noise), rng.random(words) ** 6 * 0.5])
            rows += [(f"s{which}:{k}", float(x)) for x in p]
    want = {}
    for stratum in {s for s, _ in rows}:
        bins = [min(int(p * S.BINS), S.BINS - 1) for s, p in rows if s == stratum]
        random = 2 * sum(b >= S.BINS // 2 for b in bins)
        own = []
        for b in sorted(set(bins)):
            accepted = sum(x >= b for x in bins)
            if b > 0 and random and 1 - min(random * (1 - b / S.BINS), accepted) / accepted <= 0.05:
                own.append(b)
        if random < S.FEW:
            k = min(int(stratum.split(":")[1]), max(S.TAILS))
            fixed = next((b for b, share in S.TAILS[k] if (sum(x < b for x in bins) + 1) * share <= 0.05 * sum(x >= b for x in bins)), None)
            own += [] if fixed is None else [fixed]
        if own:
            want[stratum] = min(own)
    got = {r["stratum"]: r["bin"] for r in S.thresholds(spark.createDataFrame(rows, "stratum string, p double"), 0.05).collect()}
    assert got == want and len(want) > 6


def test_tails_of_joined_words(spark):
    """What the fixed tails stand for: how often words joined in ten styles reach a p, by length; and why the least length is
    20 signs: below it words with digits behind them reach high values as noise does."""
    rng = np.random.default_rng(18)
    words = "the of and that was for are with his they have from word but what all were when your can said use each which their will other about many then them these some her would make like into time has look more write see number way could people first water been call find long down day did get come made may part over new sound take only little work know place year live request response handler buffer index value config user account session token manager service factory controller entwicklung gesellschaft versicherung werden haben durch nach ueber".split()
    join = {
        "lower": "".join, "camel": lambda w: w[0] + "".join(map(str.capitalize, w[1:])), "pascal": lambda w: "".join(map(str.capitalize, w)), "upper": lambda w: "".join(w).upper(), "snake": "_".join,
        "upper snake": lambda w: "_".join(w).upper(), "kebab": "-".join, "path": "/".join, "digits": lambda w: "".join(w) + str(rng.integers(0, 10000)), "camel digits": lambda w: w[0] + "".join(map(str.capitalize, w[1:])) + str(rng.integers(0, 1000)),
    }
    made = [(name, f([str(x) for x in rng.choice(words, int(rng.integers(2, 14)))]).translate(str.maketrans("-_", "+/"))) for name, f in join.items() for _ in range(2000)]
    rows = spark.createDataFrame(made, "style string, s string").repartition(4).select("style", F.length("s").alias("n"), S.battery(F.col("s"), S.encoding(F.col("s"))).alias("p")).collect()
    share = lambda low, high, p, styles=tuple(join): np.mean([r["p"] >= p for r in rows if low <= r["n"] <= high and r["style"] in styles])
    for k, (low, high) in ((4, (20, 31)), (5, (32, 63))):
        for cut, tail_share in S.TAILS[k]:
            assert share(low, high, cut / S.BINS) < 3 * tail_share + 0.005, (k, cut)
    assert share(16, 19, 0.2, ("digits",)) > 0.3 > 0.28 > share(20, 31, 0.2, ("digits",))
