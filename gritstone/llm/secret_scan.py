"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests. DataFrame functions only.

Candidates are runs of at least MIN_LENGTH characters of base-64 alphabets. The encoding of each is inferred from its characters,
and four tests ask whether it is uniform noise over that alphabet: chi-squared over its signs, chi-squared over its
classes (digits, lower and upper case), runs above and below the alphabet's middle, and serial correlation. Fisher's
method combines their p-values.

Random strings have uniform p-values, ordinary words have values near 0. Per encoding and length class (powers of two)
the number of random strings follows from how many p-values exceed 1/2, and with it the false-discovery rate of
accepting all above a threshold; the lowest threshold with a rate of at most `fdr` is used. Short strings tell words
and noise apart badly, which the counts of their own length class show, so they need a higher threshold. Few random
strings make a bad estimate, so where there are fewer than FEW of them, a fixed cut for the length class serves as well, if
so many of the strings below it as TAILS says, and one more, could pass it and still keep the rate. The counts
cover all documents: at most STRATA x BINS rows, of which the driver sees one threshold per stratum. No text is shuffled.

Cases: a null or empty text has no spans; repeated rows are judged each, and count each; an empty table gives no rows;
extra columns are left out; ties in start go by kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, written

KINDS = ("assign", "access", "hex", "random")
#: Fixed values of the task: the patterns.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "key")

MIN_LENGTH, BINS = 20, 100
#: Matches of one text that are added up together.
RUN = 200
#: Length class (the longest also for longer strings) -> (bin, share of joined words with at least that p), measured over
#: runs of 3 to 19 words in eight styles; of the longer runs none of 22,062 passed, which is put at one in a thousand.
FEW, TAILS = 256, {4: ((20, 0.032), (30, 0.017), (50, 0.0021)), 5: ((5, 0.001),)}
#: What hides base spans; a run of candidate signs that meets one holds it.
HIDDEN = "\x00"
CANDIDATE = f"[A-Za-z0-9+/_=\\x00-]{{{MIN_LENGTH},}}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern, alphabet, in the order in which they are tried.
ENCODINGS = (
    ("dec", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("b32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("b36", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("B36", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("b62", "^[A-Za-z0-9]+$", _DIGITS + _LOWER + _UPPER),
    ("b64", "", _DIGITS + _LOWER + _UPPER + "+/"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column, first: Column) -> Column:
    """Where each of some sizes starts: first, then first plus all before."""
    starts = F.aggregate(sizes, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.slice(starts, F.lit(1), F.size(sizes))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (start, end, value) of the leftmost matches; positions in code points, value of the group.

    What lies between the matches gives their places: a split at the pattern has one part before each match, and one
    after the last. Places are added up within runs of RUN matches and over the runs, so the work for a text with many
    matches is far from their square.
    """
    zero = F.lit(0).cast("bigint")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.split(text, pattern, -1), hits, lambda part, hit: F.struct(F.length(part).cast("bigint").alias("before"), F.coalesce(F.length(hit).cast("bigint"), zero).alias("length")))
    runs = let(sizes, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: F.slice(x, k * RUN + 1, F.lit(RUN))))
    taken = lambda x: x["before"] + x["length"]

    def spans(runs: Column) -> Column:
        firsts = _running(F.transform(runs, lambda run: F.aggregate(run, zero, lambda acc, x: acc + taken(x))), zero)
        starts = F.flatten(F.zip_with(runs, firsts, lambda run, first: _running(F.transform(run, taken), first)))
        placed = F.zip_with(starts, F.flatten(runs), lambda at, x: F.struct((at + x["before"]).alias("start"), (at + taken(x)).alias("end")))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.zip_with(F.slice(placed, F.lit(1), F.size(values)), values, lambda x, value: F.struct(x["start"].alias("start"), x["end"].alias("end"), value.alias("value")))

    return let(runs, spans)


def _where(found: Column, matched: Column) -> Column:
    """The matches where a cheap test says that there may be any."""
    return F.when(matched, found).otherwise(F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, value: string>>)"))


def _kind(name: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), x["end"].alias("end")))


def _names_secret(text: Column) -> Column:
    lower, named = F.lower(text), F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lower, F.lit(word))
    return named


def base_spans(text: Column) -> Column:
    """array of (start, kind number, end) of the patterns, in that order.

    Runs of hex digits and of access-key signs are maximal, so asking for their least length in the pattern drops
    the same matches as a test afterwards. That is not so for assignments, where a short value hides what it spans.
    """
    assign = F.filter(_where(matches(text, ASSIGN, 2), _names_secret(text)), lambda x: F.length(x["value"]) >= 8)
    access = _where(matches(text, ACCESS), F.contains(text, F.lit("AKIA")))
    hexes = _where(matches(text, HEX), text.rlike("[0-9a-f]{32}"))
    return F.array_sort(F.concat(_kind("assign", assign), _kind("access", access), _kind("hex", hexes)))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the polynomial of Abramowitz and Stegun 26.2.17 (error below 1e-7)."""

    def tail(z: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        one = F.exp(-z * z / 2) * 0.3989422804014327 * let(1 / (1 + 0.2316419 * F.abs(z)), poly)
        return F.greatest(F.when(z >= 0, one).otherwise(1 - one), F.lit(1e-300))

    return let(z, tail)


def two_sided(z: Column) -> Column:
    return F.least(2 * upper_tail(F.abs(z)), F.lit(1.0))


def encoding(value: Column) -> Column:
    """(name, alphabet, signs in it that are digits, lower case, upper case, others)."""
    chosen = None
    for name, pattern, alphabet in ENCODINGS:
        sizes = [len(set(alphabet) & set(part)) for part in (_DIGITS, _LOWER, _UPPER, "+/")]
        held = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.array(*(F.lit(float(k)) for k in sizes)).alias("sizes"))
        chosen = F.when(value.rlike(pattern), held) if chosen is None else chosen.when(value.rlike(pattern), held) if pattern else chosen.otherwise(held)
    return chosen


def _classes(value: Column, sizes: Column, size: Column, n: Column) -> Column:
    """p-value of how digits, cases and others share the string; null if the alphabet has one class."""
    seen = F.array(*(n - F.length(F.translate(value, signs, "")) for signs in (_DIGITS, _LOWER, _UPPER, "+/")))
    parts = F.zip_with(seen, sizes, lambda o, k: F.when(k > 0, (o - n * k / size) * (o - n * k / size) * size / (n * k)).otherwise(0.0))
    spread = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    kinds = F.size(F.filter(sizes, lambda k: k > 0))
    tail = lambda x: (
        F.when(kinds == 2, two_sided(F.sqrt(x))).when(kinds == 3, F.exp(-x / 2)).when(kinds == 4, two_sided(F.sqrt(x)) + F.sqrt(x) * 0.7978845608028654 * F.exp(-x / 2))
    )
    return F.when(kinds > 1, let(spread, lambda x: F.greatest(tail(x), F.lit(1e-300))))


def battery(value: Column, code: Column) -> Column:
    """The combined p-value that a string is uniform noise over its encoding's alphabet."""
    alphabet, sizes = code["alphabet"], code["sizes"]
    size, n = F.length(alphabet).cast("double"), F.length(value).cast("double")
    chars = F.split(value, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(value, c, F.lit(""))), F.lit(2.0)))
    # Pearson's statistic by its exact mean and variance under equal chances
    signs = upper_tail((squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
    places = F.transform(chars, lambda c: F.instr(alphabet, c) - (size + 1) / 2)
    halves = F.array_join(F.transform(places, lambda x: F.when(x < 0, "0").otherwise("1")), "")
    runs = two_sided((F.length(F.regexp_replace(halves, "0+|1+", "x")) - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    products = let(places, lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.length(value)), lambda a, b: F.coalesce(a * b, F.lit(0.0))))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    serial = two_sided(total / ((size * size - 1) / 12 * F.sqrt(n - 1)))

    def fisher(tests: Column) -> Column:
        x = tests["x"]
        # chi-squared tails of six and eight degrees of freedom
        return F.least(F.exp(-x) * (1 + x + x * x / 2 + F.when(tests["classes"].isNull(), 0.0).otherwise(x * x * x / 6)), F.lit(1.0))

    classes = _classes(value, sizes, size, n)
    return let(
        F.struct(signs.alias("signs"), runs.alias("runs"), serial.alias("serial"), classes.alias("classes")),
        lambda t: let(F.struct((-(F.log(t["signs"]) + F.log(t["runs"]) + F.log(t["serial"]) + F.log(F.coalesce(t["classes"], F.lit(1.0))))).alias("x"), t["classes"].alias("classes")), fisher),
    )


def hidden(text: Column) -> Column:
    """The text with its base spans hidden, sign for sign; a span of one kind that meets another's may stay in part."""

    def cover(pattern: str, long_enough: Callable[[Column], Column]) -> Callable[[Column], Column]:
        piece = lambda part, hit: F.concat(part, F.coalesce(F.when(long_enough(hit), F.repeat(F.lit(HIDDEN), F.length(hit))).otherwise(hit), F.lit("")))
        return lambda x: F.array_join(F.zip_with(F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), piece), "")

    out = F.translate(text, HIDDEN, " ")
    assign = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    for found, pattern, test in ((_names_secret(text), ASSIGN, assign), (F.contains(text, F.lit("AKIA")), ACCESS, lambda hit: F.lit(True)), (text.rlike("[0-9a-f]{32}"), HEX, lambda hit: F.lit(True))):
        out = F.when(found, let(out, cover(pattern, test))).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """array of (start, end, stratum, p) of the candidate strings that meet no base span."""
    found = _where(let(hidden(text), lambda x: matches(x, CANDIDATE)), text.rlike(f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH}}}"))
    free = F.filter(found, lambda x: ~F.contains(x["value"], F.lit(HIDDEN)))
    named = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(F.translate(x["value"], "-_", "+/"), "=+", "").alias("value")))
    coded = F.transform(F.filter(named, lambda x: F.length(x["value"]) >= MIN_LENGTH), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), encoding(x["value"]).alias("code")))
    stratum = lambda x: F.concat_ws(":", x["code"]["name"], F.floor(F.log2(F.length(x["value"]))))
    return F.transform(coded, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum(x).alias("stratum"), battery(x["value"], x["code"]).alias("p")))


def thresholds(strings: DataFrame, fdr: float) -> DataFrame:
    """stratum, least bin of p whose acceptance keeps the false-discovery rate by its own counts or, if few, by TAILS; strings: stratum, p."""
    counted = strings.groupBy("stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("stratum")
    above = own.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    random = 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(own)
    accepted = counted.select("stratum", "bin", F.sum("n").over(above).alias("accepted"), random.alias("random"))
    rate = 1 - F.least(F.col("random") * (1 - F.col("bin") / BINS), F.col("accepted")) / F.col("accepted")
    own_cut = accepted.where((rate <= fdr) & (F.col("random") > 0) & (F.col("bin") > 0)).select("stratum", "bin")
    least = lambda bin: F.sum(F.when(F.col("bin") >= bin, F.col("n")).otherwise(0))
    bins = sorted({bin for held in TAILS.values() for bin, _ in held})
    totals = counted.groupBy("stratum").agg((2 * least(BINS // 2)).alias("random"), F.sum("n").alias("total"), *(least(bin).alias(f"from{bin}") for bin in bins))
    keeps = lambda bin, tail: (F.col("total") - F.col(f"from{bin}") + 1) * tail <= fdr * F.col(f"from{bin}")
    length_class = F.least(F.element_at(F.split("stratum", ":"), -1).cast("int"), F.lit(max(TAILS)))
    fixed = F.coalesce(*(F.when((length_class == k) & keeps(bin, tail), F.lit(bin).cast("bigint")) for k, held in TAILS.items() for bin, tail in held))
    few_cut = totals.where(F.col("random") < FEW).select("stratum", fixed.alias("bin")).where("bin IS NOT NULL")
    return own_cut.union(few_cut).groupBy("stratum").agg(F.min("bin").alias("bin"))


def find_secrets(docs: DataFrame, *, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans: arrays of (start, kind number, end), in that order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = clipped(docs, id_col, text_col).toDF("id", "text").select("id", text.alias("text"), base_spans(text).alias("base"))
    judged, _ = written(rows.select("id", "base", candidates(F.col("text")).alias("strings")), "secrets")
    least = thresholds(judged.select(F.explode("strings").alias("x")).select("x.stratum", "x.p"), fdr).collect()
    limits = F.create_map(*(F.lit(v) for r in least for v in (r["stratum"], r["bin"] / BINS))) if least else F.expr("CAST(map() AS map<string, double>)")
    good = F.filter("strings", lambda x: F.coalesce(x["p"] >= F.try_element_at(limits, x["stratum"]), F.lit(False)))
    return judged.select("id", "base", F.array_sort(F.concat("base", _kind("random", good))).alias("spans"))


def op8(docs: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    is_kind = lambda k: lambda x: x["kind"] == k
    counts = (F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3]))
    return find_secrets(docs).select(F.col("id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
