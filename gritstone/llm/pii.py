"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels words as outside, first or further word of an email address, IP address, card or phone number. It is
trained from a small labelled table (`pii_examples`) by maximum likelihood and decoded by Viterbi, in numpy batches of
segments of one length. Only a word with a digit or an at-sign, or one beside a bracketed "at" or "dot", may be labelled other than
outside; this splits a text's chain exactly into short segments between outside words, so long texts cost no more
than their suspicious words. Spans of the field that meet none of the patterns' spans are added to them.

The patterns are leftmost and non-overlapping per kind; each is matched in time linear in the text: an email is looked
for around its at-sign, and a number only from the start of its run of digits, where the leftmost match must begin.

Cases: a null or empty text has no spans; repeated rows are searched each; an empty table gives no rows; extra columns are left out
(`masked` keeps all columns, and a null text stays null).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, slices_with_texts
from gritstone.llm.pii_examples import KINDS, labelled_examples
from gritstone.llm.words import words_of

Span = tuple[str, int, int]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
FEATURES = 1 << 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def pattern_spans(text: str) -> list[Span]:
    """By kind in the order of KINDS, then by start."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


_MARK = re.compile(r"[(\[{<](?:at|dot)[)\]}>]", re.IGNORECASE)
_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+")
_SOFT = "\"'.,;:!?#$%&*|<>"


def shape(word: str, counted: bool) -> str:
    """Runs of digits and letters as one sign each, with a digit run's length if counted."""

    def sign(m: re.Match) -> str:
        run = m[0]
        if run[0] in "0123456789":
            return f"d{min(len(run), 20)}" if counted else "d"
        return "a" if "a" <= run[0] <= "z" else "A" if "A" <= run[0] <= "Z" else "u" if run.isalpha() else run[:3]

    return _RUNS.sub(sign, word)[:40]


def _number(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % FEATURES


@lru_cache(1 << 15)
def word_features(before: str, word: str, after: str) -> tuple[int, ...]:
    core = word.strip(_SOFT)
    digits = sum("0" <= c <= "9" for c in core)
    own = (f"s{shape(core, False)}", f"c{shape(core, True)}", f"n{min(digits, 20)}", f"l{min(len(core), 24)}", f"@{'@' in core}{bool(_MARK.search(core))}", f"f{core[:1] if not core[:1].isalnum() else ''}", f"h{digits > 0 and bool(re.fullmatch('[0-9a-fA-F]+', core))}{any(c.isalpha() for c in core)}", f"t{word[len(word.rstrip(_SOFT)) :][:2]}", f"e{word[:1] in _SOFT}", "bias")
    near = (f"p{shape(before.strip(_SOFT), True)}", f"q{shape(after.strip(_SOFT), True)}", f"b{shape(before.strip(_SOFT), False)}|{shape(core, False)}", f"a{shape(core, False)}|{shape(after.strip(_SOFT), False)}", f"w{before.lower() if before.isalpha() else ''}", f"m{bool(_MARK.search(before))}{bool(_MARK.search(after))}")
    return tuple(_number(f) for f in own + near)


N_FEATURES = len(word_features("", "", ""))


class ChainField:
    """Weights of a linear-chain field: features x labels, and label x label. A segment starts and ends outside."""

    def __init__(self):
        n = len(LABELS)
        self.states, self.steps = np.zeros((FEATURES, n)), np.zeros((n, n))
        self.barred = np.zeros((n, n))
        for b, after in enumerate(LABELS):
            for a, before in enumerate(LABELS):
                if after[0] == "I" and before[2:] != after[2:]:
                    self.barred[a, b] = -1e9

    def _scores(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per segment, word and label; features: segments x words x N_FEATURES."""
        return self.states[features].sum(2), self.steps + self.barred

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi over segments of one length: segments x words."""
        scores, steps = self._scores(features)
        n, length, _ = scores.shape
        best, back = scores[:, 0] + steps[0], np.zeros(scores.shape, np.int64)
        for t in range(1, length):
            paths = best[:, :, None] + steps
            back[:, t] = paths.argmax(1)
            best = paths.max(1) + scores[:, t]
        labels = np.zeros((n, length), np.int64)
        labels[:, -1] = (best + steps[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            labels[:, t - 1] = back[np.arange(n), t, labels[:, t]]
        return labels

    def gradient(self, features: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of segments of one length and its gradient: observed minus expected counts."""
        scores, steps = self._scores(features)
        n, length, k = scores.shape
        forward, backward = np.empty(scores.shape), np.empty(scores.shape)
        forward[:, 0] = scores[:, 0] + steps[0]
        for t in range(1, length):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1][:, :, None] + steps, 1) + scores[:, t]
        backward[:, -1] = steps[:, 0]
        for t in range(length - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(forward[:, -1] + backward[:, -1], 1)
        wrong = -np.exp(forward + backward - total[:, None, None])
        np.add.at(wrong, (np.arange(n)[:, None], np.arange(length), labels), 1)
        states, moves = np.zeros_like(self.states), np.zeros_like(self.steps)
        np.add.at(states, features.reshape(-1, features.shape[2]), wrong.reshape(-1, 1, k))
        moves[0] += wrong[:, 0].sum(0)
        moves[:, 0] += wrong[:, -1].sum(0)
        for t in range(1, length):
            pair = np.exp(forward[:, t - 1][:, :, None] + steps + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
            moves -= pair.sum(0)
            np.add.at(moves, (labels[:, t - 1], labels[:, t]), 1)
        edges = np.concatenate([np.zeros((n, 1), np.int64), labels, np.zeros((n, 1), np.int64)], 1)
        likelihood = sum(steps[edges[:, t], edges[:, t + 1]].sum() for t in range(length + 1)) + np.take_along_axis(scores, labels[:, :, None], 2).sum() - total.sum()
        return float(likelihood), states, moves


def segments(words: list[str]) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of words that may belong to a span."""
    may = [any("0" <= c <= "9" or c == "@" for c in w) for w in words]
    for k, w in enumerate(words):
        if _MARK.search(w):
            for j in range(max(0, k - 1), min(len(words), k + 2)):
                may[j] = True
    runs, first = [], None
    for k, x in enumerate([*may, False]):
        if x and first is None:
            first = k
        elif not x and first is not None:
            runs.append((first, k))
            first = None
    return runs


def segment_features(words: list[str], first: int, last: int) -> np.ndarray:
    get = lambda k: words[k] if 0 <= k < len(words) else ""
    return np.array([word_features(get(k - 1), words[k], get(k + 1)) for k in range(first, last)])


def _label(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    out = []
    for start, end in words:
        kind = next(((k, s) for k, s, e in spans if s < end and start < e), None)
        out.append(0 if kind is None else LABELS.index(("B-" if start <= kind[1] else "I-") + kind[0]))
    return out


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(2)
def trained_field(rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> ChainField:
    """Maximum likelihood with a quadratic penalty, by Adam over the labelled table."""
    field, by_length = ChainField(), defaultdict(lambda: ([], []))
    for text, spans in labelled_examples():
        places = [m.span() for m in _WORD.finditer(text)]
        words, labels = [text[a:b] for a, b in places], _label(places, spans)
        for first, last in segments(words):
            held = by_length[last - first]
            held[0].append(segment_features(words, first, last))
            held[1].append(labels[first:last])
    data = [(np.stack(f), np.array(y)) for f, y in by_length.values()]
    weights = [field.states, field.steps]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, rounds + 1):
        total = [-decay * w for w in weights]
        for f, y in data:
            _, *parts = field.gradient(f, y)
            total = [a + b for a, b in zip(total, parts, strict=True)]
        for w, g, a, b in zip(weights, total, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return field


_EDGE = "\"'.,;:!?#$%&*|<>()[]{}"
_DIGITS = {"ip": (4, 40), "card": (13, 19), "phone": (9, 15)}


def _trimmed(kind: str, start: int, end: int, text: str) -> Span | None:
    held = text[start:end]
    end -= len(held) - len(held.rstrip(_EDGE))
    start += len(held) - len(held.lstrip(_EDGE.replace("(", "") if kind == "phone" else _EDGE))
    if kind in _DIGITS:
        low, high = _DIGITS[kind]
        if not low <= sum("0" <= c <= "9" for c in text[start:end]) <= high:
            return None
    return (kind, start, end) if start < end else None


def field_spans(field: ChainField, found: list[tuple[str, list[tuple[int, int]], list[tuple[int, int]]]]) -> list[list[Span]]:
    """Spans per text; found: text, places of the words around its segments, and the segments as ranges of those."""
    by_length, out = defaultdict(list), [[] for _ in found]
    for k, (text, places, runs) in enumerate(found):
        words = [text[a:b] for a, b in places]
        for first, last in runs:
            by_length[last - first].append((k, first, segment_features(words, first, last)))
    for length, held in by_length.items():
        rows = max(1, 20_000 // length)
        for part in range(0, len(held), rows):
            chosen = held[part : part + rows]
            for (k, first, _), labels in zip(chosen, field.decode(np.stack([x[2] for x in chosen])).tolist(), strict=True):
                text, places, _ = found[k]
                at = 0
                while at < length:
                    kind, stop = LABELS[labels[at]], at + 1
                    if kind != "O":
                        while stop < length and LABELS[labels[stop]] == f"I-{kind[2:]}":
                            stop += 1
                        if span := _trimmed(kind[2:], places[first + at][0], places[first + stop - 1][1], text):
                            out[k].append(span)
                    at = stop
    return out


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"0123456789@")] = True


def _suspicious(texts: pa.Array) -> list[tuple[int, str, list[tuple[int, int]], list[tuple[int, int]]]]:
    """(text number, text, word places, segments) of the texts that may hold a span; places only near the segments."""
    words = words_of(texts)
    sums = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SIGNS[words.data], out=sums[1:])
    may = sums[words.end] > sums[words.start]
    hits = np.zeros(len(texts), bool)
    hits[words.doc[may]] = True
    out = []
    by_doc = np.searchsorted(words.start, words.offsets)
    for k, value in enumerate(texts):
        raw = value.as_py() if hits[k] or by_doc[k] < by_doc[k + 1] else ""
        marked = ("at" in (low := raw.lower()) or "dot" in low) and list(_MARK.finditer(raw)) if "(" in raw or "[" in raw or "{" in raw or "<" in raw else []
        if not hits[k] and not marked:
            continue
        first = by_doc[k]
        near = np.zeros(by_doc[k + 1] - first, bool)
        near[np.flatnonzero(may[first : by_doc[k + 1]])] = True
        base = words.offsets[k]
        start, end = words.start[first : by_doc[k + 1]] - base, words.end[first : by_doc[k + 1]] - base
        if len(raw) == words.offsets[k + 1] - base:
            points = lambda x: x
        else:
            leads = np.zeros(int(words.offsets[k + 1] - base) + 1, np.int64)
            np.cumsum((words.data[base : words.offsets[k + 1]] & 0xC0) != 0x80, out=leads[1:])
            points = lambda x, leads=leads: leads[x]
        start, end = points(start), points(end)
        for m in marked or []:
            at = int(np.searchsorted(start, m.start(), "right")) - 1
            near[max(0, at - 1) : at + 2] = True
        wide = near.copy()
        wide[:-1] |= near[1:]
        wide[1:] |= near[:-1]
        index = np.flatnonzero(wide)
        places = list(zip(start[index].tolist(), end[index].tolist(), strict=True))
        inside = near[index]
        runs, at = [], 0
        while at < len(index):
            if not inside[at]:
                at += 1
                continue
            stop = at + 1
            while stop < len(index) and inside[stop] and index[stop] == index[stop - 1] + 1:
                stop += 1
            runs.append((at, stop))
            at = stop
        out.append((k, raw, places, runs))
    return out


def all_spans(field: ChainField, texts: pa.Array) -> tuple[list[list[Span]], list[list[Span]]]:
    """Per text the patterns' spans and all spans, each by kind, then start."""
    base, every = [[] for _ in texts], [[] for _ in texts]
    found = _suspicious(texts)
    for (k, text, *_), added in zip(found, field_spans(field, [x[1:] for x in found]), strict=True):
        base[k] = own = pattern_spans(text)
        taken = sorted((s, e) for _, s, e in own)
        extra = [x for x in added if not any(s < x[2] and x[1] < e for s, e in taken)]
        every[k] = sorted([*own, *extra], key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, every


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans: arrays of (kind, start, end) in code points, end exclusive. No shuffle."""
    field = docs.sparkSession.sparkContext.broadcast(trained_field())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices_with_texts(batches, "text"):
            base, every = all_spans(field.value, texts)
            yield pa.record_batch([batch.column(0), as_rows(base), as_rows(every)], names=["id", "base", "spans"])

    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, base {spans}, spans {spans}")


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the name of the first span's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced; all columns stay. A length column, if the table has it, is set anew where the text changed."""
    length_col = length_col if length_col in docs.columns else None
    field = docs.sparkSession.sparkContext.broadcast(trained_field())

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices_with_texts(batches, text_col):
            _, every = all_spans(field.value, texts)
            changed = {k: masked_text(texts[k].as_py(), spans) for k, spans in enumerate(every) if spans}
            if changed:
                new = {text_col: changed} | ({length_col: {k: len(t) for k, t in changed.items()}} if length_col else {})
                for name, values in new.items():
                    at = batch.schema.get_field_index(name)
                    held = batch.column(at).to_pylist()
                    for k, x in values.items():
                        held[k] = x
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(held, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(mask, docs.schema)


def op3(docs: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = find_personal_data(docs)
    is_kind = lambda kind: lambda x: x["kind"] == kind
    counts = (F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
