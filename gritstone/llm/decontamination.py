"""Benchmark decontamination by edit distance over words, through CGK embeddings and bit-sampling LSH.

A benchmark item of n words leaks where a text holds a passage within floor(max_ratio * n) word edits of it. The CGK embedding
walks over a word sequence for 3n steps and, at each, repeats or passes the current word as a random function of step
and word says; a few edits then leave most of the walk the same, so edit distance becomes Hamming distance. LSH samples
positions of the walk and looks the sampled words up among the items'. Walks and samples are repeated as often as a
simulation of random edits on the items shows to be needed for the target recall; every candidate is then verified
by its exact edit distance, so nothing is reported that is no match. Where the recall is not reached in MAX_REPEATS,
all windows that pass the test below are verified against all items of that length. Items with no edits allowed need no
embedding: they are looked up whole.

Before that a lossless test skips almost all windows: of an item's n - 1 word pairs, e edits leave at least n - 1 - 2e,
so a window with fewer pairs of items of that length (each counted as often as one item has it) can't match. The items are the query set: they are taken in blocks of
`block_items` and about `block_words` words, which bounds what is broadcast, each block against all texts; no shuffle is needed but to keep one match per text and item.

Cases: null or empty texts and items match nothing; equal items are
reported each; repeated rows and ids are searched each, with one match per id and item; empty tables give no rows; extra columns
are left out (`clean_documents` keeps them); a max_ratio that may leave no word pair of an item (n - 1 - 2e < 1) is an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gritstone.llm.common import clipped, slices_with_texts
from gritstone.llm.words import GRAM_CODE, U, mix, words_of

SAMPLED = 3  # positions per LSH key
MAX_REPEATS = 400
TRIALS = 256
#: Numbers that one step of numpy work holds at a time.
CELLS = 1 << 22
_FILTER = 1 << 20


def walks(words: np.ndarray, n: np.ndarray, seeds: np.ndarray, steps: int) -> np.ndarray:
    """The first steps of the CGK embeddings of word sequences (rows of n words, then 0), each by its own seed."""
    padded = np.concatenate([words, np.zeros((len(words), 1), U)], 1)
    at, out = np.zeros(len(words), np.int64), np.empty((len(words), steps), U)
    every, own = np.arange(len(words)), mix(seeds.astype(U) + U(1))
    for j in range(steps):
        out[:, j] = now = padded[every, at]
        move = (mix(now ^ (own + mix(np.array([j], U)))) >> U(63)).astype(np.int64)
        at = np.minimum(at + move, n)
    return out


def lsh_keys(words: np.ndarray, n: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One LSH key per row: the words at a few random places of the 3n steps of its walk."""
    share = np.sort(np.random.default_rng(5).random((MAX_REPEATS, SAMPLED)), 1)
    picked = (share[seeds] * (3 * n)[:, None]).astype(np.int64)
    keys = np.empty(len(words), U)
    at_once = max(1, CELLS // (3 * max(words.shape[1], 1)))
    for part in range(0, len(words), at_once):
        rows = slice(part, part + at_once)
        walk = walks(words[rows], n[rows], seeds[rows], int(picked[rows].max()) + 1)
        held = np.take_along_axis(walk, picked[rows], 1)
        keys[rows] = mix((held * GRAM_CODE[:SAMPLED]).sum(1, dtype=U) + n[rows].astype(U) * GRAM_CODE[SAMPLED + 2] + seeds[rows].astype(U) * GRAM_CODE[SAMPLED + 3])
    return keys


def padded_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of one width, and their lengths."""
    n = np.array([len(x) for x in rows], np.int64)
    out = np.zeros((len(rows), int(n.max(initial=1))), U)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out, n


def edit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item (rows x n) to any stretch of its region (rows x m), and that stretch's end."""
    rows, m = regions.shape
    index = np.arange(m + 1)
    row = np.zeros((rows, m + 1), np.int64)
    for k in range(items.shape[1]):
        following = np.empty_like(row)
        following[:, 0] = k + 1
        following[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != items[:, k : k + 1]))
        row = np.minimum.accumulate(following - index, 1) + index
    end = row.argmin(1)
    return row[np.arange(rows), end], end


@dataclass
class ItemClass:
    """The items of one length; repeats is 0 where every window is to be verified."""

    n: int
    edits: int
    pairs: int
    words: np.ndarray
    which: np.ndarray
    repeats: int = 0


@dataclass
class PairIndex:
    """The word pairs of all items, and for each the item lengths that have it.

    An entry is a (pair, class): how often one of the class's items has the pair at most, and the offsets in an item at
    which it may be the first pair to survive. The size is in proportion to the items' words, not to pairs x classes.
    """

    pairs: np.ndarray
    bounds: np.ndarray  # pair -> its entries
    of_class: np.ndarray
    most: np.ndarray
    offset_bounds: np.ndarray  # entry -> its offsets
    offsets: np.ndarray


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The words after random edits, cut or padded to their number."""
    out = list(words)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out))) if out else 0
        if kind == 0 and out:
            del out[at]
        elif kind == 1:
            out.insert(at, U(rng.integers(1, 1 << 62)))
        elif out:
            out[at] = U(rng.integers(1, 1 << 62))
    out = (out + [U(k + 1) for k in range(len(words))])[: len(words)]
    return np.array(out, U)


def _band(edits: int) -> int:
    """Numbers of edits that share one simulation: each of the first, then steps of a quarter."""
    return edits if edits <= 16 else 16 + int(np.log(edits / 16) / np.log(1.25))


def _simulated_repeats(own: ItemClass, recall: float, rng: np.random.Generator) -> int:
    """Repeats after which the simulated share of items found after the most edits allowed reaches the recall, and half as
    many again, as so many trials leave the share uncertain; 0 if MAX_REPEATS don't reach it."""
    chosen = own.words[rng.integers(0, len(own.words), TRIALS)]
    both, n = padded_rows([*chosen, *(_edited(x, own.edits, rng) for x in chosen)])
    caught = np.zeros(TRIALS, bool)
    for seed in range(MAX_REPEATS):
        keys = lsh_keys(both, n, np.full(len(both), seed))
        caught |= keys[:TRIALS] == keys[TRIALS:]
        if seed >= 7 and caught.mean() >= recall:
            return min(MAX_REPEATS, (seed + 1) * 3 // 2)
    return 0


def _set_repeats(classes: list[ItemClass], recall: float, rng: np.random.Generator) -> None:
    """Simulate, per band of edits, the lengths with the largest share of edits, which need the most repeats."""
    bands = defaultdict(list)
    for own in classes:
        bands[_band(own.edits)].append(own)
    for band in bands.values():
        hardest = max(band, key=lambda own: (own.edits / own.n, own.n))
        repeats = _simulated_repeats(hardest, recall, rng)
        for own in band:
            own.repeats = repeats


def item_classes(texts: list[str | None], max_ratio: float, recall: float) -> tuple[list[ItemClass], dict[int, tuple[np.ndarray, np.ndarray]], PairIndex]:
    """Items by length, with as many LSH repetitions as the target recall needs; those without edits (per length the
    sorted hashes and their items); and the pairs of the former."""
    words = words_of(pa.array([t or "" for t in texts], pa.large_string()))
    hashes, by = words.hashes(), defaultdict(list)
    for k, n in enumerate(words.per_doc.tolist()):
        by[n].append(k)
    by.pop(0, None)
    classes, whole, rng = [], {}, np.random.default_rng(11)
    of_item = np.full(len(texts), -1)
    for n, which in sorted(by.items()):
        rows = np.stack([hashes[words.bounds[k] : words.bounds[k] + n] for k in which])
        edits = int(max_ratio * n + 1e-9)
        if not edits:
            keys = _whole_keys(rows)
            order = np.argsort(keys, kind="stable")
            whole[n] = keys[order], np.array(which)[order]
        elif n - 1 - 2 * edits < 1:
            raise ValueError(f"{edits} edits of {n} words may leave no word pair")
        else:
            of_item[which] = len(classes)
            classes.append(ItemClass(n, edits, n - 1 - 2 * edits, rows, np.array(which)))
    _set_repeats(classes, recall, rng)
    return classes, whole, _pair_index(words, hashes, classes, of_item)


def _whole_keys(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of words, in place of their sequence."""
    total = np.full(len(rows), rows.shape[1], U)
    for j in range(rows.shape[1]):
        total = mix(total * GRAM_CODE[j % len(GRAM_CODE)] + rows[:, j])
    return total


def _pair_index(words, hashes: np.ndarray, classes: list[ItemClass], of_item: np.ndarray) -> PairIndex:
    pairs = mix(hashes[:-1] * GRAM_CODE[0] + hashes[1:] * GRAM_CODE[1])
    within = np.flatnonzero((words.doc[:-1] == words.doc[1:]) & (of_item[words.doc[:-1]] >= 0)) if len(pairs) else np.zeros(0, np.int64)
    held, times = np.unique(np.stack([pairs[within], words.doc[within].astype(U)], 1), axis=0, return_counts=True)
    found, place = np.unique(held[:, 0], return_inverse=True)
    entry, at = np.unique(place * max(len(classes), 1) + of_item[held[:, 1].astype(np.int64)], return_inverse=True)
    most = np.zeros(len(entry), np.int64)
    np.maximum.at(most, at, times)
    firsts = []
    for c, own in enumerate(classes):
        span = min(2 * own.edits + 1, own.n - 1)
        at = (words.bounds[own.which][:, None] + np.arange(span)).ravel()
        code = np.searchsorted(found, pairs[at]) * len(classes) + c
        firsts.append(np.unique(np.stack([np.searchsorted(entry, code), np.tile(np.arange(span), len(own.which))], 1), axis=0))
    first = np.concatenate(firsts) if firsts else np.zeros((0, 2), np.int64)
    first = first[np.argsort(first[:, 0], kind="stable")]
    return PairIndex(found, np.searchsorted(entry, np.arange(len(found) + 1) * max(len(classes), 1)), entry % max(len(classes), 1), most, np.searchsorted(first[:, 0], np.arange(len(entry) + 1)), first[:, 1])


class Searcher:
    def __init__(self, classes: list[ItemClass], whole: dict[int, tuple[np.ndarray, np.ndarray]], index: PairIndex):
        self.classes, self.whole, self.index = classes, whole, index
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(index.pairs & U(_FILTER - 1)).astype(np.int64)] = True
        keys, items = [], []
        for own in classes:
            at_once = max(1, CELLS // (own.n * max(own.repeats, 1)))
            for part in range(0, len(own.words) if own.repeats else 0, at_once):
                rows = np.repeat(np.arange(part, min(part + at_once, len(own.words))), own.repeats)
                keys.append(lsh_keys(own.words[rows], np.full(len(rows), own.n), np.tile(np.arange(own.repeats), len(rows) // own.repeats)))
                items.append(rows)
        keys, items = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, U), (items, np.int64)))
        order = np.argsort(keys)
        self.keys, self.item = keys[order], items[order]

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end), positions in bytes; the best match of each text and item."""
        words = words_of(texts)
        hashes, doc, best = words.hashes(), words.doc, {}
        self._whole_matches(words, hashes, best)
        windows = self._windows(words, hashes, doc) if len(hashes) > 1 and len(self.index.pairs) else []
        for own, row, k in self._candidates(windows, words, hashes):
            self._verify(own, words, hashes, row, k, best)
        return [(d, k, *found) for (d, k), found in best.items()]

    def _whole_matches(self, words, hashes: np.ndarray, best: dict) -> None:
        """The items that allow no edit, where a text has all their words in turn."""
        for n, (keys, which) in self.whole.items():
            if len(hashes) < n:
                continue
            run = _whole_keys(np.lib.stride_tricks.sliding_window_view(hashes, n))
            low, high = (np.searchsorted(keys, run, side) for side in ("left", "right"))
            at = np.flatnonzero((high > low) & (words.doc[: len(run)] == words.doc[n - 1 :]))
            for a in at[np.unique(np.stack([words.doc[at], low[at]], 1), axis=0, return_index=True)[1]].tolist() if len(at) else ():
                d = int(words.doc[a])
                for k in which[low[a] : high[a]].tolist():
                    best[d, k] = (0, int(words.start[a] - words.offsets[d]), int(words.end[a + n - 1] - words.offsets[d]))

    def _windows(self, words, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[ItemClass, np.ndarray]]:
        """Per class the starts of windows that have as many of its pairs as a match must."""
        index = self.index
        pairs = mix(hashes[:-1] * GRAM_CODE[0] + hashes[1:] * GRAM_CODE[1])
        at = np.flatnonzero(self.maybe[(pairs & U(_FILTER - 1)).astype(np.int64)] & (doc[:-1] == doc[1:]))
        which = np.minimum(np.searchsorted(index.pairs, pairs[at]), len(index.pairs) - 1)
        real = index.pairs[which] == pairs[at]
        every, which = at[real], which[real]
        first, n = index.bounds[which], index.bounds[which + 1] - index.bounds[which]
        entries = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(index.of_class[entries], kind="stable")
        entries, every = entries[order], np.repeat(every, n)[order]
        edges, windows = np.searchsorted(index.of_class[entries], np.arange(len(self.classes) + 1)), []
        for c in np.flatnonzero(np.diff(edges)):
            own, entry, at = self.classes[c], entries[edges[c] : edges[c + 1]], every[edges[c] : edges[c + 1]]
            if len(at) < own.pairs:
                continue
            since = self._counts_since(doc[at], pairs[at], index.most[entry])
            # a pair counts for every start after its `since`, as far back as a passage with it may begin
            low = np.maximum(since, np.searchsorted(at, at - (own.n + own.edits - 2)))
            change = np.bincount(low, minlength=len(at) + 1) - np.bincount(np.arange(1, len(at) + 1), minlength=len(at) + 1)
            dense = np.cumsum(change[:-1]) >= own.pairs
            if dense.any() and len(starts := self._starts(words, at[dense], entry[dense])):
                windows.append((own, starts))
        return windows

    @staticmethod
    def _counts_since(doc: np.ndarray, pairs: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each pair found, the first of the pairs found from which on a window's count may include it: one in its own
        text, and after as many earlier occurrences of the same pair as an item can have."""
        n = len(doc)
        group = pairs + doc.astype(U) * U(0xA24BAED4963EE407)
        order = np.argsort(group, kind="stable")
        ordered = group[order]
        earlier = np.arange(n) - most[order]
        same = earlier >= 0
        same[same] = ordered[earlier[same]] == ordered[same]
        since = np.zeros(n, np.int64)
        since[order[same]] = order[earlier[same]] + 1
        return np.maximum(since, np.searchsorted(doc, doc))

    def _starts(self, words, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Windows begin where an item would that has the pair: if a pair is the first of a passage to survive, edits took
        at most 2e pairs before it, and the words from it on are in line with the item's."""
        first, n = self.index.offset_bounds[entry], self.index.offset_bounds[entry + 1] - self.index.offset_bounds[entry]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(at, n) - self.index.offsets[np.repeat(first, n) + place]
        return np.unique(np.maximum(starts, np.repeat(words.bounds[words.doc[at]], n)))

    def _candidates(self, windows: list[tuple[ItemClass, np.ndarray]], words, hashes: np.ndarray) -> Iterator[tuple[ItemClass, np.ndarray, np.ndarray]]:
        """Per class the starts of windows and the items that share an LSH key with them; walks of all classes run together."""
        for own, starts in (x for x in windows if not x[0].repeats):
            for part in range(0, len(starts), at_once := max(1, CELLS // len(own.words))):
                held = starts[part : part + at_once]
                yield own, np.repeat(held, len(own.words)), np.tile(np.arange(len(own.words)), len(held))
        windows = [x for x in windows if x[0].repeats]
        if not windows:
            return
        width = max(own.n for own, _ in windows)
        of = np.repeat(np.arange(len(windows)), [len(starts) for _, starts in windows])
        starts = np.concatenate([starts for _, starts in windows])
        n, repeats = (np.array([getattr(own, x) for own, _ in windows])[of] for x in ("n", "repeats"))
        found = []
        at_once = max(1, min(4096, CELLS // (8 * width)))
        for part in range(0, len(starts), at_once):
            rows = np.arange(part, min(part + at_once, len(starts)))
            index = starts[rows][:, None] + np.arange(width)
            inside = np.arange(width) < n[rows][:, None]
            real = index < words.bounds[words.doc[starts[rows]] + 1][:, None]
            held = np.where(inside, np.where(real, hashes[np.minimum(index, len(hashes) - 1)], U(1)), U(0))
            for seed in range(0, int(repeats[rows].max()), 8):
                row, own = np.nonzero((seed + np.arange(8)) < repeats[rows][:, None])
                keys = lsh_keys(held[row], n[rows][row], seed + own)
                first, last = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
                hit = np.repeat(np.arange(len(keys)), last - first)
                place = np.arange(len(hit)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
                found.append(np.stack([rows[row[hit]], self.item[first[hit] + place]], 1))
        met = np.unique(np.concatenate(found), axis=0)
        for c, (own, _) in enumerate(windows):
            mine = met[of[met[:, 0]] == c]
            if len(mine):
                yield own, starts[mine[:, 0]], mine[:, 1]

    def _verify(self, own: ItemClass, words, hashes: np.ndarray, starts: np.ndarray, which: np.ndarray, best: dict) -> None:
        doc = words.doc[starts]
        stop = words.bounds[doc + 1]
        # windows of one text and item within a few words of each other share a region
        chosen, last = [], {}
        for row, k in sorted(enumerate(which.tolist()), key=lambda x: (x[1], starts[x[0]])):
            seen = last.get((int(doc[row]), k))
            if seen is None or starts[row] - seen > own.edits:
                chosen.append((row, k))
                last[int(doc[row]), k] = int(starts[row])
        at_once = max(1, min(2000, CELLS // (own.n + 4 * own.edits)))
        for part in range(0, len(chosen), at_once):
            row, k = (np.array(x) for x in zip(*chosen[part : part + at_once], strict=True))
            first = starts[row] - own.edits
            low, width = words.bounds[doc[row]], own.n + 4 * own.edits
            index = first[:, None] + np.arange(width)
            inside = (index >= low[:, None]) & (index < stop[row][:, None])
            region = np.where(inside, hashes[np.clip(index, 0, len(hashes) - 1)], U(1))
            items = own.words[k]
            distance, end = edit_distances(items, region)
            good = np.flatnonzero(distance <= own.edits)
            for g in good.tolist():
                back, length = edit_distances(items[g : g + 1, ::-1], np.where(np.arange(width) < end[g], region[g], U(1))[None, : end[g]][:, ::-1])
                # the reversed search is free at both ends; the stretch that ends at `end` starts this far before it
                start_word, end_word = int(first[g] + end[g] - length[0]), int(first[g] + end[g])
                start_word, end_word = max(start_word, int(low[g])), min(end_word, int(stop[row[g]]))
                d = int(doc[row[g]])
                found = (int(distance[g]), int(words.start[start_word] - words.offsets[d]), int(words.end[max(start_word, end_word - 1)] - words.offsets[d]))
                key = (d, int(own.which[k[g]]))
                best[key] = min(best.get(key, found), found)


def _item_blocks(items: DataFrame, block_items: int, block_words: int, item_id: str, item_text: str) -> Iterator[list]:
    block, words = [], 0
    for row in clipped(items, item_id, item_text).toLocalIterator():
        block.append((row[0], row[1]))
        words += len((row[1] or "").split())
        if len(block) >= block_items or words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def _searchers(docs: DataFrame, items: DataFrame, max_ratio: float, recall: float, block_items: int, block_words: int, item_id: str, item_text: str):
    """Per block of items: their ids and a broadcast searcher."""
    for block in _item_blocks(items, block_items, block_words, item_id, item_text):
        yield [x[0] for x in block], docs.sparkSession.sparkContext.broadcast(Searcher(*item_classes([x[1] for x in block], max_ratio, recall)))


def find_leaks(docs: DataFrame, items: DataFrame, *, max_ratio: float = 0.2, recall: float = 0.99, block_items: int = 20_000, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, distance, start, end (code points, end exclusive): the best match of each text and item."""
    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    id_kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    schema = f"id {id_kind}, item_id {item_kind}, distance bigint, start bigint, end bigint"

    def searched(ids: list, held) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices_with_texts(batches, "text"):
                found = held.value.search(texts)
                which = [f[0] for f in found]
                raw = {d: texts[d].as_py().encode() for d in set(which)}
                points = lambda d, at: len(raw[d][:at].decode())
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(which, pa.int64())), pa.array([ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.int64()), pa.array([points(f[0], f[3]) for f in found], pa.int64()), pa.array([points(f[0], f[4]) for f in found], pa.int64())],
                    names=["id", "item_id", "distance", "start", "end"],
                )

        return rows.mapInArrow(search, schema)

    found = docs.sparkSession.createDataFrame([], schema)
    for ids, held in _searchers(docs, items, max_ratio, recall, block_items, block_words, item_id, item_text):
        found = found.union(searched(ids, held))
    first = Window.partitionBy("id", "item_id").orderBy("distance", "start", "end")
    return found.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def clean_documents(docs: DataFrame, items: DataFrame, *, max_ratio: float = 0.2, recall: float = 0.99, block_items: int = 20_000, block_words: int = 1_000_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that leak no item; decided in place, without a join."""
    for _, held in _searchers(docs, items, max_ratio, recall, block_items, block_words, item_id, item_text):

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices_with_texts(batches, text_col):
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in held.value.search(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).withColumnRenamed("id", "doc_id")
