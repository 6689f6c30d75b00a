"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of m characters that occurs in a document with at most k edits
shares at least m + 1 - q - k*q of its character q-grams with it, all of them on
text-minus-item diagonals at most k from the match's own.  Diagonals are cut
into overlapping bands of twice the step, so every such stretch of diagonals
lies within one band.  Shared q-grams are counted per (document, item, band);
bands that reach the bound are verified by a banded alignment: only the cells on
the band's diagonals are computed, free at both ends.

Texts and items are compared lower-cased with white space collapsed, in code
points.  Documents are scanned where they lie: nothing is shuffled.  Items go
to the executors in blocks of a fixed number of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import release_memory

Q = 8
RATE = 0.1
BLOCK_CHARS = 4 << 20  # of items in one broadcast
PIECE = 1 << 20  # characters of text scanned together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place on (Q is 8: three doublings)."""
    h, n = codes.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        power = _BASE
        while n < Q:
            h = h[:-n] * power + h[n:] if len(h) > n else h[:0]
            power, n = power * power, 2 * n
        return h ^ (h >> np.uint64(31))


def edit_budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an item of m characters: the rate's share, but no more than leave the lemma a bound of 1."""
    return max(0, min(int(m * rate), (m - Q) // Q))


CELLS = 1 << 20  # of the arrays of one batch of alignments, items and regions included


def _batches(items: list[np.ndarray], widths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of pairs whose padded arrays have CELLS cells at most; a longer pair is a run of its own."""
    at = 0
    while at < len(items):
        to, longest, widest = at, 0, 0
        while to < len(items):
            longest, widest = max(longest, len(items[to])), max(widest, widths[to])
            if to > at and (to + 1 - at) * (2 * longest + widest) > CELLS:
                break
            to += 1
        yield at, to
        at = to


def banded_alignments(items: list[np.ndarray], regions: list[np.ndarray], widths: list[int], most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of each item's best occurrence in its region, free at both ends; None beyond ``most`` edits.

    ``regions[i]`` starts on the band's lowest diagonal and ``widths[i]`` is the
    number of its diagonals: column d of row r is the place r + d of the region,
    and only these cells are kept, so a pair takes memory in proportion to its
    item and band, not to their product.  Pairs of a batch advance together,
    one item character a step.  The running minimum of distance - diagonal
    resolves the insertions, and starts travel along with the distances.  Pairs
    that exceed their budget drop out.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    if not items:
        return out
    size, wide = np.array([len(x) for x in items]), np.array(widths)
    width, longest = int(wide.max()), int(size.max())
    far = np.int32(1 << 30)
    text = np.full((len(items), longest + width), 0x110000, np.uint32)  # the filler equals no character
    rows = np.full((len(items), longest), 0x110001, np.uint32)
    for i, (item, region) in enumerate(zip(items, regions)):
        n = min(len(region), text.shape[1])
        text[i, :n], rows[i, : len(item)] = region[:n], item
    live = np.arange(len(items))
    diagonal = np.arange(width, dtype=np.int32)
    dist = np.where(diagonal < wide[:, None], 0, far).astype(np.int32)
    start = np.broadcast_to(diagonal, dist.shape).copy()
    for r in range(1, longest + 1):
        across = dist + (text[:, r - 1 : r - 1 + width] != rows[:, r - 1 : r])  # the item's character against the text's
        skip, came = np.full_like(dist, far), np.empty_like(start)
        skip[:, :-1], came[:, :-1], came[:, -1] = dist[:, 1:] + 1, start[:, 1:], 0  # the item's character left out
        take = across <= skip
        lift = np.where(take, across, skip) - diagonal
        came = np.where(take, start, came)
        low = np.minimum.accumulate(lift, axis=1)
        # the latest diagonal that sets the running minimum is where the insertions began
        source = np.maximum.accumulate(np.where(lift == low, diagonal, 0), axis=1)
        dist, start = low + diagonal, np.take_along_axis(came, source, axis=1)
        dist = np.where(diagonal < wide[live][:, None], dist, far)
        least = dist.min(axis=1)
        for j in np.nonzero((size[live] == r) & (least <= most[live]))[0]:
            end = int(dist[j].argmin())
            out[live[j]] = (int(dist[j, end]), int(start[j, end]), r + end)
        stay = (size[live] > r) & (least <= most[live])
        if not stay.all():
            if not stay.any():
                break
            live, dist, start, text, rows = live[stay], dist[stay], start[stay], text[stay], rows[stay]
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])) if len(keys) else np.empty(0)


class ItemIndex:
    """Postings of the items' q-grams as flat arrays; items shorter than Q are matched exactly."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [normal(t) for _, t in items]
        self.codes = [points(t) for t in self.texts]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(int(m), rate) for m in size], np.int64)
        self.bound = np.maximum(1, size + 1 - Q - self.budget * Q)
        self.step = 2 * self.budget + 1  # a stretch of 2k+1 diagonals lies within a band of two steps
        self.size = size
        grams = [gram_hashes(c) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order].astype(np.int32), place[order].astype(np.int32)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.short = [n for n, m in enumerate(size) if 0 < m < Q]
        self.reach = int((size + 4 * self.step).max(initial=0))

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, start, end), the best occurrence for each text and item."""
        units: list[tuple[int, int, np.ndarray]] = []
        for n, codes in enumerate(texts):
            for at in range(0, max(1, len(codes)), PIECE):  # pieces overlap by more than any match
                units.append((n, at, codes[at : at + PIECE + self.reach]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        at = 0
        while at < len(units):
            to, total = at + 1, len(units[at][2])
            while to < len(units) and total + len(units[to][2]) <= PIECE:
                total += len(units[to][2])
                to += 1
            self._scan(units[at:to], best)
            at = to
        return [(n, i, *found) for (n, i), found in best.items()]

    def _scan(self, units: list[tuple[int, int, np.ndarray]], best: dict) -> None:
        border = np.array([0x110000], np.uint32)
        joined = np.concatenate([x for _, _, codes in units for x in (codes, border)])
        starts = np.cumsum([0] + [len(c) + 1 for _, _, c in units])[:-1]
        hashes = gram_hashes(joined)
        at = np.nonzero(self.filter[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])[0]
        if len(at):
            slot = np.searchsorted(self.grams, hashes[at])
            slot[slot == len(self.grams)] = 0
            hit = self.grams[slot] == hashes[at]
            at, slot = at[hit], slot[hit]
        if len(at):
            # a text position's postings in steps that bound the expanded arrays
            total = np.cumsum(self.count[slot])
            steps = []
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), side="right")))
                steps.append((lo, hi))
                lo = hi
            # pairs of equal q-grams per band first; then, in the bands with enough, the item's distinct q-grams
            keys, n = _summed([np.unique(self._bands(at[a:b], slot[a:b], starts)[0], return_counts=True) for a, b in steps])
            keys = keys[n >= self.bound[(keys >> 26) % len(self.ids)]]
            if len(keys):
                shared = []
                for a, b in steps:
                    own, place = self._bands(at[a:b], slot[a:b], starts)
                    where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    ok = keys[where] == own
                    shared.append(np.unique((where[ok] << 32) | place[ok]))
                number, n = np.unique(np.unique(np.concatenate(shared)) >> 32, return_counts=True)
                keys = keys[number]
                keys = keys[n >= self.bound[(keys >> 26) % len(self.ids)]]
                owner, band = keys >> 26, keys & ((1 << 26) - 1)
                self._verify([(units[u], int(i), int(b)) for u, i, b in zip(owner // len(self.ids), owner % len(self.ids), band)], best)
        for i in self.short:
            for n, offset, codes in units:
                found = codes.tobytes().find(self.codes[i].tobytes()) if len(codes) else -1
                while found >= 0 and found % 4:
                    found = codes.tobytes().find(self.codes[i].tobytes(), found + 1)
                if found >= 0:
                    self._keep(best, n, i, (0, offset + found // 4, offset + found // 4 + int(self.size[i])))

    def _bands(self, at: np.ndarray, slot: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[slot]
        begin = np.repeat(self.first[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place = self.item[begin].astype(np.int64), self.place[begin]
        unit = np.searchsorted(starts, at, side="right") - 1
        local = np.repeat(at - starts[unit], count)
        unit = np.repeat(unit, count)
        band = (local - place + self.size[item]) // self.step[item] + 1  # the diagonal plus the item's size is not negative
        owner = (unit * len(self.ids) + item) << 26
        return np.concatenate((owner | band, owner | (band - 1))), np.concatenate((place, place)).astype(np.int64)

    def _verify(self, asked: list[tuple[tuple[int, int, np.ndarray], int, int]], best: dict) -> None:
        hard: list[tuple[int, int, int, np.ndarray, int, int]] = []
        for (number, offset, codes), i, band in asked:
            step, size, k = int(self.step[i]), int(self.size[i]), int(self.budget[i])
            low = (band - 1) * step - size - k  # the hits' diagonals are [low + k, low + k + 2 steps); a match strays k from them
            width = 2 * k + 2 * step
            lo, hi = max(0, low), min(len(codes), low + width + size)
            region = codes[lo:hi]
            found = region.tobytes().find(self.codes[i].tobytes())
            if found >= 0 and found % 4 == 0:
                self._keep(best, number, i, (0, offset + lo + found // 4, offset + lo + found // 4 + size))
            elif k:
                # a band that begins before the text is filled up, so that its lowest diagonal is the region's first place
                filled = np.concatenate((np.full(lo - low, 0x110000, np.uint32), region)) if lo > low else region
                hard.append((number, i, offset + low, filled, width, len(codes) + offset))
        hard = [x for x in hard if best.get((x[0], x[1]), (1,))[0]]
        hard.sort(key=lambda x: len(self.codes[x[1]]))
        for at, to in _batches([self.codes[x[1]] for x in hard], [x[4] for x in hard]):
            part = hard[at:to]
            got = banded_alignments([self.codes[x[1]] for x in part], [x[3] for x in part], [x[4] for x in part], self.budget[[x[1] for x in part]])
            for (number, i, place, _, _, end), g in zip(part, got):
                if g:  # places in the filling are none of the text
                    first = max(place + g[1], 0)
                    self._keep(best, number, i, (g[0], first, max(first, min(place + g[2], end))))

    @staticmethod
    def _keep(best: dict, number: int, item: int, found: tuple[int, int, int]) -> None:
        key = (number, item)
        if key not in best or found < best[key]:
            best[key] = found


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items that have text, in blocks of at most BLOCK_CHARS characters (a longer item is a block of its own)."""
    block: list[tuple[int, str]] = []
    chars = 0
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and trim(t) <> ''").distinct().orderBy("k", "t")
    for row in rows.toLocalIterator():
        if block and chars + len(row["t"]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row["k"], row["t"]))
        chars += len(row["t"])
    if block:
        yield block


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item_id, edits, start, end) for every document and item whose passage it holds within the edit budget.

    ``start`` and ``end`` delimit the best occurrence (fewest edits, then the
    earliest) in the normalised text.  The budget is ``edit_budget``; items of
    fewer than Q characters must occur exactly, blank or null items and null
    item keys match nothing.  Null and empty texts hold nothing.  A null
    document key is returned as null; repeated rows are returned as often as
    they come.  Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    schema = f"`{key}` long, item_id long, edits int, start long, end long"
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(ItemIndex(items, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keys = batch.column(0)
                for at in range(0, len(keys), 512):
                    found = index.search([points(normal(t)) for t in batch.column(1).slice(at, 512).to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array([at + f[0] for f in found], pa.int64())), pa.array([index.ids[f[1]] for f in found], pa.int64()),
                            pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64()),
                        ],
                        names=[key, "item_id", "edits", "start", "end"],
                    )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item within its edit budget.

    Null and empty texts hold nothing and stay; null keys and repeated rows are
    ordinary rows; blank or null items and items without a key match nothing;
    an empty table of either kind leaves ``docs`` as it is; columns are kept.
    """
    for items in _blocks(benchmark, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text))
                clean = np.ones(len(texts), bool)
                for at in range(0, len(texts), 512):
                    for found in index.search([points(normal(t)) for t in texts.slice(at, 512).to_pylist()]):
                        clean[at + found[0]] = False
                yield batch.filter(pa.array(clean))
            release_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
