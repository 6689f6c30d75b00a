"""Simple-8b: word-aligned integer coding in vectorised numpy.

A 64-bit word holds a 4-bit selector and 60 bits of data.  Selectors 1 to 15
pack COUNTS[s] values of WIDTHS[s] bits each; selector 0 is an escape, whose
data is the place of a value of more than 60 bits among the exceptions.  Values
are coded in blocks of a fixed number of values, and the words of every block
start at a stored offset, so blocks decode side by side or alone.

Layout of a segment, little-endian:
    4s magic, u32 block size, u64 values, u32 blocks, u32 exceptions,
    u32 word offset of every block and the end, u64 words, u64 exceptions
"""

from __future__ import annotations

import struct

import numpy as np

WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = 0
BLOCK = 1024
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQII")
_MARGIN = int(COUNTS.max())
_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)


_SHORT = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right") + 1).astype(np.uint8)


def _kinds(values: np.ndarray) -> np.ndarray:
    """The narrowest selector each value fits in; 16 for those of more than 60 bits."""
    if values.size and values.max() < len(_SHORT):
        return _SHORT[values]
    return (np.searchsorted(_LIMITS, values.ravel(), side="right") + 1).astype(np.uint8).reshape(values.shape)


def _window_max(rows: np.ndarray) -> dict[int, np.ndarray]:
    """For each packing count n, the largest of the n entries from each place on; 0 beyond the margin."""
    powers = {1: rows}
    n = 1
    while n * 2 <= _MARGIN:
        grown = powers[n].copy()
        np.maximum(grown[:, :-n], powers[n][:, n:], out=grown[:, :-n])
        powers[n * 2] = grown
        n *= 2
    out = {}
    for count in sorted({int(c) for c in COUNTS}):
        p = max(q for q in powers if q <= count)
        if p == count:
            out[count] = powers[p]
        else:
            both = powers[p].copy()
            np.maximum(both[:, : p - count], powers[p][:, count - p :], out=both[:, : p - count])
            out[count] = both
    return out


def pack(values: np.ndarray, sizes: list[int] | None = None, block: int = BLOCK) -> list[bytes]:
    """One segment for each run of ``sizes`` consecutive values (default: one for all)."""
    values = np.ascontiguousarray(values, np.uint64)
    sizes = [len(values)] if sizes is None else sizes
    blocks_of = [-(-n // block) for n in sizes]
    lanes = sum(blocks_of)
    grid = np.zeros((lanes, block + _MARGIN), np.uint64)
    at = lane = 0
    for n, k in zip(sizes, blocks_of):
        whole = n // block
        grid[lane : lane + whole, :block] = values[at : at + whole * block].reshape(whole, block)
        if k > whole:
            grid[lane + whole, : n - whole * block] = values[at + whole * block : at + n]
        at, lane = at + n, lane + k
    kind = _kinds(grid)
    tops = _window_max(kind)
    best = np.full(grid.shape, 0x80, np.uint8)
    for s in range(1, 16):  # the least selector that fits packs the most; the top bit marks one that does not
        np.minimum(best, (tops[int(COUNTS[s])] > s).view(np.uint8) << np.uint8(7) | np.uint8(s), out=best)
    best[best >= 0x80] = ESCAPE
    place = np.zeros(lanes, np.int64)
    every = np.arange(lanes)
    steps, picks = [], []
    while lanes and (place < block).any():
        s = best[every, np.minimum(place, block)]
        steps.append(place)
        picks.append(s)
        place = place + np.where(place < block, COUNTS[s], 0)
    steps_of = np.array(steps).T if steps else np.zeros((lanes, 0), np.int64)
    lane_of, col_of = np.nonzero(steps_of < block)  # a finished lane stays beyond the block
    pos, sel = steps_of[lane_of, col_of], (np.array(picks).T if picks else np.zeros((lanes, 0), np.uint8))[lane_of, col_of]
    words = sel.astype(np.uint64) << np.uint64(60)
    flat, base = grid.ravel(), lane_of * grid.shape[1] + pos
    for s in range(2, 16):
        at_s = np.nonzero(sel == s)[0]
        if len(at_s):
            got = words[at_s]
            for j in range(int(COUNTS[s])):
                got |= flat[base[at_s] + j] << np.uint64(j * int(WIDTHS[s]))
            words[at_s] = got
    per_lane = np.bincount(lane_of, minlength=lanes)
    ends = np.concatenate(([0], np.cumsum(per_lane)))
    out, lane = [], 0
    for n, k in zip(sizes, blocks_of):
        lo, hi = ends[lane], ends[lane + k]
        own, wide = words[lo:hi], np.nonzero(sel[lo:hi] == ESCAPE)[0]
        own[wide] = np.arange(len(wide), dtype=np.uint64)
        offsets = (ends[lane : lane + k + 1] - lo).astype("<u4")
        out.append(HEADER.pack(MAGIC, block, n, k, len(wide)) + offsets.tobytes() + own.astype("<u8").tobytes() + flat[base[lo:hi][wide]].astype("<u8").tobytes())
        lane += k
    return out


def _parts(segment: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    magic, block, n, blocks, wide = HEADER.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at = HEADER.size
    offsets = np.frombuffer(segment, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    words = np.frombuffer(segment, "<u8", int(offsets[-1]), at)
    return block, n, offsets, words, np.frombuffer(segment, "<u8", wide, at + 8 * len(words))


def _decode(words: np.ndarray, offsets: np.ndarray, block: int, exceptions: np.ndarray) -> np.ndarray:
    lanes = len(offsets) - 1
    grid = np.zeros((lanes, block + _MARGIN), np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(COUNTS[sel])))
    lane_of = np.repeat(np.arange(lanes), np.diff(offsets))
    base = lane_of * grid.shape[1] + before[:-1] - before[offsets[:-1]][lane_of]
    flat, data = grid.ravel(), words & np.uint64((1 << 60) - 1)
    for s in range(2, 16):
        at_s = np.nonzero(sel == s)[0]
        if len(at_s):
            got, to, width = data[at_s], base[at_s], int(WIDTHS[s])
            mask = np.uint64((1 << width) - 1)
            for j in range(int(COUNTS[s])):
                flat[to + j] = (got >> np.uint64(j * width)) & mask
    wide = np.nonzero(sel == ESCAPE)[0]
    if len(wide):
        flat[base[wide]] = exceptions[data[wide].astype(np.int64)]
    return grid[:, :block]


def unpack(segment: bytes) -> np.ndarray:
    """All values of a segment as uint64."""
    block, n, offsets, words, exceptions = _parts(segment)
    return _decode(words, offsets, block, exceptions).ravel()[:n]


def unpack_block(segment: bytes, number: int) -> np.ndarray:
    """The values of one block; no other block's words are read."""
    block, n, offsets, words, exceptions = _parts(segment)
    own = offsets[number : number + 2]
    return _decode(words[own[0] : own[1]], own - own[0], block, exceptions).ravel()[: min(block, n - number * block)]
