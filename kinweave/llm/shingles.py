"""Word shingles of texts as 64-bit hashes, vectorised; the one splitter of all near-duplicate operators on word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from kinweave.llm.subword import split_words

SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in a row, number of each text's); fewer words than ``width`` give one shingle, none none."""
    coded, first = split_words(texts, lower=True)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = words[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else words
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    end = np.repeat(first[1:], count)
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            at = begin + j
            own = np.where(at < end, word[np.minimum(at, max(0, len(word) - 1))] if len(word) else 0, np.uint64(0))
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + own
        out = mixed(out)
    return out, count
