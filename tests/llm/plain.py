"""Plain versions of what the operators compute, for tests."""

import re

import numpy as np
import xxhash


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles; fewer words than ``width`` give one shingle."""
    words = [w for w in re.split(r"[ \t\n\r\f\v]+", (text or "").lower()) if w]
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(" ".join(words[i : i + width])) for i in range(n)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
