"""Subword-embedding text classifiers trained jointly with a linear softmax in numpy.

A text is a bag of words; a word is the bag of its hashed features: itself and
its character n-grams between word borders, so an unseen spelling shares most
of its features with the ones seen.  A learned vector belongs to each hashed
feature; a document is the average of its words' vectors, a word the average of
its features' vectors; a linear softmax gives the class, and vectors and output
weights are trained together by stochastic gradient descent with AdaGrad steps.

For scoring, the output layer is folded into the vectors: the difference of the
two logits of a document is the average over its words of one number per word,
so each distinct word of a batch is hashed once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import release_memory, slices_by_bytes

_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
KNOWN_WORDS = 1 << 17
REPEAT, PAD = "\x01same", "\x02pad"


@dataclass(frozen=True)
class Settings:
    """What a model reads and how it is trained; every bound is stated here."""

    lower: bool = True
    ngrams: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 17
    dim: int = 8
    epochs: int = 6
    rate: float = 0.25
    seed: int = 7
    max_train: int = 6000  # labelled rows at most, by hash order
    balance: bool = True
    pad: int = 20  # times the feature PAD joins the average of every document, so that a few words decide little
    repeats: bool = False  # a word equal to the one before it also gives the feature REPEAT


def word_features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(feature buckets of all words in a row, number of features of each word)."""
    marked = [b"<" + w + b">" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)  # place in the word
    left = np.repeat(lengths, lengths) - place  # bytes from here to the word's end
    of = np.repeat(np.arange(len(words)), lengths)
    with np.errstate(over="ignore"):
        mixed = data * np.uint64(_PRIMES[0])
        mixed ^= mixed >> np.uint64(29)
        # the word itself: a polynomial hash by prefix sums would need inverses, so fold power-weighted bytes
        power = _powers(int(lengths.max(initial=1)))
        whole = np.add.reduceat(mixed * power[place], starts) if len(words) else np.empty(0, np.uint64)
        feats, owner = [whole ^ np.uint64(_PRIMES[2])], [np.arange(len(words))]
        rolling, n = mixed.copy(), 1
        for size in range(2, max(s.ngrams, default=1) + 1):
            rolling[: len(data) - size + 1] = rolling[: len(data) - size + 1] * np.uint64(_PRIMES[1]) + mixed[size - 1 :] if len(data) >= size else 0
            n = size
            if size in s.ngrams:
                ok = np.nonzero(left >= n)[0]
                feats.append(rolling[ok] + np.uint64(n))
                owner.append(of[ok])
        h = np.concatenate(feats)
        h ^= h >> np.uint64(33)
        h *= np.uint64(_PRIMES[2])
        h ^= h >> np.uint64(33)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint64(s.buckets)).astype(np.int64), np.bincount(owner, minlength=len(words))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.full(2 * n, _PRIMES[1], np.uint64))
    return _POWERS


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """(dictionary-coded words of all texts in a row, first word of each text and the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(split)
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    # splitting at a border leaves empty strings; they are no words
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
    return pc.dictionary_encode(flat.filter(keep)), kept[offsets]


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray  # per bucket: vector . (output row 1 - output row 0)
    bias: float
    seen: dict[str, float] = field(default_factory=dict, repr=False)
    repeat: float = field(init=False, default=0.0)
    rest: float = field(init=False, default=0.0)

    def __post_init__(self) -> None:
        self.repeat, self.rest = self.word_scores([REPEAT, PAD]).tolist()

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        feats, counts = word_features([w.encode("utf-8", "surrogatepass") for w in words], self.settings)
        return np.add.reduceat(self.weights[feats], np.cumsum(counts) - counts) / counts

    def logits(self, texts: pa.Array) -> np.ndarray:
        """One number per text; a text without words has the bias."""
        out = np.empty(len(texts))
        for at, to in slices_by_bytes(texts, 2 << 20):
            coded, first = split_words(texts.slice(at, to - at), self.settings.lower)
            distinct = coded.dictionary.to_pylist()
            scores = list(map(self.seen.get, distinct))
            new = [i for i, x in enumerate(scores) if x is None]
            for lo in range(0, len(new), 1 << 15):
                part = new[lo : lo + (1 << 15)]
                words = [distinct[i] for i in part]
                got = self.word_scores(words).tolist()
                for i, x in zip(part, got):
                    scores[i] = x
                if len(self.seen) < KNOWN_WORDS:  # the frequent words come early; what is known stays bounded
                    self.seen.update(zip(words, got))
            code = coded.indices.to_numpy(zero_copy_only=False)
            per_word = np.array(scores, float)[code] if distinct else np.empty(0)
            sums = np.concatenate(([0.0], np.cumsum(per_word)))
            n, total = np.diff(first), sums[first[1:]] - sums[first[:-1]]
            if self.settings.repeats:
                same = np.zeros(len(code) + 1, np.int64)
                same[2:] = np.cumsum(code[1:] == code[:-1])
                # the step from the word before a text's first is none of the text's
                again = np.where(n > 0, same[first[1:]] - same[np.minimum(first[:-1] + 1, len(code))], 0)
                n, total = n + again, total + again * self.repeat
            out[at:to] = (total + self.settings.pad * self.rest) / np.maximum(1, n + self.settings.pad) + self.bias
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -700, 700)))


def marked(text: str | None, repeats: bool) -> list[bytes]:
    """All words of a text; with ``repeats`` the mark REPEAT behind each word that equals the one before it."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if repeats:
        mark = REPEAT.encode()
        words = [x for i, w in enumerate(words) for x in ((w, mark) if i and w == words[i - 1] else (w,))]
    return words


Bag = tuple[str, bytes]


def bag(text: str | None, repeats: bool = False) -> Bag:
    """The distinct words of a whole text, joined by spaces, and the bytes of how often each comes, as int32."""
    times = Counter(marked(text, repeats))
    return b" ".join(times).decode("utf-8", "surrogatepass"), np.fromiter(times.values(), np.int32, len(times)).tobytes()


def _coded(bags: list[Bag], lower: bool) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """(distinct words of all bags, (words by number, times) of each bag); words stay in Arrow memory."""
    texts = pa.array([words for words, _ in bags], pa.large_string())
    parts = [split_words(texts.slice(at, to - at), lower) for at, to in slices_by_bytes(texts, 2 << 20)]
    chunks = pa.chunked_array([coded for coded, _ in parts], type=parts[0][0].type).unify_dictionaries().chunks
    out = []
    for chunk, (_, first) in zip(chunks, parts):
        code = chunk.indices.to_numpy(zero_copy_only=False)
        for a, b in zip(first[:-1], first[1:]):
            kinds, inverse = np.unique(code[a:b], return_inverse=True)
            times = np.bincount(inverse, np.frombuffer(bags[len(out)][1], np.int32), len(kinds))
            out.append((kinds.astype(np.int32), times.astype(np.int32)))
    return chunks[0].dictionary, out


FEATURE_SLICE = 8192


def _features(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets of all words and of PAD, number of each word's, first of each word's)."""
    feats, counts = [], []
    for at in range(0, len(words) + 1, FEATURE_SLICE):
        some = words.slice(at, FEATURE_SLICE).to_pylist()
        if at + FEATURE_SLICE > len(words):
            some.append(PAD)
        f, c = word_features([w.encode("utf-8", "surrogatepass") for w in some], s)
        feats.append(f.astype(np.int32))
        counts.append(c.astype(np.int32))
    counts = np.concatenate(counts)
    return np.concatenate(feats), counts, np.cumsum(counts, dtype=np.int64) - counts


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Fit to whole texts as given; see ``train_bags``."""
    return train_bags([bag(t, s.repeats) for t in texts], labels, s)


def train_bags(bags: list[Bag], labels: list[int], s: Settings) -> Model:
    """Fit vectors and output weights to bags of words; without both classes the score is the share of label 1.

    Only words and their times are held for every text; its features are
    expanded each time it is read, so memory does not grow with them.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min(initial=1) == y.max(initial=0):
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(s, np.zeros(s.buckets, np.float64), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(s.seed)
    known, docs = _coded(bags, s.lower)
    pad = len(known)
    feats, counts, begin = _features(known, s)
    del known, bags
    release_memory()

    def expanded(kinds: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = times.sum() + s.pad
        if s.pad:
            kinds, times = np.append(kinds, pad), np.append(times, s.pad)
        c = counts[kinds]
        at = np.repeat(begin[kinds] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        share = np.repeat(times / c / max(1, n), c)
        total = np.bincount(feats[at], share, s.buckets)  # no sorting: the buckets are few beside a text's features
        bucket = np.nonzero(total)[0]
        return bucket, total[bucket].astype(np.float32)

    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    squares = np.full(s.buckets, 1e-4, np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    out[1], out_sq = rng.normal(0, 0.1, s.dim), np.full((2, s.dim), 1e-4, np.float32)
    bias_sq = np.full(2, 1e-4, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2)) if s.balance else np.ones(2)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(docs)):
            bucket, share = expanded(*docs[i])
            hidden = share @ vectors[bucket]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = p @ out
            grad = np.outer(p, hidden)
            out_sq += grad * grad
            out -= rate * grad / np.sqrt(out_sq)
            bias_sq += p * p
            bias -= rate * 0.1 * p / np.sqrt(bias_sq)
            if len(bucket):
                norm = share * share * (back @ back / s.dim)
                squares[bucket] += norm
                vectors[bucket] -= np.outer(rate * share / np.sqrt(squares[bucket]), back)
    return Model(s, (vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(key: object, folds: int, fold: int) -> bool:
    """Whether crc32 of the key as text falls into the held-out fold."""
    return zlib.crc32(str(key).encode()) % folds == fold


def labelled_bags(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, s: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, words, times): bags of the whole texts of the first ``max_train`` training rows in hash order of the key.

    Rows of the held-out fold are never read; rows without a key or a label of
    0 or 1 are no training rows.  Of several texts with one key the least bag is
    taken, so there are ``max_train`` bags at most, however often a labelled key
    is repeated.
    """
    fold_of = F.crc32(F.col("key").cast("string")) % folds
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(target).cast("int").alias("label"))
        .where("key is not null and label in (0, 1)")
        .where(fold_of != fold)
        .distinct()
        .orderBy(F.xxhash64("key"), "key", "label")
        .limit(s.max_train)
    )

    @F.pandas_udf("words string, times binary")
    def bagged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bag(t, s.repeats) for t in texts], columns=["words", "times"])

    # max_train rows: the broadcast is bounded
    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "key")
        .select("key", "label", bagged("text").alias("bag"))
        .groupBy("key", "label")
        .agg(F.min("bag").alias("bag"))
        .select("key", "label", "bag.words", "bag.times")
    )


def _in_order(rows: list[tuple]) -> tuple[list[Bag], list[int]]:
    """Bags and labels of (key, label, words, times) in an order that does not depend on partitions."""
    rows = sorted((k, label, words, bytes(times)) for k, label, words, times in rows)
    return [(words, times) for _, _, words, times in rows], [label for _, label, _, _ in rows]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, s: Settings, key: str = "doc_id", text: str = "text") -> tuple[list[Bag], list[int]]:
    """Bags and labels of ``labelled_bags`` on the driver, ``max_train`` at most."""
    return _in_order(labelled_bags(docs, labels, target, folds, fold, s, key, text).collect())


def trained(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, s: Settings, key: str = "doc_id", text: str = "text") -> Model:
    """The model of ``train_bags`` on ``labelled_bags``, fitted in one task of an executor.

    The task holds ``max_train`` bags at most and is run again if its executor
    is lost; the order of the bags and the seed fix the result.  The driver gets
    the weights only, whose size is fixed.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train_bags(*_in_order([row for b in batches for row in zip(*[c.to_pylist() for c in b.columns])]), s)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])
        release_memory()

    got = labelled_bags(docs, labels, target, folds, fold, s, key, text).repartition(1).mapInArrow(fit, "weights binary, bias double").first()
    # a plan without rows may have no task
    return Model(s, np.frombuffer(bytes(got["weights"]), np.float64), got["bias"]) if got else train_bags([], [], s)


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., score) for every row; the model is a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            scores = pa.array(own.scores(batch.column(batch.num_columns - 1)), pa.float64())
            yield from table.drop_columns([table.column_names[-1]]).append_column("score", scores).to_batches()
        release_memory()

    wanted = docs.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    fields = [f for f in wanted.schema.fields[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return wanted.mapInArrow(run, schema)
