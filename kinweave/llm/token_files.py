"""Token-ID output: documents encoded by a public tokenizer, Simple-8b segments in files.

Documents are range-partitioned and sorted by their key; each partition writes
one run of segments.  A segment is a row of the files: ``part`` and ``seq``
order the segments, ``first`` is the number of IDs before it in its part,
``keys`` and ``lengths`` list its whole documents, and ``payload`` holds their
IDs (see ``simple8b``).  A segment closes at the first document end past
SEGMENT_IDS IDs, so each decodes alone and memory is bounded by the longest
document.  The container is Parquet, because only Spark's writers reach every
shared store; the payload is the binary format.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import simple8b
from kinweave.llm.common import without
from kinweave.storage import new_path, shuffle_partitions

SEGMENT_IDS = 1 << 18
SLICE_BYTES = 8 << 20
CACHE_CHUNKS = 5 << 17

SEGMENTS = "part int, seq int, first long, keys array<long>, lengths array<long>, payload binary"


class ChunkEncoder:
    """Encodes many texts by one pass over the distinct chunks between white space.

    Valid for tokenizers to which white space is nothing but a border, such as
    one that drops it before a word-wise model.  Every chunk goes through the
    whole tokenizer.  New chunks are encoded together, joined by a special
    token whose ID then marks the borders; chunks that hold a special token's
    string themselves are encoded alone.
    """

    GROUP = 4096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = list(special.values())
        self.border = next(iter(special.items()), None)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        joined, alone = chunks, []
        text = "\n".join(chunks)
        if self.border is None or any(s in text for s in self.special):
            alone = [c for c in chunks if self.border is None or any(s in c for s in self.special)]
            joined = [c for c in chunks if self.border is not None and not any(s in c for s in self.special)]
        flats, lengths = [], []
        if joined:
            groups = [joined[i : i + self.GROUP] for i in range(0, len(joined), self.GROUP)]
            mark, string = self.border
            for e in self.tokenizer.encode_batch_fast([string.join(g) for g in groups], add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                borders = np.nonzero(ids == mark)[0]
                lengths.append(np.diff(np.concatenate(([-1], borders, [len(ids)]))) - 1)
                flats.append(np.delete(ids, borders))
        for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False):
            flats.append(np.array(e.ids, np.uint32))
            lengths.append(np.array([len(e.ids)]))
        self.rows.update(zip(joined + alone, range(len(self.rows), len(self.rows) + len(chunks))))
        self.ids = np.concatenate((self.ids, *flats))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))))

    def _trim(self, rows: int) -> None:
        """Forget what was learnt after the first ``rows`` chunks; they are the frequent ones."""
        for chunk in list(islice(reversed(self.rows), len(self.rows) - rows)):
            del self.rows[chunk]
        self.ends = self.ends[: rows + 1].copy()
        self.ids = self.ids[: self.ends[-1]].copy()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(IDs of all texts in a row, number of IDs of each); null texts have none."""
        if len(self.rows) > CACHE_CHUNKS:
            self._trim(CACHE_CHUNKS)
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = pc.dictionary_encode(pc.list_flatten(split))
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        distinct = coded.dictionary.to_pylist()
        known = list(map(self.rows.get, distinct))
        if None in known:
            self._learn([c for c, k in zip(distinct, known) if k is None])
            known = list(map(self.rows.__getitem__, distinct))
        row = np.array(known, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if distinct else np.empty(0, np.int64)
        starts, counts = self.ends[row], self.ends[row + 1] - self.ends[row]
        before = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(starts - before[:-1], counts) + np.arange(before[-1])]
        chunks_before = split.offsets.to_numpy()
        chunks_before = chunks_before - chunks_before[0]
        return ids, np.diff(before[chunks_before])


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One for each Python worker: later tasks find the frequent chunks known."""
    return ChunkEncoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        to = max(to, at + 1)
        yield at, to
        at = to


def _encode(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        seq = first = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held_ids = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, first, held, held_ids
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            keys = pa.concat_arrays([h[0] for h in held])
            # cut at document ends
            ends = np.cumsum(lengths)
            cuts, done = [], 0
            while done < len(lengths):
                to = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SEGMENT_IDS, side="left")) + 1
                cuts.append((done, min(to, len(lengths))))
                done = cuts[-1][1]
            sizes = [int(lengths[a:b].sum()) for a, b in cuts]
            payloads = simple8b.pack(ids, sizes)
            firsts = first + np.concatenate(([0], np.cumsum(sizes)))
            borders = pa.array([0] + [b for _, b in cuts], pa.int32())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(cuts), pa.int32()), pa.array(range(seq, seq + len(cuts)), pa.int32()), pa.array(firsts[:-1], pa.int64()),
                    pa.ListArray.from_arrays(borders, keys), pa.ListArray.from_arrays(borders, pa.array(lengths, pa.int64())), pa.array(payloads, pa.binary()),
                ],
                names=["part", "seq", "first", "keys", "lengths", "payload"],
            )
            seq, first, held, held_ids = seq + len(cuts), int(firsts[-1]), [], 0
            return out

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in _slices(texts):
                ids, counts = encoder(texts.slice(a, b - a))
                with_end = np.full(len(ids) + len(counts), end_id, np.uint64)
                own = np.ones(len(with_end), bool)
                own[np.cumsum(counts + 1) - 1] = False
                with_end[own] = ids
                held.append((keys.slice(a, b - a), with_end, counts + 1))
                held_ids += len(with_end)
                if held_ids >= 4 * SEGMENT_IDS:
                    yield close()
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Encode whole texts, append ``end_id`` to each, and write the segments in ascending key order; returns the folder.

    Null texts count as empty and give the end ID alone.  Null keys come first;
    rows of equal key are ordered by a hash of the text, repeated rows are
    repeated.  Other columns are not written.  An empty table gives a folder
    with no segments.  IDs may have up to 64 bits.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    order = ["key", F.xxhash64("text"), "text"]
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    spread = rows.repartitionByRange(shuffle_partitions(spark), "key", F.xxhash64("text")).sortWithinPartitions(*order)
    spread.mapInArrow(_encode(tokenizer_path, end_id), SEGMENTS).write.option("compression", "snappy").parquet(path)
    return path


def _decode(per_doc: Callable[[np.ndarray, int, int], list], fields: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.unpack(row["payload"])
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - np.array(row["lengths"], np.int64)
                columns = [
                    pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["keys"], pa.int64()), pa.array(row["first"] + starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([per_doc(ids, int(a), int(b)) for a, b in zip(starts, ends)], fields[0][1]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "local", "n_tokens", fields[0][0]])

    return run


def _placed(spark: SparkSession, path: str, per_doc: Callable, name: str, kind: pa.DataType, ddl: str) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", F.expr("aggregate(lengths, 0L, (s, n) -> s + n)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # one row per written partition: the broadcast is bounded by the partition count
    bases = sizes.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    docs = segments.mapInArrow(_decode(per_doc, [(name, kind)]), f"part int, key long, local long, n_tokens long, {name} {ddl}")
    return docs.join(F.broadcast(bases), "part").select(F.col("key").alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", name)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    return _placed(spark, path, lambda ids, a, b: zlib.crc32(ids[a:b].astype("<u4").tobytes()), "ids_crc32", pa.int64(), "long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) of every document, decoded from the files."""
    return _placed(spark, path, lambda ids, a, b: ids[a:b].astype(np.int64), "ids", pa.list_(pa.int64()), "array<long>")
