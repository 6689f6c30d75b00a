"""Document quality: supervised subword embeddings.

Hashed word and character n-gram vectors are averaged per document and trained
with the softmax above them.  Case and punctuation are kept, and a word that
repeats the one before it has a feature of its own: shouting, symbol noise and
stuttering are what low quality looks like.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import release_memory
from kinweave.llm.subword import Settings, trained
from kinweave.llm.toxicity import _scored

SETTINGS = Settings(lower=False, ngrams=(2, 3), pad=20, repeats=True, max_train=3_000)
FOLDS, HELD_OUT = 3, 1


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, folds: int = FOLDS, fold: int = HELD_OUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key and other columns but the text, with held_out, score (0 to 1) and predicted (score >= 0.5).

    Learns ``quality`` as ``toxicity.score_toxicity`` learns ``toxic``; the same
    rules hold for nulls, empty texts, repeated rows and clashing names.
    """
    model = trained(docs, labels, "quality", folds, fold, settings, key, text)
    return _scored(docs, model, folds, fold, key, text)


def keep_quality(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, folds: int = FOLDS, fold: int = HELD_OUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose quality score is at least 0.5.

    Null, empty and blank texts get the score of an empty bag and stay or go
    together; null keys are ordinary; repeated rows are judged alike; an empty
    table stays empty; without labels of both classes the smoothed share of
    label 1 decides for all rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, "quality", folds, fold, settings, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = shared.value.scores(batch.column(batch.schema.get_field_index(text))) >= 0.5
            yield batch.filter(pa.array(good))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
