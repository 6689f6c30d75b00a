"""Toxicity: a subword-bag embedding classifier on lower-cased text.

Words share the vectors of their character 2- to 5-grams, so misspelt insults
that no training row holds are near the ones that some do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import without
from kinweave.llm.subword import Settings, score_texts, trained

SETTINGS = Settings(lower=True, ngrams=(2, 3, 4, 5), pad=50, max_train=12_000)
FOLDS, HELD_OUT = 5, 0


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, folds: int = FOLDS, fold: int = HELD_OUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key and other columns but the text, with held_out, score (0 to 1) and predicted (score >= 0.5).

    Labels (``toxic``) are learnt from rows outside the held-out fold of
    crc32(key), at most ``settings.max_train`` of them.  Null, empty and blank
    texts have no words and get the score of an empty bag; a null key is never
    held out.  Repeated rows are scored alike.  Without labels of both classes
    the score is the smoothed share of label 1.  Input columns named like the
    added ones are replaced.
    """
    model = trained(docs, labels, "toxic", folds, fold, settings, key, text)
    return _scored(docs, model, folds, fold, key, text)


def _scored(docs: DataFrame, model, folds: int, fold: int, key: str, text: str) -> DataFrame:
    docs = without(docs, "held_out", "score", "predicted")
    keep = tuple(c for c in docs.columns if c not in (key, text))
    held = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % folds == fold, F.lit(False))
    return score_texts(docs, model, key, text, keep).select(
        F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in keep], held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
