"""Scoring a streaming DataFrame with saved models.

With fixed fitted models, scoring (preprocess -> model -> calibrator) and the
joint-risk tier are stateless projections, so they run unchanged on a
Structured Streaming DataFrame.  This is a convenience, not a reference
feature: the reference scores files in batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score_models


def score_stream(stream: DataFrame, models_root: str, id_col: str = "row_id",
                 types: Mapping[str, str] | None = None) -> DataFrame:
    """Long scores (row_index, tag, outcome, featureset, model, prob, prob_calibrated) for each arriving row."""
    return score_models(stream, models_root, id_col, types)


def write_scores(scores: DataFrame, path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Append scores to Parquet, partitioned by outcome; exactly-once through the checkpoint location."""
    w = (scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy("outcome").outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
