"""Matching a stream of single records against resolved reference entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from grove.functions.text import normalize
from grove.operators.blocking import key_candidates
from grove.operators.features import pair_features
from grove.plans.resolve import fuzzy_matches


def match_stream(records: DataFrame, s1: DataFrame, out: str, checkpoint: str, t: float = 75.0) -> StreamingQuery:
    """Appends s1, rec, p of each micro-batch's matches to the Parquet table out. s1: normalised reference entities."""

    def each(batch: DataFrame, _: int) -> None:
        recs = normalize(batch)
        fuzzy_matches(pair_features(key_candidates(s1, recs), s1, recs), t).write.mode("append").parquet(out)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
