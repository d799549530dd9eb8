"""Structured Streaming forms: cleaning and chunking keep no state; first-wins dedup keeps keys within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kgloom.operators import segment
from kgloom.plans.pipelines import cleaned

KEY = ("head", "relation", "tail")


def stream_chunks(docs: DataFrame, max_chars: int = 150) -> DataFrame:
    """Cleaned chunks of a stream of (doc_id, text)."""
    return segment.chunks(cleaned(docs).select("doc_id", "text"), max_chars)


def stream_dedup(triples: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first triple of a key to arrive; keys older than the watermark are forgotten, so state is bounded."""
    return triples.withWatermark(time, late).dropDuplicatesWithinWatermark(list(KEY))


def stream_first(triples: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """head, relation, tail, source, method, ord (a bigint): of each key the triple of the least ord so far, and again whenever one of a lesser ord arrives.

    The state of a key is its least ord; it goes when the watermark has passed the key's last event by ``late``. In whatever order triples of one key arrive within
    that time, the last row told of it is the one that first-wins dedup gives, so :func:`settled` of all rows equals dedup of all triples. A triple that comes after its
    key was forgotten begins anew, and settling decides between both. Rows with a null in the key are keys as others; a null ord is the last of all.
    """
    schema = "head string, relation string, tail string, source string, method string, ord bigint"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, found, last = (state.get[0] if state.exists else None), None, state.get[1] if state.exists else 0
        for f in frames:
            last = max(last, int(f["__time"].max()))
            known = f.dropna(subset=["ord"])
            row = known.loc[known["ord"].idxmin()] if len(known) else None
            if row is not None and (best is None or int(row["ord"]) < best):
                best, found = int(row["ord"]), row
            elif best is None and found is None and not state.exists:
                found = f.iloc[0]
        state.update((best, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if found is not None:
            yield pd.DataFrame([{**dict(zip(KEY, key)), "source": found["source"], "method": found["method"], "ord": best}]).astype({"ord": "Int64"})

    own = triples.withWatermark(time, late).select(*KEY, "source", "method", F.col("ord").cast("bigint").alias("ord"), F.unix_millis(time).alias("__time"), time)
    return own.groupBy(*KEY).applyInPandasWithState(run, schema, "ord bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def settled(told: DataFrame) -> DataFrame:
    """Of the rows that :func:`stream_first` has told of each key, that of the least ord."""
    rest = ("source", "method", "ord")
    first = told.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct(F.col("ord").isNull(), "ord")).alias("f"))
    return first.select(*KEY, *(F.col(f"f.{c}") for c in rest))


def process_new(spark: SparkSession, source: str, target: str, checkpoint: str, max_chars: int = 150) -> StreamingQuery:
    """S12 as a stream: chunks of the Parquet documents that came since the last run; the checkpoint knows what is done."""
    docs = spark.readStream.schema("doc_id string, text string").parquet(source)
    return stream_chunks(docs, max_chars).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
