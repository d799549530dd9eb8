"""A store of a model's answers (M6, S12): what has been asked is not asked again, in a later run or after one that failed.

An answer is kept under the hash of the model's name and the prompt. Tasks write what they have every few answers, under a name of their attempt, and move it
when it is complete, so a job that fails keeps all answers but the last few of each task; answers that a repeated task gives twice count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.sources.io import _exists, _opened

SCHEMA = "key string, answer string"


def key_of(prompt: Column, model_name: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model_name}\n"), prompt), 256)


def known(spark: SparkSession, store: str) -> DataFrame:
    """key, answer: one row a key; an empty table where nothing has been stored. Of answers to one key the least stays, so every reader sees the same."""
    if not _exists(spark, store):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(store).groupBy("key").agg(F.min("answer").alias("answer"))


def unasked(prompts: DataFrame, store: str, model_name: str) -> DataFrame:
    """key, prompt of the distinct prompts (prompt) without an answer in the store; null prompts are none."""
    own = prompts.where("prompt is not null").select(key_of(F.col("prompt"), model_name).alias("key"), "prompt").groupBy("key").agg(F.first("prompt").alias("prompt"))
    return own.join(known(prompts.sparkSession, store), "key", "left_anti")


def ask(prompts: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]], store: str, model_name: str, size: int = 16, kept_every: int = 64) -> int:
    """Asks what :func:`unasked` gives, stores the answers, and tells how many there are. The store's folder is one that pyarrow.fs opens and all executors share."""
    fs, root = _opened(store)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(store)
        answer, n, held = model(), 0, ([], [])
        attempt = f"{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}"

        def keep() -> None:
            nonlocal n
            if held[0]:
                with fs.open_output_stream(f"{root}/.{attempt}-{n}") as out:
                    pq.write_table(pa.table({"key": pa.array(held[0], pa.string()), "answer": pa.array(held[1], pa.string())}), out)
                n += len(held[0])
                fs.move(f"{root}/.{attempt}-{n - len(held[0])}", f"{root}/{attempt}-{n}.parquet")
                for own in held:
                    own.clear()

        for batch in batches:
            keys, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(own), size):
                told = answer(own[a : a + size])
                held[0].extend(keys[a : a + size])
                held[1].extend(t for _, t in zip(own[a : a + size], told, strict=True))
                if len(held[0]) >= kept_every:
                    keep()
        keep()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return unasked(prompts, store, model_name).select("key", "prompt").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def answered(prompts: DataFrame, store: str, model_name: str) -> DataFrame:
    """prompts with the answers that the store has; null where it has none."""
    own = prompts.withColumn("__key", key_of(F.col("prompt"), model_name))
    return own.join(known(prompts.sparkSession, store).withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
