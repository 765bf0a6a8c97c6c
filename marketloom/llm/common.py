"""Helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5  # words in one shingle
SIMILARITY = 0.8  # from this similarity on, texts count as near duplicates

# A side of a join is broadcast up to this many rows, which callers keep to a few dozen bytes each;
# beyond it the join shuffles, with the same result.
BROADCAST_ROWS = 200_000

# Words of a shingle: runs of letters and digits of the lower-cased text. The Java and SQL pattern
# separates words, the Python pattern finds them; both see the same words.
NOT_WORD = r"[^\p{L}\p{N}]+"
FIND_WORDS = re.compile(r"[^\W_]+").findall


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, whatever columns it brings along."""
    taken = {name.lower() for name in frame.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session without
    that setting gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def durable(frame: DataFrame) -> DataFrame:
    """The frame stored reliably: later steps neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """The frame stored as a compressed table in the checkpoint folder, for what is too large to store plain."""
    ensure_checkpoint_dir(frame.sparkSession)
    path = f"{frame.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_side(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored frame, marked for broadcast if its counted rows stay within the bound."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def row_key(doc_id: str, text: str) -> Column:
    """Identifies a row by id and text, so that missing or repeated ids do no harm. Rows that
    agree in both are interchangeable."""
    return F.concat_ws(
        ":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    )


def sparse_hash(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all bits (a fixed invertible mixing)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))
