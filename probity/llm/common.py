"""Shared helpers: tables in the shared folder, words, word shingles.

Words are cut from UTF-8 bytes: ``bytes.lower`` changes A-Z only and ``bytes.split``
splits at exactly 0x20 and 0x09-0x0D, which is the word rule of the shingle operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.session import ensure_checkpoint_dir

#: Words whose hashes a task keeps; beyond that the store is emptied (memory bound only).
WORD_STORE = 400_000
#: Ids (8 bytes each) that one broadcast may hold.
BROADCAST_IDS = 1 << 21
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shared_path(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` (set for local sessions only where unset)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/probity-llm/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at those files."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of a query that runs here go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def as_bytes(name: str):
    """Column of a text as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit(b"").cast("binary"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not in the only column of ``ids``; rows with a null id stay.

    The ids are worked out first: up to ``BROADCAST_IDS`` of them go to every task and the
    rows of ``df`` stay where they are; more are met by a shuffle of both sides.
    """
    name = fresh_name(df, "_id")
    gone = materialise(ids.toDF(name).where(f"`{name}` is not null").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(f"`{name}`"), "left_anti")


def total_bytes(df: DataFrame, text_col: str) -> int:
    """Sum of text lengths in bytes (one aggregate row comes back)."""
    return int(df.select(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("b")).first()["b"] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen most recently."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORD_STORE:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in text order; a shorter text is one shingle, an empty one none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    acc = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        acc = acc * _MULT + word_hashes[i:n - k + 1 + i]
    return mix(acc)


class Shingler:
    """text bytes -> shingle hashes in text order."""

    def __init__(self, k: int):
        self.k, self.words = k, WordHashes()

    def sequence(self, text: bytes) -> np.ndarray:
        return shingles(self.words.of(text.lower().split()), self.k)

    def distinct(self, text: bytes) -> np.ndarray:
        return np.unique(self.sequence(text))


def rows(batch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch, one value at a time (a batch of long texts is never copied whole)."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in cols)
