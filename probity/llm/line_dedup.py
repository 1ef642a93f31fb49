"""Line dedup: two Bloom filters for once-seen and twice-seen hashes, exact confirmation of suspects.

Every task keeps a filter of line hashes it has seen and one of those it has seen again;
merged, the second holds every line that two documents share (``filters.repeat_filter``).
Only lines found in it shuffle, as text, for the exact count of documents and the choice of
the document that keeps them; a false positive is dropped there.  Texts move once, to meet
their own lists of lines to drop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from probity.llm import filters
from probity.llm.common import as_bytes, fresh_name, materialise, rows, total_bytes

HASHES = 4
BITS_PER_LINE = 16


def line_key(line: bytes) -> bytes:
    """The line without 0x20, 0x09-0x0D at its ends and with A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def distinct_keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if _long_enough(k, least)}


def _hashes(keys) -> np.ndarray:
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys)))


def _suspects(batches, least, again):
    for batch in batches:
        ids, keys = [], []
        for id_, data in rows(batch, "id", "data"):
            own = list(distinct_keys(data, least))
            if own:
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
                for i in np.flatnonzero(filters.contains(again.value, hashes, HASHES)):
                    ids.append(id_)
                    keys.append(own[i])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])


def _without(data: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Lines and dropped lines of each text; the text that stays where any line went (else null)."""
    out = []
    for text, keys in zip(data, gone):
        lines = text.split(b"\n")
        kept = None
        if keys is not None and len(keys):
            keys = set(keys)
            left = [x for x in lines if line_key(x) not in keys]
            if len(left) < len(lines):
                kept = left
        out.append((len(lines), 0 if kept is None else len(lines) - len(kept), None if kept is None else b"\n".join(kept)))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without lines that ``min_docs`` documents share, plus n_lines and n_dropped.

    A key of at least ``min_chars`` code points found under at least ``min_docs`` distinct
    ids loses all its lines except in the largest id that holds it (there all of them stay).
    Null and empty texts are one empty line; a null text stays null.  Rows that repeat an id
    are one document for the count and are treated alike.  Rows whose id is null count for
    no line and stay as they are.
    Columns named n_lines or n_dropped are replaced, all other columns pass through.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(text_col).alias("data")).where("id is not null")
    log2 = filters.log2_bits(total_bytes(docs, text_col) / 128, BITS_PER_LINE)
    again = spark.sparkContext.broadcast(
        filters.repeat_filter(known.select("data"), lambda: lambda text: _hashes(distinct_keys(text, min_chars)), log2, HASHES))
    suspects = materialise(known.mapInArrow(lambda it: _suspects(it, min_chars, again), "id long, key binary"))

    # count(distinct) spreads a hot line over (key, id) before its partial counts meet
    repeats = (suspects.groupBy("key").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keep"))
               .where(F.col("docs") >= min_docs).select("key", "keep"))
    gone = (suspects.join(repeats, "key").where("id <> keep").groupBy(F.col("id").alias("_id"))
            .agg(F.collect_set("key").alias("_gone")))

    without = pandas_udf(_without, "n_lines long, n_dropped long, kept binary")
    base = docs.drop("n_lines", "n_dropped")
    own, drops, cut = (fresh_name(base, name) for name in ("_id", "_gone", "_cut"))
    gone = gone.toDF(own, drops)
    text = F.col(f"`{text_col}`")
    done = (base.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(own), "left")
            .withColumn(cut, without(as_bytes(text_col), F.col(drops))))
    cols = [F.coalesce(F.col(f"{cut}.kept").cast("string"), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns]
    return done.select(*cols, F.col(f"{cut}.n_lines").alias("n_lines"), F.col(f"{cut}.n_dropped").alias("n_dropped"))

