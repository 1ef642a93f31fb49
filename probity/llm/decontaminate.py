"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

Items are partitioned by the size of their shingle sets (powers of two, after Zhu et al.,
"LSH Ensemble", 2016), so that within a partition containment and resemblance to a window
of known size go together.  For sizes up to s, documents are cut into windows of 3s
shingles, one every s: an item's passage, up to 2s shingles long, lies whole in one window.
Windows and items have one-permutation MinHash signatures of 4s bins; an item is a candidate
where a bin of its signature equals the window's.  For items of up to SHORT shingles, which
have too few bins for that, any common shingle makes a candidate.  Every candidate is then verified against
the document's whole shingle set.

The benchmark is the stated query set: it is read in blocks of bounded size, and documents
are scanned once for each block, without any shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import Shingler, as_bytes, rows, total_bytes, without_ids

#: Bytes of benchmark text that one broadcast block stands for (its shingles take about 1.5 times that).
BLOCK_BYTES = 32 << 20
SMALLEST = 16
SHORT = 8                   # shingles; an item of so few is a candidate wherever one of them stands
_PROBE = 20


def _bins(size: int) -> int:
    return int(math.log2(4 * size))


def _bin(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(64 - _bins(size))).astype(np.int64)


def minima(hashes: np.ndarray, size: int) -> np.ndarray:
    """Signature of a sorted set as its bins' least hashes."""
    return hashes[np.unique(_bin(hashes, size), return_index=True)[1]]


class ItemIndex:
    """Signatures of a block of items, by size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        parts: dict[int, list[int]] = {}
        short = [i for i, (_, own) in enumerate(items) if 0 < len(own) <= SHORT]
        keys = np.concatenate([items[i][1] for i in short] or [np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.array(short, dtype=np.int64), [len(items[i][1]) for i in short])
        order = np.argsort(keys, kind="stable")
        self.short = (keys[order], owner[order], self._probe(keys))
        for i, (_, own) in enumerate(items):
            if len(own) > SHORT:
                parts.setdefault(max(SMALLEST, 1 << (len(own) - 1).bit_length()), []).append(i)
        self.parts = []
        for size, members in sorted(parts.items()):
            keys = np.concatenate([minima(items[i][1], size) for i in members])
            owner = np.concatenate([np.full(len(minima(items[i][1], size)), i) for i in members])
            order = np.argsort(keys, kind="stable")
            self.parts.append((size, keys[order], owner[order], self._probe(keys)))

    @staticmethod
    def _probe(keys: np.ndarray) -> np.ndarray:
        probe = np.zeros(1 << _PROBE, dtype=bool)
        probe[keys >> np.uint64(64 - _PROBE)] = True
        return probe

    def candidates(self, seq: np.ndarray) -> set[int]:
        """Short items of which the document holds a shingle, others whose signature meets that of some window."""
        found: set[int] = set()
        keys, owner, probe = self.short
        if len(keys):
            hit = np.unique(seq[probe[seq >> np.uint64(64 - _PROBE)]])
            for a, b in zip(np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")):
                found.update(owner[a:b].tolist())
        for size, keys, owner, probe in self.parts:
            at = np.flatnonzero(probe[seq >> np.uint64(64 - _PROBE)])
            at = at[np.isin(seq[at], keys)] if len(at) else at
            if not len(at):
                continue
            bins = 1 << _bins(size)
            strides = len(seq) // size + 1
            low = np.full((strides + 2, bins), np.iinfo(np.uint64).max, dtype=np.uint64)
            np.minimum.at(low.reshape(-1), (np.arange(len(seq)) // size) * bins + _bin(seq, size), seq)
            windows = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:])  # window w: strides w, w+1, w+2
            hash_, stride, bin_ = seq[at], at // size, _bin(seq[at], size)
            is_low = np.zeros(len(at), dtype=bool)
            for back in range(3):
                w = stride - back
                is_low |= (w >= 0) & (windows[np.maximum(w, 0), bin_] == hash_)
            hit = np.unique(hash_[is_low])
            left, right = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            for a, b in zip(left, right):
                found.update(owner[a:b].tolist())
        return found


def _search(batches, k, percent, index):
    shingler = Shingler(k)
    for batch in batches:
        out = []
        for id_, data in rows(batch, "id", "data"):
            seq = shingler.sequence(data)
            if not len(seq):
                continue
            candidates = index.value.candidates(seq)
            if candidates:
                own = np.unique(seq)
                for i in sorted(candidates):
                    item_id, item = index.value.items[i]
                    at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                    shared = int((own[at] == item).sum())
                    if 100 * shared >= percent * len(item):
                        out.append((id_, item_id, len(item), shared))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["id", "item", "n_item", "n_shared"])


def _item_sets(batches, k):
    shingler = Shingler(k)
    for batch in batches:
        got = [(i, shingler.distinct(data).view(np.int64)) for i, data in rows(batch, "id", "data")]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["id", "own"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, item, n_item, n_shared, containment) where a document holds at least ``percent`` % of an item's shingles.

    Texts are compared as sets of ``k``-word shingles.  A null or empty text has none: such
    an item is found nowhere and such a document holds nothing; an item of fewer than ``k``
    words is one shingle and is found only as a whole document.  Repeated rows on either
    side give a row each, null ids are carried as null, other columns are ignored, and an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(text_col).alias("data"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), as_bytes(item_text_col).alias("data"))
    blocks = max(1, -(-total_bytes(benchmark, item_text_col) // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "data"), F.lit(blocks)) == block) if blocks > 1 else items
        sets = part.mapInArrow(lambda it: _item_sets(it, k), "id long, own array<long>").collect()  # one block of the query set
        index = spark.sparkContext.broadcast(ItemIndex([(r["id"], np.array(r["own"], dtype=np.int64).view(np.uint64)) for r in sets]))
        hits = base.mapInArrow(lambda it, index=index: _search(it, k, percent, index), "id long, item long, n_item long, n_shared long")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without rows whose id holds a benchmark item; rows with a null id are judged not at all and stay."""
    return without_ids(docs, id_col, find_contamination(docs, benchmark, id_col, text_col, **options).select(id_col))
