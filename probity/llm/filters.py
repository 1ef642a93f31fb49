"""Corpus-wide sketches of bounded size, built in place by every task and merged by section.

``repeat_filter``: two Bloom filters, one of hashes seen once and one of hashes seen again.
A key held by two documents is always in the merged second filter, whichever tasks read
them: two documents of one task set it there, documents of two tasks set the same bits in
both tasks' first filters and the merge keeps bits set in two of them.  A false positive
only makes a caller look closer.  ``count_sketch``: approximate document frequencies, used
for ordering alone.

Sizes follow the input up to a documented cap, so what is broadcast is bounded by the cap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from probity.llm.common import mix, rows

SECTION = 1 << 16           # bytes of a filter that are merged together
MERGE_TASKS = 64
MAX_LOG2_BITS = 30          # 128 MB for each filter
MAX_LOG2_COUNTERS = 23
LOG_STEPS = 8               # counters keep 8 steps for each power of two


def log2_bits(keys: float, per_key: float, cap: int = MAX_LOG2_BITS) -> int:
    return int(min(cap, max(19, math.ceil(math.log2(max(1.0, keys * per_key))))))


def positions(keys: np.ndarray, log2: int, hashes: int) -> list[np.ndarray]:
    """Bit numbers of each key, by double hashing."""
    step = (keys >> np.uint64(33)) | np.uint64(1)
    mask = np.uint64((1 << log2) - 1)
    return [((keys + np.uint64(i) * step) & mask).astype(np.int64) for i in range(hashes)]


def _bits(pos: np.ndarray) -> np.ndarray:
    return np.left_shift(np.uint8(1), (pos & 7).astype(np.uint8))


def contains(bitmap: np.ndarray, keys: np.ndarray, hashes: int) -> np.ndarray:
    """Mask of the keys whose bits are all set."""
    found = np.ones(len(keys), dtype=bool)
    for pos in positions(keys, int(math.log2(len(bitmap) * 8)), hashes):
        found &= (bitmap[pos >> 3] & _bits(pos)) != 0
    return found


def _sections(*arrays: np.ndarray):
    """Batches of (section, compressed bytes of each array), without empty sections."""
    raw = [a.view(np.uint8) for a in arrays]
    names = ["section", *(f"a{i}" for i in range(len(raw)))]
    width = min(SECTION, len(raw[0]))
    for start in range(0, len(raw[0]), width * 16):
        out = []
        for at in range(start, min(start + width * 16, len(raw[0])), width):
            parts = [r[at:at + width] for r in raw]
            if any(p.any() for p in parts):
                out.append((at // width, *(pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[1 + i] for r in out], pa.binary()) for i in range(len(raw)))],
                names=names)


def _merged(parts: DataFrame, merge: Callable, finish: Callable, size: int, raw: int | None = None) -> np.ndarray:
    """Merge sections in streams (a task holds its own sections only) and put them together.

    ``raw``: bytes before ``finish``, if not ``size``.
    """
    raw = raw or size
    packed = min(SECTION, raw)

    def run(batches):
        kept: dict[int, tuple] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                new = tuple(np.frombuffer(pa.decompress(x, packed, codec="zstd", asbytes=True), dtype=np.uint8) for x in row[1:])
                kept[row[0]] = merge(kept.get(row[0]), new)
        for section, state in kept.items():
            yield pd.DataFrame({"section": [section], "bytes": [pa.compress(finish(state).tobytes(), codec="zstd", asbytes=True)]})

    merged = parts.repartition(max(1, min(MERGE_TASKS, raw // SECTION)), "section").mapInPandas(run, "section int, bytes binary")
    out = np.zeros(size, dtype=np.uint8)
    width = size // (raw // packed)
    for row in merged.collect():  # bounded by the cap on the filter's size
        out[row["section"] * width:(row["section"] + 1) * width] = np.frombuffer(pa.decompress(row["bytes"], width, codec="zstd", asbytes=True), dtype=np.uint8)
    return out


def repeat_filter(df: DataFrame, make_keys: Callable[[], Callable[[bytes], np.ndarray]], log2: int, hashes: int) -> np.ndarray:
    """Bitmap of keys that at least two rows of ``df`` (one binary column ``data``) hold.

    ``make_keys()`` runs once for each task and returns the function from a row's bytes
    to its distinct uint64 keys.
    """
    def run(batches):
        keys_of = make_keys()
        once = np.zeros((1 << log2) // 8, dtype=np.uint8)
        again = np.zeros_like(once)
        for batch in batches:
            for (data,) in rows(batch, "data"):
                keys = keys_of(data)
                if not len(keys):
                    continue
                for pos in positions(keys, log2, hashes):
                    byte, bit = pos >> 3, _bits(pos)
                    seen = (once[byte] & bit) != 0
                    if seen.any():
                        np.bitwise_or.at(again, byte[seen], bit[seen])
                    np.bitwise_or.at(once, byte, bit)
        yield from _sections(once, again)

    def merge(old, new):
        if old is None:
            return [x.copy() for x in new]
        old[1] |= new[1] | (old[0] & new[0])
        old[0] |= new[0]
        return old

    return _merged(df.mapInArrow(run, "section int, a0 binary, a1 binary"), merge, lambda s: s[1], (1 << log2) // 8)


def count_sketch(df: DataFrame, make_keys: Callable[[], Callable[[bytes], np.ndarray]], log2: int) -> np.ndarray:
    """For each of 2**log2 buckets, LOG_STEPS * log2 of the rows' keys that fell into it (0: none or one)."""
    def run(batches):
        keys_of = make_keys()
        counts = np.zeros(1 << log2, dtype=np.uint32)
        for batch in batches:
            for (data,) in rows(batch, "data"):
                keys = keys_of(data)
                if len(keys):
                    np.add.at(counts, bucket(keys, log2), np.uint32(1))
        yield from _sections(counts)

    def merge(old, new):
        new = new[0].view(np.uint32).astype(np.uint64)
        return new if old is None else old + new

    def finish(counts):
        return np.round(LOG_STEPS * np.log2(np.maximum(counts, 1))).astype(np.uint8)

    width = 1 << log2
    parts = df.mapInArrow(run, "section int, a0 binary")
    return _merged(parts, merge, finish, width, 4 * width)


def key_filter(ids: DataFrame, log2: int, hashes: int) -> np.ndarray:
    """Bloom filter of the values of the only column of ``ids`` (long)."""
    def run(batches):
        bits = np.zeros((1 << log2) // 8, dtype=np.uint8)
        for batch in batches:
            for pos in positions(id_keys(batch.column(0).to_numpy(zero_copy_only=False)), log2, hashes):
                np.bitwise_or.at(bits, pos >> 3, _bits(pos))
        yield from _sections(bits)

    return _merged(ids.mapInArrow(run, "section int, a0 binary"), lambda old, new: new[0] if old is None else old | new[0],
                   lambda bits: bits, (1 << log2) // 8)


def id_keys(ids: np.ndarray) -> np.ndarray:
    return mix(np.asarray(ids, dtype=np.int64).view(np.uint64))


def bucket(keys: np.ndarray, log2: int) -> np.ndarray:
    return (keys >> np.uint64(64 - log2)).astype(np.int64)
