"""Deterministic pseudo-random draws from row keys (H3).

``rand()``/``randn()``/``randomSplit`` depend on partition layout, so a re-run on a
different cluster (or after an executor loss) would draw other numbers.  Every random
choice in this package is instead a hash of (salt, row id): the same row always gets
the same draw, whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from probity.functions.util import as_col

TWO_POW_32 = 4294967296.0


def _keyed(id_cols, salt) -> Column:
    parts = [] if salt is None else [F.lit(str(salt))]
    parts += [as_col(c).cast("string") for c in id_cols]
    return F.concat_ws(":", *parts)


def hash_u32(*id_cols, salt=None) -> Column:
    """First 32 bits of md5(salt:id) as a bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(_keyed(id_cols, salt)), 1, 8), 16, 10).cast("bigint")


def hash01(*id_cols, salt=None) -> Column:
    """Uniform draw in [0, 1) from md5(salt:id)."""
    return hash_u32(*id_cols, salt=salt) / F.lit(TWO_POW_32)


def hash_hex(*id_cols, salt=None) -> Column:
    """The eight hexadecimal digits behind ``hash_u32``: they compare as the number does."""
    return F.substring(F.md5(_keyed(id_cols, salt)), 1, 8)


def hash_open01(*id_cols, salt=None) -> Column:
    """Uniform draw in (0, 1): safe for ``ln``."""
    return (hash_u32(*id_cols, salt=salt) + F.lit(0.5)) / F.lit(TWO_POW_32)


def hash_long(*id_cols, salt=None) -> Column:
    """60-bit hash used as a numeric tie-breaker that ordering windows can bucket."""
    return F.conv(F.substring(F.md5(_keyed(id_cols, salt)), 1, 15), 16, 10).cast("bigint")


def gaussian(*id_cols, salt=None) -> Column:
    """Standard normal draw by Box-Muller from two independent hash draws."""
    u1 = hash_open01(*id_cols, salt=f"{salt}:u1")
    u2 = hash01(*id_cols, salt=f"{salt}:u2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def uniform(lo: float, hi: float, *id_cols, salt=None) -> Column:
    """Uniform draw in [lo, hi)."""
    return F.lit(float(lo)) + hash01(*id_cols, salt=salt) * F.lit(float(hi - lo))


def uniforms(*id_cols, salt, n: int) -> list[Column]:
    """``n`` independent uniforms in (0, 1) from ceil(n/4) md5 digests.

    Digest j is md5(salt#j:id...), and its four 32-bit words are four draws, so a
    row that needs several draws pays for one hash per four of them (Spark's
    subexpression elimination evaluates each digest once per row).
    """
    out = []
    for j in range((n + 3) // 4):
        digest = F.md5(_keyed(id_cols, f"{salt}#{j}"))
        for w in range(4):
            if len(out) == n:
                break
            word = F.conv(F.substring(digest, 1 + 8 * w, 8), 16, 10).cast("bigint")
            out.append((word + F.lit(0.5)) / F.lit(TWO_POW_32))
    return out


_MD5_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_MD5_ADDED = [int(abs(math.sin(i + 1)) * TWO_POW_32) for i in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_step(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The md5 states (4 by messages) after one block (16 words by messages)."""
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += words[g]
        f += np.uint32(_MD5_ADDED[i])
        low = f >> np.uint32(32 - _MD5_TURNS[i])
        f <<= np.uint32(_MD5_TURNS[i])
        f |= low
        f += b
        a, d, c, b = d, c, b, f
    return state + np.stack([a, b, c, d])


def md5_words(prefixes: list[bytes], suffixes: list[bytes]) -> np.ndarray:
    """The four 32-bit words of md5(prefix + suffix), words by prefixes by suffixes, as they stand in the digest's text."""
    n, m = len(prefixes), len(suffixes)
    ends = np.array([len(x) for x in suffixes])
    tail = np.zeros((m, ends.max() + 1), dtype=np.uint8)
    for row, text in zip(tail, suffixes):
        row[:len(text) + 1] = np.frombuffer(text + b"\x80", dtype=np.uint8)
    lengths = np.array([len(p) for p in prefixes])[:, None] + ends
    blocks = (lengths + 8) // 64 + 1
    data = np.zeros((n, m, 64 * int(blocks.max())), dtype=np.uint8)
    for row, p in zip(data, prefixes):
        row[:, :len(p)] = np.frombuffer(p, dtype=np.uint8)
        row[:, len(p):len(p) + tail.shape[1]] = tail[:, :row.shape[1] - len(p)]
    words, blocks = data.reshape(n * m, -1).view("<u4"), blocks.ravel()
    words[np.arange(n * m), 16 * blocks - 2] = 8 * lengths.ravel()
    words = np.ascontiguousarray(words.T)
    state = np.repeat(np.array(_MD5_START, dtype=np.uint32)[:, None], n * m, axis=1)
    for i in range(int(blocks.max())):
        after = _md5_step(state, words[16 * i:16 * i + 16])
        state = after if i == 0 else np.where(i < blocks, after, state)
    return state.byteswap().reshape(4, n, m)


def uniforms_of_runs(ids: list, runs: int, salt: str, n: int) -> np.ndarray:
    """The draws of ``uniforms`` for the keys (id, 0), ..., (id, runs - 1) of every id (null: left out of the key): n by ids by runs."""
    suffixes = [str(s).encode() for s in range(runs)]
    out = np.empty((4 * ((n + 3) // 4), len(ids), runs))
    for j in range((n + 3) // 4):
        head = f"{salt}#{j}:"
        out[4 * j:4 * j + 4] = md5_words([(head if x is None else f"{head}{x}:").encode() for x in ids], suffixes)
    out += 0.5
    out /= TWO_POW_32
    return out[:n]


def gaussians(*id_cols, salt, n: int) -> list[Column]:
    """``n`` standard normal draws: Box-Muller on pairs of ``uniforms``, both the
    cosine and the sine branch used."""
    us = uniforms(*id_cols, salt=salt, n=2 * ((n + 1) // 2))
    out = []
    for k in range(0, len(us), 2):
        r = F.sqrt(F.lit(-2.0) * F.log(us[k]))
        theta = F.lit(2.0 * math.pi) * us[k + 1]
        out += [r * F.cos(theta), r * F.sin(theta)]
    return out[:n]
