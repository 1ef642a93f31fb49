"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of non-letters becomes one blank, and the n-grams of 1 to
``ORDERS`` characters are hashed into ``BUCKETS`` buckets.  Counts by language and bucket are
summed over all labelled rows; the smoothed log-probabilities, one row per language, are
broadcast, and every batch of texts is scored by look-ups in them.

Bounds: a task holds the counts of at most ``_LANGUAGES`` languages before it passes them
on, and works on about ``_PIECE`` characters at a time; the broadcast has 4 * BUCKETS bytes
for each language that the labels name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import rows

ORDERS = 4
BUCKETS = 1 << 16
SMOOTHING = 0.1
UNKNOWN = "und"
_LANGUAGES = 64
_PIECE = 1 << 20
_BLANK = 0x20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(48)  # the upper 16 bits number 2**16 buckets
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter (made once in a process)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two blanks, each run of non-letters one blank; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter()[points]
    if not letter.any():
        return points[:0]
    before = np.concatenate(([False], letter[:-1]))
    kept = np.where(letter, points, np.uint32(_BLANK))[letter | before]
    ends = [[_BLANK], kept] if kept[-1] == _BLANK else [[_BLANK], kept, [_BLANK]]
    return np.concatenate(ends).astype(np.uint32)


def buckets_of(points: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For each order n, the bucket of the n-gram that begins at each place; BUCKETS where it would leave its text."""
    out, h = [], np.zeros(len(points), dtype=np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    for n in range(ORDERS):
        m = len(points) - n
        if m <= 0:
            break
        h = h[:m] * _MULT + wide[n:]
        found = ((h ^ (h >> np.uint64(29))) * _MULT >> _SHIFT).astype(np.int32)
        out.append(np.where(owner[:m] == owner[n:], found, BUCKETS))
    return out


def pieces(texts):
    """(points, owner, first) over the texts, about _PIECE characters at a time; a longer text comes in several parts.

    ``owner`` numbers the text of each character, ``first`` is the text of the first one.
    Parts of one text overlap by ORDERS - 1 characters, whose n-grams are the next part's.
    """
    points, owners, size = [], [], 0
    for i, text in enumerate(texts):
        p = characters(text)
        for at in range(0, max(1, len(p) - ORDERS + 1), _PIECE):
            last = at + _PIECE >= len(p) - ORDERS + 1
            part = p[at:] if last else p[at:at + _PIECE + ORDERS - 1]
            if not len(part):
                continue
            own = np.full(len(part), i, dtype=np.int32)
            points.append(part)
            owners.append(own)
            size += len(part)
            if size >= _PIECE:
                yield np.concatenate(points), np.concatenate(owners), not last
                points, owners, size = [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(owners), False


def _grams(texts):
    """(bucket, owner) arrays of all n-grams, by order and piece; places outside a text are left out."""
    for points, owner, goes_on in pieces(texts):
        for n, found in enumerate(buckets_of(points, owner)):
            if goes_on:  # the last characters begin the next part
                found = found[:len(points) - ORDERS + 1]
            yield found, owner[:len(found)]


def _counts(batches):
    """Partial (lang, docs, bucket, count) rows of labelled texts."""
    langs: dict[str, int] = {}
    table = np.zeros((_LANGUAGES, BUCKETS + 1), dtype=np.int64)
    docs = np.zeros(_LANGUAGES, dtype=np.int64)

    def flush():
        names = pa.array(list(langs), pa.string())
        for name, i in langs.items():
            at = np.flatnonzero(table[i, :BUCKETS])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(at) + 1, i), pa.int64())), pa.array(np.append(at, -1), pa.int32()),
                                              pa.array(np.append(table[i, at], docs[i]), pa.int64())], names=["lang", "bucket", "count"])
        langs.clear()
        table[:] = 0
        docs[:] = 0

    for batch in batches:
        texts, labels = [], []

        def add():
            label = np.array([langs[x] for x in labels], dtype=np.int64)
            docs[:] += np.bincount(label, minlength=_LANGUAGES)
            for found, owner in _grams(texts):
                flat = label[owner] * (BUCKETS + 1) + found
                table[:] += np.bincount(flat, minlength=table.size).reshape(table.shape)
            texts.clear()
            labels.clear()

        for text, lang in rows(batch, "text", "lang"):
            if lang not in langs:
                if len(langs) == _LANGUAGES:
                    add()
                    yield from flush()
                langs[lang] = len(langs)
            texts.append(text)
            labels.append(lang)
        if texts:
            add()
    yield from flush()


def _log_probabilities(counts: pd.DataFrame) -> pd.DataFrame:
    """One language's smoothed log-probabilities and number of texts."""
    full = np.full(BUCKETS, SMOOTHING)
    real = counts["bucket"] >= 0
    full[counts["bucket"][real].to_numpy()] += counts["count"][real].to_numpy()
    return pd.DataFrame({"lang": counts["lang"].iloc[:1], "docs": [int(counts["count"][~real].sum())],
                         "logp": [np.log(full / full.sum()).astype(np.float32).tobytes()]})


def learn_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-priors, log-probabilities by language and bucket) of all rows that have a language; null texts are empty."""
    known = labelled.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null")
    counts = known.mapInArrow(_counts, "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count"))
    # one group has a row for each bucket at most
    model = counts.groupBy("lang").applyInPandas(_log_probabilities, "lang string, docs long, logp binary").collect()
    model.sort(key=lambda r: r["lang"])
    docs = np.array([r["docs"] for r in model], dtype=float)
    logp = np.zeros((len(model), BUCKETS + 1), dtype=np.float32)  # the last bucket, outside a text, weighs nothing
    for i, r in enumerate(model):
        logp[i, :BUCKETS] = np.frombuffer(r["logp"], dtype=np.float32)
    return [r["lang"] for r in model], np.log(docs / max(1.0, docs.sum())), logp


def log_likelihoods(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Sum of log-probabilities of each text's n-grams, by language."""
    out = np.zeros((len(texts), len(logp)))
    for found, owner in _grams(texts):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
        if len(starts):
            for lang in range(len(logp)):
                out[owner[starts], lang] += np.add.reduceat(logp[lang][found], starts, dtype=np.float64)
    return out


def _predict(batches, model):
    langs, prior, logp = model.value
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        texts = [column[i].as_py() or "" for i in range(batch.num_rows)]
        # overlapping n-grams say the same thing ORDERS times
        total = prior + log_likelihoods(texts, logp) / ORDERS if langs else np.zeros((len(texts), 1))
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        best = total.argmax(axis=1)
        score = share[np.arange(len(texts)), best] / share.sum(axis=1)
        named = [bool(langs) and any(map(str.isalpha, t)) for t in texts]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array([langs[b] if ok else UNKNOWN for b, ok in zip(best, named)], pa.string()),
             pa.array(np.where(named, score, 0.0), pa.float64())], names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score"])


def held_out(id_col: str) -> Column:
    """True for rows that nothing is learned from: crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score), one row for each row of ``docs``, learned from all rows of ``labelled``.

    ``score`` is the posterior probability of the language named.  Null and empty texts and
    texts without a letter are ``und`` with score 0, as are all texts if no row is labelled.
    Equal posteriors go to the language that sorts first.  Repeated rows are scored alike;
    rows with a null language teach nothing, null texts teach only how frequent their
    language is.  A null id passes through.  Other columns are never read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn_languages(labelled, text_col, lang_col))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(lambda it: _predict(it, model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
