"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitted on a bounded sample of labelled rows (``max_examples``): a vocabulary of words and
word beginnings whose presence goes with the label (chi-squared), the examples' vectors, and
an isotonic calibration of leave-one-out votes.  Document frequencies are counted over all
documents.  A document's score is the calibrated, distance-weighted vote of its ``k``
nearest examples, which are returned as evidence; a document without any term of the
vocabulary has no neighbour and gets the label's rate among such examples.

The index cuts examples into blocks and keeps each term's largest weight in each block.  A
query visits blocks by falling upper bound and stops when the bound cannot reach its k-th
best cosine, so the neighbours are exactly those of a full scan.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import materialise, rows, without_ids
from probity.llm.license_scan import words_of

MAX_EXAMPLES = 4_096
MAX_TERMS = 1_024
MIN_DOCS = 5
MIN_CHI2 = 30.0
PREFIXES = (4, 5, 6)
NEIGHBOURS = 16
BLOCK = 64
FEW = 6  # blocks scored one by one
_FLUSH = 300_000
_STORE = 400_000
_CACHE = 50_000


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings of 4 to 6 bytes (marked by a following *)."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def _words(text: str) -> list[bytes]:
    return words_of(text.lower().encode())


def _presence(batches):
    """Partial (term, documents, labelled 1) counts; a task holds at most _FLUSH terms."""
    docs, ones = Counter(), Counter()

    def flush():
        names = list(docs)
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([docs[t] for t in names], pa.int64()),
                                          pa.array([ones[t] for t in names], pa.int64())], names=["term", "docs", "ones"])
        docs.clear()
        ones.clear()
        return out

    for batch in batches:
        for text, label in rows(batch, "text", "label"):
            own = {t for w in set(_words(text)) for t in terms_of(w)}
            docs.update(own)
            if label:
                ones.update(own)
            if len(docs) > _FLUSH:
                yield flush()
    yield flush()


def _select_terms(sample: DataFrame, total: int, positive: int, max_terms: int) -> list[bytes]:
    """Terms by chi-squared of presence against the label."""
    n, p, d, o = float(total), float(positive), F.col("docs"), F.col("ones")
    expected = d * F.lit(p / n)
    chi2 = (o - expected) * (o - expected) * F.lit(n * n) / (d * F.lit(p) * F.lit(1 - p / n) * (F.lit(n) - d + 1e-9))
    counts = (sample.select("text", "label").mapInArrow(_presence, "term binary, docs long, ones long")
              .groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("ones").alias("ones")))
    best = (counts.where(F.col("docs") >= MIN_DOCS).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
            .orderBy(F.desc("chi2"), "term").limit(max_terms))
    return sorted(bytes(r["term"]) for r in best.select("term").collect())


class _TermIds(dict):
    """word -> numbers of its vocabulary terms."""

    def __init__(self, terms: list[bytes]):
        self.numbers = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word):
        found = tuple(self.numbers[t] for t in terms_of(word) if t in self.numbers)
        if len(self) >= _STORE:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def _vectors(batches, terms):
    ids = _TermIds(terms.value)
    for batch in batches:
        keys, where, often = [], [], []
        for id_, text in rows(batch, "id", "text"):
            tf = Counter(t for found in map(ids.__getitem__, _words(text)) if found for t in found)
            keys.append(id_)
            where.append(sorted(tf))
            often.append([tf[t] for t in sorted(tf)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))],
                                         names=["id", "terms", "tf"])


def unit_vector(terms, tf, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.asarray(terms, dtype=np.int64)
    w = (1 + np.log(np.asarray(tf, dtype=float))) * idf[terms]
    return terms, w / np.sqrt((w * w).sum())


class BlockMaxIndex:
    """Examples (id, label, terms, unit weights) in blocks, with each term's largest weight by block.

    Examples with equal vectors are one entry; postings are ordered by term and block.
    """

    def __init__(self, examples: list[tuple], n_terms: int):
        examples = sorted(examples, key=lambda e: e[0])
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.labels = np.array([e[1] for e in examples], dtype=float)
        equal: dict[tuple, list[int]] = {}
        for i, (_, _, terms, weights) in enumerate(examples):
            equal.setdefault((terms.tobytes(), weights.tobytes()), []).append(i)
        # blocks of entries with the same heaviest terms have tight bounds
        heavy = lambda m: (tuple(examples[m[0]][2][np.argsort(-examples[m[0]][3], kind="stable")[:4]].tolist()), m[0])
        members = sorted(equal.values(), key=heavy)
        self.members = [np.array(m) for m in members]
        block = np.arange(len(members)) // BLOCK
        entry = np.repeat(np.arange(len(members)), [len(examples[m[0]][2]) for m in members])
        term = np.concatenate([examples[m[0]][2] for m in members])
        weight = np.concatenate([examples[m[0]][3] for m in members])
        self.top = np.zeros((n_terms, int(block[-1]) + 1))
        np.maximum.at(self.top, (term, block[entry]), weight)
        order = np.argsort(term, kind="stable")  # postings of a term lie together, those of a block in it too
        self.entry, self.weight = entry[order], weight[order]
        cells = term[order] * self.top.shape[1] + block[self.entry]
        self.start = np.searchsorted(cells, np.arange(self.top.size + 1)).reshape(-1)

    def _scores(self, terms: list[int], weights: list[float], first: int, last: int) -> np.ndarray:
        """Cosines of the entries of blocks first to last - 1, from their part of the posting lists."""
        blocks, low, high = self.top.shape[1], first * BLOCK, min(last * BLOCK, len(self.members))
        parts = [(w, self.start[t * blocks + first], self.start[t * blocks + last]) for t, w in zip(terms, weights)]
        entry = np.concatenate([self.entry[a:b] for _, a, b in parts])
        return np.bincount(entry - low if low else entry, weights=np.concatenate([w * self.weight[a:b] for w, a, b in parts]), minlength=high - low)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, example number) of the k nearest with a common term; ties to smaller ids.

        The two blocks of highest bound give a first k-th cosine; then all blocks whose bound
        reaches it are scored: one by one if they are few, else by whole posting lists.
        """
        bound = weights @ self.top[terms]
        ts, ws = terms.tolist(), weights.tolist()
        wanted, blocks = k + (without is not None), len(bound)
        order = np.argpartition(-bound, 2)[:2].tolist() if blocks > 2 else list(range(blocks))
        found = {b: self._scores(ts, ws, b, b + 1) for b in order}

        def kth(score):  # each entry is one example at least: a lower bound of the k-th example's cosine
            return float(np.partition(score, len(score) - wanted)[len(score) - wanted]) if len(score) > wanted else 0.0

        floor = kth(np.concatenate(list(found.values())))
        left = [b for b in np.flatnonzero((bound > 0) & (bound >= floor - 1e-9)).tolist() if b not in found]
        if len(left) > FEW:
            entries, score = np.arange(len(self.members)), self._scores(ts, ws, 0, blocks)
        else:
            found |= {b: self._scores(ts, ws, b, b + 1) for b in left}
            entries = np.concatenate([np.arange(b * BLOCK, b * BLOCK + len(x)) for b, x in found.items()])
            score = np.concatenate(list(found.values()))
        near = np.flatnonzero((score > 0) & (score >= kth(score) - 1e-9))
        pairs = [(-round(float(score[e]), 12), i) for e in near.tolist() for i in self.members[entries[e]][:wanted].tolist()]
        return [(-s, i) for s, i in sorted(pairs) if i != without][:k]  # examples are numbered by id

    def vote(self, found: list[tuple[float, int]], k: int) -> float:
        """Share of label 1, a neighbour at distance d weighing 1 / (d**2 + 0.01).

        The rate of label 1 weighs in like k neighbours without a common term, so that
        distant neighbours alone say little.
        """
        weight = 1 / (np.maximum(0, 2 - 2 * np.array([s for s, _ in found])) + 0.01)
        prior = k / 2.01
        return float(((weight * self.labels[[i for _, i in found]]).sum() + prior * self.labels.mean()) / (weight.sum() + prior))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: (x, fitted), each pool shrunk by one even vote; equal x are one point."""
    points, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # [sum y, weight, last x]
    for total, weight, value in zip(np.bincount(at, weights=y).tolist(), np.bincount(at).tolist(), points.tolist()):
        pools.append([total, float(weight), value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, last]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def _votes(batches, model, k):
    """(vote, label) of examples by the others."""
    idf, index = model.value
    for batch in batches:
        votes, labels = [], []
        for id_, terms, tf in rows(batch, "id", "terms", "tf"):
            own = int(np.searchsorted(index.ids, id_))
            found = index.nearest(*unit_vector(terms, tf, idf), k, without=own)
            if found:
                votes.append(index.vote(found, k))
                labels.append(index.labels[own])
        yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(labels, pa.float64())], names=["vote", "label"])


def _score(batches, model, k):
    idf, index, xs, ys, empty_rate = model.value
    cache: dict[tuple, tuple] = {}
    for batch in batches:
        out = []
        for id_, terms, tf in rows(batch, "id", "terms", "tf"):
            key = (tuple(terms), tuple(tf))
            got = cache.get(key)
            if got is None:
                found = index.nearest(*unit_vector(terms, tf, idf), k) if terms and index is not None else []
                score = float(np.interp(index.vote(found, k), xs, ys)) if found else empty_rate
                got = (score, [{"example": int(index.ids[i]), "cosine": s, "label": int(index.labels[i])} for s, i in found])
                if len(cache) >= _CACHE:
                    cache.clear()
                cache[key] = got
            out.append((id_, *got))
        kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64()),
                                          pa.array([r[2] for r in out], kind)], names=["id", "score", "evidence"])


def held_out(id_col: str):
    """True for rows that no label is learned from: crc32 of the id as text, mod 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   k: int = NEIGHBOURS, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> DataFrame:
    """(id, held_out, score, predicted, evidence), one row for each row of ``docs``.

    Labels are learned only from rows that are not held out, at most ``max_examples`` of
    them by hash of the id; null labels and ids teach nothing, an id labelled twice counts
    by its largest label, as do equal texts, which are one example; an id with several texts
    is learned from the one whose term numbers sort first.  Null and empty texts and texts without a term of the vocabulary
    get the rate of label 1 among such examples and no evidence; without any labels all
    scores are 0.  Repeated rows are scored alike.  Other columns are never read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = (labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
             .groupBy(F.col(f"`{id_col}`").cast("long").alias("_id")).agg(F.max(F.col(f"`{label_col}`")).cast("int").alias("label"))
             .orderBy(F.xxhash64("_id"), "_id").limit(max_examples))
    chosen = F.broadcast(materialise(known))  # at most max_examples rows of 12 bytes
    sample = materialise(base.join(chosen, F.col("id") == F.col("_id")).groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")))
    size = sample.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    total, positive = size["n"], size["p"] or 0
    terms = _select_terms(sample, total, positive, max_terms) if 0 < positive < total else []
    shared_terms = spark.sparkContext.broadcast(terms)
    vectors = materialise(base.mapInArrow(lambda it: _vectors(it, shared_terms), "id long, terms array<int>, tf array<int>"))

    df = np.zeros(max(1, len(terms)))
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # one row per term
        df[r["t"]] = r["n"]
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    of_sample = sample.groupBy(F.col("id").alias("_id")).agg(F.max("label").alias("label"))
    known = materialise(vectors.join(F.broadcast(of_sample), F.col("id") == F.col("_id")).groupBy("id")
                        .agg(F.min(F.struct("terms", "tf")).alias("v"), F.max("label").alias("label")).select("id", "label", "v.terms", "v.tf"))
    examples, empty = [], [0, 0]
    for r in known.collect():  # at most max_examples
        if r["terms"]:
            examples.append((r["id"], r["label"], *unit_vector(r["terms"], r["tf"], idf)))
        else:
            empty[r["label"]] += 1
    index = BlockMaxIndex(examples, len(terms)) if examples else None
    xs, ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    if index is not None:
        fitted = spark.sparkContext.broadcast((idf, index))
        tasks = max(spark.sparkContext.defaultParallelism, len(examples) // 1_000)
        votes = known.where(F.size("terms") > 0).repartition(tasks).mapInArrow(lambda it: _votes(it, fitted, k), "vote double, label double").collect()
        if votes:
            xs, ys = isotonic(np.array([v["vote"] for v in votes]), np.array([v["label"] for v in votes]))
    rate = empty[1] / max(1, sum(empty))
    model = spark.sparkContext.broadcast((idf, index, xs, ys, rate))  # bounded by max_examples and max_terms
    scored = vectors.mapInArrow(lambda it: _score(it, model, k), "id long, score double, evidence array<struct<example:long,cosine:double,label:int>>")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without rows whose id is predicted toxic; rows with a null id stay."""
    return without_ids(docs, id_col, score_toxicity(docs, labels, id_col, text_col, **options).where("predicted = 1").select(id_col))
