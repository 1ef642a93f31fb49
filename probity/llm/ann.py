"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first, calibrated width.

The tree is fitted on a bounded sample; every row is placed in its leaf by a Spark pass.
A query walks the tree with a priority queue of centroid distances and visits leaves in
that order.  How many leaves are visited is calibrated: for a bounded set of queries the
exact neighbours are found by a full scan, and the width is the smallest at which the wanted
share of them, and a least share of each query's, lies in visited leaves.  A query goes on past
the width until the leaves visited hold k + 1 rows.  Neighbouring leaves make up a fixed number of cells;
a query asks a cell once, for the leaves it visits there, and gets back k rows at most.  Cells
are searched in blocks of bounded size, against bounded parts of the queries, so a leaf that
holds a third of all rows is many tasks' work.  Copies of one vector beyond the k + 1 smallest
ids, which can be in no answer, are left out before.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.common import materialise

FIT_ROWS = 20_000
CALIBRATION_QUERIES = 128
TARGET_RECALL = 0.98
QUERY_RECALL = 0.8          # of every calibration query, however far it lies from the rest
BRANCH = 8
LEAF_FIT_ROWS = 40
CELLS = 32
BLOCK_ROWS = 32_768
PART_QUERIES = 16_384
_ROUNDS = 8


class KMeansTree:
    """Nodes hold the centroids of their children; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_FIT_ROWS):
        self.children: list[tuple[np.ndarray, list[int]] | int] = []
        self.leaves = 0
        self._grow(points, branch, leaf_rows, np.random.default_rng(7))

    def _grow(self, points, branch, leaf_rows, rng) -> int:
        me = len(self.children)
        self.children.append(0)
        part = self._split(points, branch, rng) if len(points) > leaf_rows else None
        if part is None:
            self.children[me] = self.leaves
            self.leaves += 1
        else:
            centres, label = part
            self.children[me] = (centres, [self._grow(points[label == c], branch, leaf_rows, rng) for c in range(len(centres))])
        return me

    @staticmethod
    def _split(points, branch, rng):
        centres = np.unique(points[rng.choice(len(points), min(branch, len(points)), replace=False)], axis=0)
        for _ in range(_ROUNDS):
            label = nearest_centre(points, centres)
            centres = np.stack([points[label == c].mean(axis=0) for c in np.unique(label)])
        label = nearest_centre(points, centres)
        used = np.unique(label)
        return None if len(used) < 2 else (centres[used], np.searchsorted(used, label))

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point: the nearest centre at every level."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            kind = self.children[node]
            if isinstance(kind, int):
                out[rows] = kind
            elif len(rows):
                label = nearest_centre(points[rows], kind[0])
                todo += [(child, rows[label == c]) for c, child in enumerate(kind[1])]
        return out

    def visit(self, query: np.ndarray, width: int, rows_of_leaf: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """The first ``width`` leaves, best bin first, and more until they hold ``rows`` rows."""
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < width or held < rows):
            _, node = heapq.heappop(heap)
            kind = self.children[node]
            if isinstance(kind, int):
                out.append(kind)
                held += rows_of_leaf.get(kind, 0) if rows_of_leaf else 0
            else:
                for d, child in zip(((kind[0] - query) ** 2).sum(axis=1).tolist(), kind[1]):
                    heapq.heappush(heap, (d, child))
        return out


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _top(queries: np.ndarray, query_ids, points: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of ``points`` for each query: smallest distance, then smallest id."""
    out = []
    for q, qid in zip(queries, query_ids):
        diff = points - q
        score = np.sqrt((diff * diff).sum(axis=1))
        score[ids == qid] = np.inf
        best = np.lexsort((ids, score))[:k] if len(ids) <= 4 * k else None
        if best is None:
            edge = np.partition(score, k - 1)[k - 1]
            near = np.flatnonzero(score <= edge)
            best = near[np.lexsort((ids[near], score[near]))][:k]
        out += [(int(qid), int(ids[i]), float(score[i])) for i in best if score[i] < np.inf]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def cells_of(rows_of_leaf: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """leaf -> cell (leaves in tree order, about equal rows to a cell) and cell -> number of its blocks."""
    total, before = sum(rows_of_leaf.values()), 0
    cell, held = {}, {}
    for leaf, n in sorted(rows_of_leaf.items()):
        cell[leaf] = c = before * CELLS // total
        held[c] = held.get(c, 0) + n
        before += n
    return cell, {c: -(-n // BLOCK_ROWS) for c, n in held.items()}


def calibrated_width(depths: list[list[int]], target_recall: float) -> int:
    """Least width at which ``target_recall`` of all neighbours, and QUERY_RECALL of each query's, lie in visited leaves."""
    def reach(d: list[int], share: float) -> int:
        return sorted(d)[max(0, math.ceil(share * len(d) - 1e-9) - 1)]
    return max([reach([x for d in depths for x in d], target_recall), *(reach(d, min(QUERY_RECALL, target_recall)) for d in depths)]) if depths else 1


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part, one for each id.

    Left out are null ids, null, empty or zero vectors, vectors with a null or non-finite
    component, and vectors of another length than the commonest.  An id that repeats stands
    for its least vector.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
           .where("id is not null and v is not null and size(v) > 0").where(fine))
    size = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is not None:
        out = out.where(F.size("v") == size["n"])
    return out.groupBy("id").agg(F.min("v").alias("v"))


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
                       target_recall: float = TARGET_RECALL, fit_rows: int = FIT_ROWS, calibration_queries: int = CALIBRATION_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id meets ``is_query(id column)``.

    score is the Euclidean distance of the original vectors in double precision; ties go to
    the smaller id; the query's own id is no candidate.  See ``usable_vectors`` for the rows
    that take part.  An empty table, or one without queries, gives no rows.  The tree is
    fitted on at most ``fit_rows`` rows and the width calibrated on at most
    ``calibration_queries`` queries, both chosen by hash of the id; every row is indexed.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    usable = materialise(usable_vectors(vectors, id_col, vector_col))
    fit = usable.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()
    queries = usable.where(is_query(F.col("id")))
    if not fit:
        return spark.createDataFrame([], empty)
    tree = KMeansTree(np.array([r["v"] for r in fit], dtype=np.float64))
    shared = spark.sparkContext.broadcast(tree)  # bounded by fit_rows

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=shared.value.place(_matrix(pdf["v"])))

    # of equal vectors only the k + 1 smallest ids can be in an answer
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = materialise(usable.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "v")
                         .mapInPandas(place, "id long, v array<double>, leaf long"))

    probes = [(r["id"], np.array(r["v"])) for r in queries.orderBy(F.xxhash64("id"), "id").limit(calibration_queries).collect()]
    if not probes:
        return spark.createDataFrame([], empty)
    probe_ids, probe_vectors = np.array([p[0] for p in probes]), np.stack([p[1] for p in probes])

    def scan(batches):
        for pdf in batches:
            if len(pdf):
                found = _top(probe_vectors, probe_ids, _matrix(pdf["v"]), pdf["id"].to_numpy(), k)
                yield found.merge(pdf[["id", "leaf"]], left_on="vec_id", right_on="id")[["query_id", "vec_id", "score", "leaf"]]

    exact = _ranked(points.mapInPandas(scan, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").collect()
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))} for i, v in probes}
    depths: dict[int, list[int]] = {}
    for r in exact:
        depths.setdefault(r["query_id"], []).append(order[r["query_id"]][r["leaf"]] + 1)
    width = calibrated_width(list(depths.values()), target_recall)

    # bounded by the tree, whatever the rows
    rows_of_leaf = {r["leaf"]: r["n"] for r in points.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    grid = spark.sparkContext.broadcast((*cells_of(rows_of_leaf), rows_of_leaf))
    parts = -(-queries.count() // PART_QUERIES)

    def spread(batches):
        cell, blocks, _ = grid.value
        for pdf in batches:
            at = pdf["leaf"].map(cell)
            yield pdf.assign(cell=at, block=pdf["h"].to_numpy() % at.map(blocks).to_numpy())[["id", "v", "leaf", "cell", "block", "part"]]

    def ask(batches):
        cell, blocks, held = grid.value
        for pdf in batches:
            asked = []
            for i, v, part in zip(pdf["id"], pdf["v"], pdf["part"]):
                wanted: dict[int, list[int]] = {}
                for leaf in shared.value.visit(np.asarray(v), width, held, k + 1):
                    if leaf in cell:
                        wanted.setdefault(cell[leaf], []).append(leaf)
                asked += [(i, v, sorted(leaves), c, b, part) for c, leaves in wanted.items() for b in range(blocks[c])]
            yield pd.DataFrame(asked, columns=["query_id", "q", "leaves", "cell", "block", "part"])

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(held):
            held = held.sort_values("leaf", kind="stable")
            points, ids, leaf = _matrix(held["v"]), held["id"].to_numpy(), held["leaf"].to_numpy()
            for i, q, leaves in zip(asked["query_id"], asked["q"], asked["leaves"]):
                rows = np.flatnonzero(np.isin(leaf, leaves))
                if len(rows):
                    found.append(_top(np.asarray(q)[None, :], [i], points[rows], ids[rows], k))
        return pd.concat([f for f in found if len(f)] or found[:1])

    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    key = ["cell", "block", "part"]
    held = (points.select("id", "v", "leaf", F.xxhash64(F.lit("block"), "id").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
            .mapInPandas(spread, "id long, v array<double>, leaf long, cell long, block long, part long").groupBy(*key))
    asked = (queries.select("id", "v", part.cast("long").alias("part"))
             .mapInPandas(ask, "query_id long, q array<double>, leaves array<long>, cell long, block long, part long").groupBy(*key))
    found = asked.cogroup(held).applyInPandas(search, "query_id long, vec_id long, score double")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
