"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, exact verification.

Two texts link when the Jaccard similarity of their sets of word shingles reaches the
threshold.  Sets are ordered rare-first (bucketed document frequency, then hash), so two
similar sets must share a shingle of their prefixes (Chaudhuri et al. 2006; Xiao et al.
2011, PPJoin+).  Plan:

1. texts with the same set become one node (a copy is never compared);
2. prefixes are written once; prefix shingles that no second document holds are dropped
   (``repeat_filter`` has no false negatives); sets are cut again for the texts of
   candidate pairs only;
3. *stars*: in every posting list all nodes are compared with one hub, the node whose
   shingles are commonest, once for each pair; verified links give components;
4. *rest*: nodes outside their list's hub component are compared with the list's nodes of
   other components, in the same or the next band of lengths.  Pairs inside one component
   are not needed, all others are tried, so no link between components is lost while a
   group of near copies costs one star;
5. components of all links, carried back to every copy.

Filters on a pair that shares a shingle at positions i, j (from 0) of sets of n, m, with
need = ceil(t (n + m) / (1 + t)): length min >= t max; positional 1 + min(n-i-1, m-j-1) >=
need; suffix: each set is cut by fixed pivots into 8 hash ranges and sum of min(range
counts) >= need.  All three are upper bounds on the overlap, so they drop no link.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm import filters
from probity.llm.common import Shingler, as_bytes, materialise, rows, total_bytes, without_ids
from probity.llm.components import connected_components

RANGES = 8
PREFIX_HASHES = 2
POSTINGS_A_BATCH = 1 << 16
_SCHEMA = "id long, digest binary, n long, score double, ranges array<int>, data binary"


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _ordered(shingler: Shingler, sketch: np.ndarray, log2: int, text: bytes):
    """Distinct shingles of a text, rare first, and their bucket counts."""
    own = shingler.distinct(text)
    df = sketch[filters.bucket(own, log2)]
    order = np.argsort(df, kind="stable")  # ties stay in hash order
    return own[order], df[order]


def _set_rows(batches, k, percent, log2, sketch):
    """One row for each document: its set's digest, size and, the first time in a task, prefix and filters' counts."""
    shingler, seen = Shingler(k), set()
    for batch in batches:
        out = []
        for id_, data in rows(batch, "id", "data"):
            own, df = _ordered(shingler, sketch.value, log2, data)
            n = len(own)
            if n == 0 or id_ is None:
                out.append((id_, None, n, None, None, None))
                continue
            digest = hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).digest()
            if digest in seen:
                out.append((id_, digest, n, None, None, None))
                continue
            seen.add(digest)
            ranges = np.bincount((own & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)
            out.append((id_, digest, n, float(df.mean()), ranges.astype(np.int32), own[:_prefix_length(n, percent)].tobytes()))
        if out:
            types = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                             names=["id", "digest", "n", "score", "ranges", "data"])


def _recurring(batches, again):
    """(node, n, score, g, pos) for each prefix shingle that may recur."""
    def batch_of(parts):
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), types)],
                                          names=["node", "n", "score", "g", "pos"])

    for batch in batches:
        parts, size = [], 0
        for node, n, score, data in rows(batch, "node", "n", "score", "data"):
            prefix = np.frombuffer(data, dtype=np.uint64)
            keep = np.flatnonzero(filters.contains(again.value, prefix, PREFIX_HASHES))
            if len(keep):
                parts.append((np.full(len(keep), node), np.full(len(keep), n), np.full(len(keep), score),
                              prefix[keep].view(np.int64), keep.astype(np.int32)))
                size += len(keep)
            if size >= POSTINGS_A_BATCH:
                yield batch_of(parts)
                parts, size = [], 0
        if parts:
            yield batch_of(parts)


def _lengths_and_places(x: str, y: str, percent: int):
    """Length and positional filters between two entries with n and pos."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    positional = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (positional >= _need(n, m, percent))


def _need(n, m, percent: int):
    return F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)


def _suffix_filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose range counts allow the overlap; counts are read for these pairs only."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("ranges").alias("_ra"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("ranges").alias("_rb"))
    suffix = sum((F.least(F.col("_ra")[i], F.col("_rb")[i]) for i in range(RANGES)), F.lit(0))
    return (pairs.distinct().join(left, "a").join(right, "b")
            .where(suffix >= _need(F.col("_n"), F.col("_m"), percent)).select("a", "b"))


def _band(n, percent: int):
    """Length band: two lengths that pass the length filter lie in the same or in adjacent bands."""
    if percent >= 100:
        return F.col(n)
    return F.floor(F.log(F.col(n).cast("double")) * ((1 - 1e-6) / math.log(100 / percent)))


def _verified(pairs: DataFrame, base: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold exactly, each checked once.

    Only texts whose id is in a Bloom filter of the pairs' ids are cut into sets again and
    shuffle; one that is there by chance joins with no pair.
    """
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    log2 = filters.log2_bits(ids.count(), 16)
    wanted = pairs.sparkSession.sparkContext.broadcast(filters.key_filter(ids, log2, PREFIX_HASHES))

    def cut(batches):
        shingler = Shingler(k)
        for batch in batches:
            keys = filters.id_keys(batch.column(0).to_numpy(zero_copy_only=False))
            for i in np.flatnonzero(filters.contains(wanted.value, keys, PREFIX_HASHES)):
                own = shingler.distinct(batch.column(1)[int(i)].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0)[int(i):int(i) + 1], pa.array([own.view(np.int64)], pa.list_(pa.int64()))],
                                                 names=["node", "shingles"])

    sets = materialise(base.where("id is not null").mapInArrow(cut, "node long, shingles array<long>"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included.  A null or
    empty text, or one without words, has an empty set, links with nothing and keeps its own
    id; a text of fewer than k words is one shingle.  Rows that repeat an id are one document
    for reachability, each with its own count.  A row whose id is null gets its count and a
    null component, and links nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(text_col).alias("data"))
    words = total_bytes(docs, text_col) / 6
    log2 = int(min(filters.MAX_LOG2_COUNTERS, max(16, np.ceil(np.log2(max(1.0, words / 8))))))
    known = base.where("id is not null").select("data")
    sketch = spark.sparkContext.broadcast(filters.count_sketch(known, lambda: Shingler(k).distinct, log2))

    found = materialise(base.mapInArrow(lambda it: _set_rows(it, k, percent, log2, sketch), _SCHEMA))

    bits = filters.log2_bits(words * (100 - percent) / 100, 16)
    again = spark.sparkContext.broadcast(filters.repeat_filter(
        found.where("data is not null").select("data"), lambda: lambda data: np.frombuffer(data, dtype=np.uint64), bits, PREFIX_HASHES))

    # the row that gives a node its prefix is one that carries it, whichever task wrote it
    nodes = materialise(found.where("digest is not null").groupBy("digest")
                        .agg(F.min("id").alias("node"), F.first("n").alias("n"),
                             F.first(F.when(F.col("data").isNotNull(), F.struct("score", "ranges", "data")), ignorenulls=True).alias("p"))
                        .select("digest", "node", "n", "p.*"))

    posted = materialise(nodes.select("node", "n", "score", "data").mapInArrow(
        lambda it: _recurring(it, again), "node long, n long, score double, g long, pos int"))
    hub = F.max(F.struct("score", -F.col("node"), F.struct("node", "n", "pos").alias("h")))
    lists = materialise(posted.groupBy("g").agg(F.count("*").alias("size"), hub.alias("hub"))
                        .where("size > 1").select("g", F.col("hub.h").alias("h")))
    entry = F.struct("node", "n", "pos").alias("e")

    def pair(x, y):
        return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]

    near_hub = (posted.select("g", entry).join(lists, "g").where(F.col("e.node") != F.col("h.node"))
                .where(_lengths_and_places("e", "h", percent)).select(*pair("e", "h")))
    stars = materialise(_suffix_filtered(near_hub, nodes, percent))
    star_links = materialise(_verified(stars, base, k, percent))
    comp = materialise(connected_components(star_links))

    of_node = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    hubs = (lists.join(of_node, F.col("h.node") == F.col("_n"), "left")
            .select("g", F.coalesce("_c", "h.node").alias("hc")))
    placed = (posted.select("g", entry, _band("n", percent).alias("band")).join(hubs, "g")
              .join(of_node, F.col("e.node") == F.col("_n"), "left")
              .select("g", "band", "e", F.coalesce("_c", "e.node").alias("c"), "hc"))
    placed = materialise(placed)
    out = (placed.where("c <> hc").select("g", F.col("e").alias("x"), F.col("c").alias("cx"),
                                          F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")))
    every = placed.select("g", "band", F.col("e").alias("y"), F.col("c").alias("cy"), (F.col("c") != F.col("hc")).alias("also_out"))
    others = (out.join(every, ["g", "band"])
              .where((F.col("cx") != F.col("cy")) & (~F.col("also_out") | (F.col("x.node") < F.col("y.node"))))
              .where(_lengths_and_places("x", "y", percent)).select(*pair("x", "y")))
    rest = materialise(_suffix_filtered(others, nodes, percent).join(stars, ["a", "b"], "left_anti"))
    links = star_links.unionByName(_verified(rest, base, k, percent))
    comp = connected_components(links)

    classes = (nodes.select("digest", "node").join(comp, "node", "left")
               .select(F.col("digest").alias("_d"), F.coalesce("component", "node").alias("_c")))
    return (found.select("id", "digest", "n").join(classes, F.col("digest") == F.col("_d"), "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("_c", "id")).alias("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the row whose id is its component (rows without an id stay).

    Rows that repeat a kept id all stay; rows without words are no copies of anything and
    all stay.  Columns are those of ``docs``.
    """
    comp = jaccard_components(docs, id_col, text_col, k, percent).select(F.col(id_col).alias("_id"), F.col("component_id").alias("_c"), "n_shingles")
    return without_ids(docs, id_col, comp.where("_c <> _id and n_shingles > 0").select("_id"))
