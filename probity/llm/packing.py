"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing needs only how many pieces of each length there are: pieces of one
length are alike, and bins with the same free space are alike.  So the plan is made from
the histogram of lengths (at most ``capacity`` rows, whatever the corpus), bins with equal
free space are handled as runs of bin numbers, and a segment tree over free capacities
finds the tightest open bins in logarithmic time.  The result is exactly the best-fit
decreasing packing of all pieces.  Pieces find their places by their rank among the pieces
of their length: a counter inside each task and one running sum over (task, length) counts.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.common import materialise, rows

#: Chunks whose ids a Python worker keeps; beyond that the store is emptied.
CHUNK_STORE = 800_000
_LONG_CHUNK = 64
_RANK_BITS = 48
#: Words that are encoded as one text.
_JOINED = 256
_WORD_END = "</w>"
#: White space for str.split but not for the tokenizer's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class ChunkTokenizer:
    """ids of a text as little-endian uint32 bytes, one white-space chunk at a time.

    The vocabulary's normaliser and pre-tokenizer never look across white space, so a
    text's ids are the ids of its chunks in order; common chunks are encoded once.  New
    words of Latin letters are encoded many in one text, which is cut behind every token
    that ends a word; where these are not as many as the words, each is encoded by itself.
    """

    added, ends = re.compile(r"(?!)"), np.zeros(1, dtype=bool)     # no added tokens, no ends of words known

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.store = Tokenizer.from_file(path), {}
        normaliser = self.tokenizer.normalizer
        self.normal = normaliser.normalize_str if normaliser is not None else str
        self.folds = self.normal("AZ") == "az"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        # array("I") holds 32 bits in the machine's order
        return [np.frombuffer(array("I", e.ids), dtype=np.uint32).astype("<u4", copy=False).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """``_ids`` of words that the tokenizer does not split further."""
        groups = [words[at:at + _JOINED] for at in range(0, len(words), _JOINED)]
        out = []
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, dtype="<u4")]) + 4).tolist() if self.ends.any() else []
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                out += [ids[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self._ids(group)
        return out

    def _learn(self, missing: set[str]) -> None:
        """Store chunks; a word with marks behind it, or with capitals, is put together from its parts.

        Letters and other signs never share a token.  What counts as a letter is the word's
        end after normalising; capitals are folded only if the vocabulary folds them.
        """
        same, lowered, parts = [], {}, {}
        for chunk in missing:
            if self.added.search(chunk):    # added tokens are found before normalising, in any place
                same.append(chunk)
                continue
            low = chunk.lower() if self.folds and chunk.isascii() else chunk
            word = low.rstrip(string.punctuation)
            if len(word) < len(low) and word[-1:].isalpha() and (word.isascii() or self.normal(word)[-1:].isalpha()):
                parts[chunk] = (word, low[len(word):])
            elif low != chunk:
                lowered[chunk] = low
            else:
                same.append(chunk)
        new = set(same).union(lowered.values(), *parts.values()).difference(self.store)
        words = [p for p in new if p.isalpha() and (p.isascii() or max(p) <= "\xff")]
        self.store.update(zip(words, self._ids_of_words(words)))
        others = list(new.difference(words))
        self.store.update(zip(others, self._ids(others)))
        get = self.store.__getitem__
        self.store.update([(chunk, get(low)) for chunk, low in lowered.items()])
        self.store.update([(chunk, get(word) + get(tail)) for chunk, (word, tail) in parts.items()])
        for part in new:
            if len(part) > _LONG_CHUNK and part not in missing:
                del self.store[part]

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        missing = set().union(*(c for c in chunks if c)).difference(self.store)
        if len(self.store) + len(missing) > CHUNK_STORE:
            self.store.clear()
            missing = set().union(*(c for c in chunks if c))
        self._learn(missing)
        out = [self._ids([t])[0] if c is None else b"".join(map(self.store.__getitem__, c)) for t, c in zip(texts, chunks)]
        for chunk in missing:
            if len(chunk) > _LONG_CHUNK:
                del self.store[chunk]
        return out


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(batches, path, capacity, end_id, keep_ids):
    tokenizer = chunk_tokenizer(path or default_vocabulary())
    end, task, ranks = np.asarray([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), {}

    def cut(ids_, texts):
        out = []
        for id_, ids in zip(ids_, tokenizer.encode(texts)):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                n = len(part) // 4
                rank = ranks.get(n, 0)
                ranks[n] = rank + 1
                out.append((id_, piece, at // 4, n, zlib.crc32(part), task, rank, np.frombuffer(part, dtype="<u4").astype(np.int32) if keep_ids else None))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        names = ["id", "piece", "start", "length", "ids_crc32", "task", "task_rank", "ids"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        ids_, texts, size = [], [], 0
        for id_, text in rows(batch, "id", "text"):
            ids_.append(id_)
            texts.append(text)
            size += len(text)
            if size > 2_000_000:
                yield cut(ids_, texts)
                ids_, texts, size = [], [], 0
        if texts:
            yield cut(ids_, texts)


class _FreeSpace:
    """Segment tree over free capacities 0..capacity; a leaf holds runs of bins with that much space."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.width)]

    def push(self, space: int, first: int, count: int):
        self.runs[space].append((first, count))
        at = space + self.width
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def pop(self, space: int) -> tuple[int, int]:
        run = self.runs[space].pop()
        at = space + self.width
        if not self.runs[space]:
            self.any[at] = 0
            at >>= 1
            while at:
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
                at >>= 1
        return run

    def tightest(self, need: int) -> int | None:
        """Smallest free space >= need that some bin has."""
        at = need + self.width
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, pieces, first_bin, per_bin, offset) that place every piece.

    The piece of a run with rank first_rank + j lies in bin first_bin + j // per_bin, at
    offset + (j % per_bin) * length.
    """
    free, bins, out = _FreeSpace(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = free.tightest(length)
            if space is None:
                space, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = free.pop(space)
            per = min(space // length, left)
            use = min(count, left // per)
            if count > use:
                free.push(space, first + use, count - use)
            out.append((length, rank, use * per, first, per, capacity - space))
            free.push(space - per * length, first, use)
            rank += use * per
            left -= use * per
    return out


def _placed(batches, plan):
    runs = plan.value
    keys = (runs[:, 0] << _RANK_BITS) + runs[:, 1]
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        length, rank = get("length").to_numpy(), get("rank").to_numpy()
        run = runs[np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1]
        j = rank - run[:, 1]
        seq, offset = run[:, 3] + j // run[:, 4], run[:, 5] + j % run[:, 4] * length
        kept = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(get(n) for n in kept), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                                         names=[*kept, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1,
                   vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and then ``end_id``; only one longer than ``capacity`` is
    cut.  Null and empty texts are the end id alone.  Every row of ``docs`` is packed, also
    repeated rows and rows whose id is null; an empty table gives no rows.  Other columns
    are ignored.  ``vocabulary`` is a tokenizers file that every executor can read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    pieces = materialise(base.mapInArrow(
        lambda it: _pieces(it, vocabulary, capacity, end_id, keep_ids),
        "id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long, ids array<int>"))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = np.array(best_fit_decreasing(counts, capacity), dtype=np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])  # bounded by capacity alone
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    cols = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = (pieces.join(by_task.select("task", "length", before.alias("before")), ["task", "length"])
              .select(*cols, (F.col("before") + F.col("task_rank")).alias("rank")))
    schema = "id long, piece int, start long, length long, ids_crc32 long, " + ("ids array<int>, " if keep_ids else "")
    return ranked.mapInArrow(lambda it: _placed(it, plan), schema + "sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed sequences of ``pack_documents(keep_ids=True)``.

    A group holds at most ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.count("*").alias("n_pieces"))
