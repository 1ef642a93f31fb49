"""Conversation structure repair: cheapest edits to a legal order of roles, by grammar-compressed dynamic programming.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Edits: Keep (0),
Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert an empty
user or assistant row (2); a truncated row that stays adds 1.  The audit is the string of the
edits' initials; of equally cheap audits the ASCII-least is taken.

1. Rows become symbols (role initial x fault), sorted by range over the whole table, and
   conversations are cut into blocks of at most BLOCK rows and BLOCK_BYTES of text.
2. Re-Pair over the distinct blocks: each round replaces the most frequent pairs that do not
   overlap one another by new symbols, until no pair recurs.
3. A symbol is a min-plus matrix over the states (nothing yet, after s, after u, after a), with
   the rank of each entry's audit among those of the same start.  A rule's matrix is the
   product of its two parts; its audit is a rope, the state in which the parts meet.  Rules
   are evaluated bottom-up once and shared by all conversations.
4. Blocks, then the blocks of a conversation in one partition, then its partitions are
   multiplied; the chosen states go back down the same way, and ropes unroll to audits.

Inserts are written before the row they precede, so all audits of one stretch of rows have
the same number of row letters and end in one: none is a prefix of another, and comparing
the left parts alone decides.

No step holds a whole conversation but the last, which streams its rows, sorted, through one
task with constant memory (a SHA-256 of the whole conversation is a chain) besides the audit.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import materialise, rows

BLOCK = 4_096
BLOCK_BYTES = 1 << 20
ROUNDS = 12  # halving a block of BLOCK rows so often leaves one symbol
BATCH = 128  # new rules a round; ROUNDS * BATCH rules are broadcast at most
BROADCAST_ROWS = 200_000  # repeated (conversation, message) pairs of about 80 bytes
SALTS = 32
_FLUSH = 500_000
_MEMO = 100_000
_INF = 1 << 40

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
#: Empty rows to insert after the last row, by state.
CLOSING = (0, 2, 1, 0)
#: Leaf symbols: a row that must go, then (initial, truncated) of the others.
LEAVES = [None] + [(c, t) for c in "uaso" for t in (False, True)]
_SYMBOL = {leaf: i for i, leaf in enumerate(LEAVES)}
_WHITE = " \t\n\x0b\x0c\r"


def next_role(state: int) -> int:
    """State after a user or assistant row is added where it may stand."""
    return AFTER_A if state == AFTER_U else AFTER_U


def kept(state: int, initial: str) -> int | None:
    """State after a row of this initial, None where it may not stand."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial in ("u", "a"):
        to = next_role(state)
        return to if (initial == "a") == (to == AFTER_A) else None
    return None


class Matrix:
    """Cost and audit rank by (start, end) state; ``mid`` is where the two parts meet, ``text`` a leaf's audits."""

    __slots__ = ("cost", "rank", "mid", "text")

    def __init__(self, cost, rank, mid=None, text=None):
        self.cost, self.rank, self.mid, self.text = cost, rank, mid, text

    def pack(self) -> bytes:
        return np.array([self.cost, self.rank], dtype=np.int64).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Matrix:
        cost, rank = np.frombuffer(data, dtype=np.int64).reshape(2, STATES, STATES).tolist()
        return cls(cost, rank)


def _ranks(keys: list) -> list[int]:
    """Place of each end state's audit in ASCII order, from sortable keys (None: not reachable)."""
    out = [STATES] * STATES
    for place, j in enumerate(sorted((j for j in range(STATES) if keys[j] is not None), key=lambda j: keys[j])):
        out[j] = place
    return out


def leaf_matrix(leaf: tuple[str, bool] | None) -> Matrix:
    """All ways to treat one row: up to two inserts before it (more come back to the same state), then its own edit."""
    cost = [[_INF] * STATES for _ in range(STATES)]
    text = [[None] * STATES for _ in range(STATES)]
    for start in range(STATES):
        state = start
        for inserts in range(3):
            ways = [(DELETE, state, 0)]
            if leaf is not None:
                ways += [(REROLE, next_role(state), int(leaf[1])), (KEEP, kept(state, leaf[0]), int(leaf[1]))]
            for edit, end, more in ways:
                if end is None:
                    continue
                way = (inserts * COST[INSERT] + COST[edit] + more, INSERT * inserts + edit)
                if text[start][end] is None or way < (cost[start][end], text[start][end]):
                    cost[start][end], text[start][end] = way
            state = next_role(state)
    return Matrix(cost, [_ranks(text[i]) for i in range(STATES)], text=text)


def product(left: Matrix, right: Matrix) -> Matrix:
    cost, rank, mid = [], [], []
    for i in range(STATES):
        c, m = [_INF] * STATES, [None] * STATES
        for j in range(STATES):
            best = min((left.cost[i][k] + right.cost[k][j], left.rank[i][k], k) for k in range(STATES))
            if best[0] < _INF:
                c[j], m[j] = best[0], best[2]
        cost.append(c)
        mid.append(m)
        rank.append(_ranks([None if k is None else (left.rank[i][k], right.rank[k][j]) for j, k in enumerate(m)]))
    return Matrix(cost, rank, mid)


def fold(parts: list[Matrix]) -> list[Matrix]:
    """Products of the first 1, 2, ... parts."""
    out = parts[:1]
    for p in parts[1:]:
        out.append(product(out[-1], p))
    return out


def way_back(folded: list[Matrix], start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) state of each part on the best way."""
    out = []
    for k in range(len(folded) - 1, 0, -1):
        mid = folded[k].mid[start][end]
        out.append((mid, end))
        end = mid
    return [(start, end), *reversed(out)]


class Grammar:
    """Re-Pair rules by round, with the matrix of every symbol."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices = [leaf_matrix(leaf) for leaf in LEAVES]
        self.parts: dict[int, tuple[int, int]] = {}

    def add_round(self, pairs: list[tuple[int, int]]) -> None:
        names = {}
        for a, b in pairs:
            names[a, b] = len(self.matrices)
            self.parts[len(self.matrices)] = (a, b)
            self.matrices.append(product(self.matrices[a], self.matrices[b]))
        self.rounds.append(names)

    def compress(self, symbols: list[int]) -> list[int]:
        for names in self.rounds:
            out, i, n = [], 0, len(symbols)
            while i < n:
                new = names.get((symbols[i], symbols[i + 1])) if i + 1 < n else None
                out.append(symbols[i] if new is None else new)
                i += 1 if new is None else 2
            symbols = out
        return symbols

    def unroll(self, symbol: int, start: int, end: int) -> str:
        """Audit of a symbol between two states."""
        out, todo = [], [(symbol, start, end)]
        while todo:
            s, i, j = todo.pop()
            if s in self.parts:
                mid = self.matrices[s].mid[i][j]
                a, b = self.parts[s]
                todo += [(b, mid, j), (a, i, mid)]
            else:
                out.append(self.matrices[s].text[i][j])
        return "".join(out)

    def folded(self, block: bytes) -> tuple[list[int], list[Matrix]]:
        symbols = self.compress(list(block))
        return symbols, fold([self.matrices[s] for s in symbols])

    def audit(self, block: bytes, start: int, end: int) -> str:
        symbols, folded = self.folded(block)
        return "".join(self.unroll(s, i, j) for s, (i, j) in zip(symbols, way_back(folded, start, end)))


def best_end(m: Matrix) -> int:
    """End state of the cheapest whole repair; ties to the ASCII-least audit."""
    return min(range(STATES), key=lambda j: (m.cost[START][j] + CLOSING[j] * COST[INSERT], m.rank[START][j]))


def _pairs(batches, grammar):
    """Partial (a, b, n) counts of adjacent symbols in compressed blocks."""
    rules, counts = grammar.value, Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in counts], pa.int32()), pa.array([b for _, b in counts], pa.int32()),
                                          pa.array(list(counts.values()), pa.int64())], names=["a", "b", "n"])
        counts.clear()
        return out

    for batch in batches:
        for block, n in rows(batch, "seq", "n"):
            s = rules.compress(list(block))
            for pair, times in Counter(zip(s, s[1:])).items():
                counts[pair] += times * n
            if len(counts) > _FLUSH:
                yield flush()
    yield flush()


def learn_grammar(blocks: DataFrame) -> Grammar:
    """Re-Pair over the column ``seq`` (binary, one symbol a byte) of all blocks, equal ones counted together."""
    distinct, grammar = materialise(blocks.groupBy("seq").agg(F.count("*").alias("n"))), Grammar()
    for _ in range(ROUNDS):
        shared = blocks.sparkSession.sparkContext.broadcast(grammar)
        counts = distinct.mapInArrow(lambda it: _pairs(it, shared), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        chosen: list[tuple[int, int]] = []
        firsts, seconds = set(), set()
        for r in counts.where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(8 * BATCH).collect():
            a, b = r["a"], r["b"]
            if len(chosen) < BATCH and a not in seconds and b not in firsts:  # no occurrence overlaps one of a pair chosen before
                chosen.append((a, b))
                firsts.add(a)
                seconds.add(b)
        shared.unpersist()
        if not chosen:
            break
        grammar.add_round(chosen)
    return grammar


def _keyed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages with their flags: key, conv, turn, role, text, h (of role and text), blank, truncated."""
    conv = F.col(f"`{conv_col}`")
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    base = messages.select(F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("v"), conv.cast("string"))).alias("key"), conv.alias("conv"),
                           F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    body = F.rtrim(F.col("text"), F.lit(_WHITE))
    return base.select("*", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("h"), (body == "").alias("blank"),
                       (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))


def _marked(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``seen``: the same role and text stand in an earlier turn of the conversation."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeats = materialise(keyed.where(~F.col("blank")).groupBy("key", "h").agg(F.count("*").alias("n"), F.min(turn).alias("first")).where("n > 1").drop("n"))
    if repeats.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(repeats), ["key", "h"], "left")
    else:  # a message may be a third of all rows
        spread = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")).join(spread, ["key", "h", "salt"], "left").drop("salt")
    return joined.withColumn("seen", F.coalesce(turn > F.col("first"), F.lit(False))).drop("first")


_BLOCK_ROWS = "key string, part int, block int, idx int, turn long, role string, text string, fault int, seq binary"


def _blocks(batches):
    """Rows in order, each with its block and first fault, and after each block a row with its symbols."""
    part = TaskContext.get().partitionId()
    key = h = turn = None
    block = size = 0
    symbols = bytearray()
    out: list[tuple] = []

    def close():
        nonlocal block, size
        if symbols:
            out.append((key, part, block, len(symbols), None, None, None, None, bytes(symbols)))
        symbols.clear()
        block, size = block + 1, 0

    def batch_of(table):
        names = [f.split()[0] for f in _BLOCK_ROWS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        weight = 0
        for k, t, role, text, hash_, blank, truncated, seen in rows(batch, "key", "turn", "role", "text", "h", "blank", "truncated", "seen"):
            if k != key:
                close()
                key, h, block = k, None, 0
            elif len(symbols) >= BLOCK or size >= BLOCK_BYTES:
                close()
            fault = BLANK if blank else DUPLICATE if seen or (hash_ == h and t == turn) else TRUNCATED if truncated else NONE
            initial = role[:1] if role[:1] in ("u", "a", "s") else "o"
            out.append((k, part, block, len(symbols), t, role, text, fault, None))
            symbols.append(_SYMBOL[None if fault in (BLANK, DUPLICATE) else (initial, fault == TRUNCATED)])
            h, turn = hash_, t
            size += len(text)
            weight += len(text)
            if weight >= BLOCK_BYTES or len(out) >= BLOCK:
                yield batch_of(out)
                out.clear()
                weight = 0
    close()
    yield batch_of(out)


def _block_matrices(batches, grammar):
    rules, memo = grammar.value, {}
    for batch in batches:
        keys, parts, blocks, found = [], [], [], []
        for key, part, block, seq in rows(batch, "key", "part", "block", "seq"):
            m = memo.get(seq)
            if m is None:
                m = rules.folded(seq)[1][-1].pack()
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[seq] = m
            keys.append(key)
            parts.append(part)
            blocks.append(block)
            found.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()), pa.array(found, pa.binary())],
                                         names=["key", "part", "block", "m"])


def _part_matrices(batches):
    for batch in batches:
        out = [(key, part, blocks, fold([Matrix.unpack(b["m"]) for b in blocks])[-1].pack()) for key, part, blocks in rows(batch, "key", "part", "blocks")]
        yield pa.RecordBatch.from_pylist([{"key": k, "part": p, "blocks": b, "m": m} for k, p, b, m in out], schema=_PARTS)


_PARTS = pa.schema([("key", pa.string()), ("part", pa.int32()), ("blocks", pa.list_(pa.struct([("block", pa.int32()), ("m", pa.binary())]))), ("m", pa.binary())])
_PLACED = pa.schema([("key", pa.string()), ("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_PLACED_BLOCKS = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _place_parts(batches):
    """States of each conversation's parts on its best way."""
    for batch in batches:
        out = []
        for key, parts in rows(batch, "key", "parts"):
            folded = fold([Matrix.unpack(p["m"]) for p in parts])
            out += [{"key": key, "part": p["part"], "start": i, "end": j} for p, (i, j) in zip(parts, way_back(folded, START, best_end(folded[-1])))]
        yield pa.RecordBatch.from_pylist(out, schema=_PLACED)


def _place_blocks(batches):
    for batch in batches:
        out = []
        for key, part, blocks, start, end in rows(batch, "key", "part", "blocks", "start", "end"):
            folded = fold([Matrix.unpack(b["m"]) for b in blocks])
            out += [{"key": key, "part": part, "block": b["block"], "start": i, "end": j} for b, (i, j) in zip(blocks, way_back(folded, start, end))]
        yield pa.RecordBatch.from_pylist(out, schema=_PLACED_BLOCKS)


def _audits(batches, grammar):
    rules, memo = grammar.value, {}
    for batch in batches:
        keys, parts, blocks, found = [], [], [], []
        for key, part, block, seq, start, end in rows(batch, "key", "part", "block", "seq", "start", "end"):
            a = memo.get((seq, start, end))
            if a is None:
                a = rules.audit(seq, start, end)
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[seq, start, end] = a
            keys.append(key)
            parts.append(part)
            blocks.append(block)
            found.append(a)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()), pa.array(found, pa.string())],
                                         names=["key", "part", "block", "audit"])


def _planned(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows of all conversations, each block after its audit, dealt by conversation and sorted."""
    spark = messages.sparkSession
    marked = _marked(_keyed(messages, conv_col, turn_col, role_col, text_col)).drop("conv")
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("h")]
    placed = materialise(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, _BLOCK_ROWS))
    blocks = placed.where("seq is not null").select("key", "part", "block", "seq")
    rules = spark.sparkContext.broadcast(learn_grammar(blocks))  # ROUNDS * BATCH rules at most

    matrices = blocks.mapInArrow(lambda it: _block_matrices(it, rules), "key string, part int, block int, m binary")
    # a conversation has as many blocks in a partition as the partition's size allows, and as many parts as there are partitions
    parts = materialise(matrices.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("blocks"))
                        .mapInArrow(_part_matrices, "key string, part int, blocks array<struct<block:int,m:binary>>, m binary"))
    ways = (parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("parts"))
            .mapInArrow(_place_parts, "key string, part int, start int, end int"))
    chosen = (parts.select("key", "part", "blocks").join(ways, ["key", "part"])
              .mapInArrow(_place_blocks, "key string, part int, block int, start int, end int"))
    audits = (blocks.join(chosen, ["key", "part", "block"]).select("key", "part", "block", "seq", "start", "end")
              .mapInArrow(lambda it: _audits(it, rules), "key string, part int, block int, audit string"))
    lines = placed.where("seq is null").select("key", "part", "block", "idx", "turn", "role", "text", "fault", F.lit(None).cast("string").alias("audit"))
    return (lines.unionByName(audits.withColumn("idx", F.lit(-1)), allowMissingColumns=True)
            .repartition("key").sortWithinPartitions("key", "part", "block", "idx"))


def _walk(batches) -> Iterator[tuple]:
    """(key, turn, role, text, fault, edit, new role) of each row and insert in order, then (key,) at a conversation's end.

    ``edit`` is the row's letter; an insert has no fault, an empty text and no turn.
    """
    names = ("user", "assistant")
    key, state, letters = None, START, iter("")

    def insert():
        nonlocal state
        state = next_role(state)
        return key, None, None, "", None, INSERT, names[state == AFTER_A]

    def end():
        for _ in range(CLOSING[state]):
            yield insert()
        yield (key,)

    for batch in batches:
        for k, turn, role, text, fault, audit in rows(batch, "key", "turn", "role", "text", "fault", "audit"):
            if k != key:
                if key is not None:
                    yield from end()
                key, state = k, START
            if audit is not None:
                letters = iter(audit)
                continue
            while (edit := next(letters)) == INSERT:
                yield insert()
            new = role
            if edit == REROLE:
                state = next_role(state)
                new = names[state == AFTER_A]
            elif edit == KEEP:
                state = kept(state, role[:1])
            yield key, turn, role, text, fault, edit, new
    if key is not None:
        yield from end()


_REPORT = pa.schema([("key", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _report(batches):
    out = []

    def fresh():
        return {"faults": [0, 0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0,
                "before": None, "low": None, "high": None, "turns": 0}

    s = fresh()
    for row in _walk(batches):
        if len(row) == 1:
            gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
            out.append((row[0], gaps, *s["faults"][1:], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()))
            s = fresh()
            if len(out) >= 1_024:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)
                out.clear()
            continue
        _, turn, role, text, fault, edit, new = row
        s["audit"].append(edit)
        s["cost"] += COST[edit]
        if edit != INSERT:
            s["faults"][fault] += 1
            s["cost"] += int(fault == TRUNCATED and edit != DELETE)
            if s["before"] is not None and s["before"] + role[:1] not in ("su", "ua", "au"):
                s["illegal"] += 1
            s["before"] = role[:1]
            if turn is not None and turn != s["high"]:
                s["low"] = turn if s["low"] is None else s["low"]
                s["high"] = turn
                s["turns"] += 1
        if edit != DELETE:
            s["sha"].update((("\n" if s["lines"] else "") + new + ":" + text).encode("utf-8", "surrogatepass"))
            s["lines"] += 1
        if len(s["audit"]) >= BLOCK:  # one string a block, not one a row
            s["audit"] = ["".join(s["audit"])] if len(s["audit"][0]) < BLOCK else s["audit"][:1] + ["".join(s["audit"][1:])]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)


def conversation_report(messages: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each distinct ``conv_col`` of ``conversations``.

    Rows are taken by turn (nulls first), equal turns by a hash of role and text.  Null roles
    and texts read as one space; rows with a null conversation are one conversation; repeated
    rows are duplicates.  A conversation without messages has zeros, an empty audit and the
    hash of the empty string.  Roles count by their first character; any other than s, u and
    a must be reroled or deleted.  Other columns are never read.
    """
    conv = F.col(f"`{conv_col}`")
    every = conversations.select(conv.alias("_conv")).distinct().select(
        "_conv", F.when(F.col("_conv").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("_conv").cast("string"))).alias("key"))
    found = _planned(messages, conv_col, turn_col, role_col, text_col).mapInArrow(
        _report, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "key", "left").select(
        F.col("_conv").alias(conv_col), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _rows_out(batches):
    out, position, weight = [], 0, 0
    kinds = [("key", pa.string()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    for row in _walk(batches):
        if len(row) == 1:
            position = 0
            continue
        key, turn, _, text, _, edit, new = row
        if edit != DELETE:
            out.append((key, position, turn, new, text, edit))
            position, weight = position + 1, weight + len(text)
        if len(out) >= BLOCK or weight >= BLOCK_BYTES:
            yield flush()
            out.clear()
            weight = 0
    yield flush()


def repair_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, position, turn, role, text, edit): the rows of every repaired conversation.

    ``edit`` is K, R or I; inserted rows have no turn and an empty text.  Conversations of
    which nothing is left have no rows.  Nulls and ties as in ``conversation_report``.
    """
    names = messages.select(F.col(f"`{conv_col}`").alias("_conv")).distinct().select(
        "_conv", F.when(F.col("_conv").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("_conv").cast("string"))).alias("key"))
    rows_ = _planned(messages, conv_col, turn_col, role_col, text_col).mapInArrow(
        _rows_out, "key string, position long, turn long, role string, text string, edit string")
    return rows_.join(names, "key").select(F.col("_conv").alias(conv_col), "position", F.col("turn").alias(turn_col), F.col("role").alias(role_col),
                                           F.col("text").alias(text_col), "edit")


def damaged(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``messages`` (four columns) with faults put in by crc32 of "conversation:turn", mod 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    rows_ = messages.where(kind != 0).select(F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`"), F.when(kind == 4, "user").otherwise(space(role_col)).alias(role_col),
                                             text.alias(text_col), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows_.drop("_copy")
