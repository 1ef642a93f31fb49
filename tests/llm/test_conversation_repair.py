"""Repair against a search over all edit strings, the grammar against plain folding, damage and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from probity.llm import conversation_repair as C

LEGAL = re.compile("(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string, key string, idx int, audit string"


def edit_strings(n):
    """Each row's letter with up to two inserts before it and at the end."""
    gaps = ["", "I", "II"]
    for letters in itertools.product("KRD", repeat=n):
        for before in itertools.product(gaps, repeat=n + 1):
            yield "".join(b + e for b, e in zip(before, letters)) + before[n]


def apply(audit, rows):
    """(cost, lines) or None if illegal; rows are (role, text, fault)."""
    cost, lines, roles, at = 0, [], "", 0
    for e in audit:
        cost += C.COST[e]
        if e == "I":
            role, text = ("assistant" if roles.endswith("u") else "user"), ""
        else:
            role, text, fault = rows[at]
            at += 1
            if e == "D":
                continue
            if fault in ("blank", "duplicate"):
                return None
            cost += fault == "truncated"
            if e == "R":
                role = "assistant" if roles.endswith("u") else "user"
        roles += role[:1] if role else "?"
        lines.append((role, text))
    return (cost, lines) if LEGAL.fullmatch(roles) else None


def brute(rows):
    best = None
    for audit in edit_strings(len(rows)):
        got = apply(audit, rows)
        if got is not None and (best is None or (got[0], audit) < best[:2]):
            best = (got[0], audit, got[1])
    return best


def faults(rows):
    """Fault of each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(conv, rows):
    """The whole report of one conversation; rows are (turn, role, text) in order."""
    f = faults(rows)
    cost, audit, lines = shortest([(r, t, x) for (_, r, t), x in zip(rows, f)])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (conv, gaps, *(f.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def shortest(rows):
    """Dijkstra-free plain DP over (row, roles written so far by state), whole strings kept: checked against ``brute`` below."""
    layer = {"": (0, "", [])}
    ends = lambda s: s[-1:]

    def put(layer, state, way):
        if state not in layer or way[:2] < layer[state][:2]:
            layer[state] = way

    def grown(layer):
        out = dict(layer)
        for _ in range(2):
            for state, (c, a, lines) in list(out.items()):
                new = "a" if ends(state) == "u" else "u"
                put(out, new, (c + 2, a + "I", lines + [("assistant" if new == "a" else "user", "")]))
        return out

    for role, text, fault in rows:
        after = {}
        for state, (c, a, lines) in grown(layer).items():
            put(after, state, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            new, more = "a" if ends(state) == "u" else "u", int(fault == "truncated")
            put(after, new, (c + 2 + more, a + "R", lines + [("assistant" if new == "a" else "user", text)]))
            i = role[:1]
            if i == new or (i == "s" and state == ""):
                put(after, i, (c + more, a + "K", lines + [(role, text)]))
        layer = after
    return min(v for s, v in grown(layer).items() if s in ("", "a"))


def random_rows(rng, n, wild=False):
    roles = ["system", "user", "assistant"] + (["tool", "", "User"] if wild else [])
    return [(rng.choice([i, i, i, None if wild else i]), rng.choice(roles), rng.choice(["", " \n", "Yes.", "no", "Well! \t", f"text {i}?", f"cut {i}"])) for i in range(n)]


def test_plain_version_equals_search():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(4 if n == 3 else 25):
            made = random_rows(rng, n, True)
            rows = [(r, t, f) for (_, r, t), f in zip(made, faults(made))]
            assert shortest(rows) == brute(rows)


def symbols(rows):
    return bytes(C._SYMBOL[None if f in ("blank", "duplicate") else (r[:1] if r[:1] in ("u", "a", "s") else "o", f == "truncated")] for (_, r, _), f in zip(rows, faults(rows)))


def test_grammar_keeps_costs_and_audits():
    rng = random.Random(2)
    grammar = C.Grammar()
    for _ in range(6):
        known = len(grammar.matrices)
        pairs = []
        for _ in range(5):
            a, b = rng.randrange(known), rng.randrange(known)
            if (a, b) not in pairs:
                pairs.append((a, b))
        grammar.add_round(pairs)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(1, 40), True)
        cost, audit, _ = shortest([(r, t, f) for (_, r, t), f in zip(rows, faults(rows))])
        block = symbols(rows)
        m = grammar.folded(block)[1][-1]
        end = C.best_end(m)
        assert m.cost[0][end] + 2 * C.CLOSING[end] == cost
        assert grammar.audit(block, 0, end) + "I" * C.CLOSING[end] == audit
        # the same over blocks of blocks
        cut = sorted({0, len(block), *rng.choices(range(len(block) + 1), k=3)})
        parts = [block[a:b] for a, b in zip(cut, cut[1:])]
        folded = C.fold([C.Matrix.unpack(grammar.folded(p)[1][-1].pack()) for p in parts])
        assert "".join(grammar.audit(p, i, j) for p, (i, j) in zip(parts, C.way_back(folded, 0, C.best_end(folded[-1])))) + "I" * C.CLOSING[end] == audit


def order(rows):
    """By turn (nulls first), as the operator orders distinct turns; the fixtures repeat a turn only by equal rows."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(7)
    out = {c: random_rows(rng, rng.randint(1, 9), c % 2 == 1) for c in range(120)}
    for c in out:  # at most one null turn, so that the order is stated
        first = True
        for i, (t, r, x) in enumerate(out[c]):
            if t is None and not first:
                out[c][i] = (i, r, x)
            first = first and t is not None
    out[200] = [(i, "user" if i % 2 == 0 else "assistant", f"message {i}.") for i in range(9_000)]  # several blocks
    out[200][4_500] = (4_500, "assistant", "message 17.")
    out[200][17] = (17, "assistant", "message 17.")
    out[201] = [(0, "user", "x" * 2_000_000 + "."), (1, "assistant", "y" * 1_500_000), (2, "user", "z.")]
    out[202] = [(None, "system", "Be brief.")]
    out[203] = [(5, "user", "Same."), (5, "user", "Same."), (5, "user", "Same."), (9, "user", "Same.")]
    out[None] = [(-3, "user", "Hé?"), (4, "assistant", "\U0001F600!")]
    return out


def frame(spark, conversations):
    return spark.createDataFrame([(c, *r, "k", 1, "clash") for c, rows in conversations.items() for r in rows], KIND).repartition(6)


def test_report_equals_plain_version(spark, conversations):
    df = frame(spark, conversations)
    extra = spark.createDataFrame([(999,), (None,), (200,)], "conv_id long")
    got = sorted((tuple(r) for r in C.conversation_report(df, df.select("conv_id").union(extra)).collect()), key=str)
    want = sorted([plain(c, order(rows)) for c, rows in conversations.items()] + [(999, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())], key=str)
    assert got == want


def test_nulls_read_as_one_space(spark):
    df = spark.createDataFrame([(1, 0, None, "Hello."), (1, 1, "user", None), (1, None, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in C.conversation_report(df, df).collect()] == [plain(1, [(None, "user", "Hi."), (0, " ", "Hello."), (1, "user", " ")])]


def test_repaired_rows_are_legal_and_agree_with_the_hash(spark, conversations):
    df = frame(spark, conversations)
    lines = {}
    for r in sorted(C.repair_conversations(df).collect(), key=lambda r: r["position"]):
        lines.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
    for r in C.conversation_report(df, df).collect():
        own = lines.get(r["conv_id"], [])
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert LEGAL.fullmatch("".join(x[:1] for _, x, _ in own))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in own).encode()).hexdigest() == r["repaired_sha256"]


def test_damage(spark, conversations):
    small = {c: rows for c, rows in conversations.items() if c is None or c < 200}
    got = sorted((tuple(r) for r in C.damaged(frame(spark, small)).collect()), key=str)
    want = []
    for c, rows in small.items():
        for t, role, text in rows:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_empty_table(spark, conversations):
    df = frame(spark, {1: [(0, "user", "x")]}).limit(0)
    assert C.conversation_report(df, df).count() == 0
    assert C.repair_conversations(df).count() == 0


def test_many_repeats_take_the_salted_join(spark, conversations, monkeypatch):
    df = frame(spark, {c: rows for c, rows in conversations.items() if c is not None and c < 60})
    want = sorted(map(str, C.conversation_report(df, df).collect()))
    monkeypatch.setattr(C, "BROADCAST_ROWS", -1)
    assert sorted(map(str, C.conversation_report(df, df).collect())) == want
