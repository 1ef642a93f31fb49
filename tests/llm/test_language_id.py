"""Language identification against a plain count-and-sum version, on held-out rows and on awkward rows."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from probity.llm import language_id as L

STEMS = {"aa": ["kor", "tash", "mil", "benu"], "bb": ["ço", "éla", "üri", "nowe"], "cc": ["stra", "zwin", "kor", "hulp"]}


def make(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, make(rng, lang := rng.choice("abc") * 2, rng.randint(1, 60)), lang) for i in range(200)]
    return out + [(300, None, "aa"), (301, "", "aa"), (302, "12 -- 34", "bb"), (303, "tashmil benu", None), (None, "zwinstra hulp", "cc"),
                  (5, out[5][1], out[5][2]), (304, make(rng, "bb", 30_000), "bb"), (305, "a", None), (306, "x\néLA \U0001F600 Ço", None)]


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " " if t.strip() else ""
    return collections.Counter(t[i:i + n] for n in range(1, L.ORDERS + 1) for i in range(len(t) - n + 1))


def bucket(gram):
    p = np.array([ord(c) for c in gram], dtype=np.uint32)
    return int(L.buckets_of(p, np.zeros(len(p), dtype=np.int32))[len(gram) - 1][0])


def plain(rows, learned):
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in learned:
        docs[lang] += 1
        for g, c in plain_grams(text or "").items():
            counts[lang][bucket(g)] += c
    out = []
    for id_, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            out.append((id_, "und", 0.0))
            continue
        grams = collections.Counter()
        for g, c in plain_grams(text).items():
            grams[bucket(g)] += c
        total = {}
        for lang in docs:
            mass = sum(counts[lang].values()) + L.SMOOTHING * L.BUCKETS
            total[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
                c * math.log((counts[lang][b] + L.SMOOTHING) / mass) for b, c in grams.items()) / L.ORDERS
        best = min(total, key=lambda k: (-total[k], k))
        out.append((id_, best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "clash", 1) for a, b, c in rows], "doc_id long, text string, lang string, lang_pred string, score int").repartition(3)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def test_equals_plain_sums(spark, rows):
    df = frame(spark, rows)
    got = [tuple(r) for r in L.identify_languages(df, df.where("lang is not null")).collect()]
    want = plain(rows, [r for r in rows if r[2] is not None])
    assert [g[:2] for g in order(got)] == [w[:2] for w in order(want)]
    assert np.allclose([g[2] for g in order(got)], [w[2] for w in order(want)], atol=1e-4)


def test_parts_of_a_long_text_sum_to_the_whole(monkeypatch):
    text = make(random.Random(5), "bb", 3000)
    logp = np.random.default_rng(0).normal(size=(3, L.BUCKETS + 1))
    logp[:, L.BUCKETS] = 0
    whole = L.log_likelihoods(["aé", text, "", text[:70], "z"], logp)
    for piece in (1, 5, 50, 1000):
        monkeypatch.setattr(L, "_PIECE", piece)
        assert np.allclose(L.log_likelihoods(["aé", text, "", text[:70], "z"], logp), whole)


def test_held_out_rows_are_found(spark, rows):
    df = frame(spark, [(i, t, None if i is None or i % 4 == 0 else x) for i, t, x in rows])
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(df, df.where("lang is not null")).collect()}
    tested = [(i, x) for i, t, x in rows[:200] if i % 4 == 0 and len(t.split()) >= 4]
    assert sum(got[i] == x for i, x in tested) >= 0.98 * len(tested)


def test_without_labels_or_rows(spark, rows):
    df = frame(spark, rows)
    assert {tuple(r)[1:] for r in L.identify_languages(df, df.limit(0)).collect()} == {("und", 0.0)}
    assert L.identify_languages(df.limit(0), df).count() == 0


def test_more_languages_than_a_task_holds(monkeypatch):
    texts, langs = [make(random.Random(i), "aa", 5) for i in range(60)], ["abcdef"[i % 6] for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(langs)], names=["text", "lang"])

    def sums():
        out = collections.Counter()
        for b in L._counts([batch]):
            for r in b.to_pylist():
                out[r["lang"], r["bucket"]] += r["count"]
        return out

    whole = sums()
    monkeypatch.setattr(L, "_LANGUAGES", 2)
    assert sums() == whole and whole["a", -1] == 10
