"""Stages of the pipeline and the whole of it on planted documents, with awkward rows among them."""

import random

import pytest

import corpus_pipeline as pipe

WORDS = [f"w{i}" for i in range(3000)]
LINE = "Subscribe to our newsletter for more of this."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    docs = {i: text(rng.randint(30, 80)) for i in range(200)}
    toxic = [i for i in range(200) if i % 5 == 0]
    for i in toxic:
        docs[i] += " vilespew grumwort vilespew"
    item = text(30)
    docs[300] = text(20) + " " + item + " " + text(20)                     # holds a benchmark item
    docs[301] = text(120)
    docs[302] = docs[301].rsplit(" ", 2)[0]                                # a near copy
    docs |= {310 + i: f"{text(40)}\n{LINE}\n{text(20)}" for i in range(4)}  # a line in four documents
    docs |= {320: None, 321: "", 322: " \n", 323: text(9_000)}
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs.items()] + [(None, "no id here", "en", "src", 10), (321, "", "en", "src", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, set(toxic)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


AWKWARD = [320, 321, 321, 322, None]


def test_each_stage_on_the_whole_table(spark, planted):
    d, docs, toxic = planted
    whole = spark.read.parquet(f"{d}/documents.parquet")
    every = ids(whole)

    kept = pipe.toxicity(spark, whole, d)
    assert kept.columns == whole.columns and set(every) - set(ids(kept)) == toxic
    assert [i for i in ids(kept) if i in AWKWARD] == sorted(AWKWARD, key=str)

    lines = pipe.line_dedup(spark, whole, d)
    assert lines.columns == whole.columns and ids(lines) == every
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert [i for i in range(310, 314) if LINE in texts[i]] == [313] and texts[320] is None and texts[5] == docs[5]

    near = pipe.near_copies(spark, whole, d)
    assert near.columns == whole.columns and set(every) - set(ids(near)) == {302}
    assert [i for i in ids(near) if i in AWKWARD] == sorted(AWKWARD, key=str)

    clean = pipe.decontamination(spark, whole, d)
    assert clean.columns == whole.columns and set(every) - set(ids(clean)) == {300}
    assert [i for i in ids(clean) if i in AWKWARD] == sorted(AWKWARD, key=str)


def test_run_applies_all_stages(spark, planted):
    d, docs, toxic = planted
    out = pipe.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == ({None, *docs} - toxic - {300, 302})
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["piece"] for r in out if r["doc_id"] == 323) >= 1  # the long text is cut, not dropped


def test_stages_on_an_empty_table(spark, planted):
    d, _, _ = planted
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        assert stage(spark, empty, d).count() == 0
