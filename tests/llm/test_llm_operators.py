"""Each operator against brute force or planted cases, and on awkward rows.

Awkward rows: null ids and texts, empty and very long texts, repeated rows, extra columns
with clashing names, and an empty table.
"""

import collections
import random
import zlib

import numpy as np
import pytest

from probity.llm import ann, decontaminate, html_text, jaccard_join, license_scan, line_dedup, packing, quotations, substring_dedup, toxicity

WORDS = [f"w{i}" for i in range(4000)]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    base, passage = text(rng, 300), text(rng, 70)
    edited = base.split()
    edited[150] = "changed"
    rows = [(i, text(rng, 120)) for i in range(20)]
    rows += [(30, base), (31, base), (32, " ".join(edited)), (33, text(rng, 60) + " " + passage + " " + text(rng, 60)),
             (34, text(rng, 90) + "\n" + passage), (35, passage + " " + text(rng, 20000)),
             (40, None), (41, ""), (42, "one two"), (42, "one two"), (43, " \t\n"), (None, base), (30, base)]
    line = "This very line recurs in many documents."
    rows += [(50 + i, f"{text(rng, 30)}\n  {line.upper() if i % 2 else line}\t\n{text(rng, 10)}") for i in range(5)]
    df = spark.createDataFrame([(a, b, "x", 1, "y", 2) for a, b in rows], "doc_id long, text string, n_lines string, id int, _id string, score int")
    return rows, df.repartition(5)


def sets(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_jaccard_components(awkward):
    rows, df = awkward
    s = [(i, sets(t)) for i, t in rows]
    low = {i: i for i, _ in rows if i is not None}
    for _ in range(4):
        for i, a in s:
            for j, b in s:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    want = collections.Counter((i, len(a), None if i is None else low[i]) for i, a in s)
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
    assert got == want
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {31, 32}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_null_ids_take_no_part(spark):
    """A row without an id stands first in the only task; the texts after it still link."""
    words = [f"q{i}" for i in range(100)]
    near = words[:50] + ["other"] + words[51:]
    rows = [(None, " ".join(words)), (7, " ".join(words)), (9, " ".join(near)), (5, " ".join(words[:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r[0] or 0, r[2]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(0, None), (5, 5), (7, 7), (9, 7)]


def test_line_dedup(awkward):
    rows, df = awkward
    holders = collections.defaultdict(set)
    for i, t in rows:
        for ln in (t or "").split("\n"):
            if i is not None and len(ln.strip(" \t\n\v\f\r")) >= 20:
                holders[ln.strip(" \t\n\v\f\r").lower()].add(i)
    got = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(df).collect())
    want = collections.Counter()
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (i is not None and len(h := holders.get(x.strip(" \t\n\v\f\r").lower(), ())) >= 3 and i != max(h))]
        want[(i, t if len(keep) == len(ls) else "\n".join(keep), len(ls), len(ls) - len(keep))] += 1
    assert got == want
    assert sum(n for (_, _, _, n), c in got.items()) >= 4
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_packing_round_trip(awkward):
    from tokenizers import Tokenizer
    rows, df = awkward
    tok = Tokenizer.from_file(packing.default_vocabulary())
    out = packing.pack_documents(df, keep_ids=True).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[(i, p, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_best_fit_decreasing_equals_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([10, 37, 100])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 200))), reverse=True)
        bins = []
        for x in items:
            fit = [b for b in bins if b >= x]
            if fit:
                b = min(fit)
                bins.remove(b)
                bins.append(b - x)
            else:
                bins.append(cap - x)
        runs = packing.best_fit_decreasing(collections.Counter(items), cap)
        used = collections.Counter()
        for length, _, n, first, per, _ in runs:
            for j in range(n):
                used[first + j // per] += length
        assert sorted(cap - u for u in used.values()) == sorted(bins)


def test_chunk_tokenizer_equals_whole_texts():
    from tokenizers import Tokenizer
    path = packing.default_vocabulary()
    tok, own = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    texts = ["It's A test, isn't it? ... yes!", "Écoute, ÇA! é, ΣΑΣ. İx,", "a\x1cb  c d", "x,, y., 3, 4. <|endoftext|> z", "", "  "]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_license_scan(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under apache license 2 0"), (3, "under the Apache License 2.1"),
            (4, "Copyright (c) 2020 Some One Else. All rights reserved."), (5, None), (6, ""), (None, "CC BY cc by"), (7, "cc. BY-nc"), (7, "cc. BY-nc")]
    got = {(r["doc_id"], frozenset(m["label"] for m in r["matches"]), r["n_words"]) for r in
           license_scan.scan_licenses(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int")).collect()}
    assert got == {(1, frozenset({"apache-2.0"}), 8), (2, frozenset({"apache-2.0"}), 6), (3, frozenset(), 6), (4, frozenset({"reserved", "copyright-notice"}), 9),
                   (5, frozenset(), 0), (6, frozenset(), 0), (None, frozenset({"cc-by"}), 4), (7, frozenset({"cc-by"}), 3)}


def test_contamination(spark, awkward):
    rows, df = awkward
    rng = random.Random(9)
    items = [(1, rows[0][1][:400]), (2, text(rng, 40)), (3, None), (4, ""), (5, "one two"), (None, " ".join(rows[25][1].split()[19000:19030])), (1, rows[0][1][:400])]
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, id int")
    want = collections.Counter()
    for i, t in rows:
        for j, u in items:
            a, b = sets(t), sets(u)
            if b and 100 * len(a & b) >= 80 * len(b):
                want[(i, j, len(b), len(a & b))] += 1
    got = collections.Counter(tuple(r)[:4] for r in decontaminate.find_contamination(df, bench).collect())
    assert got == want and len(want) >= 3
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


def test_contamination_by_short_items(spark):
    rng = random.Random(21)
    docs = [(i, text(rng, 3000)) for i in range(40)]
    items = []
    for i, t in docs:
        w = t.split()
        items += [(len(items) + j, " ".join(w[at:at + n])) for j, (n, at) in enumerate((n, rng.randrange(2900)) for n in (5, 6, 7, 8) for _ in range(10))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                                                                 spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(n // 40, n) for n in range(len(items))} <= got


def test_repeated_passages(awkward):
    _, df = awkward
    got = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        got[(r["class_id"], r["class_first_word"])].add(r["doc_id"])
    found = set().union(*got.values())
    assert found == {30, 31, 32, 33, 34, 35}
    assert any({33, 34, 35} <= c for c in got.values())
    assert any({30, 31, 32} <= c for c in got.values())
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_partners_of_one_text_with_passages_of_other_extent_share_a_class(spark):
    """a and c recur in b with extents that differ by more than a tenth; what a and c share has a class of its own, however many hold it."""
    rng = random.Random(5)
    b = text(rng, 300).split()
    a, c = text(rng, 30).split() + b[20:200] + text(rng, 30).split(), text(rng, 10).split() + b[70:260]
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))] + [(10 + i, text(rng, 40) + " " + " ".join(b[80:190])) for i in range(80)]
    rows = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    at = {1: 30 + 80, 2: 100, 3: 10 + 30} | {10 + i: 40 + 20 for i in range(80)}  # the words b[100:150]
    classes = {i: {(r["class_id"], r["class_first_word"]) for r in rows if r["doc_id"] == i and r["first_word"] <= p + 10 and r["first_word"] + r["n_words"] >= p + 40}
               for i, p in at.items()}
    assert all(classes[i] & classes[j] for i, j in ((1, 2), (1, 3), (2, 3)))
    assert all(classes[2] & classes[i] for i in at)


def test_word_runs_follow_the_word_rule():
    runs = substring_dedup.WordRuns(2)
    assert runs.sequence(b"  Ab\tc \x0b\nAB c ").tolist() == runs.sequence(b"aB C\r\x0cab  C").tolist()
    assert len(runs.sequence("a\u00a0b \u2003 c".encode())) == 2 and not len(runs.sequence(b" \n")) and not len(runs.sequence(b""))
    assert runs.sequence(b"ab ba")[0] != runs.sequence(b"ba ab")[0] and len(set(runs.sequence(b"a b c a b c " + b"x" * 5000).tolist())) == 4


def test_shuffles_of_a_written_step_are_freed(spark):
    from probity.llm.common import materialise, shuffles_freed
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
        assert materialise(spark.range(100).groupBy((substring_dedup.F.col("id") % 7).alias("k")).count()).count() == 7
    assert spark.conf.get(name) == before


def test_a_passage_shared_with_another_hub_explains_no_token(monkeypatch):
    """w's passages with hubs h1 (0..60) and h2 (50..116) cover it; against h1 its tokens from 60 on stay unexplained."""
    import pyarrow as pa
    monkeypatch.setattr(substring_dedup.filters, "contains", lambda bits, values, n: np.ones(len(values), dtype=bool))
    w = list(range(1000, 1116))
    hits = [{"fn": fn, "a": 0, "cs": [30, 70], "b": 115, "ha": 0, "hb": 59} for fn in range(2)]
    row = {"hub": b"h1", "rid": b"w", "hits": hits, "hub_tokens": w[:60], "tokens": w, "in": [{"s": 0, "n": 60}, {"s": 50, "n": 66}]}
    out = [r for b in substring_dedup._verify([pa.RecordBatch.from_pylist([row])], 46, 80, 2, type("Filter", (), {"value": None})) for r in b.to_pylist()]
    assert [(r["s"], r["n"]) for r in out if r["token"] is None] == [(0, 60)]
    assert [r["token"] for r in out if r["token"] is not None] == w[60:]


def test_compact_windows_cover_every_long_run_once():
    values = np.random.default_rng(0).integers(0, 1000, 60).astype(np.uint64)
    windows = substring_dedup.compact_windows(values, 10)
    for i in range(60):
        for j in range(i + 9, 60):
            at = [c for a, c, b in windows if a <= i <= c <= j <= b]
            assert len(at) == 1 and values[at[0]] == values[i:j + 1].min()


def test_toxicity(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, text(rng, 60) + (f" you {rng.choice(['vilestuff', 'vilething', 'nastyx'])}{rng.choice('abc')} end" if bad else ""), int(bad)))
    docs = spark.createDataFrame([(a, b, 9) for a, b, _ in rows] + [(None, "vilestuffa", 9), (1000, None, 9), (1001, "", 9), (0, rows[0][1], 9)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == 604 and all(0 <= r["score"] <= 1 for r in out)
    truth = {a: c for a, _, c in rows}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 5, 40)
    make = lambda: toxicity.unit_vector(np.sort(rng.choice(40, rng.integers(1, 6), replace=False)), rng.integers(1, 4, 40)[:0].tolist() or 1, idf)
    examples = [(i, int(i % 3 == 0), *make()) for i in range(500)]
    index = toxicity.BlockMaxIndex(examples, 40)
    for _ in range(50):
        t, w = make()
        dense = np.zeros(40)
        dense[t] = w
        cos = sorted(((round(float(dense[e[2]] @ e[3]), 12), -e[0]) for e in examples if set(e[2]) & set(t)), reverse=True)[:7]
        got = [(s, -int(index.ids[i])) for s, i in index.nearest(t, w, 7)]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in cos], abs=1e-9)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    vs = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 8)).astype(np.float32))]
    vs += [(1000 + i, vs[5][1]) for i in range(60)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [1.0, None] + [1.0] * 6), (2004, [1.0]), (None, vs[3][1]), (7, vs[7][1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in vs + bad], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, lambda i: i % 100 == 0, target_recall=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q, v in vs:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), i) for i, u in vs if i != q)[:10]
            hit += len({i for _, i in d} & {i for _, i, _ in got[q]})
            total += 10
    assert hit >= 0.95 * total
    assert not {2000, 2001, 2002, 2003, 2004} & {i for g in got.values() for _, i, _ in g}
    assert ann.nearest_neighbours(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_nearest_neighbours_over_many_blocks_and_query_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    monkeypatch.setattr(ann, "PART_QUERIES", 4)
    vs = np.random.default_rng(8).normal(size=(500, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest_neighbours(df, lambda i: i % 50 == 0, target_recall=1.0).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == list(range(0, 500, 50))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((vs - vs[q]) ** 2).sum(axis=1))
        assert len(set(found)) == 10 and q not in found and list(d[found]) == sorted(d[found])
        hit += len(set(np.argsort(d)[1:11].tolist()) & set(found))
    assert hit >= 99
    cell, blocks = ann.cells_of({0: 100, 3: 5, 7: 40})
    assert sorted(cell) == [0, 3, 7] and [blocks[cell[i]] for i in (0, 3, 7)] == [4, 1, 2]


def test_html(spark):
    page = ("<html><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies here today</p></div>"
            "<main><h1>Title &amp; more</h1><p>One two\n three.<br>four<script>var x='</p>';</script></p><div class='ad'>buy now</div><p>Five six seven.</main>"
            "<section id='comments'><p>great post by you</p></section><footer>foot</footer></body></html>")
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>unclosed <b>text here is fine &lt;x"), (3, "w", "<p>unclosed <b>text here is fine &lt;x"), (4, "z", "<!-- only" + " a" * 50000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract_main_text(df).collect()]
    assert (1, "Title & more\n\nOne two three. four\n\nFive six seven.") in got
    assert got.count((3, "unclosed text here is fine <x")) == 2
    assert {(2, ""), (None, ""), (4, "")} <= set(got) and len(got) == 6
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_nearest_neighbours_ranks_are_full(spark):
    """Seven groups of 30 vectors and one far group of 3, of which one is a query; then a table of 7."""
    for seed in (44, 6):
        rng = np.random.default_rng(seed)
        vs = [c + rng.normal(scale=0.01, size=4) for c in rng.normal(scale=1000, size=(7, 4)) for _ in range(30)] + [np.full(4, 9e3) + rng.normal(scale=0.01, size=4) for _ in range(3)]
        ask = lambda i: (i % 3 == 0) & (i <= 210)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
        ranks = collections.Counter(r["query_id"] for r in ann.nearest_neighbours(df, ask, calibration_queries=60).collect())
        assert ranks == {i: 10 for i in range(0, 211, 3)}
    few = df.limit(7)
    assert collections.Counter(r["query_id"] for r in ann.nearest_neighbours(few, lambda i: i >= 0).collect()) == {r["vec_id"]: 6 for r in few.collect()}


def test_nearest_neighbours_width_serves_every_probe():
    tree = ann.KMeansTree(np.random.default_rng(3).normal(size=(300, 4)))
    assert len(tree.visit(np.zeros(4), 1, {leaf: 2 for leaf in range(tree.leaves)}, 11)) == 6
    assert ann.calibrated_width([[1] * 10] * 50 + [[1] * 5 + [9] * 5], 0.98) == 9


def labelled_pages():
    """Pages with a marked article among a link list, an advert and a footer, and the texts of their articles."""
    pages, texts = [], []
    for i in range(40):
        rng = random.Random(i)
        words = [text(rng, 30) for _ in range(3)]
        body = f"<h1>Title {i}</h1>" + "".join(f"<p>{w}</p>" for w in words)
        pages.append("<html><body><nav><ul><li><a href='/a'>home</a></li><li><a href='/b'>news</a></li></ul></nav><div class='ad'>buy this now</div>"
                     f"<article>{body}</article><footer>some imprint</footer></body></html>")
        texts.append("\n\n".join([f"Title {i}", *words]))
    return pages, texts


def test_html_weights_reach_pages_without_marks(spark):
    pages, texts = labelled_pages()
    top = "<html><body><nav><ul><li><a href='/a'>home</a></li><li><a href='/b'>news</a></li></ul></nav>"
    stripped = [p.replace("<article>", "").replace("</article>", "") for p in pages]
    recipe = top + "<div><h1>Pancakes</h1><ul><li>two eggs</li><li>one cup of milk</li></ul><ol><li>Mix all of it</li><li>Bake</li></ol></div><footer>some imprint</footer></body></html>"
    teaser = top + "<h1>Real</h1><p>The body of this page has many words and is marked by nothing.</p><footer>some imprint</footer><div><article><p>Teaser</p></article></div></body></html>"
    script = "<script>document.write('<main>')</script><!-- <main> -->" + stripped[7]
    rows = list(enumerate([*stripped[:5], recipe, teaser, script])) + [(100 + i, p) for i, p in enumerate(pages[5:])]
    got = dict(html_text.extract_main_text(spark.createDataFrame([(i, "u", p) for i, p in rows], "page_id long, url string, html string")).select("page_id", "text").collect())
    assert [got[i] for i in range(5)] == texts[:5] and [got[100 + i] for i in range(35)] == texts[5:]
    assert got[5] == "Pancakes\n\ntwo eggs\n\none cup of milk\n\nMix all of it\n\nBake"
    assert "The body of this page has many words" in got[6] and "home" not in got[6]
    assert got[7] == texts[7]


def test_html_names_do_not_cut(spark):
    pages, texts = labelled_pages()
    wraps = ["<div class='has-sidebar'>", "<div class='overflow-hidden'>", "<div id='with-ads'>", "<div class='social-science'>", "<div data-id='menu' data-hidden='no'>",
             "<blockquote cite='/hidden-costs'>"]
    rows = [p.replace("<article>", w).replace("</article>", "</div>") for w, p in zip(wraps, pages)]
    rows += [pages[6].replace("<article>", "<div class='sidebar widget'><article>").replace("</article>", "</article></div>")]
    rows += [p.replace("</article>", "<div class='ad'>inside</div><div hidden>unseen</div></article>") for p in pages[7:9]]
    rows += [p.replace("<article>", "<article><div class='comments'>").replace("</article>", "</div></article>") for p in pages[9:]]
    rows += [pages[20].replace("<article>", "<div class='comments'>").replace("</article>", "</div>")]
    got = dict(html_text.extract_main_text(spark.createDataFrame([(i, "u", p) for i, p in enumerate(rows)], "page_id long, url string, html string")).select("page_id", "text").collect())
    assert [got[i] for i in range(40)] == texts
    assert got[40] == texts[20]  # 31 marked pages say that their comments are the text: learned, not fixed


def test_quotations(spark):
    rows = [(1, 0, "Hello world.\n\nHow are you today?"), (1, 1, "I am fine.\nThanks for asking!"), (1, 2, "> How are you TODAY\nAnswering the first again."),
            (1, 3, "> > How are you today?\n> Answering the first again\nSure thing"), (1, 4, "> I am fine.\n> Thanks for asking!\n\nGood to hear"), (1, 5, "continuing"),
            (1, 6, "> Good to hear\nnested"), (1, 7, ">> unknown words\nno link"), (2, 5, "no quotes"), (2, 9, None), (2, 5000, ""), (None, 1, "> q"), (3, None, "t"),
            (1, 1, "I am fine.\nThanks for asking!")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in quotations.link_quotations(df).collect()}
    assert quotations.link_quotations(df).count() == len(rows)
    assert [got[1, t]["parent_turn"] for t in range(8)] == [None, 0, 0, 2, 1, 4, 4, 6]
    assert [got[1, t]["text"] for t in (2, 3, 4, 7)] == ["Answering the first again.", "Sure thing", "Good to hear", "no link"]
    assert sorted(range(8), key=lambda t: got[1, t]["reply_path"]) == [0, 2, 3, 1, 4, 6, 7, 5]
    assert [got[2, t]["parent_turn"] for t in (5, 9, 5000)] == [None, 5, 9]
    assert got[3, None]["reply_path"] is None and got[1, 3]["max_level"] == 2
    assert quotations.link_quotations(df.limit(0)).count() == 0


def test_new_words_are_encoded_together():
    from tokenizers import Tokenizer
    path = packing.default_vocabulary()
    tok, own, rng = Tokenizer.from_file(path), packing.ChunkTokenizer(path), random.Random(17)
    asked, plain = [], own._ids
    own._ids = lambda texts: asked.extend(texts) or plain(texts)
    letters = [chr(i) for i in range(256) if chr(i).isalpha()]
    marks = ["", "", ".", "###", "'", "\">", "--", "&&&'s"]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(marks) for _ in range(400)) for _ in range(10)]
    texts += ["a<|endoftext|> <|endoftext|>, A<|ENDOFTEXT|> b <|startoftext|>!"]
    want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert len(asked) < 1000                       # 4,000 words, most of them new

    own = packing.ChunkTokenizer(path)
    own.ends[:] = False                            # a vocabulary without such marks: one word at a time
    assert own.encode(texts) == want


def test_dropped_ids_move_no_text(spark, monkeypatch):
    from probity.llm import common
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(i % 50, f"text {i}") for i in range(300)] + [(None, "none")], schema).repartition(3)
    gone = spark.createDataFrame([(i,) for i in (3, 3, 7, 99)] + [(None,)], "id long").repartition(2).distinct()
    want = sorted(r["text"] for r in df.collect() if r["doc_id"] not in (3, 7))
    kept = common.without_ids(common.materialise(df), "doc_id", gone)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(r["text"] for r in kept.collect()) == want
    monkeypatch.setattr(common, "BROADCAST_IDS", 1)
    assert sorted(r["text"] for r in common.without_ids(df, "doc_id", gone).collect()) == want
