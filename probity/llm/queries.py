"""One query per operator, over its whole table, and SQL twins where SQL can say the same.

Each query is thin: it reads the table, calls its operator with production parameters and
derives the digest columns.  Queries without SQL here are tested against brute force in
``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import language_id, license_scan, whitening
from probity.llm.ann import nearest_neighbours
from probity.llm.conversation_repair import conversation_report, damaged
from probity.llm.decontaminate import find_contamination
from probity.llm.html_text import extract_main_text
from probity.llm.jaccard_join import jaccard_components
from probity.llm.line_dedup import drop_repeated_lines
from probity.llm.packing import pack_documents
from probity.llm.quotations import link_quotations
from probity.llm.substring_dedup import repeated_passages
from probity.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]+"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_SPACES}), '{_UPPER}', '{_LOWER}') AS key
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, (r.key IS NOT NULL AND l.doc_id <> r.keep) AS gone FROM l LEFT JOIN r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the largest doc_id only."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
t AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT t.u, c.low FROM c JOIN t ON t.v = c.node WHERE c.low < t.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.low AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(low) AS low FROM c GROUP BY node) k ON k.node = d.doc_id
""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's shingle set and its component over Jaccard >= 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _license_sql() -> str:
    """Base places from the word list, template labels as patterns over the spaced words."""
    base = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        test = " AND ".join(f"ws[i + {n}] = '{w}'" for n, w in enumerate(phrase.split()))
        base.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    more = [f"CASE WHEN regexp_matches(t, '{license_scan.as_regex(t)}') THEN ['{label}'] ELSE [] END" for label, t in license_scan.TEMPLATES]
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_NO_WORD}'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS t, list_concat({', '.join(base)}) AS b FROM w),
q AS (SELECT *, list_sort(list_distinct(list_transform(b, lambda x: x.label))) AS bl, list_concat(CAST([] AS VARCHAR[]), {', '.join(more)}) AS ml FROM p)
SELECT doc_id, n_words, len(b) AS n_base, list_min(list_transform(b, lambda x: x.at)) AS first_word, list_max(list_transform(b, lambda x: x.at)) AS last_word,
       array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ',') AS labels,
       CASE WHEN len(ml) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM q"""


@query(_license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases with their places, and labels of the phrases and of the matched templates."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                        F.when(F.exists("matches", lambda m: ~m["base"]), 1.0).when(F.size("matches") > 0, 0.5).otherwise(0.0).alias("score"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=None)


@query(f"""
WITH i AS (SELECT item_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}'), lambda w: w <> '') AS ws FROM benchmark),
d AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}'), lambda w: w <> '') AS ws FROM documents),
si AS (SELECT DISTINCT id, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM i WHERE len(ws) > 0)),
sd AS (SELECT DISTINCT id, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n_item FROM si GROUP BY id),
x AS (SELECT sd.id AS doc_id, si.id AS item_id, count(*) AS n_shared FROM sd JOIN si ON sd.g = si.g GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM x JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n_item
""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of a benchmark item's 5-word shingles."""
    return find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated vote of the nearest labelled examples for every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose vec_id is divisible by 100."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 100 == 0)


@query()
def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without quotes, with parents and reply order."""
    return link_quotations(table(spark, sf_dir, "conversations"))


@query()
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that recur in another document, with their class."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 of the id, mod 4, is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out("doc_id"))
    return (language_id.identify_languages(docs.select("doc_id", "text"), learned)
            .select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading components of the distinct quantised vectors, each scaled to variance one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised(F.col("embedding")).alias("x"))
    return whitening.whiten(rows, "vec_id", "x")


_REPAIR_SQL = r"""
WITH RECURSIVE crc(i, v) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT list(v ORDER BY i) AS t FROM crc),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind
      FROM conversations, crcs),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS pos FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, left(role, 1) AS c,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
r AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
ins(i, k, x) AS (VALUES ('0', '', '0'), ('0', 'I', 'u'), ('0', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'),
                        ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')),
walk(conv_id, pos, state, way) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '0', {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, pos, state, min(way) FROM (
    SELECT w.conv_id, r.pos, CASE x.letter WHEN 'D' THEN ins.x WHEN 'R' THEN CASE WHEN ins.x = 'u' THEN 'a' ELSE 'u' END ELSE r.c END AS state,
      {'cost': w.way.cost + 2 * length(ins.k) + x.cost + CASE WHEN x.letter <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
       'audit': w.way.audit || ins.k || x.letter,
       'lines': list_concat(w.way.lines, CASE ins.k WHEN '' THEN CAST([] AS VARCHAR[]) WHEN 'I' THEN CASE WHEN ins.i = 'u' THEN ['assistant:'] ELSE ['user:'] END
                  ELSE CASE WHEN ins.i = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END,
                CASE x.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'R' THEN [CASE WHEN ins.x = 'u' THEN 'assistant:' ELSE 'user:' END || r.text] ELSE [r.role || ':' || r.text] END)} AS way
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1 JOIN ins ON ins.i = w.state
      JOIN (VALUES ('D', 3), ('R', 2), ('K', 0)) x(letter, cost)
        ON x.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (x.letter = 'R' OR r.c = CASE WHEN ins.x = 'u' THEN 'a' ELSE 'u' END OR r.c = 's' AND ins.x = '0')
  ) GROUP BY conv_id, pos, state),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
b AS (SELECT w.conv_id, min({'cost': way.cost + 2 * length(z.k), 'audit': way.audit || z.k, 'lines': list_concat(way.lines, z.more)}) AS way
      FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.pos
        JOIN (VALUES ('0', '', CAST([] AS VARCHAR[])), ('a', '', []), ('u', 'I', ['assistant:']), ('s', 'II', ['user:', 'assistant:'])) z(state, k, more) ON z.state = w.state
      GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.way.cost, 0) AS cost, coalesce(b.way.audit, '') AS audit,
       sha256(coalesce(array_to_string(b.way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query(_REPAIR_SQL)
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after the damage put in."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_report(damaged(messages), messages)
