"""Scored views derived from the driver tables.

Every diagnostic takes a *scored* table (id, split, features, label, prediction).
The driver tables carry no model output, so these views attach a fixed arithmetic
scorer (only ``+ - * /``, bit-identical in Spark and DuckDB).  Each view exists twice:
as a Spark DataFrame (``clf(spark, sf_dir)``) and as DuckDB SQL text
(``CLF_SQL``) for the oracle.  Both read the whole table.

Views (FIXTURES.md §3):

* ``clf``   lineitem, binary: y = returnflag 'R', p from quantity/discount/tax;
* ``reg``   lineitem, regression: y = extendedprice, yh from quantity/tax/discount;
* ``multi`` orders, 3 classes from orderstatus, probabilities from three scores;
* ``docs``  documents joined to labels: y = quality, p from n_chars;
* ``ev``    events, time slices: y = purchase, p from value;
* ``nul``   lineitem with nulls injected by a hash draw (no column holds a null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.hashing import hash01

FEATURES = ["f1", "f2", "f3", "f4"]
SPLIT_SALT = "split"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(u):
    """60/20/20 by u < 0.6 / u < 0.8.  u = k / 2^32 is exact, so floor(5u) picks the
    same split with one evaluation of the hash (a CASE would reference it twice)."""
    names = F.array(*[F.lit(x) for x in ("train", "train", "train", "cal", "test")])
    return F.element_at(names, F.floor(u * F.lit(5.0)).cast("int") + F.lit(1))


def _line_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       F.col("l_quantity").cast("bigint").cast("string"))


def _lineitem(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        _line_id().alias("id"),
        F.col("l_quantity").alias("f1"),
        F.col("l_extendedprice").alias("f2"),
        (F.col("l_discount") + F.lit(0.0)).alias("f3"),
        (F.col("l_tax") + F.lit(0.0)).alias("f4"),
        F.col("l_linestatus").alias("grp"),
        F.col("l_returnflag").alias("flag"),
    ).withColumn("split", _split(hash01("id", salt=SPLIT_SALT)))


def clf_score(df: DataFrame) -> DataFrame:
    """The fixed binary scorer: p from the four features, yh = p >= 0.5."""
    p = F.col("f1") / F.lit(50.0) * F.lit(0.6) + F.col("f3") * F.lit(2.0) + F.col("f4") * F.lit(2.0)
    return df.withColumn("p", p).withColumn("yh", F.when(F.col("p") >= F.lit(0.5), 1).otherwise(0))


def reg_score(df: DataFrame) -> DataFrame:
    """The fixed regression scorer."""
    yh = F.col("f1") * F.lit(2000.0) + F.col("f4") * F.lit(10000.0) - F.col("f3") * F.lit(5000.0)
    return df.withColumn("yh", yh)


def clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _lineitem(spark, sf_dir).withColumn(
        "y", F.when(F.col("flag") == "R", 1).otherwise(0)).drop("flag")
    return clf_score(base)


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _lineitem(spark, sf_dir).withColumn("y", F.col("f2")).drop("flag")
    return reg_score(base)


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    s0 = F.lit(0.5) + F.col("o_totalprice") / F.lit(500000.0)
    s1 = F.lit(1.0)
    s2 = F.lit(0.2) + F.length("o_orderpriority").cast("double") / F.lit(10.0)
    tot = s0 + s1 + s2
    df = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("f1"),
        F.col("o_custkey").cast("double").alias("f2"),
        F.length("o_orderpriority").cast("double").alias("f3"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
         .otherwise(2).alias("y"),
        (s0 / tot).alias("p0"), (s1 / tot).alias("p1"), (s2 / tot).alias("p2"),
    ).withColumn("split", _split(hash01(F.col("id").cast("string"), salt=SPLIT_SALT)))
    df = df.withColumn("probs", F.array("p0", "p1", "p2"))
    yh = (F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0)
           .when(F.col("p1") >= F.col("p2"), 1).otherwise(2))
    return df.withColumn("yh", yh)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    df = d.join(lab, "doc_id", "inner").select(
        F.col("doc_id").alias("id"),
        F.col("n_chars").cast("double").alias("f1"),
        F.col("lang"), F.col("source"),
        F.col("quality").alias("y"))
    p = F.col("f1") / (F.col("f1") + F.lit(2000.0))
    return df.withColumn("p", p).withColumn("yh", F.when(F.col("p") >= F.lit(0.5), 1).otherwise(0))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_score(read(spark, sf_dir, "events"))


def ev_score(e: DataFrame) -> DataFrame:
    """Scored events view from a batch or streaming ``events`` DataFrame."""
    df = e.select(
        F.col("event_id").alias("id"), F.col("ts"), F.col("event_type"),
        F.col("value").alias("f1"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"))
    p = F.col("f1") / (F.col("f1") + F.lit(100.0))
    return df.withColumn("p", p).withColumn("yh", F.when(F.col("p") >= F.lit(0.5), 1).otherwise(0))


def nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem features with ~10 % nulls per column (hash draw per row and column)."""
    li = read(spark, sf_dir, "lineitem")
    base = li.select(_line_id().alias("id"), "l_quantity", "l_extendedprice",
                     (F.col("l_discount") + F.lit(0.0)).alias("l_discount"), "l_returnflag", "l_linestatus")
    out = base.select(
        "id",
        *[F.when(hash01("id", salt=f"null:{c}") < F.lit(0.1), F.lit(None)).otherwise(F.col(c)).alias(c)
          for c in ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")],
        "l_linestatus")
    return out


# ---------------------------------------------------------------------------
# DuckDB twins.  ``H(expr, salt)`` is the same md5-based draw as ``hash01``.
# ---------------------------------------------------------------------------

def H(expr: str, salt: str | None) -> str:
    key = expr if salt is None else f"concat_ws(':', '{salt}', {expr})"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def HL(expr: str) -> str:
    """52-bit tie-break hash (``row_numbers``)."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 13))::BIGINT"


_SPLIT = ("CASE WHEN {u} < 0.6::DOUBLE THEN 'train' WHEN {u} < 0.8::DOUBLE THEN 'cal' "
          "ELSE 'test' END")

_LINE_ID = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
            "CAST(l_quantity AS BIGINT))")

LINE_SQL = f"""
SELECT id, f1, f2, f3, f4, grp, flag, {_SPLIT.format(u=H('id', SPLIT_SALT))} AS split
FROM (SELECT {_LINE_ID} AS id, l_quantity AS f1, l_extendedprice AS f2,
             l_discount + 0.0::DOUBLE AS f3, l_tax + 0.0::DOUBLE AS f4,
             l_linestatus AS grp, l_returnflag AS flag FROM lineitem) b
"""

CLF_P = "f1 / 50.0::DOUBLE * 0.6::DOUBLE + f3 * 2.0::DOUBLE + f4 * 2.0::DOUBLE"
REG_YH = "f1 * 2000.0::DOUBLE + f4 * 10000.0::DOUBLE - f3 * 5000.0::DOUBLE"

CLF_SQL = f"""
SELECT id, f1, f2, f3, f4, grp, split, y, p, CASE WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END AS yh
FROM (SELECT id, f1, f2, f3, f4, grp, split, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS y,
             {CLF_P} AS p FROM ({LINE_SQL}) l) s
"""

REG_SQL = f"""
SELECT id, f1, f2, f3, f4, grp, split, f2 AS y, {REG_YH} AS yh FROM ({LINE_SQL}) l
"""

MULTI_SQL = """
SELECT id, f1, f2, f3, y, p0, p1, p2, split,
       CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS yh
FROM (
  SELECT id, f1, f2, f3, y, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1,
         s2 / (s0 + s1 + s2) AS p2, {split} AS split
  FROM (SELECT o_orderkey AS id, o_totalprice AS f1, CAST(o_custkey AS DOUBLE) AS f2,
               CAST(length(o_orderpriority) AS DOUBLE) AS f3,
               CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS y,
               0.5::DOUBLE + o_totalprice / 500000.0::DOUBLE AS s0, 1.0::DOUBLE AS s1,
               0.2::DOUBLE + CAST(length(o_orderpriority) AS DOUBLE) / 10.0::DOUBLE AS s2
        FROM orders) o
) m
""".replace("{split}", _SPLIT.format(u=H("CAST(id AS VARCHAR)", SPLIT_SALT)))

DOCS_SQL = """
SELECT id, f1, lang, source, y, p, CASE WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END AS yh
FROM (SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS f1, d.lang, d.source, l.quality AS y,
             CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0::DOUBLE) AS p
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x
"""

EV_SQL = """
SELECT id, ts, event_type, f1, y, p, CASE WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END AS yh
FROM (SELECT event_id AS id, ts, event_type, value AS f1,
             CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y,
             value / (value + 100.0::DOUBLE) AS p FROM events) e
"""

NUL_SQL = "SELECT id, " + ", ".join(
    f"CASE WHEN {H('id', 'null:' + c)} < 0.1::DOUBLE THEN NULL ELSE {c} END AS {c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
) + f""", l_linestatus FROM (SELECT {_LINE_ID} AS id, l_quantity, l_extendedprice,
       l_discount + 0.0::DOUBLE AS l_discount, l_returnflag, l_linestatus FROM lineitem) b"""


def with_views(sql: str, *names: str, ctes: str | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views, then ``ctes``."""
    defs = {"clf": CLF_SQL, "reg": REG_SQL, "multi": MULTI_SQL, "docs": DOCS_SQL,
            "ev": EV_SQL, "nul": NUL_SQL}
    parts = [f"{n} AS ({defs[n]})" for n in names]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql


BUILDERS = {"clf": clf, "reg": reg, "multi": multi, "docs": docs, "ev": ev, "nul": nul}


def clf_scorer():
    """The binary fixture scorer as a ``Scorer`` (for re-scoring perturbed rows)."""
    from probity.operators.scoring import Scorer

    def fn(df):
        out = clf_score(df)
        return out.withColumn("probs", F.array(F.lit(1.0) - F.col("p"), F.col("p")))
    return Scorer(fn=fn, task="classification")


def reg_scorer():
    from probity.operators.scoring import Scorer
    return Scorer(fn=reg_score, task="regression")


def multi_scorer():
    """The three-class fixture scorer: the arithmetic of ``multi`` over f1 and f3."""
    from probity.operators.scoring import Scorer

    def fn(df):
        s0 = F.lit(0.5) + F.col("f1") / F.lit(500000.0)
        s1 = F.lit(1.0)
        s2 = F.lit(0.2) + F.col("f3") / F.lit(10.0)
        tot = s0 + s1 + s2
        out = df.withColumn("probs", F.array(s0 / tot, s1 / tot, s2 / tot))
        p = [F.col("probs")[c] for c in range(3)]
        return out.withColumn("yh", F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2))
    return Scorer(fn=fn, task="classification", n_classes=3)


# linear weights of ``reg_score`` (intercept 0)
REG_WEIGHTS = {"f1": 2000.0, "f3": -5000.0, "f4": 10000.0}


def U(keys: str, salt: str, n: int) -> list[str]:
    """DuckDB twin of ``hashing.uniforms``."""
    out = []
    for j in range((n + 3) // 4):
        digest = f"md5(concat_ws(':', '{salt}#{j}', {keys}))"
        for w in range(4):
            if len(out) == n:
                break
            out.append(f"((('0x' || substr({digest}, {1 + 8 * w}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)")
    return out


def G(keys: str, salt: str, n: int) -> list[str]:
    """DuckDB twin of ``hashing.gaussians``."""
    us = U(keys, salt, 2 * ((n + 1) // 2))
    out = []
    for k in range(0, len(us), 2):
        r = f"sqrt(-2.0 * ln({us[k]}))"
        th = f"(2.0 * pi() * {us[k + 1]})"
        out += [f"({r} * cos({th}))", f"({r} * sin({th}))"]
    return out[:n]
