"""Structured Streaming check: the time-slice monitor fed by a file stream."""

from __future__ import annotations

from probity.registry import register, rounded
from probity.sources import fixtures as fx
from probity.sources.fixtures import with_views
from probity.streaming import monitor


@register("stream_slice_metrics", with_views("""
SELECT slice, n, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier,
       round(selection_rate, 6) AS selection_rate, round(psi, 6) AS psi FROM (
  SELECT s.slice, max(s.n) AS n, max(s.acc) AS accuracy, max(s.brier) AS brier, max(s.sel) AS selection_rate,
         sum((r.e - CASE WHEN coalesce(c.ca, 0) = 0 THEN 0.0001 ELSE c.ca / s.n END)
             * ln(r.e / CASE WHEN coalesce(c.ca, 0) = 0 THEN 0.0001 ELSE c.ca / s.n END)) AS psi
  FROM sl s CROSS JOIN ref r LEFT JOIN cs c ON c.slice = s.slice AND c.bin = r.bin
  GROUP BY s.slice) x""", "ev", ctes="""
b AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS slice, y, yh, p,
             CASE WHEN f1 >= e[1] AND f1 <= e[11] THEN len(list_filter(e[2:10], lambda x: x <= f1)) END AS bin
      FROM ev CROSS JOIN (SELECT CASE WHEN hi = lo THEN [lo FOR i IN range(11)]
                                 ELSE [(i / 10 * 100) / (100 / (hi - lo)) + lo FOR i IN range(11)] END AS e
                          FROM (SELECT min(f1) AS lo, max(f1) AS hi FROM ev) m) ed),
ref AS (SELECT g.bin, CASE WHEN coalesce(c.n, 0) = 0 THEN 0.0001 ELSE c.n / (SELECT count(*) FROM b) END AS e
        FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c
        ON g.bin = c.bin),
sl AS (SELECT slice, count(*) AS n, avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS acc,
              avg((p - y) * (p - y)) AS brier, avg(yh) AS sel FROM b GROUP BY slice),
cs AS (SELECT slice, bin, count(*) AS ca FROM b WHERE bin IS NOT NULL GROUP BY slice, bin)
"""))
def stream_slice_metrics(spark, d):
    reference = fx.ev(spark, d)
    edges, shares = monitor.reference_profile(reference, "f1")
    schema = fx.read(spark, d, "events").schema
    name = monitor.run_monitor(spark, d, schema, fx.ev_score, "ts", "f1", edges, shares, glob="events.parquet")
    return rounded(spark.table(name))
