"""Shared SQL sub-queries mirroring the adapters of ``stageflow.sources.tables``."""

from stageflow.plans.registry import cte

cte("r", """SELECT l_orderkey AS entity, CAST(l_linenumber AS INTEGER) AS stage, CAST((l_linenumber - 1) // 2 AS INTEGER) AS line,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t,
  l_quantity AS qty, l_extendedprice AS price, nullif(l_discount, 0.0) AS disc, l_tax AS tax,
  CAST(l_returnflag = 'R' AS INTEGER) AS row_label FROM lineitem""")
cte("lab", "SELECT o_orderkey AS entity, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders")
cte("v", """SELECT entity, stage, line, min(t) AS entry, max(t) AS exit, max(t) - min(t) AS duration,
  max(qty) AS qty, max(price) AS price, max(disc) AS disc, max(tax) AS tax FROM r GROUP BY entity, stage, line""", ["r"])
cte("lv", "SELECT v.*, coalesce(lab.label, 0) AS label FROM v LEFT JOIN lab USING (entity)", ["v", "lab"])
cte("sens", """SELECT entity, stage, line, entry, feature, value FROM (
  SELECT entity, stage, line, entry, 'qty' AS feature, qty AS value FROM v UNION ALL
  SELECT entity, stage, line, entry, 'price', price FROM v UNION ALL
  SELECT entity, stage, line, entry, 'disc', disc FROM v UNION ALL
  SELECT entity, stage, line, entry, 'tax', tax FROM v) WHERE value IS NOT NULL""", ["v"])
cte("routes", """SELECT entity, string_agg('S' || stage, '->' ORDER BY entry, stage) AS route, CAST(count(*) AS INTEGER) AS num_stages
  FROM v GROUP BY entity""", ["v"])
cte("routes_l", """SELECT routes.*, coalesce(lab.label, 0) AS label, ls.line_sequence FROM routes LEFT JOIN lab USING (entity)
  JOIN (SELECT entity, string_agg('L' || line, '->' ORDER BY line) AS line_sequence FROM (SELECT DISTINCT entity, line FROM v) GROUP BY entity) ls USING (entity)""",
  ["routes", "lab", "v"])
cte("ranked_v", "SELECT *, CASE WHEN stage = 6 THEN 5 WHEN stage > 6 THEN stage - 1 ELSE stage END AS stage_rank FROM v", ["v"])
cte("m", """SELECT entity, stage, stage_rank, entry AS t, qty, price, disc, tax, stage = 1 AS is_entry, stage = 7 AS is_exit,
  CASE WHEN stage = 7 THEN lab.label END AS response,
  lag(stage) OVER w AS prev_stage,
  coalesce(greatest(0.0, (entry - lag(entry) OVER w) * 1440.0), 0.0) AS transit_minutes
  FROM ranked_v LEFT JOIN lab USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY stage_rank, entry, stage)""", ["ranked_v", "lab"])
cte("ev", """SELECT event_id, epoch_us(ts) - 1704067200000000 AS us, ts, user_id AS entity, event_type AS stage, value, props FROM events""")
cte("tk", "SELECT entry, count(*) AS n, entry - lag(entry) OVER (ORDER BY entry) AS gap FROM v WHERE stage = 1 GROUP BY entry", ["v"])
