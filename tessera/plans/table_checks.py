"""Queries over tables that run over pages: merged fragments, alignment of two documents, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import table_alignment
from tessera.operators.components import written
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

DOC = ["batch_id"]

RUNS = """, r_page AS (
  SELECT *, table_idx = max(table_idx) OVER p AS on_last, table_idx = min(table_idx) OVER p AS on_first FROM b_printed WINDOW p AS (PARTITION BY role, batch_id, page_index)),
r_on AS (
  SELECT *, coalesce(lag(page_index) OVER o = page_index - 1 AND lag(columns) OVER o = columns AND lag((y + h) / 842.0) OVER o >= 0.7 AND y / 842.0 <= 0.3 AND lag(on_last) OVER o AND on_first
    AND lag(list_max(rows)) OVER o >= 2 AND list_max(rows) >= 2, false) AS goes_on FROM r_page WINDOW o AS (PARTITION BY role, batch_id ORDER BY table_idx)),
r_run AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY role, batch_id ORDER BY table_idx) AS run FROM r_on),
r AS (SELECT *, row_number() OVER (PARTITION BY role, batch_id, run ORDER BY table_idx) - 1 AS place, count(*) OVER (PARTITION BY role, batch_id, run) AS fragments FROM r_run),
r_sum AS (
  SELECT a.role, a.batch_id, a.table_idx AS i, b.place - a.place + 1 AS k, a.columns, a.fragments - a.place AS left_on, list_transform(range(1, len(a.rows) + 1), lambda c: list_sum(list_transform(parts, lambda p: p[c]))::BIGINT) AS rows
  FROM r a JOIN (SELECT role, batch_id, run, place, table_idx, list(rows) OVER (PARTITION BY role, batch_id, run ORDER BY table_idx) AS upto FROM r) b
    ON a.role = b.role AND a.batch_id = b.batch_id AND a.run = b.run AND b.place >= a.place, LATERAL (SELECT b.upto[a.place + 1:] AS parts))"""

WALK = """, s AS (SELECT role, batch_id, i, k, columns, left_on, header, list_transform(rows, lambda x: x - CASE WHEN header THEN k - 1 ELSE 0 END) AS rows FROM r_sum, (VALUES (true), (false)) v(header)),
near AS (
  SELECT m.batch_id, m.table_idx AS i, t.table_idx AS j, list_max(list_transform(range(1, m.columns + 1), lambda c: abs(m.rows[c] - t.rows[c]))) AS apart
  FROM r m JOIN r t ON m.batch_id = t.batch_id AND m.columns = t.columns WHERE m.role = 'master' AND t.role = 'translation'),
fit AS MATERIALIZED (SELECT * FROM near WHERE apart <= 1),
split AS MATERIALIZED (
  SELECT m.batch_id, m.i, t.i AS j, m.k, t.k AS n, m.rows AS merged, CASE WHEN m.k > 1 THEN m.header ELSE t.header END AS header
  FROM s m JOIN s t ON m.batch_id = t.batch_id AND m.columns = t.columns
  WHERE m.role = 'master' AND t.role = 'translation' AND m.k + t.k > 2 AND list_max(list_transform(range(1, m.columns + 1), lambda c: abs(m.rows[c] - t.rows[c]))) <= 1
  QUALIFY row_number() OVER (PARTITION BY m.batch_id, m.i, t.i ORDER BY m.k DESC, t.k DESC, m.header DESC, t.header DESC) = 1),
skip_t AS MATERIALIZED (SELECT batch_id, i, j, min(d) AS d FROM (SELECT batch_id, i, j - d AS j, d FROM fit, range(1, 4) x(d)) GROUP BY 1, 2, 3),
skip_m AS MATERIALIZED (SELECT batch_id, i, j, min(d) AS d FROM (SELECT batch_id, i - d AS i, j, d FROM fit, range(1, 4) x(d)) GROUP BY 1, 2, 3),
docs AS (SELECT batch_id, count(*) FILTER (role = 'master') AS nm, count(*) FILTER (role = 'translation') AS nt FROM b_printed GROUP BY 1),
walk AS (
  SELECT batch_id, nm, nt, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS di, 0::BIGINT AS dj, 0::BIGINT AS pe, 0::BIGINT AS pm, -1::BIGINT AS step, '' AS status, '' AS reason, NULL::BIGINT[] AS merged, false AS header FROM docs
  UNION ALL
  SELECT q.batch_id, nm, nt, q.i, q.j,
    CASE WHEN q.pe > 0 THEN 0 WHEN q.pm > 0 THEN 1 WHEN q.i >= nm THEN 0 WHEN q.j >= nt THEN 1 WHEN k IS NOT NULL THEN k WHEN apart IS NOT NULL THEN 1 WHEN st.d IS NOT NULL THEN 0 ELSE 1 END,
    CASE WHEN q.pe > 0 THEN 1 WHEN q.pm > 0 THEN 0 WHEN q.i >= nm THEN 1 WHEN q.j >= nt THEN 0 WHEN k IS NOT NULL THEN n WHEN apart IS NOT NULL THEN 1 WHEN st.d IS NOT NULL THEN 1 WHEN sm.d IS NOT NULL THEN 0 ELSE 1 END,
    CASE WHEN q.pe > 0 THEN q.pe - 1 WHEN q.pm > 0 OR q.i >= nm OR q.j >= nt OR k IS NOT NULL OR apart IS NOT NULL THEN 0 ELSE coalesce(st.d - 1, 0) END,
    CASE WHEN q.pe > 0 THEN 0 WHEN q.pm > 0 THEN q.pm - 1 WHEN q.i >= nm OR q.j >= nt OR k IS NOT NULL OR apart IS NOT NULL OR st.d IS NOT NULL THEN 0 ELSE coalesce(sm.d - 1, 0) END,
    q.step,
    CASE WHEN q.pe > 0 THEN 'EXTRA' WHEN q.pm > 0 THEN 'MISSING' WHEN q.i >= nm THEN 'EXTRA' WHEN q.j >= nt THEN 'MISSING' WHEN k IS NOT NULL OR apart IS NOT NULL THEN 'PASS' WHEN st.d IS NOT NULL THEN 'EXTRA' WHEN sm.d IS NOT NULL THEN 'MISSING' ELSE 'DIFFERENT' END,
    CASE WHEN q.pe > 0 THEN 'Extra translated table (re-sync)' WHEN q.pm > 0 THEN 'No matching translated table (re-sync)' WHEN q.i >= nm THEN 'Extra translated table' WHEN q.j >= nt THEN ''
      WHEN k IS NOT NULL THEN format('Cross-page table split match (English {} page(s), Translated {} page(s))', k, n) WHEN apart = 0 THEN 'Exact structure match' WHEN apart IS NOT NULL THEN 'Structure match within tolerance'
      WHEN st.d IS NOT NULL THEN 'Extra translated table (re-sync)' WHEN sm.d IS NOT NULL THEN 'No matching translated table (re-sync)' ELSE 'Column/row structure does not match' END,
    CASE WHEN q.pe = 0 AND q.pm = 0 THEN sp.merged END, CASE WHEN q.pe = 0 AND q.pm = 0 THEN coalesce(sp.header, false) ELSE false END
  FROM (SELECT batch_id, nm, nt, i + di AS i, j + dj AS j, pe, pm, step + 1 AS step FROM walk WHERE i + di < nm OR j + dj < nt) q
  LEFT JOIN split sp ON sp.batch_id = q.batch_id AND sp.i = q.i AND sp.j = q.j LEFT JOIN fit ON fit.batch_id = q.batch_id AND fit.i = q.i AND fit.j = q.j
  LEFT JOIN skip_t st ON st.batch_id = q.batch_id AND st.i = q.i AND st.j = q.j LEFT JOIN skip_m sm ON sm.batch_id = q.batch_id AND sm.i = q.i AND sm.j = q.j),
steps AS (
  SELECT batch_id, step, CASE WHEN status = 'EXTRA' THEN step ELSE i END + 1 AS table_number, status, reason, CASE WHEN di > 0 THEN i END AS master_from, di AS master_n, CASE WHEN dj > 0 THEN j END AS target_from, dj AS target_n, merged, header AS repeated_header FROM walk WHERE step >= 0)"""

BASE = sql("b_printed").replace("WITH ", "WITH RECURSIVE ", 1) + RUNS + WALK


@register(
    "k23_merged_fragments",
    sql("b_printed") + RUNS + """
SELECT f.batch_id, run::BIGINT AS run, fragments, first_page::INT AS first_page, last_page::INT AS last_page, s.columns, array_to_string(s.rows, ',') AS rows_plain, array_to_string(list_transform(s.rows, lambda x: x - fragments + 1), ',') AS rows_header
FROM (SELECT batch_id, run, fragments, min(page_index) OVER (PARTITION BY batch_id, run) AS first_page, max(page_index) OVER (PARTITION BY batch_id, run) AS last_page, place, table_idx FROM r WHERE role = 'master' AND fragments > 1) f
JOIN r_sum s ON s.role = 'master' AND s.batch_id = f.batch_id AND s.i = f.table_idx AND s.k = f.fragments WHERE place = 0""",
)
def k23_merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the masters that run over pages, put together with and without repeated headers."""
    runs = table_alignment.merged_runs(table_alignment.continued(bindings.printed_tables(spark, sf_dir, "master"), DOC), DOC)
    return runs.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("rows_plain", "rows_header")})


@register("k22_split_tables", BASE + " SELECT batch_id, step::INT AS step, table_number::INT AS table_number, status, reason, master_from, master_n::INT AS master_n, target_from, target_n::INT AS target_n, array_to_string(merged, ',') AS merged, repeated_header FROM steps")
def k22_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the two documents of each batch aligned, fragments over pages included."""
    steps = table_alignment.aligned(*(bindings.printed_tables(spark, sf_dir, r) for r in ("master", "translation")), DOC)
    return steps.withColumn("merged", F.array_join(F.transform("merged", lambda x: x.cast("string")), ","))


@register(
    "k24_split_report",
    BASE + """,
l AS (SELECT role, batch_id, table_idx, page_index, CASE WHEN page_index % 3 = 1 THEN concat('A-', page_index) ELSE concat(page_index + 1) END AS label, overflow_reasons FROM b_printed),
e AS (SELECT steps.batch_id, step, role, min(table_idx) AS a, max(table_idx) AS b, flatten(list(overflow_reasons)) AS reasons FROM steps JOIN l ON l.batch_id = steps.batch_id AND ((role = 'master' AND table_idx BETWEEN master_from AND master_from + master_n - 1) OR (role = 'translation' AND table_idx BETWEEN target_from AND target_from + target_n - 1)) GROUP BY ALL),
f AS (SELECT e.*, x.page_index AS pa, y.page_index AS pb, x.label AS la, y.label AS lb, CASE WHEN e.role = 'master' THEN 'Eng ' ELSE 'Trans ' END AS name FROM e JOIN l x ON x.role = e.role AND x.batch_id = e.batch_id AND x.table_idx = a JOIN l y ON y.role = e.role AND y.batch_id = e.batch_id AND y.table_idx = b),
g AS (SELECT batch_id, step, string_agg(name || CASE WHEN pa = pb THEN concat('P', pa + 1) ELSE concat('P', pa + 1, '-P', pb + 1) END, ' | ' ORDER BY role) AS pages, string_agg(name || CASE WHEN la = lb THEN la ELSE la || '-' || lb END, ' | ' ORDER BY role) AS labels, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM f GROUP BY 1, 2)
SELECT batch_id, step::INT AS step, table_number::INT AS table_number, status, reason, pages AS sequence_page_number, labels AS labeled_page_number, len(reasons) > 0 AS has_text_overflow, array_to_string(reasons, '; ') AS overflow_reasons,
  CASE WHEN len(reasons) > 0 THEN status || ' (Review Overflow)' WHEN status = 'PASS' THEN 'PASS (OK)' ELSE status || ' (Review Structure)' END AS display_status, CASE WHEN len(reasons) > 0 THEN 'amber' WHEN status = 'PASS' THEN 'green' ELSE 'red' END AS colour
FROM steps JOIN g USING (batch_id, step)""",
)
def k24_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned tables as report rows, with pages by number and by printed label, and overflow reasons."""
    m, t = (bindings.printed_tables(spark, sf_dir, r) for r in ("master", "translation"))
    labels = lambda d: d.where("page_index % 3 = 1").select(*DOC, "page_index", F.concat(F.lit("A-"), "page_index").alias("label")).distinct()
    steps = written(table_alignment.aligned(m, t, DOC), "table-steps")
    return table_alignment.report(steps, m, t, DOC, labels(m), labels(t)).drop("master_from", "master_n", "target_from", "target_n", "merged", "repeated_header")
