"""Registered queries on delivered files and references, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.drift import schema_drift
from strandloom.operators.orphans import orphan_counts, orphan_references, references_of
from strandloom.operators.parse_errors import read_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(table(spark, folder, "expression_raw"), table(spark, folder, "field_aliases")).errors


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(table(spark, folder, "expression_raw"), table(spark, folder, "field_aliases")).records


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    expression = references_of(table(spark, folder, "expression"), "expression", "expr_id", "locus_tag", "measured_at")
    genes = references_of(
        table(spark, folder, "reference_genes"), "reference_genes", "ref_id", "locus_tag", "selected_at"
    )
    parents = table(spark, folder, "cds").select(F.col("locus_tag").alias("key"), "added_at", "retired_at")
    return orphan_references(expression.unionByName(genes), parents)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "row_id", "reason").distinct()


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift(table(spark, folder, "expression_feed"), table(spark, folder, "field_aliases")).changes


def p5_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift(table(spark, folder, "expression_feed"), table(spark, folder, "field_aliases")).lifespans


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift(table(spark, folder, "expression_feed"), table(spark, folder, "field_aliases")).records


def p5_failed_casts(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift(table(spark, folder, "expression_feed"), table(spark, folder, "field_aliases")).failed_casts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p3_found, p3_records, p4_found, p4_counts, p5_found, p5_lifespans, p5_records, p5_failed_casts)
    return {f.__name__: f for f in own}


_LINES = r"""
lines AS (
  SELECT raw_id, file_name, line_no,
    CASE WHEN file_name ILIKE '%.csv' THEN ',' ELSE chr(9) END AS sep,
    regexp_replace(raw_line, '\r$', '') AS line
  FROM expression_raw),
sound AS (
  SELECT *, CASE sep
      WHEN ',' THEN regexp_full_match(line, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*')
      ELSE regexp_full_match(line, '([^"\t]*|"([^"]|"")*")(\t([^"\t]*|"([^"]|"")*"))*') END AS ok,
    list_transform(string_split(
      regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g'), sep), lambda x: 0) AS marks
  FROM lines),
cut AS (
  SELECT *, CASE sep
      WHEN ',' THEN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)
      ELSE regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) END AS raw_cells
  FROM sound),
cells AS (
  SELECT *, list_transform(raw_cells, lambda x: CASE WHEN x LIKE '"%'
      THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS cells
  FROM cut),
alias_keys AS (
  SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS k, min(canonical) AS canonical
  FROM field_aliases GROUP BY 1),
header AS (
  SELECT file_name, len(cells) AS n, list_transform(cells, lambda x:
    regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS ks
  FROM cells WHERE line_no = 1),
columns AS (
  SELECT h.file_name, h.pos, a.canonical
  FROM (SELECT file_name, unnest(ks) AS k, generate_subscripts(ks, 1) AS pos FROM header) h
  JOIN alias_keys a ON h.k = a.k),
body AS (
  SELECT c.*, h.n FROM cells c LEFT JOIN header h ON c.file_name = h.file_name WHERE c.line_no <> 1),
checked AS (
  SELECT b.raw_id, c.canonical, trim(b.cells[c.pos], ' ' || chr(9)) AS v
  FROM body b JOIN columns c ON b.file_name = c.file_name WHERE b.ok AND len(b.cells) = b.n),
bad_values AS (
  SELECT DISTINCT raw_id FROM checked WHERE (canonical = 'locus_tag' AND v = '')
    OR (canonical LIKE 'RPKM%' AND NOT regexp_full_match(replace(v, ',', ''),
      '([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')))
"""

_VALID_REFS = r"""
refs AS (
  SELECT 'expression' AS ref_table, expr_id AS row_id, trim(locus_tag, ' ' || chr(9) || chr(10) || chr(13)) AS tag,
    measured_at AS ts FROM expression
  UNION
  SELECT 'reference_genes', ref_id, trim(locus_tag, ' ' || chr(9) || chr(10) || chr(13)), selected_at
    FROM reference_genes),
owners AS (
  SELECT trim(locus_tag, ' ' || chr(9) || chr(10) || chr(13)) AS tag, added_at, retired_at FROM cds),
firsts AS (SELECT tag, min(added_at) AS first_at FROM owners GROUP BY tag),
orphans AS (
  SELECT r.ref_table, r.row_id, r.ts,
    CASE WHEN f.first_at IS NULL THEN 'missing' WHEN r.ts < f.first_at THEN 'late' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN firsts f ON r.tag = f.tag
  WHERE r.tag <> '' AND NOT EXISTS (SELECT 1 FROM owners o WHERE o.tag = r.tag AND o.added_at <= r.ts
    AND (o.retired_at IS NULL OR r.ts < o.retired_at)))
"""

_DRIFT = r"""
alias_keys AS (
  SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS k, min(canonical) AS canonical
  FROM field_aliases GROUP BY 1),
keys AS (
  SELECT source, file_name, record::JSON AS j, unnest(json_keys(record::JSON)) AS key FROM expression_feed),
cells AS (
  SELECT k.source, k.file_name, k.key, coalesce(a.canonical, k.fk) AS field_name,
    CASE json_type(j -> ('$."' || key || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
      WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t
  FROM (SELECT *, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS fk FROM keys) k
  LEFT JOIN alias_keys a ON k.fk = a.k),
counted AS (SELECT source, file_name, field_name, key, t, count(*) AS n FROM cells GROUP BY ALL),
types AS (
  SELECT source, file_name, field_name, t FROM counted WHERE t IS NOT NULL GROUP BY source, file_name, field_name, t
  QUALIFY row_number() OVER (PARTITION BY source, file_name, field_name ORDER BY sum(n) DESC, t DESC) = 1),
names AS (
  SELECT source, file_name, field_name, key FROM counted GROUP BY source, file_name, field_name, key
  QUALIFY row_number() OVER (PARTITION BY source, file_name, field_name ORDER BY sum(n) DESC, key DESC) = 1),
files AS (
  SELECT source, file_name, row_number() OVER (PARTITION BY source ORDER BY min(delivered_at), file_name) AS seq
  FROM expression_feed GROUP BY source, file_name),
meta AS (
  SELECT f.source, f.seq, n.field_name, n.key, t.t FROM names n JOIN files f USING (source, file_name)
  LEFT JOIN types t USING (source, file_name, field_name)),
found AS (
  SELECT source, seq, field_name, 'added' AS change_kind FROM meta a WHERE seq > 1 AND NOT EXISTS (
    SELECT 1 FROM meta b WHERE b.source = a.source AND b.field_name = a.field_name AND b.seq = a.seq - 1)
  UNION ALL
  SELECT source, seq + 1, field_name, 'removed' FROM meta a WHERE EXISTS (
    SELECT 1 FROM files f WHERE f.source = a.source AND f.seq = a.seq + 1) AND NOT EXISTS (
    SELECT 1 FROM meta b WHERE b.source = a.source AND b.field_name = a.field_name AND b.seq = a.seq + 1)
  UNION ALL
  SELECT a.source, a.seq, a.field_name, k.kind FROM meta a
  JOIN meta b ON b.source = a.source AND b.field_name = a.field_name AND b.seq = a.seq - 1
  JOIN (SELECT unnest(['renamed', 'retyped']) AS kind) k
    ON (k.kind = 'renamed' AND a.key <> b.key) OR (k.kind = 'retyped' AND a.t <> b.t))
"""


_SPANS = f"""{_DRIFT},
state AS (
  SELECT m.*, f.file_name, lag(seq) OVER w AS ps, lag(key) OVER w AS pk, lag(t) OVER w AS pt
  FROM meta m JOIN files f USING (source, seq) WINDOW w AS (PARTITION BY m.source, field_name ORDER BY seq)),
runs AS (
  SELECT *, sum(CASE WHEN ps = seq - 1 AND pk = key AND pt IS NOT DISTINCT FROM t THEN 0 ELSE 1 END)
    OVER (PARTITION BY source, field_name ORDER BY seq) AS run FROM state),
spans AS (
  SELECT source, field_name, key AS key_name, t AS json_type, min_by(file_name, seq) AS first_file,
    max_by(file_name, seq) AS last_file, count(*) AS n_files FROM runs GROUP BY source, field_name, run, key, t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_records": rf"""WITH {_LINES},
            good AS (
              SELECT DISTINCT ON (raw_id) raw_id, file_name, line_no, cells FROM body b WHERE ok AND n = len(cells)
                AND raw_id NOT IN (SELECT raw_id FROM bad_values)),
            places AS (SELECT file_name, canonical, min(pos) AS pos FROM columns GROUP BY ALL),
            cells_of AS (
              SELECT g.raw_id, g.file_name, g.line_no, p.canonical, trim(g.cells[p.pos], ' ' || chr(9)) AS v
              FROM good g JOIN places p ON p.file_name = g.file_name)
            SELECT raw_id, file_name, line_no, max(v) FILTER (canonical = 'locus_tag') AS locus_tag,
              {", ".join(f"CAST(replace(max(v) FILTER (canonical = '{c}'), ',', '') AS DOUBLE) AS {c}" for c in
                         ("RPKM_rep1", "RPKM_rep2", "RPKM_rep3", "RPKM_average"))}
            FROM cells_of GROUP BY raw_id, file_name, line_no""",
        "p5_lifespans": f"WITH {_SPANS} SELECT * FROM spans",
        "p3_found": f"""WITH {_LINES}
            SELECT b.raw_id, CASE WHEN NOT b.ok THEN 'quoting'
              WHEN b.n IS NULL OR len(b.cells) <> b.n THEN 'column_count' ELSE 'value' END AS reason
            FROM body b WHERE NOT b.ok OR b.n IS NULL OR len(b.cells) <> b.n
              OR b.raw_id IN (SELECT raw_id FROM bad_values)""",
        "p4_found": f"WITH {_VALID_REFS} SELECT DISTINCT ref_table, row_id, reason FROM orphans",
        "p4_counts": f"""WITH {_VALID_REFS} SELECT ref_table, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, reason,
            count(*) AS n_orphans FROM orphans GROUP BY ALL""",
        "p5_found": f"""WITH {_DRIFT} SELECT f.source, files.file_name, f.field_name, f.change_kind
            FROM found f JOIN files USING (source, seq)""",
    }
