"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.cutoffs import Cutoffs, fraction_cutoffs
from strandloom.llm.leakage import leaked_items
from strandloom.llm.packing import pack_documents
from strandloom.llm.residue import residue_spans
from strandloom.llm.topn import top_n


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cutoffs(spark: SparkSession, folder: str) -> Cutoffs:
    return fraction_cutoffs(
        _table(spark, folder, "expression"),
        _table(spark, folder, "studies"),
        source="source",
        key="expr_id",
        value="RPKM_average",
        percent="top_expressed_pct",
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).kept.select("source", F.col("key").alias("expr_id"))


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).cutoffs


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    variants = _table(spark, folder, "variants")
    best = top_n(variants, group="target_idx", item="variant_number", score="composite_score", n=3)
    return best.select("target_idx", "variant_number")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"), key="doc_id", text="text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leaked_items(
        _table(spark, folder, "documents"),
        _table(spark, folder, "eval_items"),
        key="doc_id",
        text="text",
        boxes="line_boxes",
        item_key="item_id",
        item_text="text",
    )
    return leaks.select("doc_id", "item_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return residue_spans(_table(spark, folder, "documents"), key="doc_id", text="text", boxes="line_boxes")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_spans(spark, folder).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cutoffs, p2_found, p6_packed, p7_found, p8_found, p8_spans)}


_COUNTED = """
counted AS (
  SELECT source, expr_id, max(RPKM_average) AS v
  FROM expression
  WHERE RPKM_average >= 0 AND NOT isnan(RPKM_average) AND source IS NOT NULL
  GROUP BY source, expr_id),
ranked AS (
  SELECT c.source, c.expr_id, c.v, s.top_expressed_pct AS pct,
    count(*) OVER (PARTITION BY c.source ORDER BY c.v DESC) AS n_from,
    count(*) OVER (PARTITION BY c.source) AS n_all
  FROM counted c JOIN studies s ON c.source = s.source),
cutoff AS (
  SELECT source, any_value(n_all) AS n_records, max(v) AS cutoff
  FROM ranked WHERE 100 * n_from >= pct * n_all GROUP BY source)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_COUNTED} SELECT r.source, r.expr_id FROM ranked r JOIN cutoff c "
        "ON r.source = c.source AND r.v >= c.cutoff",
        "p1_cutoffs": f"WITH {_COUNTED} SELECT r.source, c.cutoff, c.n_records, count(*) AS n_kept "
        "FROM ranked r JOIN cutoff c ON r.source = c.source AND r.v >= c.cutoff "
        "GROUP BY r.source, c.cutoff, c.n_records",
        "p2_found": """
            WITH items AS (
              SELECT target_idx, variant_number, max(composite_score) AS score FROM variants
              WHERE composite_score IS NOT NULL AND NOT isnan(composite_score)
              GROUP BY target_idx, variant_number)
            SELECT target_idx, variant_number FROM items
            QUALIFY row_number() OVER (PARTITION BY target_idx ORDER BY score DESC, variant_number) <= 3""",
    }
