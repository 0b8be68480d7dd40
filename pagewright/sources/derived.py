"""Inputs derived from the relational test tables: detections, raw detector rows, tables, text blocks.

Plain SQL that Spark and DuckDB read alike, so that a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DET_KEY = ["ok", "ln", "pk", "sk", "cp"]
PAGE_WIDTH, PAGE_HEIGHT = 762, 1000

DETS = """
SELECT page_id, ok, ln, pk, sk, cp, class_id, CAST(CAST(permille AS DOUBLE) / 1000 AS FLOAT) AS score,
       CASE WHEN page_id % 3 = 0 THEN -1 ELSE hint END AS order_hint,
       least(bx, CAST(762 AS DOUBLE)) AS x1, least(byy, CAST(1000 AS DOUBLE)) AS y1,
       least(bx + bw, CAST(762 AS DOUBLE)) AS x2, least(byy + bh, CAST(1000 AS DOUBLE)) AS y2
FROM (
  SELECT page_id, ok, ln, pk, sk, 0 AS cp, class_id, permille, hint, bx, byy, bw, bh FROM det_base
  UNION ALL
  SELECT page_id, ok, ln, pk, sk, 1 AS cp, class_id, permille - 50, hint, bx + 3, byy + 2, bw, bh FROM det_base WHERE ln % 2 = 0) AS both_copies"""

DET_BASE = """
SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page_id, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
       CAST((l_partkey * 7) % 600 AS DOUBLE) AS bx, CAST((l_suppkey * 31 + l_linenumber * 97) % 900 AS DOUBLE) AS byy,
       CAST(20 AS DOUBLE) + CAST(l_quantity AS DOUBLE) * 8 AS bw, CAST(12 + (l_partkey % 5) * 24 AS DOUBLE) AS bh,
       300 + (l_partkey * 37 + l_orderkey) % 700 AS permille, CAST(l_suppkey % 17 AS INT) AS class_id,
       CAST((l_partkey * 13 + l_linenumber) % 1000 AS INT) AS hint
FROM lineitem"""

#: Pages for which page-level geometry is derived: size, rotation and skew follow from the id.
PAGES = """
SELECT page_id, CAST(600 + (page_id % 5) * 100 AS INT) AS width, CAST(800 + (page_id % 7) * 100 AS INT) AS height,
       CAST((page_id % 4) * 90 AS INT) AS rotation, CAST(page_id % 31 - 15 AS DOUBLE) / 2 AS skew
FROM (SELECT DISTINCT CAST(floor(l_orderkey / 4) AS BIGINT) AS page_id FROM lineitem) AS ids"""

#: Cells of one table per order: a header, then a row per line; equal flags of neighbouring lines share a cell.
CELLS = """
SELECT ok, 0 AS r, c, 1 AS rowspan, 1 AS colspan, TRUE AS is_header, name AS txt
FROM (SELECT DISTINCT l_orderkey AS ok FROM lineitem) AS o CROSS JOIN (VALUES (0, 'flag'), (1, 'part|supplier'), (2, 'qty, "n"'), (3, '<mode> & more')) AS h(c, name)
UNION ALL
SELECT ok, CAST(min(rn) AS INT) AS r, 0 AS c, CAST(count(*) AS INT) AS rowspan, 1 AS colspan, FALSE AS is_header, min(flag) AS txt
FROM (SELECT ok, flag, rn, rn - row_number() OVER (PARTITION BY ok, flag ORDER BY rn) AS island FROM table_lines) AS i GROUP BY ok, flag, island
UNION ALL SELECT ok, CAST(rn AS INT), 1, 1, 1, FALSE, concat(CAST(pk AS VARCHAR(20)), '|', CAST(sk AS VARCHAR(20))) FROM table_lines
UNION ALL SELECT ok, CAST(rn AS INT), 2, 1, 1, FALSE, CAST(CAST(qty AS INT) AS VARCHAR(20)) FROM table_lines
UNION ALL SELECT ok, CAST(rn AS INT), 3, 1, 1, FALSE, CASE WHEN pk % 3 = 0 THEN concat('a<b & "', CAST(sk AS VARCHAR(20)), '"') WHEN pk % 3 = 1 THEN concat('x, ', CAST(sk AS VARCHAR(20))) ELSE CAST(sk AS VARCHAR(20)) END FROM table_lines"""

TABLE_LINES = """
SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, l_returnflag AS flag,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
FROM lineitem"""


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables of the corpus as views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "lineitem")
    spark.sql(DET_BASE).createOrReplaceTempView("det_base")
    return spark.sql(DETS)


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "lineitem")
    return spark.sql(PAGES)


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "lineitem")
    spark.sql(TABLE_LINES).createOrReplaceTempView("table_lines")
    return spark.sql(CELLS.replace("VARCHAR(20)", "STRING"))
