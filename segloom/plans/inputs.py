"""The driver's tables as this engine's inputs, each with the same projection in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segloom.operators import segments
from segloom.operators.ordered import spread

SOURCE, TARGET = "English", "German"

#: One row for each line of each document.
SEGMENTS_SQL = """segs as (
  select doc_id, source as context, cast(doc_id as varchar) as group_key, unnest(string_split(text, chr(10))) as text,
         cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as integer) as pos
  from documents),
seg as (select doc_id, context, pos, doc_id || '/' || pos as id, text, group_key from segs)"""

#: Boxes made of the keys of lineitem: synthetic, an image for each order, the same statement in both engines.
REGIONS = """select l_orderkey as image_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as pos,
  (l_partkey * 7 + l_linenumber * 13) % 160 as x, (l_suppkey * 11 + l_linenumber * 29) % 90 as y, 3 + l_partkey % 90 as w, 2 + (l_suppkey * 3 + l_linenumber) % 40 as h,
  l_returnflag || ' ' || l_linestatus || case when l_partkey % 5 = 0 then '' else ' ' || cast(l_partkey % 11 as varchar(10)) end as text,
  0.5 + cast(l_suppkey % 8 as double) / 16 as confidence, l_linenumber % 3 as part
from lineitem"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.from_lines(spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic regions with their boxes as structs; part 0 to 2 stands for upright, turned, and flagged ones."""
    rows = spark.sql(REGIONS.replace("from lineitem", "from {lineitem}").replace("varchar(10)", "string"), lineitem=read(spark, sf_dir, "lineitem"))
    return rows.selectExpr("image_id", "pos", "struct(x, y, w, h) as box", "cast(null as struct<x: bigint, y: bigint, w: bigint, h: bigint>) as ink", "text", "confidence", "cast(null as boolean) as rotated", "cast(null as int) as rotation", "part")
