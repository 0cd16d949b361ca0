"""The pN_ queries of the text problems; each takes (spark, folder) and reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import areas, encoding, packing
from ashlar.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents")).select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text after encoding and decoding; null texts come back empty."""
    return encoding.decode(encoding.encode(table(spark, d, "documents"))).select("doc_id", "text")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).drop("row")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the packing divided."""
    packed = packing.pack(table(spark, d, "documents"))
    return packed.filter((F.col("pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return areas.subject_areas(*[table(spark, d, n) for n in ("documents", "subject_examples", "subject_areas")])


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return areas.area_shares(p8_found(spark, d), table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_round_trip, p7_pack, p7_found, p7_fill, p8_found, p8_shares)}
ORACLE_SQL = {"p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
