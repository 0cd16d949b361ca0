"""Tables of one Parquet path each, and the runs of the provenance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a folder; only the named columns if any are."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def runs(provenance: DataFrame) -> DataFrame:
    """The runs in the order of their instants: provenance_id, workspace, seq (1, 2, ... in the workspace).

    A row without a readable workspace is a workspace of its own. Instants that can't be read come first; equal ones
    follow the id. Rows without an id are left out (no row can refer to them); repeated ids count once.
    """
    meta = provenance.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("metadata_json").alias("meta"))
    parsed = meta.select(
        F.col("id").alias("provenance_id"),
        F.coalesce(F.get_json_object("meta", "$.workspace"), F.concat(F.lit("?"), "id")).alias("workspace"),
        F.get_json_object("meta", "$.extracted_at").try_cast("timestamp").alias("at"),
    )
    order = W.partitionBy("workspace").orderBy(F.col("at").asc_nulls_first(), "provenance_id")
    return parsed.select("provenance_id", "workspace", F.row_number().over(order).alias("seq"))
