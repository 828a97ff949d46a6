"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"  # the six ASCII white-space characters
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str) -> Column:
    """The text, or an empty one for NULL."""
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str) -> Column:
    """True where ``crc32(doc_id as text) mod 5`` is 0; False for a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for ``rows`` rows: the session's number, or more so that none holds above ``rows_each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)
