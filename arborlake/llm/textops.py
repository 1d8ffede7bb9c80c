"""Text expressions that the operators share. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(col: Column | str) -> Column:
    """Number of maximal runs without space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(col: Column) -> Column:
    """A-Z only. lower() does just that where every character is ASCII, and is far quicker than translate()."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    """The words of a text that isn't null."""
    return F.array_remove(F.split(col, SPACE), "")


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def hex_sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


BROADCAST_IDS = 2_000_000


def small(df: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """df to broadcast if it has at most bound rows, counted here; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= bound else df


def without(docs: DataFrame, ids: DataFrame, blank: bool = False) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column, counted here). Few ids are broadcast, more are joined by a shuffle.

    Rows with a null doc_id share one fate. blank: rows without words stay all the same."""
    ids = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    ids = small(ids)
    gone = F.col("doc_id").eqNullSafe(F.col("_gone"))
    return docs.join(ids, gone & (n_words("text") > 0) if blank else gone, "left_anti")
