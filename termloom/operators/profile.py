"""Profiles of delimited keyword collections, and frequencies in both senses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import split_cell, stripped

#: Lower ends of the frequency bands.
BANDS = ((1, "1"), (2, "2-4"), (5, "5-9"), (10, "10-49"), (50, "50-99"), (100, ">=100"))


def explode_keywords(corpus: DataFrame, article: str, cell: str) -> DataFrame:
    """(article_id, keyword), a row per keyword of a cell, repeats in one cell included."""
    return corpus.select(F.col(article).alias("article_id"), F.explode(split_cell(F.col(cell))).alias("keyword"))


def first_rows(batches: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in a total order; rows without a key all stay."""
    at = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return batches.withColumn("_at", F.when(F.col(key).isNotNull(), at).otherwise(1)).where("_at = 1").drop("_at")


def occurrence_frequency(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))


def document_frequency(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("keyword").agg(F.countDistinct("article_id").alias("frequency"))


def bands(frequency: DataFrame) -> DataFrame:
    """(band, n_keywords, n_occurrences) of the frequency bands that have keywords."""
    band = F.lit(None).cast("string")
    for low, name in BANDS:
        band = F.when(F.col("frequency") >= low, F.lit(name)).otherwise(band)
    x = frequency.where("frequency >= 1").groupBy(band.alias("band"))
    return x.agg(F.count(F.lit(1)).alias("n_keywords"), F.sum("frequency").alias("n_occurrences"))


def summary(frequency: DataFrame) -> DataFrame:
    """One row: occurrences, unique keywords, singletons and their share, keywords from 5 and 10 on."""
    at_least = lambda n: F.count_if(F.col("frequency") >= n)
    single = F.count_if(F.col("frequency") == 1)
    return frequency.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("n_occurrences"), F.count(F.lit(1)).alias("n_unique"), single.alias("n_singletons"),
        F.coalesce(F.try_divide(single, F.count(F.lit(1))), F.lit(0.0)).alias("singleton_share"), at_least(5).alias("n_from_5"), at_least(10).alias("n_from_10"),
    )


def coverage(corpus: DataFrame, cell: str) -> DataFrame:
    has = F.col(cell).isNotNull() & (stripped(F.col(cell)) != "")
    return corpus.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(has).alias("n_with"), (F.count(F.lit(1)) - F.count_if(has)).alias("n_without"))


def top(frequency: DataFrame, n: int = 20) -> DataFrame:
    return frequency.orderBy(F.desc("frequency"), "keyword").limit(n)


def bottom(frequency: DataFrame, n: int = 20) -> DataFrame:
    return frequency.orderBy("frequency", "keyword").limit(n)


def inventory(df: DataFrame) -> DataFrame:
    """(column, type, n_present) of every column, in one pass."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("n_present")) for c, t in df.dtypes]))
    return one.select(rows.alias("r")).select("r.*")


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: rows before and after a step, how many it removed, and the different keys on either side."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"n_{n}"), F.countDistinct(key).alias(f"n_keys_{n}"))
    x = count(before, "before").crossJoin(count(after, "after"))  # one row each
    return x.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def schema_difference(a: DataFrame, b: DataFrame) -> dict:
    return {"only_first": sorted({*a.columns} - {*b.columns}), "only_second": sorted({*b.columns} - {*a.columns})}


def checksum(df: DataFrame, columns: list) -> DataFrame:
    """One row: rows and an order-free digest: the sum of each row's first 60 bits of SHA-256 modulo 2^60, in hex."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(part) % (1 << 60), F.lit(0)).cast("string").alias("digest"))
