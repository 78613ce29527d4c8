"""Similarity of strings and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_pair(a: str, b: str) -> float:
    """Jaro-Winkler over code points: prefix weight 0.1 for up to four, above a Jaro of 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    reach = max(len(b) // 2 - 1, 0)
    free, common = [True] * len(b), []
    for i, ch in enumerate(a):
        at = b.find(ch, max(0, i - reach), i + reach + 1)
        while at >= 0 and not free[at]:
            at = b.find(ch, at + 1, i + reach + 1)
        if at >= 0:
            free[at] = False
            common.append(ch)
    m = len(common)
    if not m:
        return 0.0
    other = (ch for ch, f in zip(b, free, strict=True) if not f)
    moved = sum(x != y for x, y in zip(common, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_pair(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: One evaluation per row: a filter on a deterministic UDF column would plan it twice.
jaro_winkler_once = jaro_winkler_udf.asNondeterministic()


def jaro_winkler(a: Column, b: Column) -> Column:
    return jaro_winkler_once(a, b)


def least_length_ratio(threshold: float) -> float:
    """Length ratio below which no pair reaches a Jaro-Winkler of threshold (> 0.82), so that filtering by it loses none."""
    return max(0.0, (threshold - 0.4) / 0.2 - 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double; null where a vector is zero, empty or of other length."""
    as_double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(as_double(x), as_double(y), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def char_grams(norm: Column, low: int = 2, high: int = 4) -> Column:
    """Grams of low to high characters inside each word, the word padded by one blank on either side; a padded
    word shorter than a size gives itself once, at the first size that holds all of it."""

    def of_word(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.char_length(p)

        def of_size(n):
            cut = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(p, i, F.lit(n)))
            whole = (size == n) if n > low else (size <= n)
            return F.when(size > n, cut).when(whole, F.array(p)).otherwise(F.array().cast("array<string>"))

        each = [of_size(n) for n in range(low, high + 1)]
        return F.flatten(F.array(*each))

    words = F.filter(F.split(norm, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


def tfidf(items: DataFrame, key: str, norm: str, low: int = 2, high: int = 4) -> DataFrame:
    """(key, gram, w): L2-normalised weights tf * (ln((1 + n) / (1 + df)) + 1) over all items."""
    grams = items.select(key, F.explode(char_grams(F.col(norm), low, high)).alias("gram"))
    tf = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    x = tf.join(df, "gram").crossJoin(F.broadcast(n))  # one row
    x = x.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norms, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w"))


def sparse_cosine(pairs: DataFrame, vectors: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """pairs with `similarity` of their two keys' sparse vectors (key, gram, w); 0 without a common gram."""
    left = vectors.select(F.col(key).alias(a), "gram", F.col("w").alias("wa"))
    right = vectors.select(F.col(key).alias(b), "gram", F.col("w").alias("wb"))
    dots = pairs.select(a, b).distinct().join(left, a).join(right, [b, "gram"]).groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return pairs.join(dots, [a, b], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edits per character of the longer text; 1 for two empty texts."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """levenshtein_similarity() of two texts with their tokens in order."""
    ordered = lambda c: F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")
    return levenshtein_similarity(ordered(a), ordered(b))


def nearest(vectors: DataFrame, key: str, vector: str, k: int, block_rows: int = 4096) -> DataFrame:
    """(key, neighbour, similarity, rank): the k nearest other rows of every row by cosine, keys of any type that
    has an order; ties go to the smaller key; zero vectors have no neighbours. Exact, without a join of all pairs: every row meets every
    other in matrix products of two blocks, and each block keeps only its k best per row."""
    import numpy as np
    import pyarrow as pa

    if vectors.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        from ..plans.numbering import numbered

        named = numbered(vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).alias("_v")), ["_key"], "_id", 0)
        found = nearest(named, "_id", "_v", k, block_rows)
        found = found.join(named.select("_id", F.col("_key").alias(key)), "_id")
        other = named.select(F.col("_id").alias("neighbour"), F.col("_key").alias("_other"))
        return found.join(other, "neighbour").select(key, F.col("_other").alias("neighbour"), "similarity", "rank")
    x = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("v"))
    x = x.where(F.size("v") > 0).where(F.element_at("v", 1).isNotNull())
    total = max(1, x.count())
    parts = max(1, -(-total // block_rows))
    block = x.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    sides = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = block.select(F.col("part").alias("p"), sides.alias("q"), "id", "v", F.lit(True).alias("asks"))
    cols = block.select(sides.alias("p"), F.col("part").alias("q"), "id", "v", F.lit(False).alias("asks"))

    def best(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids = np.array(table.column("id").to_pylist(), np.int64)
        v = np.array(table.column("v").to_pylist(), np.float64)
        out = {"id": [], "neighbour": [], "similarity": []}
        if asks.any() and (~asks).any():
            own, other = ids[asks], ids[~asks]
            order = np.argsort(other, kind="stable")
            other = other[order]
            sim = v[asks] @ v[~asks][order].T
            sim[own[:, None] == other[None, :]] = -np.inf
            for i, row in enumerate(np.round(sim, 12)):
                top = np.lexsort((other, -row))[:k]
                top = top[row[top] > -np.inf]
                out["id"] += [own[i]] * len(top)
                out["neighbour"] += other[top].tolist()
                out["similarity"] += row[top].tolist()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "neighbour": pa.array(out["neighbour"], pa.int64()), "similarity": pa.array(out["similarity"], pa.float64())})

    found = rows.unionByName(cols).groupBy("p", "q").applyInArrow(best, "id long, neighbour long, similarity double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", key)
