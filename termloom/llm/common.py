"""Pieces that the training-data operators share: whole-text words, shared scratch space, hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialise, release, scratch_path  # noqa: F401

#: White space of the word rule `[^\x20\x09-\x0D]+`; equal to what bytes.split() splits at.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without keeping the array of words."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(text, WS))
        - F.substring(text, 1, 1).rlike(WS).cast("int")
        - F.substring(text, -1, 1).rlike(WS).cast("int")
    ).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- hashing of words in numpy -------------------------------------------------------------------

_IS_WORD = np.ones(256, np.bool_)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE1, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict = {}


def _powers(base: int, n: int) -> tuple:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[base] = tuple(out)
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Grams:
    """64-bit hashes of any run of a sequence of 64-bit items, from one prefix sum."""

    def __init__(self, items: np.ndarray):
        up, self.down = _powers(_BASE2, len(items) + 1)
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def hash_words(texts: list) -> tuple:
    """(hashes of all words of all texts, offsets of each text's words, byte starts, byte ends, buffer)."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _IS_WORD[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(_BASE1, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    h = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return h, np.searchsorted(start, bounds), start, end, joined


def slices(batch, column: str = "text", most_bytes: int = 1 << 19):
    """(row offset, encoded texts) of parts of an Arrow batch of bounded size; null texts count as empty."""
    texts, size, at = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        b = t.as_buffer() if t.is_valid else None
        b = b.to_pybytes() if b is not None else b""
        texts.append(b)
        size += len(b)
        if size >= most_bytes:
            yield at, texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield at, texts
