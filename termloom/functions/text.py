"""Keyword text as Column functions. Only NFKC, which Spark lacks, is a UDF, and only for texts beyond ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = r"[\s\x1c-\x1f]+"
ASCII = r"^[\x00-\x7F]*$"
# Traces of a wrong decoding, and three marks in a row.
ARTEFACT = r"(?iu)â€|Ã[^A-Z]|Ã©|â€™|â€œ|Â©|â„¢|\\u[0-9a-f]{4}|&#[0-9]+;"
PUNCTUATION_RUN = r"(?U)[^\w\s]{3,}"
MATCH, NON_MATCH, UNCERTAIN = "match", "non_match", "uncertain"
LABELS = (MATCH, NON_MATCH, UNCERTAIN)


@F.pandas_udf(StringType())
def _normalise_any(s: pd.Series) -> pd.Series:
    one = lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).lower().strip())
    return s.map(lambda x: None if x is None else one(x))


def normalise_ascii(c: Column) -> Column:
    """normalise() of texts that are ASCII, or that NFKC leaves as they are and hold no other white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), _SPACE, " "), "^ | $", "")


def normalise(c: Column) -> Column:
    """NFKC, lower case, ends stripped, runs of white space as one blank; null stays null."""
    plain = c.rlike(ASCII)
    return F.when(plain, normalise_ascii(c)).otherwise(_normalise_any(F.when(~plain, c)))


def stripped(c: Column) -> Column:
    """A text without white space, of any kind, at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def split_cell(cell: Column, sep: str = ";") -> Column:
    """Keywords of a delimited cell: trimmed, empty ones gone, repeats kept; null gives no keywords."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), re.escape(sep)), stripped)
    return F.filter(parts, lambda k: k != "")


def strip_punctuation(norm: Column) -> Column:
    return F.regexp_replace(norm, r"[-/(). ]", "")


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.char_length(a), F.char_length(b)
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(F.lit(0.0))


def is_acronym(kw: Column) -> Column:
    return stripped(kw).rlike("^[A-Z]{2,6}$")


def bracketed_acronyms(kw: Column) -> Column:
    return F.transform(F.regexp_extract_all(kw, F.lit(r"\(([A-Za-z]{2,6})\)"), F.lit(1)), F.upper)


def initials(kw: Column) -> Column:
    """Initials of a keyword of two words or more, where they make two to six letters; else null."""
    words = F.filter(F.split(stripped(kw), r"(?U)[\s\-/]+"), lambda w: w != "")
    letters = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when((F.size(words) >= 2) & F.char_length(letters).between(2, 6), letters)


def is_malformed(kw: Column) -> Column:
    return (F.char_length(stripped(kw)) < 3) | kw.rlike(ARTEFACT) | kw.rlike(PUNCTUATION_RUN)


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def label(c: Column) -> Column:
    """One spelling for each label; anything else stays, in lower case and stripped."""
    x = F.lower(stripped(c))
    return F.when(x.isin("non-match", "nonmatch", "non_match"), F.lit(NON_MATCH)).otherwise(x)


def strip_fence(c: Column) -> Column:
    """An answer without the code fence around it; white space goes at both ends, line breaks too."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(c), r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```$", ""))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def free_text_decision(c: Column) -> Column:
    """Decision in a free answer: a denial first, then the word match, else uncertain."""
    x = F.lower(c)
    denies = x.contains("non-match") | x.contains("not the same") | x.contains("non_match") | x.contains("not match")
    return F.when(denies, F.lit(NON_MATCH)).when(x.contains("match"), F.lit(MATCH)).otherwise(F.lit(UNCERTAIN))


def prompt(template: str, context: str | None = None, **columns: Column) -> Column:
    """A template with {name} places filled from columns; null counts as empty. context is a template of its own,
    added after a blank line in rows that have text for one of its places."""
    if context is not None:
        used = [n for n in columns if f"{{{n}}}" in context]
        some = F.coalesce(*[F.nullif(stripped(columns[n].cast("string")), F.lit("")) for n in used], F.lit(None).cast("string")).isNotNull()
        return F.concat(prompt(template, **columns), F.when(some, F.concat(F.lit("\n\n"), prompt(context, **columns))).otherwise(""))
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def percent(n: Column, total: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)))


def register(spark: SparkSession) -> None:
    """SQL names: normalise_kw (by UDF) and jaro_winkler."""
    from .similarity import jaro_winkler_udf

    spark.udf.register("normalise_kw", _normalise_any)
    spark.udf.register("jaro_winkler", jaro_winkler_udf)
