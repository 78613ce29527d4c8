"""Readers and writers of the interchange formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.text import label
from ..operators.network import both_ways, induced, matrix

ENCODINGS = ("utf-8", "iso-8859-1")
#: Names of a corpus column, first match wins, then without regard to case.
ALIASES = {
    "article_id": ("EID", "article_id"), "title": ("Title", "TI"), "year": ("Year", "PY"), "doc_type": ("Document Type", "DT"),
    "author_keywords": ("Author Keywords", "DE"), "index_keywords": ("Index Keywords", "ID"), "abstract": ("Abstract", "AB"), "doi": ("DOI",),
    "source_title": ("Source title", "SO"), "language": ("Language of Original Document", "Language", "LA"),
}
LOG = S.StructType([
    S.StructField("pair_id", S.StringType()), S.StructField("keyword_a", S.StringType()), S.StructField("keyword_b", S.StringType()),
    S.StructField("prompt_hash", S.StringType()), S.StructField("response", S.StringType()), S.StructField("decision", S.StringType()),
    S.StructField("confidence", S.DoubleType()), S.StructField("guard_applied", S.StringType()), S.StructField("timestamp", S.TimestampType()),
    S.StructField("model", S.StringType()), S.StructField("input_tokens", S.LongType()), S.StructField("output_tokens", S.LongType()),
    S.StructField("cost_usd", S.DoubleType()),
])


class MissingInput(FileNotFoundError):
    """An input that a step needs is not there."""


def require(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise MissingInput(path)
    return path


def encoding_of(spark: SparkSession, path: str) -> str:
    """utf-8 if every file's bytes decode as such, else ISO 8859-1; checked where the bytes are."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    bad = raw.where(~F.is_valid_utf8(F.col("content").cast("string")))
    return ENCODINGS[0] if bad.isEmpty() else ENCODINGS[1]


def read_csv(spark: SparkSession, path: str, columns: list | None = None, schema: S.StructType | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header, every column a string unless a schema says more; a byte-order mark is no part of the first name."""
    require(spark, path)
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding or encoding_of(spark, path))
    df = r.schema(schema).csv(path) if schema else r.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*columns) if columns else df


def resolve(df: DataFrame, names) -> str | None:
    """The first of names that df has, exactly, then whatever its case."""
    for n in names:
        if n in df.columns:
            return n
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def sniff_key(df: DataFrame, part: str = "2-s2.0-", share: float = 0.5) -> str | None:
    """The first column of which more than a share of the rows holds a part, in one pass."""
    if not df.columns:
        return None
    row = df.agg(*[F.avg(F.coalesce(F.col(f"`{c}`").cast("string").contains(part), F.lit(False)).cast("double")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return next((c for i, c in enumerate(df.columns) if (row[f"c{i}"] or 0) > share), None)


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Batches with columns under their own names, batch and row order kept in _batch and _row."""
    out = None
    for i, path in enumerate(paths):
        df = read_csv(spark, path)
        key = resolve(df, ALIASES["article_id"]) or sniff_key(df)
        found = {new: resolve(df, names) for new, names in ALIASES.items()} | {"article_id": key}
        df = df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(new) for new, c in found.items()])
        df = df.withColumn("_batch", F.lit(i)).withColumn("_row", F.monotonically_increasing_id())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_sheet(spark: SparkSession, path: str, label_column: str) -> DataFrame:
    """An annotation sheet: strings, without its row of instructions, labels in one spelling."""
    df = read_csv(spark, path).where(F.coalesce(F.col("pair_id"), F.lit("")) != "INSTRUCTIONS")
    return df.withColumn(label_column, label(F.col(label_column)))


def read_log(spark: SparkSession, path: str, schema: S.StructType = LOG) -> DataFrame:
    """A JSONL log; lines that are no JSON are left out."""
    require(spark, path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(method, threshold, dev_f1, dev_coverage) of a registry that nests them by method."""
    kind = "map<string, struct<threshold:double, dev_f1:double, dev_coverage:double>>"
    raw = spark.read.text(require(spark, path), wholetext=True)
    return raw.select(F.explode(F.from_json("value", kind)).alias("method", "t")).select("method", "t.*")


#: What an annotated sheet may lack of its pairs.
PAIR_COLUMNS = ("keyword_a", "keyword_b", "freq_a", "freq_b", "stratum")


def with_metadata(rows: DataFrame, metadata: list, key: str = "pair_id", column: str = "stratum") -> DataFrame:
    """rows with the columns of their pairs that they lack, where they lack `column`: from the first metadata table
    (a path that may be missing, or a DataFrame) that is there. Rows that it doesn't have drop out."""
    if column in rows.columns:
        return rows
    for m in metadata:
        if isinstance(m, str):
            try:
                m = read_csv(rows.sparkSession, m)
            except MissingInput:
                continue
        lacking = [c for c in PAIR_COLUMNS if c in m.columns and c not in rows.columns]
        return rows.join(m.select(key, *lacking).dropDuplicates([key]), key)
    return rows


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration file as nested dicts and lists: JSON, or YAML where a YAML reader is installed."""
    text = spark.read.text(require(spark, path), wholetext=True).first()
    text = text["value"] if text else ""
    if path.endswith(".json"):
        return json.loads(text or "{}")
    try:
        import yaml
    except ImportError as e:
        raise MissingInput(f"no YAML reader for {path}; JSON needs none") from e
    return yaml.safe_load(text) or {}


def write_thresholds(new: DataFrame, path: str, key: str = "method") -> DataFrame:
    """Puts new's rows (method, threshold, ...) into the registry at path, in place of those of equal key, in a file
    that replaces the old one whole. A registry has a row per method, so the driver writes it."""
    spark = new.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = upsert(read_thresholds(spark, path), new, key) if fs.exists(at) else new
    told = {r[key]: {c: v for c, v in r.asDict().items() if c != key and v is not None} for r in rows.orderBy(key).collect()}
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(told, indent=2).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)
    return spark.createDataFrame([(k, v.get("threshold")) for k, v in told.items()], f"{key} string, threshold double")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str, run_id: str) -> None:
    """Adds decisions to a JSONL log, in a folder of the run: earlier runs stay as they are."""
    df.write.mode("append").json(f"{path}/run_id={run_id}")


def upsert(registry: DataFrame, new: DataFrame, key: str = "method") -> DataFrame:
    """registry with new's rows in place of those of equal key."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def versioned(path: str, run_id: str) -> str:
    """A place per run, so that nothing is overwritten."""
    return f"{path}/run_id={run_id}"


def write_edges(found: DataFrame, path: str) -> None:
    write_csv(found.orderBy(F.desc("weight"), "src", "dst"), path, "\t")


def write_matrix(kept: DataFrame, found: DataFrame, path: str, n: int = 100) -> None:
    write_csv(matrix(kept, found, n), path, "\t")


def frequencies(kept: DataFrame, condition: str) -> DataFrame:
    return kept.select(F.col("id").alias("keyword"), "freq", F.lit(condition).alias("condition"))


def figure_data(kept: DataFrame, found: DataFrame, n: int = 100) -> tuple:
    """What a figure of the n most frequent nodes needs: nodes with degree, and edges."""
    few, inside = induced(kept, found, n)
    degree = both_ways(inside).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    return few.join(degree, "id", "left").fillna(0, ["degree"]), inside


def annotation_sheet(pairs: DataFrame, labels: list, instructions: str) -> DataFrame:
    """pairs as strings with blank label columns, a row of instructions first (order column _order)."""
    x = pairs.select(*[F.col(c).cast("string").alias(c) for c in pairs.columns]).withColumns({c: F.lit("") for c in labels})
    head = x.sparkSession.createDataFrame([tuple("INSTRUCTIONS" if c == "pair_id" else instructions if c == labels[-1] else "" for c in x.columns)], x.schema)
    return head.withColumn("_order", F.lit(0)).unionByName(x.withColumn("_order", F.lit(1)))


def row_numbered_within(df: DataFrame, by: str, order: list) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def report(rows: DataFrame, title: str, width: int = 72) -> str:
    """A fixed-width text of a small table, for people."""
    out = [title, "=" * width]
    for r in rows.toLocalIterator():
        out += [f"{c:<40}{'' if v is None else v}" for c, v in r.asDict().items()] + ["-" * width]
    return "\n".join(out)
