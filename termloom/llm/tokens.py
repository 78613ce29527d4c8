"""Token counts of flat, unindexed token files by a separator scan.

A file is a run of little-endian ids; every document ends with the end-of-document id and nothing says
where. Files are read in blocks; each block is searched for the separator at once with numpy and tells only
its separators' places. A prefix scan over the blocks of a file carries the number of separators and the
last one's place across block edges, so documents may cover any number of blocks.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_path, table

#: Where the tokenizers' vocabulary files are; a parameter of every function that tokenises.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id after the vocabulary's last: 50256 is free in it.
END = 50256
WIDTH = 2
BLOCK_BYTES = 4 << 20
#: Documents go to files, and files to the scan, in so many waves: scratch holds one wave of tokens.
WAVES = 4


def _place(uri: str) -> tuple:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _bytes(path: str) -> bytes:
    """A file's bytes, given a local path or the URI of a file system that Arrow knows."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    fs, at = _place(path)
    with fs.open_input_file(at) as f:
        return f.read()


def encoder(vocabulary: str | bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, given its path or its bytes."""
    import tiktoken

    lines = (vocabulary if isinstance(vocabulary, bytes) else _bytes(vocabulary)).splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, vocabulary_bc, end: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        encode, task = encoder(vocabulary_bc.value).encode_ordinary, TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}.{task.taskAttemptId()}.bin"
        fs, path = _place(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        n, size, no_id = 0, 0, None
        out = fs.open_output_stream(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            no_id = pa.nulls(1, ids.type)
            for text in texts.to_pylist():
                raw = np.array([*encode(text or ""), end], kind).tobytes()
                out.write(raw)
                size += len(raw)
            yield pa.record_batch(
                [pa.array([name] * len(ids), pa.string()), pa.array(np.arange(n, n + len(ids))), ids, pa.array([None] * len(ids), pa.int64())],
                ["file", "ordinal", "doc_id", "bytes"],
            )
            n += len(ids)
        out.close()
        if no_id is not None:  # else the task had no rows, and nothing names its empty file
            yield pa.record_batch(
                [pa.array([name], pa.string()), pa.array([None], pa.int64()), no_id, pa.array([size], pa.int64())],
                ["file", "ordinal", "doc_id", "bytes"],
            )

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH) -> DataFrame:
    """Writes docs (doc_id, text) as flat token files, one per task, in a shared folder. Returns, written to
    scratch, (file, ordinal, doc_id) of every document and, with null ordinal, (file, bytes) of every file.
    A task that runs again writes a file of its own; only files named here count. The vocabulary file is read on the
    driver and sent to the executors; ids may be of any type."""
    docs = docs.select("doc_id", "text")
    schema = f"file string, ordinal long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bytes long"
    bc = docs.sparkSession.sparkContext.broadcast(_bytes(vocabulary))
    return materialise(docs.mapInArrow(_writer(folder, bc, end, width), schema), "manifest")


def _scanner(end: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _place(row["file"])
                with fs.open_input_file(path) as f:
                    f.seek(row["start"])
                    ids = np.frombuffer(f.read(row["size"]), kind)
                ends = np.flatnonzero(ids == end) + row["start"] // width
                yield pa.record_batch(
                    [pa.array([row["file"]], pa.string()), pa.array([row["start"] // width], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    ["file", "start", "n", "ends"],
                )

    return run


def count_tokens(files: DataFrame, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, complete) of every document in flat files, given as (file URI, bytes).

    Documents count from 0 in their file; n_tokens leaves out the separator; two separators in a row hold a
    document of 0 tokens. Ids after the last separator are a document with complete = false. Empty files
    and no files give no rows; a file named twice counts once; null names are left out. A rest of bytes
    that is no whole id is not read.
    """
    block = block_bytes // width * width
    files = files.where("file is not null and bytes > 0").groupBy("file").agg(F.max("bytes").alias("bytes"))
    files = files.withColumn("bytes", F.col("bytes") - F.col("bytes") % width).where("bytes > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block).cast("long")))
    blocks = files.select("file", "bytes", cut.alias("start"))
    blocks = blocks.select("file", "start", F.least(F.lit(block), F.col("bytes") - F.col("start")).alias("size"))
    blocks = blocks.repartition("file", "start")
    seen = blocks.mapInArrow(_scanner(end, width), "file string, start long, n long, ends array<long>")
    seen = materialise(seen, "separators")

    order = W.partitionBy("file").orderBy("start")
    edge = seen.select("file", "start", "n", F.size("ends").cast("long").alias("k"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    edge = (
        edge.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0)))
        .withColumn("from", F.coalesce(F.max("last").over(before), F.lit(-1)))
        .withColumn("final", F.lead("start").over(order).isNull())
    )
    # Files' edges grow with the corpus: never a broadcast, whatever their compressed size.
    x = seen.join(edge.select("file", "start", "base", "from", "final").hint("merge"), ["file", "start"])
    length = lambda e, i: e - F.when(i == 0, F.col("from")).otherwise(F.get("ends", i - 1)) - 1
    docs = F.transform("ends", lambda e, i: F.struct((F.col("base") + i).alias("ordinal"), length(e, i).alias("n_tokens"), F.lit(True).alias("complete")))
    rest = F.col("start") + F.col("n") - 1 - F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("from"))
    tail = F.when(
        F.col("final") & (rest > 0),
        F.array(F.struct((F.col("base") + F.size("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("complete"))),
    ).otherwise(F.array().cast("array<struct<ordinal:bigint,n_tokens:bigint,complete:boolean>>"))
    return x.select("file", F.explode(F.concat(docs, tail)).alias("d")).select("file", "d.*")


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, waves: int = WAVES) -> DataFrame:
    """(doc_id, n_tokens) per row of docs: tokenised to flat files, counted by their separators alone.

    Null and empty texts have 0 tokens; a text that spells a special token is ordinary text; null ids, ids of any
    type and repeated rows give a row each; an empty table gives none; other columns are left out. A very long
    text is one document of as many blocks as its tokens fill. Each wave's files go once it is counted.
    """
    spark, parts = docs.sparkSession, []
    docs = docs.select("doc_id", "text")
    wave = F.pmod(F.xxhash64("doc_id", "text"), F.lit(waves))
    for i in range(waves):
        folder = scratch_path(spark, "tokens")
        manifest = write_tokens(docs.where(wave == i), folder, vocabulary)
        counted = count_tokens(manifest.where("ordinal is null").select("file", "bytes"))
        found = manifest.where("ordinal is not null").join(counted.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
        parts.append(materialise(found, "counts"))
        _remove(spark, folder)
        discard(manifest)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op5_token_counts(spark, sf_dir):
    return document_tokens(table(spark, sf_dir, "documents"))
