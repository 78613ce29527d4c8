"""Substring dedup: repeated passages by sharded Aho-Corasick automata.

1. Anchors. Every window of 35 words picks the 6-word phrase of least hash in it, so that equal windows
   pick the same phrase at the same place. Consecutive windows with one phrase form a context. One phrase
   in about sixteen words is picked; only phrases that occur twice or more go on.
2. Confirmation. A context whose whole word sequence occurs twice is a recurring passage. Where one phrase
   has several contexts, each distinct context also gives its windows, and a window in two of them recurs.
   Equal means equal 64-bit hashes of two chained levels; counts are pre-aggregated, so that a hot passage
   costs one row per task.
3. Automata. Documents are dealt to shards of about a megabyte. A shard gets each recurring passage that
   occurs in it once, as a place in one of its documents, compiles the passages into one Aho-Corasick
   automaton over word numbers, and streams all its documents through it: every occurrence, in whichever
   document, is found there.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grams, discard, hash_words, materialise, slices, table

WINDOW, PHRASE = 35, 6
SHARD_BYTES = 1 << 20
_PLACE = np.uint64((1 << 30) - 1)


def contexts(texts: list, window: int, phrase: int) -> tuple:
    """For the words of each text: (text number, first word, words, phrase hash, context hash) of all contexts."""
    h, off, *_ = hash_words(texts)
    none = np.zeros(0, np.int64)
    n = len(h)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    g = Grams(h)
    at = np.arange(n - phrase + 1)
    phrases = g.of(at, at + phrase)
    least = (phrases & ~_PLACE) | at.astype(np.uint64)
    width, have = window - phrase + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    text = np.repeat(np.arange(len(texts)), np.diff(off))[: n - window + 1]
    start = np.flatnonzero(np.arange(n - window + 1) + window <= off[text + 1])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    text, pick = text[start], (least[start] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((head[1:], [len(start)])) - 1
    a, b = start[head], start[last] + window
    return text[head], a - off[text[head]], b - a, phrases[pick[head]], g.of(a, b)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count_phrases(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch):
                hashes, n = np.unique(contexts(texts, window, phrase)[3], return_counts=True)
                yield pa.record_batch([_signed(hashes), pa.array(n.astype(np.int64))], ["phrase", "n"])

    return run


def _places(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            shard, key = batch.column("shard").to_numpy(), batch.column("key").to_numpy()
            for at, texts in slices(batch):
                text, a, size, p, c = contexts(texts, window, phrase)
                text = text + at
                yield pa.record_batch(
                    [pa.array(shard[text]), pa.array(key[text]), pa.array(a.astype(np.int32)), pa.array(size.astype(np.int32)), _signed(p), _signed(c)],
                    ["shard", "key", "a", "size", "phrase", "context"],
                )

    return run


def _squeeze(batches):
    """Texts as zstd frames: a third of what shuffles write for texts."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        z = []
        for _, texts in slices(batch):
            z += [pack(t) for t in texts]
        cols = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*cols, pa.array(z, pa.binary())], [*[c for c in batch.schema.names if c != "text"], "z"])


def squeezed(docs: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_squeeze, f"{schema}, z binary")


def _windows(window: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                h, *_ = hash_words([unpack(row["z"])])
                spans = row["spans"]
                a = np.array([s["a"] for s in spans])
                n = np.array([s["size"] for s in spans]) - window + 1
                single = np.repeat(np.array([s["single"] for s in spans]), n)
                starts = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                wh = Grams(h).of(starts, starts + window)
                m = len(wh)
                yield pa.record_batch(
                    [pa.array(np.full(m, row["shard"], np.int32)), pa.array(np.full(m, row["key"], np.int64)), pa.array(starts.astype(np.int32)), pa.array(single), _signed(wh)],
                    ["shard", "key", "a", "single", "window"],
                )

    return run


class Shard:
    """The automaton of a shard's recurring passages over numbers of words."""

    def __init__(self, texts: dict, marks: list):
        """texts: words by key; marks: (key, first word, words) of each passage."""
        self.numbers: dict = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        number = self.numbers.setdefault
        for key, a, size in marks:
            passage = texts[key][a : a + size]
            self.automaton.add_word(tuple(number(w, len(self.numbers) + 1) for w in passage), size)
        if marks:
            self.automaton.make_automaton()
        self.empty = not marks

    def covered(self, words: list) -> np.ndarray:
        """Which words lie in an occurrence of a passage."""
        edge = np.zeros(len(words) + 1, np.int32)
        if not self.empty:
            for end, size in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
                edge[end - size + 1] += 1
                edge[end + 1] -= 1
        return np.cumsum(edge[:-1]) > 0


def _stream(id_type: pa.DataType, with_text: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        words = [unpack(z).split() for z in docs.column("z").to_pylist()]
        keys = docs.column("key").to_pylist()
        by_key = dict(zip(keys, words, strict=True))
        places = zip(*[marks.column(c).to_pylist() for c in ("key", "a", "size")], strict=True)
        shard = Shard(by_key, [x for x in places if x[0] in by_key])
        n_removed, digest, kept_text = [], [], []
        for w in words:
            gone = shard.covered(w)
            kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(w)
            n_removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode("utf-8", "replace"))
        out = {
            "doc_id": docs.column("doc_id").cast(id_type), "n_words": pa.array([len(w) for w in words], pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
        }
        return pa.table(out | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {}))

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, with_text: bool = True
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of `window` words over it occurs anywhere else, in the same document too;
    windows are judged on the input. Null and blank texts have no words and keep the digest of nothing.
    Rows with equal ids or texts are documents of their own, so a repeated row is a repeat of the other;
    null ids stay. An empty table gives no rows. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-total // shard_bytes))
    named = docs.select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit("key"), "text", "doc_id").alias("key"),
    )

    seen = docs.select("text").mapInArrow(_count_phrases(window, phrase), "phrase long, n long")
    recurring = materialise(seen.groupBy("phrase").agg(F.sum("n").alias("n")).where("n >= 2").select("phrase"), "phrases")
    place = "shard int, key long, a int, size int, phrase long, context long"
    places = named.select("shard", "key", "text").mapInArrow(_places(window, phrase), place)
    places = materialise(places.join(recurring, "phrase"), "places")

    distinct = places.groupBy("phrase", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("shard", "key", "a", "size")).alias("at")
    )
    distinct = materialise(distinct, "contexts")
    several = distinct.groupBy("phrase").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("phrase")
    whole = places.join(distinct.where("n >= 2").select("phrase", "context"), ["phrase", "context"])
    whole = whole.groupBy("shard", "context").agg(F.min(F.struct("key", "a", "size")).alias("at")).select("shard", "at.*")

    spans = distinct.join(several, "phrase").select("at.*", (F.col("n") == 1).alias("single"))
    spans = spans.groupBy("shard", "key").agg(F.collect_list(F.struct("a", "size", "single")).alias("spans"))
    texts = squeezed(named.select("shard", "key", "text"))
    windows = texts.join(spans, ["shard", "key"]).mapInArrow(_windows(window), "shard int, key long, a int, single boolean, window long")
    windows = materialise(windows, "windows")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("window")
    edges = windows.where("single").join(again, "window")
    edges = edges.groupBy("shard", "window").agg(F.min(F.struct("key", "a")).alias("at"))
    marks = whole.unionByName(edges.select("shard", "at.key", "at.a", F.lit(window).alias("size")))
    marks = materialise(marks, "marks")
    discard(recurring, places, distinct, windows)

    left = squeezed(named).groupBy("shard")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    from pyspark.sql.pandas.types import to_arrow_type

    run = _stream(to_arrow_type(docs.schema["doc_id"].dataType), with_text)
    return left.cogroup(marks.groupBy("shard")).applyInArrow(run, schema)


def op1_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
with w as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, w, unnest(generate_series(1, len(w) - 34)) as i from w where len(w) >= 35),
h as (select r, i, sha256(array_to_string(w[i:i + 34], ' ')) as h from s),
b as (select r, i from (select r, i, count(*) over (partition by h) as n from h) where n > 1),
g as (select distinct r, i + k as p from b, (select unnest(generate_series(0, 34)) as k)),
m as (select r, list(p) as gone from g group by r)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(len(m.gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when m.gone is null then w.w
    else list_transform(list_filter(list_zip(w.w, generate_series(1, len(w.w))), lambda z: not list_contains(m.gone, z[2])), lambda z: z[1]) end, ' ')) as kept_sha256
from w left join m on w.r = m.r"""
