"""Line dedup: a deletion-neighbourhood join with an edit bound of one character.

Two lines are within one edit if deleting one character from each, at the same place, or from the longer
one only, makes them equal. Emitting every deletion of every line would cost the square of its length, so
the neighbourhood opens in three steps, each of which keeps only keys that two different lines share:
halves (one half of any such pair is intact), blocks (all but one block is intact) and single characters
inside such a block. All steps are minima per key; no pair within a group is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, table

#: Shorter lines go by equality only: one edit makes too many different short lines alike.
LEAST_CHARS = 16
#: Characters of a block, at least; longer lines have blocks of the root of their length.
BLOCK_CHARS = 16


def _power(n: Column) -> Column:
    """Exponent of the greatest power of two up to n."""
    return F.char_length(F.bin(n)) - 1


def _half_keys(line: Column, size: Column) -> Column:
    """Hashes of both ends, for a pair in which this line is as long or longer, and one in which it is shorter."""
    own, other = _power(F.floor((size - 1) / 2)), _power(F.floor(size / 2))
    ends = lambda c: [F.xxhash64(F.lit("a"), c, F.substring(line, F.lit(1), F.pow(F.lit(2), c).cast("int"))), F.xxhash64(F.lit("z"), c, F.right(line, F.pow(F.lit(2), c).cast("int")))]
    return F.when(own == other, F.array(*ends(own))).otherwise(F.array(*ends(own), *ends(other)))


def _blocks(line: str, n: Column, short: bool) -> Column:
    """For a pair whose longer line has n characters: (key of all but block j, block j) of each block; of the
    shorter line the block lacks a character."""
    line, size = F.col(line), F.greatest(F.lit(BLOCK_CHARS), F.ceil(F.sqrt(n))).cast("int")
    less = 1 if short else 0

    def block(j):
        start = (j * size).cast("int")
        width = F.least(size, (n - start).cast("int")) - less
        rest = F.xxhash64(n, j, F.substring(line, F.lit(1), start), F.substring(line, start + width + 1, n.cast("int")))
        return F.struct(rest.alias("rest"), F.substring(line, start + 1, width).alias("mid"), F.lit(short).alias("short"))

    return F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), block)


def split_lines(docs: DataFrame) -> DataFrame:
    """(ord, line) of all lines with a word; ord is (id is null, doc_id, hash of the text, line number)."""
    x = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    x = x.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    null = F.col("doc_id").isNull()
    return x.select(F.struct(null.alias("null"), "doc_id", "h", "pos").alias("ord"), "line")


def removals(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, h, gone): the numbers of the lines, from 0, that each document of docs (doc_id, text) loses;
    h is xxhash64(text).

    A line with a word goes if an earlier one is equal or, from least_chars characters on, within one edit
    (character inserted, deleted or replaced). Earlier means smaller (doc_id, null last; hash of the text;
    line number); earlier lines count whether they stay or not. Rows with equal doc_id and text are one
    document. Null and blank texts have no lines. Hashes of 128 bits stand for equal lines.
    """
    ids = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    lines = split_lines(docs)
    size = F.char_length("line").cast("long")
    longer = lines.where(size >= least_chars)

    ends = longer.select("ord", *ids, F.explode(_half_keys(F.col("line"), size)).alias("key"))
    multi = ends.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    near = ends.join(materialise(multi, "ends"), "key").groupBy("h1", "h2").agg(F.min("ord").alias("ord"))
    near = materialise(near, "near")
    places = near.groupBy("ord.doc_id", "ord.h").agg(F.collect_set("ord.pos").alias("at"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    places = places.select(F.col("doc_id").alias("d2"), F.col("h").alias("hh"), "at")
    texts = texts.join(places, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("hh")))
    cut = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("pos"), s.alias("line"))), lambda s: F.array_contains("at", s["pos"]))
    cand = texts.select("doc_id", "h", F.explode(cut).alias("c")).select(
        F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h", F.col("c.pos").alias("pos")).alias("ord"), F.col("c.line").alias("line")
    )
    cand = cand.select("ord", "line", *ids, F.char_length("line").cast("long").alias("n")).dropDuplicates(["h1", "h2"])
    cand = materialise(cand, "candidates")
    release(docs.sparkSession)

    parts = F.concat(_blocks("line", F.col("n"), False), _blocks("line", F.col("n") + 1, True))
    parts = cand.select("ord", "h1", "h2", F.explode(parts).alias("b")).select("ord", "h1", "h2", "b.*")
    multi = parts.groupBy("rest").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("rest")
    parts = parts.join(multi, "rest")
    mid = F.col("mid")
    each = F.transform(F.sequence(F.lit(0), F.char_length(mid) - 1), lambda i: F.struct(F.xxhash64("rest", F.concat(F.substring(mid, F.lit(1), i), F.substring(mid, i + 2, F.char_length(mid)))).alias("v"), i.alias("i")))
    whole = F.array(F.struct(F.xxhash64("rest", mid).alias("v"), F.lit(-1).alias("i")))
    rows = parts.select("ord", "h1", "h2", F.explode(F.when(F.col("short"), whole).when(F.char_length(mid) > 0, each)).alias("x"))
    rows = materialise(rows.select("ord", "h1", "h2", "x.v", "x.i"), "deletions")
    first = rows.groupBy("v", "i").agg(F.min(F.struct("ord", "h1", "h2")).alias("m"))
    first = materialise(first, "first")
    by_v = first.groupBy("v").agg(F.min(F.when(F.col("i") < 0, F.col("m"))).alias("short"), F.min(F.when(F.col("i") >= 0, F.col("m"))).alias("long"))
    # A line that is shorter meets the longer ones; any other meets those with the same character gone, and the shorter ones.
    x = rows.join(first, ["v", "i"]).join(by_v, "v")
    options = F.when(F.col("i") < 0, F.array("long")).otherwise(F.array("m", "short"))
    x = x.select("ord", "h1", "h2", F.explode(options).alias("p")).where("p.ord < ord").select("h1", "h2", F.col("p.h1").alias("p1"), F.col("p.h2").alias("p2")).distinct()
    one = cand.select("h1", "h2", F.col("line").alias("a"))
    two = cand.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("b"))
    close = x.join(one, ["h1", "h2"]).join(two, ["p1", "p2"]).where(F.levenshtein("a", "b", 1).between(0, 1))
    close = materialise(close.select("h1", "h2").distinct(), "close")
    discard(near, rows, first, cand)
    release(docs.sparkSession)

    occurrences = lines.select("ord", *ids)
    groups = occurrences.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("c"))
    groups = groups.join(close.withColumn("edited", F.lit(True)), ["h1", "h2"], "left").where("c > 1 or edited")
    groups = materialise(groups.select("h1", "h2", "first", F.coalesce("edited", F.lit(False)).alias("edited")), "groups")
    gone = occurrences.join(groups, ["h1", "h2"]).where("edited or ord <> first")
    gone = gone.groupBy("ord.doc_id", "ord.h").agg(F.sort_array(F.collect_set("ord.pos")).alias("gone"))
    gone = materialise(gone, "gone")
    discard(close, groups)
    release(docs.sparkSession)
    return gone


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs, all rows and columns, with a text less the lines that removals() names, and n_removed_lines
    (a column of docs with that name is replaced). A text that loses all lines is empty; null stays null.
    n_chars, where docs has it, is that of the new text."""
    gone = removals(docs.select("doc_id", "text"), least_chars).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "gone")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    x = row.join(gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    kept = F.filter(F.split(F.col("_row.text"), "\n"), lambda s, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    x = x.select("_row.*", text.alias("_text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n"))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    new = {"text": F.col("_text"), "n_removed_lines": F.col("_n")}
    if kind:
        new["n_chars"] = F.char_length("_text").cast(kind)
    return x.withColumns(new).drop("_text", "_n")


def op4_line_dedup(spark, sf_dir):
    """Per document: doc_id, n_lines (with a word), n_removed, removed (numbers of the lines, joined)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removals(docs).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "gone")
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    x = docs.select("doc_id", count.cast("long").alias("n_lines"), F.xxhash64("text").alias("_hash"))
    x = x.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    return x.select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def stage(spark, docs, sf_dir):
    """docs without repeated lines; a document of which nothing is left stays, with an empty text."""
    return dedup_lines(docs).select(docs.columns)


ORACLE = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos from documents),
w as (select * from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
f as (select line, min(struct_pack(d := doc_id, p := pos)) as o, length(line) as n from w group by line),
e as (select distinct a.line from f a join f b on a.n = b.n and b.o < a.o and a.n >= 16 and levenshtein(a.line, b.line) <= 1
  union select distinct a.line from f a join f b on a.n = b.n + 1 and b.o < a.o and b.n >= 16 and levenshtein(a.line, b.line) <= 1
  union select distinct a.line from f a join f b on a.n = b.n - 1 and b.o < a.o and a.n >= 16 and levenshtein(a.line, b.line) <= 1),
g as (select w.doc_id, w.pos from w join f using (line) left join e using (line)
  where e.line is not null or struct_pack(d := w.doc_id, p := w.pos) <> f.o),
r as (select doc_id, count(*)::bigint as n_removed, string_agg(pos::varchar, ',' order by pos) as removed from g group by doc_id),
n as (select doc_id, count(*)::bigint as n_lines from w group by doc_id)
select d.doc_id, coalesce(n.n_lines, 0)::bigint as n_lines, coalesce(r.n_removed, 0)::bigint as n_removed, coalesce(r.removed, '') as removed
from documents d left join n using (doc_id) left join r using (doc_id)"""
