"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

Documents with equal shingle sets form a class, and only classes are compared. Each bucket of a band names
its most popular class (the one that meets most others over all bands) as centre, and pairs every other
class with it; pairs are confirmed on the full sets. A centre may be unlike two classes that are like each
other. Members of a centre are therefore known by their edits, the shingles that they lack of it and those
that they add. Two members of different components can only be a link if they share so many edits as follows
from how far both are from the centre, one at least. Members share that many only if they meet in a prefix
of their edits, the rarest first, as in joins of sets by overlap. Those that meet there, at places that leave
enough edits behind, are compared too: no pair of a bucket that could be a link is left out, and members
that only share what many share make no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Grams, discard, hash_words, materialise, mix64, slices, table
from .phrases import squeezed

WORDS, PERCENT = 5, 85
#: 32 bands of 4: a pair at 0.85 shares no band with probability (1 - 0.85^4)^32 < 1e-10.
BANDS, ROWS = 32, 4


def shingle_sets(texts: list, words: int = WORDS) -> list:
    """For each encoded text the sorted distinct 64-bit hashes of its shingles: runs of `words` words of the
    text in lower case (A-Z only), the whole sequence where there are fewer, nothing without words."""
    h, off, *_ = hash_words([t.lower() for t in texts])
    g, out = Grams(h), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= words:
            start = np.arange(a, b - words + 1)
            out.append(np.unique(g.of(start, start + words)))
        elif b > a:
            out.append(g.of(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """Band hashes of a shingle set from one permutation."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.low = (np.arange(self.bins + 1, dtype=np.float64) * (2.0**64 / self.bins))[:-1].astype(np.uint64)
        self.factor = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.tag = mix64(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def sources(self, attempt: int, bins: np.ndarray) -> np.ndarray:
        """The bins that empty bins look at in an attempt; a function of bin and attempt alone."""
        x = mix64(bins.astype(np.uint64) + np.uint64(attempt * 1_000_003 + 17))
        return (x % np.uint64(self.bins)).astype(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted and distinct, at least one."""
        at = np.searchsorted(hashes, self.low)
        end = np.append(at[1:], len(hashes))
        full = at < end
        least = np.where(full, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            seen = self.sources(attempt, empty)
            hit = full[seen]
            least[empty[hit]] = least[seen[hit]]
            empty, attempt = empty[~hit], attempt + 1
        return mix64((mix64(least.reshape(self.bands, self.rows)) * self.factor).sum(1, dtype=np.uint64) + self.tag)


def _sign(words: int):
    def run(batches):
        signer = Signer()
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid")
            for at, texts in slices(batch):
                sets = shingle_sets(texts, words)
                some = [s if len(s) else None for s in sets]
                yield pa.record_batch(
                    [
                        ids.slice(at, len(texts)), tids.slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if s is None else blake2b(s.tobytes(), digest_size=16).digest() for s in some], pa.binary()),
                        pa.array([None if s is None else signer.of(s).view(np.int64) for s in some], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "tid", "n_shingles", "fp", "bands"],
                )

    return run


def _compare(words: int, percent: int):
    """Pairs (a, b, za, zb) as (a, b, linked, nb, far, edits): whether the full sets have
    100 * intersection >= percent * union; the size of b; 100 * (shingles of b that a lacks) + percent * (others
    that a has), so that a and b are linked if far <= (100 - percent) * nb; and all these shingles."""

    def run(batches):
        unpack, sets = zstandard.ZstdDecompressor().decompress, OrderedDict()

        def of(key, z):
            if key not in sets:
                sets[key] = shingle_sets([unpack(z)], words)[0]
                if len(sets) > 64:
                    sets.popitem(last=False)
            sets.move_to_end(key)
            return sets[key]

        for batch in batches:
            linked, nb, far, edits = [], [], [], []
            for a, b, za, zb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "za", "zb")], strict=True):
                x, y = of(a, za), of(b, zb)
                edit = np.setxor1d(x, y, assume_unique=True)
                lacks = (len(edit) - len(x) + len(y)) // 2
                far.append(100 * lacks + percent * (len(edit) - lacks))
                linked.append(far[-1] <= (100 - percent) * len(y))
                nb.append(len(y))
                edits.append(edit.view(np.int64))
            yield pa.record_batch(
                [
                    batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(nb, pa.int64()), pa.array(far, pa.int64()),
                    pa.array(edits, pa.list_(pa.int64())),
                ],
                ["a", "b", "linked", "nb", "far", "edits"],
            )

    return run


def _open_pairs(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one centre in different components that may be links.

    With n shingles of the centre, 100 * intersection >= percent * union of two members is the same as
    (100 + percent) * (shared edits) >= far + far2 - (100 - percent) * n. Members linked with the centre are of
    one component, so one of the two is not, its far is above (100 - percent) * n, and they share an edit.
    """
    m = stars.select("a", "b", "nb", "far", "edits").join(roots.select(F.col("node").alias("a"), "root"), "a", "left")
    m = m.withColumn("root", F.coalesce("root", "a"))
    several = m.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("b")
    m = materialise(m.join(several, "b"), "members")

    slack = (100 - percent) * F.col("nb")
    # The shared edits of a member with any other: more than far / (100 + percent) with one that is open; an open
    # one's partner is at least percent times the shared edits from the centre itself.
    least = F.when(F.col("far") > slack, F.greatest(F.lit(1), F.ceil((F.col("far") - slack) / 100))).otherwise(F.floor(F.col("far") / (100 + percent)) + 1)
    each = m.select("a", "b", "root", "nb", "far", F.size("edits").alias("size"), least.alias("least"), F.explode("edits").alias("s"))
    shared = each.groupBy("b", "s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
    each = each.join(shared.where("lo <> hi").select("b", "s", "m"), ["b", "s"])
    # Edits that members of other components do not have are the rarest of all, and no places to meet.
    by = F.sort_array(F.collect_list(F.struct("m", "s")))
    each = each.groupBy("a", "b", "root", "nb", "far", "size", "least").agg(by.alias("e"))
    each = each.withColumn("own", F.col("size") - F.size("e")).select("*", F.posexplode("e").alias("k", "x"))
    each = each.withColumn("after", F.col("size") - F.col("own") - F.col("k")).where("after >= least")
    each = each.select("b", F.col("x.s").alias("s"), "a", "root", "nb", "far", "after")
    each = materialise(each, "prefixes")
    other = each.select("b", "s", *[F.col(c).alias(f"{c}2") for c in ("a", "root", "far", "after")])
    need = F.col("far") + F.col("far2") - slack
    may = (100 + percent) * F.least("after", "after2") >= need
    pairs = each.join(other, ["b", "s"]).where((F.col("a") < F.col("a2")) & (F.col("root") != F.col("root2")) & may)
    pairs = materialise(pairs.select("a", F.col("a2").alias("b")).distinct(), "open")
    discard(m, each)
    return pairs


def components_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts without words have no shingles and link with nothing: component_id is their doc_id. Copies and
    repeated rows share a class; rows of one doc_id and component are all kept or all dropped. Null ids
    take part; component_id is the smallest id that is not null, and null where there is none (kept).
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tid = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid")
    signed = docs.select("doc_id", tid, "text").mapInArrow(
        _sign(words), f"doc_id {id_type}, tid binary, n_shingles long, fp binary, bands array<long>"
    )
    signed = materialise(signed, "signed")
    some = signed.where("fp is not null")
    classes = some.groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.min("tid").alias("cid"), F.first("bands").alias("bands")
    )
    classes = materialise(classes, "classes")

    rows = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = materialise(rows.join(shared, "bucket"), "buckets")
    fame = rows.groupBy("cid").agg(F.sum("m").alias("fame"))
    ranked = rows.join(fame, "cid")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("fame", "cid")).alias("c"))
    first = rows.join(centre, "bucket").where(F.col("cid") != F.col("c.cid"))
    first = materialise(first.select(F.col("cid").alias("a"), F.col("c.cid").alias("b")).distinct(), "pairs")

    # One row for each text before texts meet: copies of a hot text end in the tasks that read them.
    wanted = rows.select(F.col("cid").alias("tid")).distinct()
    texts = squeezed(docs.select(tid, "text")).groupBy("tid").agg(F.first("z").alias("z"))
    texts = materialise(texts.join(wanted, "tid", "left_semi"), "texts")

    def compared(pairs: DataFrame) -> DataFrame:
        x = pairs.join(texts.select(F.col("tid").alias("a"), F.col("z").alias("za")), "a")
        x = x.join(texts.select(F.col("tid").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")
        schema = "a binary, b binary, linked boolean, nb long, far long, edits array<long>"
        return x.mapInArrow(_compare(words, percent), schema)

    stars = materialise(compared(first), "stars")
    links = stars.where("linked").select("a", "b")
    roots = components(links, "a", "b")
    pairs = _open_pairs(stars, roots, percent)
    more = materialise(compared(pairs).where("linked").select("a", "b"), "links")
    discard(roots, pairs)

    roots = components(links.unionByName(more), "a", "b")
    classes0, classes = classes, classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    classes = classes.select("fp", "least", F.coalesce("root", "cid").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(classes.join(ids, "root").select("fp", "component_id"), "component")
    discard(first, rows, texts, stars, more, roots, classes0)
    out = signed.select("doc_id", "n_shingles", "fp").join(classes, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark, sf_dir):
    return components_of(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """docs with one row of each component: the smallest id that is not null (then the smallest hash of the text),
    one of its rows. Rows are told apart by id and text, so rows without an id, or with an id that others have,
    take part like any; texts without words are in no component and all stay. Repeated rows are one document;
    an empty table stays empty; other columns are carried along, whatever their names."""
    own = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.lit("|"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", own.alias("own"))
    found = components_of(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0")
    mark = found.groupBy("doc_id.own").agg(F.max("kept").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("not _keep or _n > 1")
    mark = materialise(mark.withColumnRenamed("own", "_own"), "marks")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_k"))
    x = whole.join(mark, F.col("_k") == F.col("_own"), "left").where("_keep is null or _keep")
    if mark.where("_keep").isEmpty():
        return x.select("_row.*")
    once = x.where("_n is null").unionByName(x.where("_n is not null").dropDuplicates(["_k"]))
    return once.select("_row.*")


ORACLE = r"""
with recursive w as (select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s0 as (select r, case when len(w) >= 5 then list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
n as (select r, len(s)::bigint as n from s0),
cls as (select min(r) as c, s from (select r, list_sort(s) as s from s0 where len(s) > 0) group by s),
mem as (select s0.r, cls.c from s0 join cls on list_sort(s0.s) = cls.s),
x as (select c, unnest(s) as g from cls),
shared as (select a.c as a, b.c as b, count(*) as m from x a join x b on a.g = b.g and a.c < b.c group by 1, 2),
link as (select a, b from shared join n na on na.r = a join n nb on nb.r = b where 100 * m >= 85 * (na.n + nb.n - m)),
edge as (select a, b from link union all select b, a from link),
reach as (select c as a, c as b from cls union select reach.a, edge.b from reach join edge on reach.b = edge.a),
ids as (select m.c, min(w.doc_id) as least from mem m join w using (r) group by m.c),
comp as (select reach.a as c, min(ids.least) as component_id from reach join ids on ids.c = reach.b group by 1)
select w.doc_id, n.n as n_shingles, case when n.n = 0 then w.doc_id else comp.component_id end as component_id,
  w.doc_id is not distinct from (case when n.n = 0 then w.doc_id else comp.component_id end) as kept
from w join n using (r) left join mem using (r) left join comp on comp.c = mem.c"""
