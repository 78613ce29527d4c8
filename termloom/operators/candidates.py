"""Candidate pairs by strata. Each stratum returns (keyword_a, keyword_b, stratum, retrieval_method,
similarity_score) with keyword_a < keyword_b, scores rounded to 4 places; vocab is (keyword, norm, frequency)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.jaro import pairs_above
from ..functions.similarity import jaro_winkler
from ..plans.scratch import materialise

#: Order in which strata claim a pair, of benchmark building and of the downstream run.
BENCHMARK_ORDER = ("i", "ii", "iv", "v", "ix", "iii", "vi", "vii", "viii", "x")
#: Normal forms on one side of a tile: a large block is many tiles, and no task holds all of it.
TILE = 2048
#: Pairs of keywords in one batch of a tile's results, about.
BATCH = 1 << 17
STOPWORDS = ("and", "of", "the", "in", "for", "a", "an")
DOWNSTREAM_ORDER = ("i", "ii", "iv", "v", "iii", "vi", "vii", "viii", "x")


def vocabulary(frequency: DataFrame) -> DataFrame:
    x = frequency.where("keyword is not null")
    return x.select("keyword", T.normalise(F.col("keyword")).alias("norm"), "frequency")


def _pairs(df: DataFrame, a: str, b: str, stratum, method, score) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return df.where(x != y).select(
        F.least(x, y).alias("keyword_a"), F.greatest(x, y).alias("keyword_b"),
        stratum.alias("stratum"), method.alias("retrieval_method"), F.round(score, 4).alias("similarity_score"),
    )


def _same_key(vocab: DataFrame, key, stratum: str, method: str, score: float) -> DataFrame:
    x = vocab.select("keyword", key.alias("key")).where("key is not null")
    y = x.select(F.col("keyword").alias("other"), "key")
    out = x.join(y, "key").where("keyword < other")
    return _pairs(out, "keyword", "other", F.lit(stratum), F.lit(method), F.lit(score))


def case_variants(vocab: DataFrame) -> DataFrame:
    """i: equal normal forms."""
    return _same_key(vocab, F.col("norm"), "i", "capitalisation_whitespace", 1.0)


def punctuation_variants(vocab: DataFrame, least: int = 3) -> DataFrame:
    """iv: equal without punctuation and blanks."""
    key = T.strip_punctuation(F.col("norm"))
    return _same_key(vocab, F.when(F.char_length(key) >= least, key), "iv", "punctuation_hyphenation", 0.95)


def spelling_variants(
    vocab: DataFrame, low: float = 0.85, high: float | None = 0.95, least_frequency: int = 2, least_length: int = 4,
    ratio: float = 0.6, prefix: int = 3,
) -> DataFrame:
    """ii: Jaro-Winkler in [low, high) among keywords with one prefix; every pair of normal forms is scored once,
    however many keywords share them, and a block is dealt out in tiles that meet two by two."""
    pool = vocab.where((F.col("frequency") >= least_frequency) & (F.char_length("norm") >= least_length))
    norms = pool.groupBy("norm").agg(F.collect_list("keyword").alias("keywords")).withColumn("block", F.substring("norm", 1, prefix))
    counts = norms.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / TILE)
    x = norms.join(counts, "block").select("block", "norm", "keywords", F.pmod(F.xxhash64("norm"), parts).alias("part"), parts.alias("parts"))
    x = x.select("block", "norm", "keywords", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    x = x.select("block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "norm", "keywords", "part")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        part, norm = t["part"].to_numpy(), np.array(t["norm"].to_pylist(), object)
        kept, same = t["keywords"].to_pylist(), t["p"][0].as_py() == t["q"][0].as_py()
        sides = [np.arange(len(norm))] * 2 if same else [np.flatnonzero(part == t[k][0].as_py()) for k in "pq"]
        of = np.repeat(np.arange(len(norm)), [len(k) for k in kept])
        words = sorted(zip((k for ks in kept for k in ks), of.tolist(), strict=True))  # in the order of code points, which is Spark's
        of = np.array([i for _, i in words], np.int64)
        places = np.argsort(of, kind="stable")  # places of the keywords of each normal form, one after the other
        many = np.bincount(of, minlength=len(norm))
        first, words = np.cumsum(many) - many, pa.array([w for w, _ in words], pa.string())

        def batch(found):
            r, c, s = (np.concatenate(z) for z in zip(*found, strict=True))
            n = many[r] * many[c]
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            r, c, s = r[at], c[at], s[at]
            x, y = places[first[r] + k // many[c]], places[first[c] + k % many[c]]
            return pa.record_batch([words.take(pa.array(np.minimum(x, y))), words.take(pa.array(np.maximum(x, y))), pa.array(s)], ["keyword_a", "keyword_b", "score"])

        a, b = (norm[i].tolist() for i in sides)
        found, size = [], 0
        for r, c, s in pairs_above(a, b, np.full(len(a), low), prefix, ratio, same, digits=4, below=np.inf if high is None else high):
            found.append((sides[0][r], sides[1][c], s))
            size += len(r)
            if size >= BATCH:
                yield batch(found)
                found, size = [], 0
        if size:
            yield batch(found)

    # Else the tiles of a block stay in the task to which the join has dealt the block.
    x = x.repartition("block", "p", "q").groupBy("block", "p", "q").applyInArrow(scored, "keyword_a string, keyword_b string, score double")
    return x.select("keyword_a", "keyword_b", F.lit("ii").alias("stratum"), F.lit("jaro_winkler").alias("retrieval_method"), F.col("score").alias("similarity_score"))


def representatives(vocab: DataFrame) -> DataFrame:
    """(norm, keyword): of each normal form the most frequent keyword, then the smallest."""
    return vocab.groupBy("norm").agg(F.min_by("keyword", F.struct(-F.col("frequency"), "keyword")).alias("keyword"))


def plural_variants(vocab: DataFrame) -> DataFrame:
    """v: +s, +es and ies for y, between representatives."""
    one = representatives(vocab)
    two = one.select(F.col("norm").alias("target"), F.col("keyword").alias("other"))
    n = F.col("norm")
    rules = (
        ("singular_plural_s", F.concat(n, F.lit("s"))), ("singular_plural_es", F.concat(n, F.lit("es"))),
        ("singular_plural_ies_y", F.when(n.endswith("ies") & (F.char_length(n) > 4), F.concat(F.expr("substring(norm, 1, char_length(norm) - 3)"), F.lit("y")))),
    )
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), k.alias("target")) for m, k in rules]))
    x = one.select("keyword", keys.alias("k")).select("keyword", "k.*").where("target is not null").join(two, "target")
    return _pairs(x, "keyword", "other", F.lit("v"), F.col("method"), F.lit(0.9))


def acronyms(vocab: DataFrame) -> DataFrame:
    """iii: a keyword of two to six capitals with a longer one that has it in brackets or by its initials."""
    short = vocab.where(T.is_acronym(F.col("keyword"))).select(F.col("keyword").alias("short"), F.upper(F.trim("keyword")).alias("key"))
    keys = F.array_union(T.bracketed_acronyms(F.col("keyword")), F.array_compact(F.array(T.initials(F.col("keyword")))))
    long = vocab.select(F.col("keyword").alias("long"), F.explode(keys).alias("key"))
    x = short.join(long, "key").where("short <> long and char_length(long) > char_length(short)").select("short", "long").distinct()
    return _pairs(x, "short", "long", F.lit("iii"), F.lit("acronym_expansion"), F.lit(0.95))


def malformed_nearest(vocab: DataFrame, low: float = 0.7, least_frequency: int = 2, most: int | None = None, pool: int | None = None) -> DataFrame:
    """ix: a malformed keyword with its nearest good one (Jaro-Winkler above low) of the same two first
    characters, ties to the smaller keyword; without such a block, among the head of the good ones (by
    frequency, keyword; 300 unless pool says more). most and pool cap both sides, in total orders, if given."""
    bad = vocab.where(T.is_malformed(F.col("keyword")) & (F.char_length("norm") >= 2)).select(F.col("keyword").alias("bad"), F.col("norm").alias("bn"), "frequency")
    if most is not None:
        bad = bad.orderBy(F.desc("frequency"), "bad").limit(most)
    bad = bad.select("bad", "bn", F.substring("bn", 1, 2).alias("block"))
    good = vocab.where((F.col("frequency") >= least_frequency) & ~T.is_malformed(F.col("keyword")))
    good = good.select(F.col("keyword").alias("good"), F.col("norm").alias("gn"), F.substring("norm", 1, 2).alias("block"), "frequency")
    if pool is not None:
        at = F.row_number().over(W.partitionBy("block").orderBy(F.desc("frequency"), "good"))
        inside = good.withColumn("at", at).where(F.col("at") <= pool).drop("at")
    else:
        inside = good
    asks = bad.select(F.col("bn").alias("ask")).distinct()
    floor = float(np.nextafter(low, np.inf))  # a score has to be above low
    own = lambda g: g.groupBy("gn").agg(F.min("good").alias("good"))
    one = own(inside)
    # The nearest of four equal first characters come first: their scores leave few of the block to compare.
    seeds = materialise(_nearest(asks.where(F.char_length("ask") >= 4).withColumn("floor", F.lit(floor)), one, 4), "seeds")
    left = asks.join(seeds.select("ask", "score"), "ask", "left").select("ask", F.coalesce("score", F.lit(floor)).alias("floor"))
    inner = _nearest(left, one, 2, cap=3).unionByName(seeds)
    head = good.orderBy(F.desc("frequency"), "good").limit(pool or 300).select("good", "gn")
    alone = asks.withColumn("block", F.substring("ask", 1, 2)).join(good.select("block").distinct(), "block", "left_anti")
    outer = _nearest(alone.select("ask", F.lit(floor).alias("floor")), own(head), 0)
    best = inner.unionByName(outer).groupBy("ask").agg(F.min_by(F.struct("good", "score"), F.struct(-F.col("score"), "good")).alias("b"))
    best = bad.join(best.select(F.col("ask").alias("bn"), "b.*"), "bn").select("bad", "good", "score")
    return _pairs(best, "bad", "good", F.lit("ix"), F.lit("malformed_jw_nearest"), F.col("score"))


def _nearest(asks: DataFrame, good: DataFrame, prefix: int, cap: int = 4) -> DataFrame:
    """(ask, good, score): of each tile in which a normal form (ask, floor) meets good ones (gn, good) of the same first
    characters, the best score at floor or above, ties to the smaller good. Pairs that share more than cap first
    characters may be left out."""
    asks, good = asks.withColumn("block", F.substring("ask", 1, prefix)), good.withColumn("block", F.substring("gn", 1, prefix))
    count = lambda x, n: x.groupBy("block").agg(F.count(F.lit(1)).alias(n))
    counts = count(asks, "na").join(count(good, "ng"), "block")
    counts = counts.select("block", F.ceil(F.col("na") / TILE).alias("pa"), F.ceil(F.col("ng") / TILE).alias("pg"))

    def dealt(x, text, word, floor, own, other, p, q):
        """Rows of one side in their part, once for each part of the other side."""
        y = x.join(counts, "block").withColumn("part", F.pmod(F.xxhash64(text), F.col(own)))
        y = y.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return y.select("block", F.col(p).alias("p"), F.col(q).alias("q"), F.col(text).alias("text"), word.alias("word"), floor.alias("floor"))

    x = dealt(asks, "ask", F.lit(None).cast("string"), F.col("floor"), "pa", "pg", "part", "other")
    x = x.unionByName(dealt(good, "gn", F.col("good"), F.lit(None).cast("double"), "pg", "pa", "other", "part"))

    def best(t: pa.Table) -> pa.Table:
        rows = zip(t["text"].to_pylist(), t["word"].to_pylist(), t["floor"].to_pylist(), strict=True)
        a, b = [], []
        for text, word, floor in rows:
            a.append((text, floor)) if word is None else b.append((word, text))
        b.sort()  # in the order of code points, which is Spark's
        score, at = np.array([f for _, f in a], float), np.full(len(a), len(b))
        for r, c, s in pairs_above([x for x, _ in a], [x for _, x in b], score, prefix, cap=cap):  # score is the floor and rises
            order = np.lexsort((c, -s, r))
            r, c, s = r[order], c[order], s[order]
            lead = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            r, c, s = r[lead], c[lead], s[lead]
            won = (s > score[r]) | ((s == score[r]) & (c < at[r]))
            score[r[won]], at[r[won]] = s[won], c[won]
        has = np.flatnonzero(at < len(b))
        texts = [pa.array([a[i][0] for i in has], pa.string()), pa.array([b[at[i]][0] for i in has], pa.string())]
        return pa.table([*texts, pa.array(score[has], pa.float64())], ["ask", "good", "score"])

    return x.repartition("block", "p", "q").groupBy("block", "p", "q").applyInArrow(best, "ask string, good string, score double")


def embedding_bands(neighbours: DataFrame, edges=(0.85, 0.75, 0.60, 0.50), top: int = 5, top_short: int = 3) -> DataFrame:
    """vi, vii, x by similarity band and viii for short ambiguous queries, from (keyword, neighbour,
    similarity, rank, short); the first claim of a pair wins: by stratum, then by the asking keyword."""
    high, near, broad, low = edges
    s = F.col("similarity")
    stratum = F.when(F.col("short"), "viii").when(s >= near, "vi").when(s >= broad, "vii").otherwise("x")
    method = F.when(F.col("short"), "embedding_short_ambig").when(s >= near, "embedding_near_synonym").when(s >= broad, "embedding_broader_narrower").otherwise("embedding_weak_semantic")
    x = neighbours.where((s >= low) & (s < high) & (F.col("rank") <= F.when(F.col("short"), top_short).otherwise(top)))
    out = _pairs(x, "keyword", "neighbour", stratum, method, s)
    return first_claim(out, BENCHMARK_ORDER)


def keyword_neighbours(vocab: DataFrame, vectors: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(keyword, neighbour, similarity, rank, short): the nearest keywords of each by their vectors (keyword, vector),
    and whether the asking one is short and ambiguous; embedding_bands() takes it."""
    from ..functions.similarity import nearest

    asks = vocab.select("keyword", short_ambiguous(F.col("norm"), F.col("keyword")).alias("short"))
    own = vectors.join(vocab.select("keyword"), "keyword", "left_semi")
    return nearest(own, "keyword", vector, k).join(asks, "keyword")


def shared_token_pairs(vocab: DataFrame, least_shared: int = 1, stopwords=STOPWORDS) -> DataFrame:
    """(keyword_a, keyword_b, n_shared): keywords whose normal forms share tokens that are no stop words."""
    token = F.explode(F.array_distinct(F.filter(F.split("norm", r"[\s\-/]+"), lambda w: (w != "") & ~w.isin(*stopwords))))
    x = vocab.select("keyword", token.alias("token"))
    both = x.join(x.select(F.col("keyword").alias("other"), "token"), "token").where("keyword < other")
    both = both.groupBy(F.col("keyword").alias("keyword_a"), F.col("other").alias("keyword_b")).agg(F.count(F.lit(1)).alias("n_shared"))
    return both.where(F.col("n_shared") >= least_shared)


def short_ambiguous(norm, keyword):
    return F.char_length(norm).between(2, 4) & T.is_lower(norm) & ~T.is_acronym(keyword)


def first_claim(pairs: DataFrame, order=BENCHMARK_ORDER) -> DataFrame:
    """One row per pair: that of the stratum which comes first; equal strata by method and score."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stratum"))
    at = F.row_number().over(W.partitionBy("keyword_a", "keyword_b").orderBy(place, "retrieval_method", F.desc("similarity_score")))
    return pairs.where(place > 0).withColumn("_at", at).where("_at = 1").drop("_at")


def all_strata(vocab: DataFrame, neighbours: DataFrame | None = None, order=BENCHMARK_ORDER) -> DataFrame:
    parts = [case_variants(vocab), spelling_variants(vocab), punctuation_variants(vocab), plural_variants(vocab), acronyms(vocab)]
    if "ix" in order:
        parts.append(malformed_nearest(vocab))
    if neighbours is not None:
        parts.append(embedding_bands(neighbours))
    return first_claim(reduce(DataFrame.unionByName, parts), order)


def with_ids(pairs: DataFrame, pattern: str = "RAW%06d") -> DataFrame:
    """pairs with pair_id in the order (stratum, keyword_a, keyword_b). Numbers come from partition counts of
    a range-sorted table, so no task holds all rows."""
    from ..plans.numbering import numbered

    x = numbered(pairs, ["stratum", "keyword_a", "keyword_b"], "_n")
    return x.withColumn("pair_id", F.format_string(pattern, "_n")).drop("_n")


def stratum_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_pairs"))


def matches_among(pairs: DataFrame, vocab: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(keyword_a, keyword_b) of candidate pairs whose normal forms reach a Jaro-Winkler."""
    a = vocab.select(F.col("keyword").alias("keyword_a"), F.col("norm").alias("na"))
    b = vocab.select(F.col("keyword").alias("keyword_b"), F.col("norm").alias("nb"))
    x = pairs.select("keyword_a", "keyword_b").distinct().join(a, "keyword_a").join(b, "keyword_b")
    x = x.withColumn("_s", jaro_winkler(F.col("na"), F.col("nb"))).where(F.col("_s") >= threshold)
    return x.select("keyword_a", "keyword_b")


def rebuilt_matches(vocab: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Matches without a verifier: equal normal forms, and pairs of one prefix, of equal text without
    punctuation or of singular and plural that reach the threshold. The length filter loses none of them."""
    from ..functions.similarity import least_length_ratio

    near = spelling_variants(vocab, threshold, None, least_length=3, ratio=least_length_ratio(threshold))
    other = punctuation_variants(vocab).unionByName(plural_variants(vocab))
    parts = [case_variants(vocab).select("keyword_a", "keyword_b"), near.select("keyword_a", "keyword_b"), matches_among(other, vocab, threshold)]
    return reduce(DataFrame.unionByName, parts).distinct()


def estimated_pool(sampled: int, floor: int = 50_000, fallback: int = 63_500) -> int:
    return max(5 * sampled, floor) if sampled else fallback
