"""Toxicity by weak supervision.

Voters look at a bounded sample of training rows: seed lexicons of several kinds and languages, hostile
phrases, an insult after a second person, shouting, spelling that hides a word, and one lexicon for each kind of
feature (words, word beginnings of four lengths) that is induced from the labels of other folds, so that no
row's own label has a vote on it. A generative model estimates by EM how each voter votes on either class, and
how far pairs of voters go together beyond that, which lowers their weight. Its posterior labels alone train a
linear classifier over words and word beginnings. Labels give the lexicons of other folds, the share of toxic
rows and EM's first guess of the accuracies; they are in no voter of their own row and are no target.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_words, materialise, mix64, slices, table
from .licences import normal_words
from .near import shingle_sets

#: Labelled documents that learning sees at most, and the folds that lexicons are induced across.
SAMPLE_ROWS, FOLDS = 8_000, 3
#: Minima of a text's 5-word shingles; texts that have one in common are near copies.
MINIMA = 8
#: Features are numbers: the kind (words, their first bytes of these lengths, or the length), then a hash of BITS bits.
BITS, BEGINNINGS = 41, (4, 5, 6, 7)
KINDS = 1 + len(BEGINNINGS)
LENGTH = KINDS
#: A lexicon's features: this share of their rows at least, and so many of a lexicon above chance by chance.
LEAST_SHARE, FALSE = 0.75, 5
#: Distinct lexicon features a word from which a text is dense, and below which it is sparse.
DENSE, SPARSE = 1 / 200, 1 / 400
#: Correlation of votes from which two voters count as copies; logarithm of the most that a vote can say.
COPY, MOST = 0.9, 5.3
THRESHOLD = 0.7
# The seed lexicons, by what they say.
MIND = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "clown", "loser", "losers", "imbécile", "stupide",
    "débile", "crétin", "abruti", "dumm", "dummkopf", "trottel", "depp", "blödmann", "estúpido", "idiota", "imbécil", "tonto", "payaso",
)
WORTH = (
    "trash", "garbage", "scum", "filth", "vermin", "worthless", "parasite", "parasites", "ordure", "racaille", "vermine", "abschaum",
    "müll", "wertlos", "ungeziefer", "basura", "escoria", "inútil",
)
DISGUST = (
    "pathetic", "disgusting", "hateful", "ugly", "repulsive", "hate", "despise", "pathétique", "dégoûtant", "ekelhaft",
    "erbärmlich", "widerlich", "hässlich", "asqueroso", "patético", "repugnante",
)
SEEDS = (*MIND, *WORTH, *DISGUST)
PHRASES = (
    "shut up", "get lost", "drop dead", "go to hell", "screw you", "nobody likes you", "kill yourself", "ferme la", "ta gueule",
    "halt die klappe", "halt den mund", "verpiss dich", "cállate", "vete al infierno",
)
SECOND_PERSON = ("you", "your", "youre", "u", "tu", "vous", "toi", "du", "ihr", "dich", "eres", "usted", "tú")
# Fixed value: a word some of whose letters stand for others, or are starred out.
HIDDEN = re.compile(rb"[A-Za-z][*@#$]{2,}[A-Za-z]|[A-Za-z]{2,}[013@$][a-z]{2,}")
#: Voters that look at the text alone; then come the induced lexicons, one for each kind of feature, the density of
#: what they find, and two voters for "not toxic": found next to nothing, and found nothing.
FIXED = ("mind", "worth", "disgust", "phrase", "second person", "shouting", "hidden")


def features(texts: list) -> tuple:
    """(text number, feature) of the distinct features of each encoded text, in order, and its number of words."""
    plain = [b" ".join(normal_words(t)) for t in texts]
    h, off, start, end, joined = hash_words(plain)
    text = np.repeat(np.arange(len(texts)), np.diff(off))
    kinds, size = [h], end - start
    pad, first, n = np.frombuffer(joined + bytes(8), np.uint8), np.zeros(len(start), np.uint64), 0
    for length in BEGINNINGS:
        while n < length:
            first = (first << np.uint64(8)) | np.where(size > n, pad[np.minimum(start + n, len(pad) - 1)], 0).astype(np.uint64)
            n += 1
        kinds.append(np.where(size > length, mix64(first), np.uint64(0)))
    mask, shift, pairs = np.uint64((1 << BITS) - 1), BITS + 3, []
    for i, k in enumerate(kinds):
        some = k != 0
        pairs.append((text[some] << shift) | (i << BITS) | (k[some] & mask).astype(np.int64))
    # What a text has less of than its length lets expect says something too: one feature for each power of two of words.
    n = np.diff(off)
    reached = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    each = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
    pairs.append((np.repeat(np.arange(len(texts)), reached) << shift) | (LENGTH << BITS) | each)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> shift, pairs & ((1 << shift) - 1), n


def shouting(text: bytes) -> bool:
    """Mostly capitals, or an exclamation in every other word."""
    upper, letters = sum(map(text.count, (b"A", b"E", b"I", b"N", b"T"))), max(1, sum(map(text.lower().count, (b"a", b"e", b"i", b"n", b"t"))))
    return upper > 0.5 * letters or text.count(b"!") * 8 > len(text)


def fixed_votes(text: bytes) -> list:
    """1 for each of FIXED that calls the text toxic, else 0."""
    words = normal_words(text)
    have = {w.decode("utf-8", "replace") for w in set(words)}
    padded = (" " + b" ".join(words).decode("utf-8", "replace") + " ") if have else ""
    seeds = {s.encode() for s in SEEDS} if not have.isdisjoint(SEEDS) else set()
    persons = {s.encode() for s in SECOND_PERSON}
    near = any(w in seeds and not persons.isdisjoint(words[max(0, i - 4) : i]) for i, w in enumerate(words)) if seeds else False
    hidden = len(HIDDEN.findall(text)) > 0.02 * max(1, len(words))
    found = [not have.isdisjoint(x) for x in (MIND, WORTH, DISGUST)]
    return [int(x) for x in (*found, any(f" {p} " in padded for p in PHRASES), near, shouting(text), hidden)]


def minima(hashes: np.ndarray, number: int) -> int | None:
    """The least of a text's shingles in the order of a given number."""
    return None if not len(hashes) else int(mix64(hashes ^ np.uint64(number + 1)).min().view(np.int64))


def _described():
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch):
                text, feature, n = features(texts)
                cut, sets = np.searchsorted(text, np.arange(len(texts) + 1)), shingle_sets(texts)
                yield pa.record_batch(
                    [
                        *(pa.array([minima(x, i) for x in sets], pa.int64()) for i in range(MINIMA)),
                        batch.column("key").slice(at, len(texts)), batch.column("toxic").slice(at, len(texts)), pa.array(n.astype(np.int64)),
                        pa.array([fixed_votes(t) for t in texts], pa.list_(pa.int32())),
                        pa.array([feature[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                    ],
                    [*(f"m{i}" for i in range(MINIMA)), "key", "toxic", "n", "fixed", "features"],
                )

    return run


def telling(inside: np.ndarray, n: np.ndarray, base: float, tested: int) -> np.ndarray:
    """Which features rows of the class hold more often than chance, by a likelihood-ratio test of inside among
    n rows against the base over all rows, so strict that of `tested` features FALSE pass by chance."""
    base = min(max(base, 1e-6), 1 - 1e-6)
    out = n - inside
    g = inside * np.log(np.maximum(inside, 1e-9) / (n * base)) + out * np.log(np.maximum(out, 1e-9) / (n * (1 - base)))
    return (g >= np.log(max(tested, 1) / FALSE)) & (inside >= 2.5) & (inside >= LEAST_SHARE * n)


def label_model(votes: np.ndarray, prior: float, start: np.ndarray | None = None, rounds: int = 200) -> tuple:
    """(posterior of class 1 per row, accuracies, correlations, weights) of voters (columns; 1 toxic, -1 not, 0 none).

    EM over how often each voter casts each vote on rows of either class. A vote speaks for its class by the ratio
    of the two rates, at worst not at all, so that the classes can't change places; silence says nothing.
    Voters that vote together beyond what the classes explain have a correlation, and a voter's weight in the
    posterior is one over the sum of its squared correlations with the voters that vote where it votes. Voters
    that all but copy each other weigh as one from the start, as EM would take their agreement for accuracy.
    start: first guess of the accuracies, the chance to be right where a voter votes."""
    n, m = votes.shape
    first = np.full(m, 0.8) if start is None else np.clip(start, 0.5, 0.995)
    if not n:
        return np.zeros(0), first, np.eye(m), np.ones(m)
    for_, against = (votes > 0).astype(float), (votes < 0).astype(float)
    cast = for_ + against
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    speaks = np.stack([np.log(first / (1 - first)), -np.log(first / (1 - first))])

    def correlations(rest):
        spread = np.sqrt((rest**2).mean(0))
        rest = np.where(spread > 1e-6, rest / np.maximum(spread, 1e-6), 0)
        out = rest.T @ rest / n
        np.fill_diagonal(out, 1.0)
        return out

    def posterior(weight):
        logit = np.log(prior / (1 - prior)) + for_ @ (weight * speaks[0]) + against @ (weight * speaks[1])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    shared = (cast.T @ cast + np.eye(m)) / (cast.sum(0) + 1)  # [j, i]: how often j votes where i does
    raw = correlations(votes - votes.mean(0))
    copies = 1 / (np.where(np.abs(raw) >= COPY, raw**2, 0) * shared).sum(0)
    q = np.full(n, prior)
    for _ in range(rounds):
        now = posterior(copies)
        moved, q = np.abs(now - q).max(), now
        rate = lambda v: np.log((q @ v + 0.1) / (q.sum() + 0.2)) - np.log(((1 - q) @ v + 0.1) / ((1 - q).sum() + 0.2))
        speaks = np.stack([np.clip(rate(for_), 0, MOST), np.clip(rate(against), -MOST, 0)])
        if moved < 1e-6:
            break
    mean = np.stack([((1 - q) @ votes) / max((1 - q).sum(), 1e-9), (q @ votes) / max(q.sum(), 1e-9)])
    together = correlations(votes - ((1 - q)[:, None] * mean[0] + q[:, None] * mean[1]))
    weight = 1 / (together**2 * shared).sum(0)
    accuracy = (q @ for_ + (1 - q) @ against + 1.6) / (cast.sum(0) + 2)
    return posterior(weight), accuracy, together, weight


def train_linear(row, feature, y, chosen, rounds: int = 800, decay: float = 3e-4) -> tuple:
    """(weights of the chosen features, bias) of a logistic regression on their presence; chosen is sorted and has
    all of feature."""
    r, c = row, np.searchsorted(chosen, feature)
    w, b, m, n = np.zeros(len(chosen)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), len(y), max(1, len(chosen))
    vw, vb = np.zeros(n), 0.0
    step = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], m) + b, -30, 30)))
        g = np.bincount(c, (p - y)[r], n) / np.sqrt(np.bincount(c, minlength=n) + 1) / np.sqrt(m) + decay * w
        vw, vb = 0.9 * vw - step * g, 0.9 * vb - step * float((p - y).mean())
        w, b = np.clip(w + vw, -6, 6), b + vb
    return w.astype(np.float32), b


def seed_features() -> np.ndarray:
    """The features of the seed lexicons' words (as words; their kind is 0)."""
    return np.unique((hash_words([s.encode() for s in SEEDS])[0] & np.uint64((1 << BITS) - 1)).astype(np.int64))


def _lexicons(described: DataFrame, folds: dict) -> tuple:
    """(for each fold the features that are telling over the rows of the other folds, features tested), from counts
    that Spark makes."""
    fold = F.col("fold")
    each = described.select("fold", "toxic", F.explode("features").alias("f")).where(f"f < {LENGTH << BITS}")
    sums = [F.count(F.when(fold == k, 1)).alias(f"n{k}") for k in range(FOLDS)] + [F.sum(F.when(fold == k, F.col("toxic"))).alias(f"y{k}") for k in range(FOLDS)]
    counts = materialise(each.groupBy("f").agg(*sums, F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y")).where("n >= 3").fillna(0), "counts")
    # Only features of which enough rows are toxic, in all folds or without one, reach the driver.
    enough = [f"y >= {LEAST_SHARE} * n", *(f"y - y{k} >= {LEAST_SHARE} * (n - n{k})" for k in range(FOLDS))]
    got = counts.where(f"y >= 3 and ({' or '.join(enough)})").toArrow()
    tested = counts.count()
    col = lambda c: got.column(c).to_numpy().astype(float)
    out = []
    for k in range(FOLDS):
        rows, toxic = (sum(v[i] for j, v in folds.items() if j != k) for i in (0, 1))
        some = np.flatnonzero(col("n") > col(f"n{k}"))
        keep = telling((col("y") - col(f"y{k}"))[some], (col("n") - col(f"n{k}"))[some], toxic / max(1, rows), tested)
        out.append(got.column("f").to_numpy()[some[keep]])
    discard(counts)
    return out, tested


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> tuple:
    """(features, their weights, bias) from at most `sample` labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    Documents are taken in the order of a hash of their ids; of several rows with an id the text of the smallest
    hash counts; copies of a text count once, as not toxic if one of them is, and near copies count once. Null ids and labels teach
    nothing. Without labelled rows of both kinds nothing is learned and all texts score alike.
    """
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    y = y.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers: small enough to send to all executors.
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")
    known = known.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text", "toxic")).alias("x"))
    known = known.groupBy("x.key").agg(F.min("x.toxic").alias("toxic"), F.min("x.text").alias("text"))
    schema = ", ".join([f"m{i} long" for i in range(MINIMA)]) + ", key long, toxic int, n long, fixed array<int>, features array<long>"
    all_rows = materialise(known.mapInArrow(_described(), schema), "described")
    left = all_rows.drop("fixed", "features")
    for i in range(MINIMA):  # near copies would make the words of one text look telling
        same = F.coalesce(F.col(f"m{i}"), F.col("key"))
        left = left.groupBy(same.alias("_m")).agg(F.min_by(F.struct(*left.columns), "key").alias("x")).select("x.*")
    described = all_rows.join(left.select("key"), "key", "left_semi").withColumn("fold", F.pmod(F.hash("key"), F.lit(FOLDS)))
    described = materialise(described, "described")
    discard(all_rows)
    folds = {r["fold"]: (r["n"], r["y"]) for r in described.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y")).collect()}
    rows, toxic = (sum(v[i] for v in folds.values()) for i in (0, 1))
    if not 0 < toxic < rows:
        discard(described)
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 3.0 if toxic else -3.0

    lexicons, tested = _lexicons(described, folds)
    spark = docs.sparkSession
    marks = [(k, int(f)) for k, lexicon in enumerate(lexicons) for f in lexicon] or [(0, -1)]
    marks = spark.createDataFrame(marks, "fold int, f long")
    hits = described.select("key", "fold", F.explode("features").alias("f")).join(marks, ["fold", "f"])
    hits = hits.groupBy("key").agg(F.collect_set(F.shiftright("f", BITS)).alias("kinds"), F.count(F.lit(1)).alias("hits"))
    got = described.select("key", "toxic", "n", "fixed").join(hits, "key", "left").orderBy("key")
    got = got.select("key", "toxic", "n", "fixed", F.coalesce("kinds", F.array().cast("array<int>")).alias("kinds"), F.coalesce("hits", F.lit(0)).alias("hits")).toArrow()
    key, kinds, share = got.column("key").to_numpy(), got.column("kinds").to_pylist(), got.column("hits").to_numpy() / np.maximum(got.column("n").to_numpy(), 1)
    found = np.array([[f in k for f in range(KINDS)] for k in kinds])
    fixed = np.array(got.column("fixed").to_pylist())
    nothing = ~found.any(1) & ~fixed.any(1)
    votes = np.column_stack([fixed, found, share >= DENSE, -(share < SPARSE).astype(int), -nothing.astype(int)]).astype(int)
    y = got.column("toxic").to_numpy()[:, None]
    start = (((votes > 0) & (y > 0)).sum(0) + ((votes < 0) & (y <= 0)).sum(0) + 1.6) / ((votes != 0).sum(0) + 2)
    posterior, *_ = label_model(votes, toxic / rows, start)

    told = spark.createDataFrame(pa.table({"key": key, "q": posterior}))
    each = described.select("key", F.explode("features").alias("f"))
    counts = each.join(told, "key").groupBy("f").agg(F.sum("q").alias("y"), F.count(F.lit(1)).alias("n")).where(f"y >= 2.5 and y >= {LEAST_SHARE} * n").toArrow()
    keep = telling(counts.column("y").to_numpy(), counts.column("n").to_numpy(), float(posterior.mean()), tested)
    of_length = np.arange(64) | (LENGTH << BITS)
    chosen = np.unique(np.concatenate([counts.column("f").to_numpy()[keep], seed_features(), of_length]))
    entries = each.join(spark.createDataFrame(pa.table({"f": chosen})), "f").toArrow()
    row, feature = np.searchsorted(key, entries.column("key").to_numpy()), entries.column("f").to_numpy()
    order = np.lexsort((feature, row))
    discard(described)
    weights, bias = train_linear(row[order], feature[order], posterior, chosen)
    return chosen, weights, bias


def _scored(model_bc):
    def run(batches):
        chosen, weights, bias = model_bc.value
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch):
                text, feature, _ = features(texts)
                place = np.searchsorted(chosen, feature)
                known = np.append(chosen, -1)[place] == feature
                sums = np.bincount(text[known], weights[place[known]], len(texts)) + bias
                yield pa.record_batch([ids.slice(at, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted (score >= threshold).

    Only the text makes a score; null and empty texts get that of no words. Repeated rows score alike;
    null ids stay, with held_out false. Other columns are left out.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bc = spark.sparkContext.broadcast(model)
    x = docs.select("doc_id", "text").mapInArrow(_scored(bc), f"doc_id {id_type}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return x.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
