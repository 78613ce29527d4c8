"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks.

1. Weights. The document frequency of every word over all 32-word blocks of the corpus gives TF-IDF weights;
   they have a floor, so that no word counts nothing.
2. Space. Benchmark items are dealt to pieces of at most 128 and, for long items, of bounded words. Every
   piece's TF-IDF passages are factored by a randomised SVD (seeded Gaussian sketch, one power iteration,
   QR, small SVD); pieces are factored side by side on the executors, and nothing of it meets on the driver.
   A piece has as many dimensions as its passages need, so a benchmark of any size has spaces that hold it:
   one space of fixed rank loses more copies the larger the benchmark grows.
3. Candidates. Every window of every document is projected into each piece's space and compared with its
   items. The least inner product that a hit can have follows from the item's weights (a window that holds 60 %
   of an item's words has at least its 60 % lightest), and what a space cuts off is allowed for by the
   Cauchy-Schwarz bound. The cosine threshold is therefore one per item and window, and loses no hit.
4. Checks. The longest common subsequence with the item and with its answer decides, which also finds
   paraphrases. Items of fewer than 8 words must stand word for word: two or three words in order say nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .common import discard, hash_words, materialise, slices, table
from .licences import normal_words

#: Words of a block (a window is two blocks, and is checked with an item's length more on either side).
BLOCK = 32
#: Share of the item's words, in order, in a hit; the same where the answer holds too.
SUBSEQUENCE, WITH_ANSWER, ANSWER = 0.75, 0.6, 0.6
#: Items of fewer words must stand word for word.
SHORT = 8
#: Items and words of a piece at most (a longer item is a piece of its own), and items of one pass over the corpus.
PIECE_ITEMS, PIECE_WORDS, ITEMS_AT_ONCE = 128, 8192, 1024
#: Part of the least mass that an item's lightest words make up, which are taken to stand in any window.
GIVEN = 0.6
#: Windows that are compared at once, and distinct words that a counting task holds back.
WINDOWS_AT_ONCE, HELD = 4096, 1 << 20


def normal(texts: list) -> list:
    return [b" ".join(normal_words(t)) for t in texts]


def blocks_of(texts: list, block: int) -> tuple:
    """(word hashes, block number of each word, text number of each block, first word of each block)."""
    h, off, *_ = hash_words(texts)
    n = np.diff(off)
    word = np.arange(len(h)) - np.repeat(off[:-1], n)
    per = -(-n // block)
    first = np.concatenate(([0], np.cumsum(per)))
    number = np.repeat(first[:-1], n) + word // block
    text = np.repeat(np.arange(len(texts)), per)
    start = (np.arange(first[-1]) - first[text]) * block
    return h, number, text, start


def item_of(item_id, text: bytes) -> dict:
    """An item's words, their hashes, and its answer (its last sentence, 3 words at least)."""
    words = normal([text])[0].split()
    last = [p for p in (normal([s])[0].split() for s in text.replace(b"?", b".").replace(b"!", b".").replace(b"\n", b".").split(b".")) if len(p) >= 3]
    return {"item_id": item_id, "words": words, "answer": last[-1] if last else words, "hashes": hash_words([b" ".join(words)])[0]}


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence of words, by bit-parallel rows."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def verdict(item: dict, words: list) -> tuple:
    """(is a hit, share of the item's words in order, share of the answer's, 0 where no answer could help)."""
    if len(item["words"]) < SHORT:
        found = b" %b " % b" ".join(item["words"]) in b" %b " % b" ".join(words)
        return found, float(found), float(found)
    share = common_subsequence(item["words"], words) / max(1, len(item["words"]))
    if share < WITH_ANSWER:
        return False, share, 0.0
    answer = common_subsequence(item["answer"], words) / max(1, len(item["answer"]))
    return share >= SUBSEQUENCE or (share >= WITH_ANSWER and answer >= ANSWER), share, answer


# --- 1: weights -----------------------------------------------------------------------------------


def _frequencies(block: int):
    def run(batches):
        held, size = [], 0

        def merged():
            word = np.concatenate([w for w, _ in held])
            word, at = np.unique(word, return_inverse=True)
            return word, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(word, n):
            return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            total = 0
            for _, texts in slices(batch):
                h, number, text, _ = blocks_of(normal(texts), block)
                total += len(text)
                word, at = np.unique(h, return_inverse=True)
                each = np.unique(at * max(1, len(text)) + number) // max(1, len(text))
                held.append((word, np.bincount(each, minlength=len(word)).astype(np.int64)))
                size += len(word)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield rows(*held.pop())
                        size = 0
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])
        if held:
            yield rows(*merged())

    return run


def _parsed():
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch):
                items = [item_of(None, t) for t in texts]
                h = [np.unique(x["hashes"], return_counts=True) for x in items]
                yield pa.record_batch(
                    [
                        batch.column("item_id").slice(at, len(texts)), pa.array([len(x["words"]) for x in items], pa.int64()),
                        pa.array([b" ".join(x["words"]) for x in items], pa.binary()), pa.array([b" ".join(x["answer"]) for x in items], pa.binary()),
                        pa.array([w.view(np.int64) for w, _ in h], pa.list_(pa.int64())), pa.array([n.astype(np.int64) for _, n in h], pa.list_(pa.int64())),
                    ],
                    ["item_id", "n", "words", "answer", "hashes", "times"],
                )

    return run


# --- 2: spaces ------------------------------------------------------------------------------------


def randomised_svd(a: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Orthonormal columns (words x dimensions) that span the rows of a, up to a relative 1e-5, `rank` at most."""
    rank = min(rank, *a.shape)
    y = a.T @ np.random.default_rng(seed).standard_normal((a.shape[0], rank))
    q, _ = np.linalg.qr(a.T @ (a @ np.linalg.qr(y)[0]))
    _, s, w = np.linalg.svd(a @ q, full_matrices=False)
    return q @ w[s > 1e-5 * max(s[0], 1e-30)].T


def least_mass(weight: np.ndarray, times: np.ndarray, n: int) -> float:
    """The least weight of an item's words that a window with a hit holds."""
    miss = 0 if n < SHORT else int(n * (1 - WITH_ANSWER) + 1e-6)
    order = np.argsort(weight, kind="stable")
    upto = np.cumsum(times[order])
    held = np.clip(upto[-1] - miss - (upto - times[order]), 0, times[order])
    return float((held * weight[order]).sum())


def taken_as_held(item: np.ndarray, word: np.ndarray, mass: np.ndarray, weight: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which words a search need not look for, as any window may be taken to hold them: words that are light
    enough in all items that have them, GIVEN of an item's need together. item, word: of each entry."""
    order = np.lexsort((weight[word], item))
    upto = np.cumsum(mass[order])
    start = np.flatnonzero(np.concatenate(([True], np.diff(item[order]) != 0)))
    upto -= np.repeat(upto[start] - mass[order][start], np.diff(np.append(start, len(order))))
    light = np.empty(len(order), np.bool_)
    light[order] = upto <= GIVEN * need[item[order]]
    return np.bincount(word, ~light) == 0


def _fitted(rank: int):
    def run(rows: pa.Table) -> pa.Table:
        times, weight, n = (rows.column(c).to_numpy() for c in ("times", "weight", "n"))
        numbers, i = np.unique(rows.column("no").to_numpy(), return_inverse=True)
        words, j = np.unique(rows.column("word").to_numpy().view(np.uint64), return_inverse=True)
        each = np.zeros(len(words))
        each[j] = weight
        need = np.array([least_mass(weight[i == k], times[i == k], int(n[i == k][0])) for k in range(len(numbers))])
        held = taken_as_held(i, j, times * weight, each, need)
        need -= np.bincount(i, times * weight * held[j], len(numbers))
        a = np.zeros((len(numbers), len(words)))
        a[i, j] = times * np.sqrt(weight)
        a, words, each = a[:, ~held], words[~held], each[~held]
        basis = randomised_svd(a, rank, int(numbers[0]))
        at = a @ basis
        rest = np.sqrt(np.maximum((a**2).sum(1) - (at**2).sum(1), 0))
        return pa.table({
            "piece": [rows.column("piece")[0].as_py()], "longest": pa.array([int(n.max())], pa.int64()),
            "numbers": pa.array([numbers.tolist()], pa.list_(pa.int64())), "words": [words.tobytes()], "weights": [each.astype(np.float32).tobytes()],
            "basis": [(basis * np.sqrt(each)[:, None]).astype(np.float32).tobytes()], "at": [at.astype(np.float32).tobytes()],
            "rest": [rest.astype(np.float32).tobytes()], "need": [need.astype(np.float32).tobytes()],
        })

    return run


def spaces(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, piece_items: int = PIECE_ITEMS) -> tuple:
    """(items, pieces), both written to scratch: items (no, item_id, n, words, answer, piece) with numbers from 0,
    and a row for each piece with its words, their weights, its basis, and its items' places in the space."""
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    known = benchmark.where("text is not null").select("item_id", "text")
    items = known.mapInArrow(_parsed(), f"item_id {id_type}, n long, words binary, answer binary, hashes array<long>, times array<long>")
    # Items of a class are about as long as each other; its pieces hold as many as PIECE_WORDS allows.
    items = items.where("n > 0").withColumn("class", F.ceil(F.col("n") / 64))
    items = numbered(items, [F.col("class"), F.col("n"), F.xxhash64("words"), F.col("item_id")], "no", 0)
    first = items.groupBy("class").agg(F.min("no").alias("_first"))
    per = F.greatest(F.lit(1), F.least(F.lit(piece_items), F.floor(F.lit(PIECE_WORDS) / (64 * F.col("class")))))
    named = items.join(first, "class").withColumn("_k", F.floor((F.col("no") - F.col("_first")) / per))
    pieces = numbered(named.select("class", "_k").distinct(), [F.col("class"), F.col("_k")], "piece", 0)
    sorted_items, items = items, materialise(named.join(pieces, ["class", "_k"]).drop("class", "_k", "_first"), "items")
    discard(sorted_items, pieces)

    seen = docs.select("text").mapInArrow(_frequencies(block), "word long, n long").groupBy("word").agg(F.sum("n").alias("df"))
    rows = items.select("no", "piece", "n", F.explode(F.arrays_zip(F.col("hashes").alias("word"), F.col("times").alias("times"))).alias("e")).select("no", "piece", "n", "e.word", "e.times")
    # The row without a word has the number of blocks.
    wanted = rows.select(F.col("word").alias("_w")).unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("_w"))).distinct()
    seen = materialise(seen.join(wanted, F.col("word").eqNullSafe(F.col("_w")), "left_semi"), "frequencies")
    blocks = F.lit(seen.where("word is null").agg(F.sum("df")).first()[0] or 0)
    weight = F.log(1 + blocks / (1 + F.coalesce("df", F.lit(0))))
    # A corpus without blocks has no hits; its weights only have to be above 0.
    rows = rows.join(seen.where("word is not null"), "word", "left").withColumn("weight", F.greatest(weight, F.lit(0.01)))
    schema = "piece long, longest long, numbers array<long>, words binary, weights binary, basis binary, at binary, rest binary, need binary"
    fitted = rows.select("piece", "no", "n", "word", "times", "weight").groupBy("piece").applyInArrow(_fitted(piece_items), schema)
    fitted = materialise(fitted, "spaces")
    discard(seen)
    return items, fitted


# --- 3 and 4: candidates and checks ---------------------------------------------------------------


class Space:
    """One piece: its space, and the (window, item) pairs whose cosine reaches the item's threshold."""

    def __init__(self, row: dict, items: dict, block: int):
        array = lambda c: np.frombuffer(row[c], np.float32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.weights, self.rest, self.need = array("weights"), array("rest"), array("need") * np.float32(1 - 1e-3)
        self.basis = array("basis").reshape(len(self.words), -1)
        self.at = np.ascontiguousarray(array("at").reshape(len(self.rest), -1).T)
        self.items = [items[no] for no in row["numbers"]]
        self.reach = -(-row["longest"] // block)

    def pairs(self, row, block, before, first, last, n):
        """(window, item) arrays, part by part. row, block, before: this piece's words by place, with the block
        before in which the text has the word (far below 0 without); n: all blocks; first, last: of each block's text."""
        far = self.reach
        # A word counts once in each window around its block: less those that its block before has reached.
        low = np.maximum(np.maximum(block - 1 - far, first[block]), np.where(before < 0, -1, before + far + 1))
        high = np.minimum(block + far, last[block]) + 1
        some = low < high
        row, low, high = row[some], low[some], high[some]
        order = np.argsort(low, kind="stable")
        row, low, high = row[order], low[order], high[order]
        for a in range(0, n, WINDOWS_AT_ONCE):
            b = min(n, a + WINDOWS_AT_ONCE)
            i, j = np.searchsorted(low, (a - 2 * far - 2, b))
            r, up, down = row[i:j], np.maximum(low[i:j], a) - a, np.minimum(high[i:j], b) - a
            r, up, down = (x[down > 0] for x in (r, up, down))
            if not len(r):
                continue
            step = np.zeros((b - a + 1, self.basis.shape[1]), np.float32)
            mass = np.bincount(up, self.weights[r], b - a + 1) - np.bincount(down, self.weights[r], b - a + 1)
            back = np.argsort(down, kind="stable")
            for place, rows, sign in ((up, r, 1), (down[back], r[back], -1)):
                head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                step[place[head]] += sign * np.add.reduceat(self.basis[rows], head, axis=0)
            near = np.cumsum(step[:-1], axis=0) @ self.at
            near += np.sqrt(np.maximum(np.cumsum(mass[:-1]), 0)).astype(np.float32)[:, None] * self.rest
            window, item = np.nonzero(near >= self.need)
            if len(window):
                yield window + a, item


class Search:
    """All pieces of one pass over the corpus."""

    def __init__(self, fitted: list, items: list, block: int):
        known = {x["no"]: x | {"words": x["words"].split(), "answer": x["answer"].split()} for x in items}
        self.block, self.spaces = block, [Space(r, known, block) for r in fitted]
        self.words = np.unique(np.concatenate([s.words for s in self.spaces]))
        self.rows = []
        for s in self.spaces:
            at = np.full(len(self.words), -1)
            at[np.searchsorted(self.words, s.words)] = np.arange(len(s.words))
            self.rows.append(at)

    def of(self, texts: list) -> dict:
        """(text number, item number) -> (share, share of the answer) of the best hit."""
        block, texts = self.block, normal(texts)
        h, number, text, start = blocks_of(texts, block)
        n, found, split = len(text), {}, {}
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        own = self.words[at] == h
        word, place = np.divmod(np.unique(at[own] * n + number[own]), n)
        if not len(word):
            return found
        first, last = np.searchsorted(text, text), np.searchsorted(text, text, "right") - 1
        again = (word[1:] == word[:-1]) & (first[place[1:]] == first[place[:-1]])
        before = np.concatenate(([-n * 4 - 9], np.where(again, place[:-1], -n * 4 - 9)))
        for space, rows in zip(self.spaces, self.rows, strict=True):
            row = rows[word]
            mine = row >= 0
            for window, of in space.pairs(row[mine], place[mine], before[mine], first, last, n):
                for w, p in zip(window.tolist(), of.tolist(), strict=True):
                    item, t = space.items[p], int(text[w])
                    best = found.get((t, item["no"]), (0.0, 0.0))
                    if best[0] + best[1] == 2.0:
                        continue
                    if t not in split:
                        split[t] = texts[t].split()
                    a, size = int(start[w]), len(item["words"])
                    words = split[t][max(0, a - size) : a + 2 * block + size]
                    have = set(words)
                    if sum(x in have for x in item["words"]) < (size if size < SHORT else WITH_ANSWER * size - 1e-6):
                        continue
                    ok, *share = verdict(item, words)
                    if ok and best < tuple(share):
                        found[t, item["no"]] = tuple(share)
        return found


def _listed(search_bc):
    def run(batches):
        search = Search(*search_bc.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch):
                if found := search.of(texts):
                    cols = [pa.array(c) for c in zip(*((at + t, no, s, a) for (t, no), (s, a) in found.items()), strict=True)]
                    yield pa.record_batch([ids.take(cols[0]), *cols[1:]], ["doc_id", "no", "overlap", "answer_overlap"])

    return run


def _cleaned(search_bc):
    def run(batches):
        search = Search(*search_bc.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, np.bool_)
            for at, texts in slices(batch):
                clean[[at + t for t, _ in search.of(texts)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _passes(docs: DataFrame, benchmark: DataFrame, block: int, at_once: int):
    """(items, a broadcast search for each pass): a pass holds at most at_once items, so its broadcast is of
    bounded size (a longer item than PIECE_WORDS counts with its words)."""
    spark, size = docs.sparkSession, min(PIECE_ITEMS, at_once)
    items, fitted = spaces(docs, benchmark, block, size)
    at_a_time = max(1, at_once // size)
    n = items.agg(F.max("piece")).first()[0]

    def searches():
        for a in range(0, 0 if n is None else n + 1, at_a_time):
            here = F.col("piece").between(a, a + at_a_time - 1)
            rows = [r.asDict() for r in fitted.where(here).orderBy("piece").toLocalIterator()]
            known = [r.asDict() for r in items.where(here).select("no", "words", "answer").toLocalIterator()]
            yield spark.sparkContext.broadcast((rows, known, block))

    return items, fitted, searches()


def contaminated(docs: DataFrame, benchmark: DataFrame, block=BLOCK, at_once=ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap) of documents that hold a benchmark item, or most of it in order.

    Null and blank texts and items have no words and match nothing; an empty table of either gives no rows.
    A document that holds an item at several places gives one row for it, with the best; repeated rows give
    their row each; equal items are found each. Ids may be of any type, and null ids show as null. Texts of
    any length are searched whole, some thousand windows at a time. Other columns are left out. The corpus is read
    once for the weights and once for every at_once items; each pass is written to scratch before the next.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    items, fitted, searches = _passes(docs, benchmark, block, at_once)
    schema = f"doc_id {id_type}, no long, overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for search in searches:
        out = out.unionByName(materialise(docs.mapInArrow(_listed(search), schema), "hits"))
        search.destroy()
    discard(fitted)
    return out.join(items.select("no", "item_id"), "no").select("doc_id", "item_id", "overlap", "answer_overlap")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block=BLOCK, at_once=ITEMS_AT_ONCE) -> DataFrame:
    """docs, all columns, without the rows whose text holds a benchmark item. Each row is judged by its own
    text: ids may be null or shared, and repeated rows go or stay together. Null and blank texts stay."""
    items, fitted, searches = _passes(docs, benchmark, block, at_once)
    left = docs
    for i, search in enumerate(searches):
        if i:  # what an earlier pass left is written before the next, so that its broadcast can go
            written = materialise(left, "clean")
            discard(left)
            left, _ = written, before.destroy()
        left, before = left.mapInArrow(_cleaned(search), docs.schema), search
    discard(items, fitted)
    return left


def op3_decontaminate(spark, sf_dir):
    """contaminated() of all documents and benchmark items: one row per hit."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs, sf_dir):
    """docs without the rows that hold a benchmark item, judged row by row: see decontaminate()."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
