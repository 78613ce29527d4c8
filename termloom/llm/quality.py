"""Quality rules: a learned decision list over per-document statistics, as one Spark conditional.

Sequential covering: grow a conjunction of thresholds on part of the labelled rows by the gain in
precision it brings, prune it on the rest, take out the rows it covers, repeat. Only counts per feature
and bin reach the driver; their number depends on the parameters alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table, words

SYMBOLS = "[#*$%&|<>]"
#: Labelled ids that the list is learned from at most, in the order of a hash.
LABELLED = 50_000
#: Base rules of the contract.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct")
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the columns COUNTS (columns of docs with these names are replaced). Null and empty
    texts count 0 throughout; rows are independent, so null ids, ties and repeated rows need no rule, and an empty
    table stays empty. Very long texts are counted whole, in one row.

    n_repeat_words counts the words in 3-word windows that a text holds twice or more. Only texts with
    fewer distinct windows than windows go further: there each window becomes one long, its hash above and
    its place below, so that one sort of longs brings equal windows together. A text of n words leaves
    64 - log2(n) bits of hash.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    count = lambda chars: (F.size(F.split(whole, chars, -1)) - 1).cast("long")
    at = lambda i: F.get(F.col("_h"), i)
    none = F.array().cast("array<bigint>")
    x = docs.withColumn("_w", words(F.col(text)))
    x = x.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    x = x.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": count(SYMBOLS),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_upper": count("[A-Z]"),
        "n_digits": count("[0-9]"),
        "_h": F.transform("_w", lambda s: F.xxhash64(s)),
    }).drop("_w", "_lines", text)
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    x = x.withColumn("_win", F.when(F.size("_h") > 3, windows).otherwise(none))
    x = x.withColumns({
        "n_distinct": F.size(F.array_distinct("_h")).cast("long"),
        "_low": F.pow(F.lit(2.0), F.char_length(F.bin("n_words"))).cast("long") - 1,
        "_again": F.size(F.array_distinct("_win")) < F.size("_win"),
    }).drop("_h")
    x = x.withColumn("_high", F.bitwise_not("_low"))
    packed = F.transform("_win", lambda h, i: h.bitwiseAND(F.col("_high")).bitwiseOR(i.cast("long")))
    x = x.withColumn("_win", F.when(F.col("_again"), F.sort_array(packed)).otherwise(none))
    top = lambda v: v.bitwiseAND(F.col("_high"))
    same = lambda v, i: F.coalesce(top(v) == top(F.get(F.col("_win"), i)), F.lit(False))
    hits = F.filter("_win", lambda v, i: same(v, i + 1) | same(v, i - 1))
    x = x.withColumn("_hits", F.sort_array(F.transform(hits, lambda v: v.bitwiseAND(F.col("_low"))))).drop("_win")
    three = F.lit(3).cast("long")
    covered = F.transform("_hits", lambda p, i: F.least(three, F.coalesce(F.get(F.col("_hits"), i + 1) - p, three)))
    x = x.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b))
    return x.drop("_hits", "_low", "_high", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


class Condition(tuple):
    """(feature, is_upper, threshold): feature > threshold if is_upper, else feature <= threshold."""

    def holds(self) -> Column:
        name, upper, threshold = self
        return feature(name) > threshold if upper else feature(name) <= threshold


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.holds()
    return out


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, _q): the label of at most `most` ids; of several labels of one id the smallest counts, nulls don't."""
    y = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(
    measured: DataFrame, labels: DataFrame, bins: int = 24, most_rules: int = 6, most_conditions: int = 3,
    least_rows: int = 8, least_precision: float = 0.9,
) -> list:
    """A decision list for quality 0, as a list of conjunctions, from measured rows with labels.

    Rows without a label, with a null label or doc_id teach nothing; of several labels of one doc_id the
    smallest counts; LABELLED ids teach at most. Without labelled rows of both kinds the list is empty. Rows that fail the base rules
    are left out: the list is only asked about the others.
    """
    names = list(FEATURES)
    x = measured.where(~base_failed()).join(labelled(labels), "doc_id")
    x = x.select(
        (F.col("_q") == 0).cast("int").alias("_bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("_grow"),
        *{c for f in FEATURES.values() for c in f},
    )
    x = materialise(x, "quality")
    grid = [i / bins for i in range(1, bins)]
    row = x.agg(*[F.percentile_approx(feature(n), grid, 1000).alias(n) for n in names], F.sum("_bad").alias("_bad"), F.count(F.lit(1)).alias("_n")).first()
    if not row["_bad"] or row["_bad"] == row["_n"]:
        discard(x)
        return []
    cuts = {n: sorted({float(v) for v in row[n]}) for n in names}

    def tally(rows: DataFrame) -> dict:
        """feature -> per interval between its cuts: (bad rows, rows)."""
        place = lambda n: F.aggregate(F.array(*map(F.lit, cuts[n])), F.lit(0), lambda a, c: a + (F.col(n) > c).cast("int"))
        wide = rows.select("_bad", *[feature(n).alias(n) for n in names])
        long = wide.select("_bad", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), place(n).alias("b")) for n in names])).alias("c"))
        got = long.groupBy("c.f", "c.b").agg(F.sum("_bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
        out = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for r in got:
            out[r["f"]][r["b"]] = [r["bad"], r["n"]]
        return out

    def best(rows: DataFrame) -> tuple | None:
        """The condition of the highest information gain over the rows' own precision."""
        found, counts = None, tally(rows)
        for name in names:
            total = [sum(v[i] for v in counts[name]) for i in (0, 1)]
            if not total[0]:
                return None
            below = [0, 0]
            for cut, (bad, n) in zip(cuts[name], counts[name], strict=False):
                below = [below[0] + bad, below[1] + n]
                for upper, (b, m) in ((False, below), (True, (total[0] - below[0], total[1] - below[1]))):
                    if b and m < total[1]:
                        gain = b * (math.log2((b + 1) / (m + 2)) - math.log2((total[0] + 1) / (total[1] + 2)))
                        if found is None or gain > found[0]:
                            found = (gain, Condition((name, upper, cut)), b, m)
        return found

    rules, grow, prune = [], x.where("_grow"), x.where("not _grow")
    for _ in range(most_rules):
        conditions, rows = [], grow
        while len(conditions) < most_conditions:
            got = best(rows)
            if got is None or got[0] <= 0:
                break
            conditions.append(got[1])
            rows = rows.where(got[1].holds())
            if got[2] == got[3]:
                break
        if not conditions:
            break
        shorter = [conditions[: i + 1] for i in range(len(conditions))]
        sums = [F.sum(F.when(_all(c), v)).alias(f"{k}{i}") for i, c in enumerate(shorter) for k, v in (("b", F.col("_bad")), ("n", F.lit(1)))]
        on_prune, on_grow = prune.agg(*sums).first(), grow.agg(*sums).first()
        worth = lambda r, i: ((r[f"b{i}"] or 0) + 0.5) / ((r[f"n{i}"] or 0) + 1)
        keep = max(range(len(shorter)), key=lambda i: (worth(on_prune, i), -i))
        rows_of = lambda r: (r[f"b{keep}"] or 0, r[f"n{keep}"] or 0)
        (b1, n1), (b2, n2) = rows_of(on_grow), rows_of(on_prune)
        if n1 + n2 < least_rows or b1 + b2 < least_precision * (n1 + n2) or b2 < least_precision * n2:
            break
        rules.append(shorter[keep])
        grow, prune = grow.where(~_all(shorter[keep])), prune.where(~_all(shorter[keep]))
    discard(x)
    return rules


def verdict(rules: list) -> Column:
    """The number of the first rule of the list that rejects a row, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for i, conditions in enumerate(rules):
        out = out.when(_all(conditions), F.lit(i + 1))
    return out


def op2_quality(spark, sf_dir):
    """Per row of documents: its counts, base_failed, kept and rejected_by, the number of the rule that rejects it."""
    measured = materialise(measure(table(spark, sf_dir, "documents").select("doc_id", "text")), "measured")
    rules = learn(measured, table(spark, sf_dir, "labels"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules).isNull()).alias("kept"),
        F.when(~base_failed(), verdict(rules)).alias("rejected_by"),
    )


def stage(spark, docs, sf_dir):
    """Documents that neither the base rules nor the learned list reject, row by row: null, empty and short texts
    go, whatever their id; repeated rows stay or go together; no rows give no rows; other columns are carried along,
    whatever their names."""
    labels = table(spark, sf_dir, "labels")
    # At most LABELLED ids: small enough to send to all executors. Only their documents are measured twice.
    known = docs.select("doc_id", "text").join(F.broadcast(labelled(labels).select("doc_id")), "doc_id", "left_semi")
    known = materialise(measure(known), "measured")
    rules = learn(known, labels)
    discard(known)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    # A filter on these counts would be pushed below them, each written out in full wherever it is used. Spark moves no
    # filter below a projection that is not deterministic, and rand() >= 0 holds for every row.
    counted = measure(whole, "_text").withColumn("_hold", F.rand(0))
    return counted.where(~base_failed() & verdict(rules).isNull() & (F.col("_hold") >= 0)).select("_row.*")
