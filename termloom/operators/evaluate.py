"""Pairwise evaluation, threshold search, error classes and annotation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LABELS, MATCH, NON_MATCH, UNCERTAIN

_METRICS = ("precision", "recall", "f1", "coverage", "uncertain_rate", "three_way_acc")


def binary_metrics(pairs: DataFrame, by: list, gold: str = "gold_label", predicted: str = "predicted") -> DataFrame:
    """Per group: n, precision, recall, f1, coverage, uncertain_rate, three_way_acc, rounded to 4 places.
    Abstaining on a gold match is a miss; gold uncertain counts neither way; a share without a base is 0."""
    g, p = F.col(gold), F.col(predicted)
    x = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(g == p).alias("same"), F.count_if(p == UNCERTAIN).alias("unsure"),
        F.count_if((g == MATCH) & (p == MATCH)).alias("tp"), F.count_if((g == NON_MATCH) & (p == MATCH)).alias("fp"),
        F.count_if((g == MATCH) & (p != MATCH)).alias("fn"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    decided = F.col("n") > F.col("unsure")
    x = x.withColumn("precision", F.when(decided, share(F.col("tp"), F.col("tp") + F.col("fp"))).otherwise(0.0))
    x = x.withColumn("recall", F.when(decided, share(F.col("tp"), F.col("tp") + F.col("fn"))).otherwise(0.0))
    x = x.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    x = x.withColumn("uncertain_rate", share(F.col("unsure"), F.col("n"))).withColumn("coverage", 1 - F.col("uncertain_rate"))
    x = x.withColumn("three_way_acc", share(F.col("same"), F.col("n")))
    return x.select(*by, "n", *[F.round(m, 4).alias(m) for m in _METRICS])


def decide(score, threshold):
    return F.when(score >= threshold, F.lit(MATCH)).otherwise(F.lit(NON_MATCH))


def grid(spark, low: int, high: int, step: int = 1) -> DataFrame:
    """Thresholds low/100 ... high/100."""
    return spark.range(low, high + 1, step, 1).select((F.col("id") / 100).alias("threshold"))


def sweep(scored: DataFrame, thresholds: DataFrame, score: str = "score") -> DataFrame:
    """Metrics at each threshold, each pair scored once."""
    x = scored.crossJoin(F.broadcast(thresholds))  # a grid of fixed size
    return binary_metrics(x.withColumn("predicted", decide(F.col(score), F.col("threshold"))), ["threshold"])


def best_threshold(swept: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """The row of the highest F1, the lowest threshold among equals, with the coverage asked for."""
    return swept.where(F.col("coverage") >= least_coverage).orderBy(F.desc("f1"), "threshold").limit(1)


def by_method(wide: DataFrame, methods: list, gold: str = "gold_label") -> DataFrame:
    """Metrics per method of a wide table of predictions."""
    long = wide.unpivot(["pair_id", gold], methods, "method", "predicted")
    return binary_metrics(long, ["method"], gold)


def versus(metrics: DataFrame, baseline: str, key: str = "method") -> DataFrame:
    """metrics with delta_f1 against one method's row."""
    base = metrics.where(F.col(key) == baseline).select(F.col("f1").alias("_f1"))
    return metrics.crossJoin(F.broadcast(base)).withColumn("delta_f1", F.round(F.col("f1") - F.col("_f1"), 4)).drop("_f1")  # one row


def error_class(gold, predicted):
    g, p = F.col(gold), F.col(predicted)
    rules = (
        ((g == MATCH) & (p == MATCH), "TP"), ((g == NON_MATCH) & (p == NON_MATCH), "TN"), ((g == NON_MATCH) & (p == MATCH), "FP"),
        ((g == MATCH) & (p == NON_MATCH), "FN"), ((g == UNCERTAIN) & (p == UNCERTAIN), "Correct_Abstention"),
        ((g != UNCERTAIN) & (p == UNCERTAIN), "Incorrect_Abstention"), ((g == UNCERTAIN) & (p != UNCERTAIN), "Missed_Abstention"),
    )
    out = F.lit("Other")
    for when, name in reversed(rules):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out


def examples(classified: DataFrame, category: str, key: str, n: int = 3) -> DataFrame:
    return classified.withColumn("_at", F.row_number().over(W.partitionBy(category).orderBy(key))).where(F.col("_at") <= n).drop("_at")


def kappa(pairs: DataFrame, a: str, b: str, by: list | None = None) -> DataFrame:
    """Per group: n_pairs, n_agree, pct_agreement, cohen_kappa, over the pairs that both sides give one of LABELS;
    kappa is null where chance alone agrees always. invalid_labels() has what falls out."""
    by = by or []
    x, y = F.col(a), F.col(b)
    pairs = pairs.where(x.isin(*LABELS) & y.isin(*LABELS))
    sides = [F.count_if(c == v).alias(f"{k}{i}") for k, c in (("a", x), ("b", y)) for i, v in enumerate(LABELS)]
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(x == y).alias("n_agree"), *sides)
    n = F.col("n_pairs").cast("double")
    po = F.try_divide(F.col("n_agree"), n)
    pe = F.try_divide(sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(1, 3)), F.col("a0") * F.col("b0")), n * n)
    return g.select(*by, "n_pairs", "n_agree", (po * 100).alias("pct_agreement"), F.when(pe != 1, F.try_divide(po - pe, 1 - pe)).alias("cohen_kappa"))


def invalid_labels(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, and how many have no valid label on either side or on one."""
    bad = lambda c: ~F.coalesce(F.col(c).isin(*LABELS), F.lit(False))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(bad(a)).alias("n_invalid_a"), F.count_if(bad(b)).alias("n_invalid_b"), F.count_if(bad(a) | bad(b)).alias("n_left_out"))


def assembled(pairs: DataFrame, first: DataFrame, second: DataFrame, adjudicated: DataFrame, key: str = "pair_id") -> DataFrame:
    """pairs with gold_label and agreement_status: the two annotators' labels, where they have the pair, and the
    adjudicator's, where there is one, joined on the key (tables of (key, label))."""
    x = pairs
    for i, side in enumerate((first, second, adjudicated)):
        x = x.join(side.select(key, F.col("label").alias(f"_l{i}")).dropDuplicates([key]), key, "left")
    label, status = gold("_l0", "_l1", "_l2")
    return x.withColumn("gold_label", label).withColumn("agreement_status", status).drop("_l0", "_l1", "_l2")


def kappa_by(pairs: DataFrame, a: str, b: str, stratum: str, strata: DataFrame) -> DataFrame:
    """kappa per stratum, strata without pairs included."""
    return strata.select(stratum).join(kappa(pairs, a, b, [stratum]), stratum, "left").fillna(0, ["n_pairs", "n_agree"])


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows and columns in the order of LABELS, zeros filled."""
    labels = pairs.sparkSession.createDataFrame([(x,) for x in LABELS], f"{a} string")
    got = pairs.groupBy(a).pivot(b, list(LABELS)).agg(F.count(F.lit(1)))
    return labels.join(got, a, "left").fillna(0)


def disagreements(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of different labels, with empty columns for the adjudicator."""
    return pairs.where(~F.col(a).eqNullSafe(F.col(b))).withColumn("adjudicator_label", F.lit("")).withColumn("adjudicator_notes", F.lit(""))


def label_distribution(pairs: DataFrame, label: str) -> DataFrame:
    """(label, n) with zeros filled."""
    all_ = pairs.sparkSession.createDataFrame([(x,) for x in LABELS], f"{label} string")
    got = pairs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return all_.join(got, label, "left").fillna(0, ["n"])


def status_counts(assigned: DataFrame, status: str = "agreement_status") -> DataFrame:
    return assigned.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def gold(first: str, second: str, adjudicated: str) -> tuple:
    """(gold_label, agreement_status) columns: an agreed valid label, else a valid adjudication, else uncertain."""
    a, b, c = F.col(first), F.col(second), F.col(adjudicated)
    valid = lambda x: x.isin(*LABELS)
    label = F.when((a == b) & valid(a), a).when(valid(c), c).otherwise(F.lit(UNCERTAIN))
    status = F.when((a == b) & valid(a), F.lit("agreed")).when(valid(c), F.lit("adjudicated")).otherwise(F.lit("unresolved"))
    return label, status


def crosstab(pairs: DataFrame, stratum: str, label: str) -> DataFrame:
    """Counts per stratum and label, pct_match, and a row TOTAL, in one rollup."""
    x = pairs.rollup(stratum).agg(*[F.count_if(F.col(label) == v).alias(v) for v in LABELS], F.count(F.lit(1)).alias("total"), F.grouping(stratum).alias("_all"))
    name = F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col(stratum))
    return x.select(name.alias(stratum), *LABELS, "total", F.round(100.0 * F.col(MATCH) / F.col("total"), 2).alias("pct_match"))


# --- samples and splits ------------------------------------------------------------------------------


def hash_rank(key: list, by: list, seed: str):
    """Rank inside each group in an order that depends on seed and key alone, the same on any engine."""
    return F.row_number().over(W.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256), *key))


def stratified_sample(rows: DataFrame, targets: DataFrame, stratum: str, key: list, seed: str = "42") -> DataFrame:
    """target rows of each stratum (stratum, target), all of a shorter one."""
    x = rows.join(F.broadcast(targets), stratum).withColumn("_at", hash_rank(key, [stratum], seed))  # one row per stratum
    return x.where(F.col("_at") <= F.col("target")).drop("_at", "target")


def shortfall(rows: DataFrame, targets: DataFrame, stratum: str) -> DataFrame:
    have = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("available"))
    x = targets.join(have, stratum, "left").fillna(0, ["available"])
    return x.withColumn("shortfall", F.greatest(F.col("target") - F.col("available"), F.lit(0)))


def proportional_targets(rows: DataFrame, stratum: str, total: int = 50) -> DataFrame:
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    all_ = rows.agg(F.count(F.lit(1)).alias("t"))
    target = F.greatest(F.lit(1), F.bround(F.col("n") / F.col("t") * total, 0).cast("int"))
    return counts.crossJoin(all_).select(stratum, target.alias("target"))  # one row


def stratified_split(rows: DataFrame, by: list, key: list, share: float = 0.7, seed: str = "42") -> DataFrame:
    """rows with split: dev for the first rounded share of each cell in hash order, test for the rest; a cell of one is dev."""
    x = rows.withColumn("_at", hash_rank(key, by, seed)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    dev = (F.col("_n") == 1) | (F.col("_at") <= F.bround(F.col("_n") * share, 0))
    return x.withColumn("split", F.when(dev, "dev").otherwise("test")).drop("_at", "_n")


def split_check(split: DataFrame, by: str, tolerance: float = 5.0) -> DataFrame:
    """Per value of `by`: its percentage in either part, and whether they differ by tolerance points at most."""
    total = split.groupBy("split").agg(F.count(F.lit(1)).alias("t"))
    x = split.groupBy(by, "split").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), "split")  # two rows
    pct = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, 100.0 * F.col("n") / F.col("t"))), F.lit(0.0)).alias(f"pct_{s}")
    x = x.groupBy(by).agg(pct("dev"), pct("test"))
    return x.withColumn("within", F.abs(F.col("pct_dev") - F.col("pct_test")) <= tolerance)
