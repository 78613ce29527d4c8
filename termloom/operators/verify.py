"""Verification of pairs against a decision log, and the guard that may abstain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LABELS, MATCH, NON_MATCH, UNCERTAIN, short_hash, strip_fence, stripped
from .evaluate import best_threshold, binary_metrics

REQUIRED = ("decision", "confidence", "justification")
LEXICAL = ("i", "ii", "iv", "v", "ix")


@dataclass(frozen=True)
class Guard:
    """threshold: least confidence of a firm decision; of_class overrides it per label. allow_uncertain=False
    turns an uncertain answer into non_match and leaves out the confidence rule."""

    threshold: float = 0.5
    of_class: tuple = ()
    allow_uncertain: bool = True


def guarded(log: DataFrame, response: str = "response", guard: Guard = Guard(), prefix: str = "guard_") -> DataFrame:
    """log with guard_decision, guard_confidence, guard_justification, guard_applied and guard_reason.

    G1 no JSON; G2 fields missing (arrays and scalars lack all); G3 decision outside the labels; G4 a firm
    decision below the threshold. All give uncertain. Confidence is read as a number (true is 1), within 0
    and 1, else 0. Reasons have the spelling of decision logs, so that logs compare by reason.
    """
    raw = strip_fence(F.col(response))
    x = log.withColumn("_v", F.try_parse_json(raw)).withColumn("_keys", F.coalesce(F.json_object_keys(F.when(F.col("_v").isNotNull(), raw)), F.array().cast("array<string>")))
    field = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("_keys")))
    decision = F.lower(stripped(F.coalesce(field("decision"), F.lit(""))))
    is_true = F.schema_of_variant(F.try_variant_get("_v", "$.confidence", "variant")) == "BOOLEAN"
    number = F.when(is_true, (field("confidence") == "true").cast("double")).otherwise(F.coalesce(field("confidence").try_cast("double"), F.lit(0.0)))
    number = F.coalesce(number, F.lit(0.0))
    number = F.when(F.isnan(number), 0.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    x = x.withColumns({"_missing": missing, "_decision": decision, "_confidence": number})
    least = F.lit(guard.threshold)
    for name, value in guard.of_class:
        least = F.when(F.col("_decision") == name, F.lit(value)).otherwise(least)
    g1, g2, g3 = F.col("_v").isNull(), F.size("_missing") > 0, ~F.col("_decision").isin(*LABELS)
    g4 = (F.col("_decision") != UNCERTAIN) & (F.col("_confidence") < least) & F.lit(guard.allow_uncertain)
    applied = F.when(g1, "G1").when(g2, "G2").when(g3, "G3").when(g4, "G4")
    reason = (
        F.when(g1, F.lit("malformed_parse_failure"))
        .when(g2, F.concat(F.lit("malformed_missing_field:"), F.array_join("_missing", ",")))
        .when(g3, F.concat(F.lit("invalid_decision:"), F.col("_decision")))
        .when(g4, F.format_string("confidence_%.3f_below_threshold_%.3f", F.col("_confidence"), least))
    )
    final = F.when(applied.isNotNull(), F.lit(UNCERTAIN)).otherwise(F.col("_decision"))
    if not guard.allow_uncertain:
        final = F.when(applied.isNull() & (final == UNCERTAIN), F.lit(NON_MATCH)).otherwise(final)
    out = {
        "decision": final, "confidence": F.when(g1 | g2, 0.0).otherwise(F.col("_confidence")),
        "justification": F.when(~g1, field("justification")), "applied": applied, "reason": reason,
    }
    return x.withColumns({prefix + k: v for k, v in out.items()}).drop("_v", "_keys", "_missing", "_decision", "_confidence")


def raw_decision(log: DataFrame, response: str = "response") -> DataFrame:
    """log with raw_decision: the guard without the confidence rule."""
    x = guarded(log, response, Guard(threshold=0.0), "_g_")
    return x.withColumn("raw_decision", F.col("_g_decision")).drop(*[c for c in x.columns if c.startswith("_g_")])


def contradictions(decided: DataFrame) -> DataFrame:
    """G5, as a flag: (a, b, c) with a~b and b~c matching but a and c not; decided has keyword_a < keyword_b."""
    m = decided.where(F.col("decision") == MATCH).select(F.col("keyword_a").alias("x"), F.col("keyword_b").alias("y"))
    both = m.union(m.select("y", "x"))
    left, right = both.select(F.col("x").alias("b"), F.col("y").alias("a")), both.select(F.col("x").alias("b"), F.col("y").alias("c"))
    n = decided.where(F.col("decision") == NON_MATCH).select(F.col("keyword_a").alias("a"), F.col("keyword_b").alias("c"))
    # From the denied pairs outward: each is joined on one end, then on both, so no pairs of matches arise.
    return n.join(left, "a").join(right, ["b", "c"]).select("a", "b", "c").distinct()


def replay(pairs: DataFrame, log: DataFrame, key: list = ("pair_id",), order: str = "seq", decision: str = "decision") -> DataFrame:
    """pairs with the log's last decision for their key; uncertain where the log has none."""
    key = list(key)
    last = log.groupBy(*key).agg(F.max_by(decision, order).alias("_d"))
    return pairs.join(last, key, "left").withColumn("predicted", F.coalesce("_d", F.lit(UNCERTAIN))).drop("_d")


def auto_decide(pairs: DataFrame, score: str = "jw", threshold: float = 0.92, strata=LEXICAL) -> DataFrame:
    """pairs with auto_decision and auto_confidence for lexical strata, null for the others."""
    lexical, s = F.col("stratum").isin(*strata), F.col(score)
    yes = F.when(s >= threshold, F.lit(MATCH)).otherwise(F.lit(NON_MATCH))
    return pairs.withColumn("auto_decision", F.when(lexical, yes)).withColumn("auto_confidence", F.when(lexical, F.when(s >= threshold, s).otherwise(1 - s)))


def pending(pairs: DataFrame, log: DataFrame, key: list) -> DataFrame:
    """Pairs that the log has not decided."""
    return pairs.join(log.select(*key).distinct(), key, "left_anti")


def cost(tokens_in, tokens_out, per_1000_in: float, per_1000_out: float):
    return F.round(tokens_in / 1000 * per_1000_in + tokens_out / 1000 * per_1000_out, 6)


def within_budget(calls: DataFrame, order: list, price: str, cap: float) -> DataFrame:
    """The calls, in order, that start while the total before them is below cap. Running totals come from
    sums per range of the order, so that no task holds all calls."""
    from ..plans.numbering import numbered
    from ..plans.scratch import materialise

    x = materialise(numbered(calls, order, "_n").withColumn("_g", F.floor((F.col("_n") - 1) / 10_000)), "calls")
    money = F.col(price).cast("decimal(30,6)")
    sums = x.groupBy("_g").agg(F.sum(money).alias("s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("s").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(before.select("_g", "_b"), "_g")
    inside = F.coalesce(F.sum(money).over(W.partitionBy("_g").orderBy("_n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("total_before", (F.col("_b") + inside).cast("double")).where(F.col("total_before") < cap).drop("_n", "_g", "_b")


def guard_sweep(pairs: DataFrame, log: DataFrame, thresholds: DataFrame, key: list = ("pair_id",), order: str = "seq", response: str = "response", gold: str = "gold_label") -> DataFrame:
    """Metrics of a logged run at each threshold of the guard: the last answer to each pair is judged anew, pairs
    without one are uncertain. Answers are parsed once; the confidence rule alone depends on the threshold."""
    key = list(key)
    last = log.groupBy(*key).agg(F.max_by(response, order).alias(response))
    x = pairs.select(*key, gold).join(guarded(last, response, Guard(threshold=0.0), "_g_"), key, "left")
    x = x.crossJoin(F.broadcast(thresholds))  # a grid of fixed size
    firm = F.col("_g_decision").isin(MATCH, NON_MATCH) & (F.col("_g_confidence") >= F.col("threshold"))
    return binary_metrics(x.withColumn("predicted", F.when(firm, F.col("_g_decision")).otherwise(UNCERTAIN)), ["threshold"], gold)


def best_guard(swept: DataFrame, least_coverage: float = 0.7, default: float = 0.5) -> DataFrame:
    """One row (threshold, f1, coverage): the lowest threshold of the highest F1 among those that cover enough, or
    the default, with nulls, where none does."""
    best = best_threshold(swept, least_coverage).select("threshold", "f1", "coverage")
    one = swept.sparkSession.createDataFrame([(0,)], "_o int").join(best.withColumn("_o", F.lit(0)), "_o", "left")
    return one.select(F.coalesce("threshold", F.lit(default)).alias("threshold"), "f1", "coverage")


def overlay(logs: list, key: list, order: str = "seq") -> DataFrame:
    """One decision per key from logs in rising priority: the later log wins, then the later entry."""
    parts = [x.withColumn("_p", F.lit(i)) for i, x in enumerate(logs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    at = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_p"), F.desc(order)))
    return out.withColumn("_at", at).where("_at = 1").drop("_at", "_p")


def with_fallback(pairs: DataFrame, log: DataFrame, key: list, score: str, threshold: float = 0.92, order: str = "seq") -> DataFrame:
    """The log's last decision by `order`, or one by score where it has none; from_log tells which. One row per pair,
    however often the log has it."""
    last = log.groupBy(*key).agg(F.max_by("decision", order).alias("_d"))
    yes = F.when(F.col(score) >= threshold, F.lit(MATCH)).otherwise(F.lit(NON_MATCH))
    x = pairs.join(last, key, "left")
    return x.withColumn("from_log", F.col("_d").isNotNull()).withColumn("decision", F.coalesce("_d", yes)).drop("_d")


def histogram(log: DataFrame, decision: str = "decision") -> DataFrame:
    return log.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))


def call_statistics(log: DataFrame, tokens_in: str = "input_tokens", tokens_out: str = "output_tokens", price: str = "cost_usd") -> DataFrame:
    """One row: calls, mean tokens in and out, total cost."""
    return log.agg(F.count(F.lit(1)).alias("n_calls"), F.avg(tokens_in).alias("mean_in"), F.avg(tokens_out).alias("mean_out"), F.coalesce(F.round(F.sum(price), 6), F.lit(0.0)).alias("total_cost"))


def coverage(pairs: DataFrame, log: DataFrame, key: list) -> DataFrame:
    """One row: candidates, how many of them the log has decided, and their share."""
    x = pairs.select(*key).join(log.select(*key).distinct().withColumn("_d", F.lit(1)), key, "left")
    return x.agg(F.count(F.lit(1)).alias("n_pairs"), F.count("_d").alias("n_decided"), F.coalesce(F.try_divide(F.count("_d"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"))


def projection(n_pairs: int, mean_in: float, mean_out: float, per_1000_in: float, per_1000_out: float, most_cost: float = 50.0, most_pairs: int = 20_000) -> dict:
    """Projected cost of a run, and why it should halt, if it should."""
    total = n_pairs * (mean_in / 1000 * per_1000_in + mean_out / 1000 * per_1000_out)
    halt = "cost" if total > most_cost else "pairs" if n_pairs > most_pairs else None
    return {"n_pairs": n_pairs, "cost": round(total, 6), "halt": halt}


def verify(pairs: DataFrame, answer: Callable, retries: int = 3, delays=(1.0, 2.0, 4.0)) -> DataFrame:
    """pairs with response, attempt, error, prompt_hash of a caller's answer(keyword_a, keyword_b) -> str, on
    executors; a call that keeps failing gives an empty response and its error."""
    import pyarrow as pa

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches):
        import time

        for batch in batches:
            texts, tries, errors = [], [], []
            for a, b in zip(batch.column("keyword_a").to_pylist(), batch.column("keyword_b").to_pylist(), strict=True):
                text, error, n = "", None, 0
                for n in range(1, retries + 1):
                    try:
                        text, error = answer(a, b), None
                        break
                    except Exception as e:  # noqa: BLE001  the caller's service may fail in any way
                        error = f"{type(e).__name__}: {e}"
                        if n < retries:
                            time.sleep(delays[min(n, len(delays)) - 1])
                texts.append(text)
                tries.append(n)
                errors.append(error)
            cols = [*batch.columns, pa.array(texts, pa.string()), pa.array(tries, pa.int32()), pa.array(errors, pa.string())]
            yield pa.record_batch(cols, [*batch.schema.names, "response", "attempt", "error"])

    out = pairs.mapInArrow(run, f"{schema}, response string, attempt int, error string")
    return out.withColumn("prompt_hash", short_hash(F.concat_ws("|", "keyword_a", "keyword_b")))
