import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import candidates as C
from termloom.operators import evaluate as E
from termloom.operators import network as N
from termloom.operators import profile as P
from termloom.operators import verify as V
from termloom.operators.components import components
from termloom.plans.numbering import numbered


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(300)], [(5, 5), (7, 6), (6, 7)], [(random.Random(i).randrange(80), random.Random(i + 99).randrange(80)) for i in range(60)], [(0, i) for i in range(1, 200)]])
def test_components_match_union_find(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union_find(edges)


def test_guard_truth_table(spark):
    good = '{"decision": "%s", "confidence": %s, "justification": "j"}'
    rows = [
        (0, "```json\n" + good % ("match", 0.9) + "\n```", "match", 0.9, None), (1, "oops", "uncertain", 0.0, "G1"), (2, "[1]", "uncertain", 0.0, "G2"),
        (3, '{"decision": "match"}', "uncertain", 0.0, "G2"), (4, good % ("perhaps", 0.9), "uncertain", 0.9, "G3"), (5, good % (" MATCH ", '"0.8"'), "match", 0.8, None),
        (6, good % ("match", 7), "match", 1.0, None), (7, good % ("non_match", -1), "uncertain", 0.0, "G4"), (8, good % ("uncertain", 0.1), "uncertain", 0.1, None),
        (9, good % ("match", "null"), "uncertain", 0.0, "G4"), (10, None, "uncertain", 0.0, "G1"), (11, good % ("match", '"x"'), "uncertain", 0.0, "G4"),
    ]
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "seq int, response string")
    got = V.guarded(df).orderBy("seq").select("guard_decision", "guard_confidence", "guard_applied").collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]
    forced = V.guarded(df, guard=V.Guard(allow_uncertain=False)).orderBy("seq").collect()
    assert forced[8].guard_decision == "non_match" and forced[7].guard_decision == "non_match" and forced[1].guard_decision == "uncertain"


def test_metrics_and_best_threshold(spark):
    df = spark.createDataFrame([("match", "match"), ("match", "uncertain"), ("non_match", "match"), ("uncertain", "match"), ("non_match", "non_match")], "gold_label string, predicted string")
    r = E.binary_metrics(df.withColumn("m", F.lit("x")), ["m"]).first()
    assert (r.precision, r.recall, r.f1, r.coverage, r.three_way_acc) == (0.5, 0.5, 0.5, 0.8, 0.4)
    scored = spark.createDataFrame([("match", 0.9), ("non_match", 0.2)], "gold_label string, score double")
    assert E.best_threshold(E.sweep(scored, E.grid(spark, 10, 95))).first().threshold == 0.21


def test_case_plural_acronym_and_first_claim(spark):
    f = spark.createDataFrame([("GIS", 3), ("Geographic Information System", 2), ("model", 5), ("models", 4), ("Model", 1), ("land-use", 2), ("land use", 2), ("city", 1), ("cities", 1)], "keyword string, frequency long")
    got = {(r.keyword_a, r.keyword_b): r.stratum for r in C.all_strata(C.vocabulary(f)).collect()}
    assert got["Model", "model"] == "i" and got["land use", "land-use"] in ("ii", "iv") and got["cities", "city"] in ("ii", "v")
    assert got["GIS", "Geographic Information System"] == "iii"
    assert len(got) == len(set(got))


def test_network_density_modularity_and_ari(spark):
    k = spark.createDataFrame([(a, w) for a in range(6) for w in ("a", "b", "c")] + [(9, "z")] * 2 + [(i, "z") for i in range(20, 25)], "article_id long, keyword string")
    arts = N.articles_of(k)
    kept = N.nodes(arts)
    found = N.edges(arts, kept)
    d = N.density(kept, found).first()
    assert (d.n_nodes, d.n_edges, d.density) == (4, 3, 0.5)
    part = N.louvain(kept, found)
    got = {r.id: r.community for r in part.collect()}
    assert got["a"] == got["b"] == got["c"] != got["z"]
    one = kept.select("id", F.lit(0).alias("community"))
    assert abs(N.modularity(found, one).first().modularity) < 1e-12
    assert N.adjusted_rand(part, part).first().ari == 1.0
    m = N.adjusted_mutual(part, part).first()
    assert abs(m.ami - 1) < 1e-9 and abs(m.nmi - 1) < 1e-9


def test_louvain_finds_two_cliques(spark):
    pairs = [(x + str(i), x + str(j), 5) for x in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 1)]
    found = spark.createDataFrame(pairs, "src string, dst string, weight long")
    kept = spark.createDataFrame([(x + str(i), 1) for x in "ab" for i in range(4)], "id string, freq long")
    c = {r.id: r.community for r in N.louvain(kept, found).collect()}
    assert len({c[f"a{i}"] for i in range(4)}) == 1 and len(set(c.values())) == 2


def test_budget_numbering_and_first_rows(spark):
    calls = spark.createDataFrame([(i, 0.5) for i in range(30)], "seq long, price double").repartition(7)
    assert sorted(r.seq for r in V.within_budget(calls, ["seq"], "price", 3.0).collect()) == list(range(6))
    n = {r.seq: r.n for r in numbered(calls, ["seq"]).collect()}
    assert n == {i: i + 1 for i in range(30)}
    rows = spark.createDataFrame([("k", 2), ("k", 1), (None, 3), (None, 4)], "key string, at long")
    assert sorted(r["at"] for r in P.first_rows(rows, "key", ["at"]).collect()) == [1, 3, 4]


def test_overlay_pending_fallback_and_contradiction(spark):
    a = spark.createDataFrame([(1, "match", 5), (2, "match", 1)], "pair_id long, decision string, seq long")
    b = spark.createDataFrame([(1, "non_match", 1)], "pair_id long, decision string, seq long")
    got = {r.pair_id: r.decision for r in V.overlay([a, b], ["pair_id"]).collect()}
    assert got == {1: "non_match", 2: "match"}
    pairs = spark.createDataFrame([(1, 0.1), (3, 0.95)], "pair_id long, jw double")
    assert [r.pair_id for r in V.pending(pairs, a, ["pair_id"]).collect()] == [3]
    assert {r.pair_id: (r.decision, r.from_log) for r in V.with_fallback(pairs, a, ["pair_id"], "jw").collect()} == {1: ("match", True), 3: ("match", False)}
    d = spark.createDataFrame([("a", "b", "match"), ("b", "c", "match"), ("a", "c", "non_match")], "keyword_a string, keyword_b string, decision string")
    assert [tuple(r) for r in V.contradictions(d).collect()] == [("a", "b", "c")]


def test_verify_retries_and_reports(spark):
    pairs = spark.createDataFrame([("a", "b"), ("x", "y")], "keyword_a string, keyword_b string")

    def answer(a, b):
        if a == "x":
            raise RuntimeError("down")
        return a + b

    got = {r.keyword_a: (r.response, r.attempt, r.error) for r in V.verify(pairs, answer, delays=(0.0,)).collect()}
    assert got == {"a": ("ab", 1, None), "x": ("", 3, "RuntimeError: down")}


def test_split_is_stable_and_stratified(spark):
    x = spark.createDataFrame([(i, "s" + str(i % 3)) for i in range(90)] + [(999, "lone")], "pair_id long, stratum string")
    a = {r.pair_id: r.split for r in E.stratified_split(x, ["stratum"], ["pair_id"]).collect()}
    b = {r.pair_id: r.split for r in E.stratified_split(x.repartition(5), ["stratum"], ["pair_id"]).collect()}
    assert a == b and a[999] == "dev" and sum(v == "dev" for v in a.values()) == 64


def test_nearest_equals_brute_force(spark):
    import numpy as np

    from termloom.functions.similarity import nearest

    v = np.random.default_rng(1).standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.id, r.rank): r.neighbour for r in nearest(df, "id", "v", 3, block_rows=16).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for i in range(60):
        assert [got[i, r] for r in (1, 2, 3)] == list(np.argsort(-s[i], kind="stable")[:3])
