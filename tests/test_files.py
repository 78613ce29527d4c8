import json

import pytest
from pyspark.sql import functions as F

from termloom.operators import network as N
from termloom.sources import files as S
from termloom.streaming import decision_log as D


def test_csv_with_mark_encoding_aliases_and_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿EID,Author Keywords,title\n2-s2.0-1,a; b,\"x, \"\"y\"\"\nz\"\n2-s2.0-2,,t\n".encode())
    (tmp_path / "b.csv").write_bytes("id,author keywords\n2-s2.0-1,caf\xe9\n".encode("latin-1"))
    df = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns[0] == "EID" and df.count() == 2
    assert S.encoding_of(spark, str(tmp_path / "b.csv")) == "iso-8859-1"
    c = S.read_corpus(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert [r.author_keywords for r in c.orderBy("_batch", "_row").collect()] == ["a; b", None, "café"]
    assert c.where("article_id is null").count() == 0
    with pytest.raises(S.MissingInput):
        S.read_csv(spark, str(tmp_path / "none.csv"))


def test_log_registry_upsert_and_sheet(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"pair_id": "1", "decision": "match"}\nbroken\n{"pair_id": "2"}\n')
    assert S.read_log(spark, str(tmp_path / "log.jsonl")).where("pair_id is not null").count() == 2
    (tmp_path / "t.json").write_text(json.dumps({"B3": {"threshold": 0.92, "dev_f1": 0.9}, "full": {"threshold": 0.5, "dev_f1": 0.97, "dev_coverage": 0.9}}))
    t = S.read_thresholds(spark, str(tmp_path / "t.json"))
    assert {r.method: r.threshold for r in t.collect()} == {"B3": 0.92, "full": 0.5}
    new = spark.createDataFrame([("B3", 0.9)], "method string, threshold double")
    assert {r.method: r.threshold for r in S.upsert(t, new).collect()} == {"B3": 0.9, "full": 0.5}
    sheet = S.annotation_sheet(spark.createDataFrame([("BP1", "a")], "pair_id string, keyword_a string"), ["label", "notes"], "read me").orderBy("_order").collect()
    assert [r.pair_id for r in sheet] == ["INSTRUCTIONS", "BP1"] and sheet[0].notes == "read me"
    (tmp_path / "s.csv").write_text("pair_id,label\nINSTRUCTIONS,\nBP1, Non-Match \n")
    assert [tuple(r) for r in S.read_sheet(spark, str(tmp_path / "s.csv"), "label").collect()] == [("BP1", "non_match")]


def test_network_sinks(spark, tmp_path):
    kept = spark.createDataFrame([("a", 9), ("b", 7), ("c", 5)], "id string, freq long")
    found = spark.createDataFrame([("a", "b", 4), ("b", "c", 2)], "src string, dst string, weight long")
    S.write_edges(found, str(tmp_path / "e"))
    S.write_matrix(kept, found, str(tmp_path / "m"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "e")).count() == 2
    m = {r.id: r.asDict() for r in N.matrix(kept, found).collect()}
    assert m["a"]["b"] == m["b"]["a"] == 4 and m["a"]["a"] == 0
    nodes, edges = S.figure_data(kept, found, 2)
    assert {r.id: r.degree for r in nodes.collect()} == {"a": 4, "b": 4} and edges.count() == 1


def test_growing_log_as_a_stream(spark, tmp_path):
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    good = '{"decision": "match", "confidence": 0.9, "justification": "j"}'
    row = lambda i, h, t, r=good: json.dumps({"pair_id": i, "prompt_hash": h, "response": r, "timestamp": f"2024-01-01T00:00:{t:02d}Z"})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text("\n".join([row("1", "h", 1), row("1", "h", 2), row("2", "h", 3, "oops")]))
    D.keep_latest(D.decisions(D.tail(spark, log)), out, mark).awaitTermination(120)
    (tmp_path / "log" / "2.jsonl").write_text(row("2", "h2", 9))
    D.keep_latest(D.decisions(D.tail(spark, log)), out, mark).awaitTermination(120)
    got = {r.pair_id: r.guard_decision for r in D.latest(spark, out).collect()}
    assert got == {"1": "match", "2": "match"}
    assert D.hourly(D.tail(spark, log)).isStreaming
    assert F is not None
