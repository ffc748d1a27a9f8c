import json
import os

from pyspark.sql import functions as F

from ponderloom.sources import readers as S
from ponderloom.streaming import sessions as ST
from test_graphs import chain, make


def test_traces_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    with open(path, "w") as out:
        out.write('{"cot_text": "A. B.", "answer_correct": true, "level": 3}\n\n{"cot_text": "C"}\n')
    rows = S.traces(spark, path)
    assert [r.cot_text for r in rows.collect()] == ["A. B.", "C"]
    S.write_traces(rows, str(tmp_path / "out"))
    assert S.traces(spark, str(tmp_path / "out")).count() == 2
    assert S.traces(spark, str(tmp_path / "nothing"), missing_ok=True).count() == 0


def test_graphs_round_trip(spark, tmp_path):
    g = make(spark, ("a", "RTV", chain(3)), ("b", "K", []))
    S.write_graphs(g, str(tmp_path / "g"))
    got = {r.trace_id: len(r.nodes) for r in S.graphs(spark, str(tmp_path / "g")).collect()}
    assert got == {"a": 3, "b": 1}
    os.makedirs(tmp_path / "d")
    (tmp_path / "d/one.json").write_text(json.dumps({"trace_id": "x", "graph": {"nodes": [{"id": 1, "type": "Verify"}], "edges": []}}, indent=1))
    assert [r.trace_id for r in S.graphs(spark, str(tmp_path / "d"), whole_files=True).collect()] == ["x"]
    S.write_graphs_with_text(g, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2


def test_math_tree(spark, tmp_path):
    for level in (1, 5):
        d = tmp_path / f"Level {level}" / "Algebra"
        d.mkdir(parents=True)
        (d / "p.json").write_text(json.dumps({"problem": "p", "solution": "s"}))
    assert sorted((r.level, r.subject) for r in S.math_tree(spark, str(tmp_path)).collect()) == [(1, "Algebra"), (5, "Algebra")]
    assert S.math_tree(spark, str(tmp_path), [5]).count() == 1


def test_answers(spark):
    rows = spark.createDataFrame([("q1", "one two three four five #### 1,2 is 12", "Level 4"), ("q2", "short #### 3", "x"), ("q3", "Some words that are enough \\boxed{9}", None)], "question string, answer string, level string")
    got = {r.question: (r.answer, r.answer_num, r.level) for r in S.answers(rows).collect()}
    assert got == {"q1": ("1,2 is 12", 12.0, 4), "q3": ("9", 9.0, None)}


def test_samples_and_labels(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("trace_id"), (F.col("id") % 3).alias("domain"))
    assert sorted(S.sampled(rows, "trace_id", 10).collect()) == sorted(S.sampled(rows, "trace_id", 10).collect())
    assert {r.domain: r["count"] for r in S.stratified(rows, 5).groupBy("domain").count().collect()} == {0: 5, 1: 5, 2: 5}
    path = str(tmp_path / "l.jsonl")
    with open(path, "w") as out:
        out.write('{"question_id": "a", "correct": false}\n{"trace_id": "b"}\n{"question_id": "a", "correct": true}\n')
    assert {r.trace_id: r.correct for r in S.labels(spark, path).collect()} == {"a": True, "b": True}


def test_manifest(tmp_path):
    d = S.run_dir(str(tmp_path), "extract")
    assert S.write_manifest(d, "extract", {"n": 3})["args"] == {"n": "3"} and json.load(open(f"{d}/manifest.json"))["command"] == "extract"


def test_sessions_on_batch_and_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = ST.sessions(events).agg(F.sum("n_nodes")).first()[0]
    assert batch == events.count()
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ST.windowed_types(stream).writeStream.format("memory").queryName("types").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("types").agg(F.sum("n")).first()[0] == events.count()
