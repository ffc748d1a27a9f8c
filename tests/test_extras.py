import json

from pyspark.sql import functions as F

from ponderloom import config, reports
from ponderloom.operators import extractors as X
from ponderloom.operators import graph as G
from ponderloom.sources import readers


def test_segment_extraction(spark):
    t = spark.createDataFrame([("a", "Calculate x, then check if it holds. Wait, no."), ("e", ""), ("n", None)], "trace_id string, cot_text string")
    got = {r.trace_id: r for r in X.extract_segments(t).collect()}
    assert [n.type for n in got["a"].nodes] == ["Transform", "Verify", "Backtrack"] and [tuple(e) for e in got["a"].edges] == [(1, 2), (2, 3)]
    assert got["e"].nodes == [] and not got["n"].nodes
    text = "Calculate x, then check if it holds. Wait, no."
    assert all(0 <= n.span.start <= n.span.end <= len(text) for n in got["a"].nodes)


def test_model_extraction(spark):
    class Failing:
        model = "failing"

        def __init__(self):
            self.calls = 0

        def complete(self, prompt):
            self.calls += 1
            if "bad" in prompt.rsplit("\n", 1)[-1]:
                return "no json at all"
            if self.calls == 1:
                raise RuntimeError("busy")
            return 'x {"nodes": [{"id": 1, "type": "??"}, {"type": "verify", "span": [1]}], "edges": [[1, 2], [3]]} y'

    t = spark.createDataFrame([("a", "fine"), ("b", "bad")], "trace_id string, cot_text string")
    got = {r.trace_id: r for r in X.extract_by_model(t.coalesce(1), Failing).collect()}
    assert [(n.id, n.type) for n in got["a"].nodes] == [(1, "Transform"), (2, "Verify")] and [tuple(e) for e in got["a"].edges] == [(1, 2)] and got["a"].error is None
    assert got["b"].nodes == [] and "no JSON" in got["b"].error


def test_synthetic_texts(spark):
    a, b = (sorted(X.synthetic_texts(spark, 60).collect()) for _ in range(2))
    assert a == b and len(a) == 60 and all(r.cot_text and r.answer in r.cot_text for r in a)
    assert {k for r in a for k in r.redundancy_types.split(",")} == set(X.KINDS) and all(1 <= len(r.redundancy_types.split(",")) <= 3 for r in a)
    for kind, (_, least, most, options) in X.REDUNDANCY.items():
        counts = [sum(o.replace("{a}", r.answer).split("{w}")[0] in r.cot_text for o in options) for r in a if kind in r.redundancy_types.split(",")]
        assert counts and all(least <= c <= most for c in counts), kind
    assert all(r.cot_text.count("{") == 0 for r in a)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"gcp": {"pass_min": 0.5}, "own": 1}))
    c = config.load(str(path), {"PONDERLOOM_EXTRACTORS": "rbe, x"})
    assert c["gcp"] == {**config.DEFAULTS["gcp"], "pass_min": 0.5} and c["own"] == 1 and c["pipeline"]["extractors"] == ["rbe", "x"]
    assert config.load(env={}) == config.DEFAULTS and config.load(env={"PONDERLOOM_CONFIG": str(path)})["own"] == 1
    assert config.models_of("qwen")[0] == "qwen2.5-7b" and len(config.one_of_each_family()) == 4


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 0.12345, None)], "name string, x double, y int")
    assert reports.to_markdown(df) == "| name | x | y |\n| --- | --- | --- |\n| a_b | 0.123 |  |"
    assert r"a\_b & 0.123 &" in reports.to_latex(df) and json.loads(reports.to_json(df)) == [{"name": "a_b", "x": 0.12345, "y": None}]


def test_exporters():
    e = reports.make_exporter("list")
    with e.span("job", n=1):
        pass
    assert e.spans[0]["name"] == "job" and e.spans[0]["n"] == 1 and e.spans[0]["seconds"] >= 0
    assert isinstance(reports.make_exporter("unknown"), reports.NullExporter)
    for kind in ("otlp", "langfuse"):
        with reports.make_exporter(kind).span("x"):
            pass


def test_summaries(spark):
    one = spark.createDataFrame([(0.5, "GO")], "kappa double, decision string")
    assert reports.describe_row(one, "Pilot") == "Pilot\n  kappa     0.500\n  decision  GO" and reports.describe_row(one.where("false"), "None") == "None"
    v = spark.createDataFrame([("a", "R2", "x"), ("a", "R2", "x"), ("b", "R4", "y")], "trace_id string, rule string, failure_mode string")
    assert reports.describe_rules(v).splitlines()[1:] == ["  R2 x  2 in 1 traces", "  R4 y  1 in 1 traces"]
    p = spark.createDataFrame([("a", 2, 70, 42, 98), ("b", 0, 0, 0, 0)], "trace_id string, n_regions int, savings int, savings_low int, savings_high int")
    assert "with_regions  1" in reports.describe_pruning(p) and "savings_high  98" in reports.describe_pruning(p)


def test_dataset_export(spark, tmp_path):
    readers.export_dataset(spark.range(3), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3


def test_catalog_and_mixed_sources(spark, tmp_path):
    readers.write_motif_catalog(spark, str(tmp_path / "m"))
    assert readers.read_motif_catalog(spark, str(tmp_path / "m")).count() == 12
    assert readers.mixed([spark.range(5), spark.range(5)], 2).count() == 4
    (tmp_path / "h.jsonl").write_text('{"task_id": "t", "prompt": "p"}\n')
    assert readers.humaneval(spark, str(tmp_path / "h.jsonl")).first().task_id == "t"


def test_column_barrier_keeps_values(spark):
    df = spark.createDataFrame([(1, [1, 2], None), (2, None, "x")], "a int, b array<int>, c string")
    assert G.fixed(df).collect() == df.collect() and G.fixed(df.where(F.lit(False))).collect() == []
