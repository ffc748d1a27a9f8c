import json

import pytest

from ponderloom import cli
from ponderloom.operators import prune as R
from ponderloom.operators.pruning import annotated_graphs
from ponderloom.schema import PRUNE_GRID, PruneConfig


def test_from_samples_to_pruned_graphs(spark, tmp_path, capsys):
    g = str(tmp_path / "g")
    assert cli.main(["extract", "samples", g]) == 0
    assert len([json.loads(r.value) for r in spark.read.text(g).collect()]) == 6
    for args in (["prune", g, str(tmp_path / "p"), "--apply"], ["validate", g, str(tmp_path / "v")], ["annotate", g, str(tmp_path / "a")], ["visualize", g, str(tmp_path / "d")], ["enroll", g, "m", str(tmp_path / "s")], ["cluster", g, str(tmp_path / "c")], ["randomize", g, str(tmp_path / "r"), "--draws", "2"], ["analyze", g]):
        assert cli.main(args) == 0
    assert cli.main(["identify", g, str(tmp_path / "s"), str(tmp_path / "i")]) == 0
    assert spark.read.json(str(tmp_path / "i")).count() == 6 and spark.read.text(str(tmp_path / "r")).count() == 12
    assert "entropy" in capsys.readouterr().out


def test_experiments(spark, tmp_path):
    assert cli.main(["calibrate", str(tmp_path / "k"), "--n", "40", "--rounds", "1"]) == 0
    got = spark.read.json(str(tmp_path / "k")).first()
    before = R.agreement(R.regions(R.with_config(annotated_graphs(spark, 40), PruneConfig())).withColumn("predicted", R.predicted())).first().f1
    assert got.f1 >= before > 0 and json.loads(got.config)["max_consecutive_transforms"] in PRUNE_GRID["max_consecutive_transforms"]
    assert cli.main(["end_to_end", "synthetic", str(tmp_path / "e"), "--n", "20"]) == 0
    rows = {r.condition: r for r in spark.read.json(str(tmp_path / "e")).collect()}
    assert set(rows) == {"control", "structural", "signal"} and rows["control"].compression == 0 and rows["structural"].compression > 0
    assert cli.main(["everything", "samples", str(tmp_path / "all")]) == 0
    assert spark.read.json(str(tmp_path / "all" / "redundancy")).count() == 6 and spark.read.json(str(tmp_path / "all" / "decision")).first().decisions


def test_unknown_command():
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
