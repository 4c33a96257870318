"""Records with values of the wrong type, and vectors that are all null."""

import json

import pytest

from faultsift.sources.sheet import read_sheet
from faultsift.operators import similarity
from faultsift.sources import failure_json

RECORDS = [{"TestName": "a", "FailureCount": 3, "HasInvestigation": True},
           {"TestName": "b", "FailureCount": "many", "HasInvestigation": "perhaps", "Owner": {"name": "x"}},
           {"TestName": 7, "FailureCount": 2.5, "Unknown": [1]}]


def test_mistyped_values_cost_no_record(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(RECORDS))
    (tmp_path / "cut.json").write_text(json.dumps(RECORDS)[:-2])
    (tmp_path / "empty.json").write_text("[]")
    records = failure_json.read_failure_json(spark, str(tmp_path))
    found = sorted((r["TestName"], r["FailureCount"], r["HasInvestigation"], r["Owner"]) for r in records.collect())
    assert found == [("7", None, None, None), ("a", 3, True, None), ("b", None, None, '{"name": "x"}')]
    for column in records.columns:                             # the first one, Product, is in no record
        assert records.select(column).count() == len(records.select(column).collect()) == 3
    bad = failure_json.rejected_values(spark, str(tmp_path)).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["field"], r["value"]) for r in bad) == [
        ("good.json", "FailureCount", "2.5"), ("good.json", "FailureCount", "many"),
        ("good.json", "HasInvestigation", "perhaps")]
    files = failure_json.unparsed_files(spark, str(tmp_path)).collect()
    assert [r["file"].rsplit("/", 1)[1] for r in files] == ["cut.json"]


def test_lines_and_nested_fields(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "list": [{"n": 1}, {"n": 2}]}\n{"id": \n{"id": 2, "list": 5}\n')
    schema = "id INT, list ARRAY<STRUCT<n: INT>>"
    rows = failure_json.read_failure_json(spark, str(tmp_path), schema, lines=True).orderBy("id").collect()
    assert [(r["id"], r["list"] and [x["n"] for x in r["list"]]) for r in rows] == [(1, [1, 2]), (2, None)]
    assert failure_json.unparsed_files(spark, str(tmp_path), schema, lines=True).count() == 1


@pytest.mark.parametrize("values", [similarity.BROADCAST_VALUES, 1])
@pytest.mark.parametrize("kind", ["targets", "anchors"])
def test_null_vectors_only(spark, values, kind):
    some = [(i, [1.0, float(i)]) for i in range(6)]
    none = [(i + 10, None) for i in range(6)]
    targets = spark.createDataFrame(none if kind == "targets" else some, "id LONG, v ARRAY<DOUBLE>")
    anchors = spark.createDataFrame(none if kind == "anchors" else some, "id LONG, v ARRAY<DOUBLE>")
    best = similarity.nearest_anchor(targets, anchors, "id", "v", "id", broadcast_values=values, block_rows=2)
    first = 10 if kind == "anchors" else 0
    assert sorted((r["score"], r["anchor"]) for r in best.collect()) == [(0.0, first)] * 6


def test_blocks_of_null_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, None)], "id LONG, v ARRAY<DOUBLE>")
    counts = similarity.neighbour_counts(rows, "id", "v", 0.3, block_rows=1)
    assert {r["id"]: r["n_neighbors"] for r in counts.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_sheets_with_their_own_headers(spark, tmp_path):
    folder = tmp_path / "some sheets"
    folder.mkdir()
    (folder / "a.csv").write_text('Test,Error\nt1,bang\n')
    (folder / "b.csv").write_text('Error,Test\n"bang, loud",t2\n\n')
    (folder / "c.tsv").write_text('"Test"\tOwner\nt3\tann\n')
    (folder / "d.csv").write_text('Test,"Error, if any"\nt4,none\n')
    (folder / "e.csv").write_text("")
    rows = {r["Test"]: r.asDict() for r in read_sheet(spark, str(folder)).collect()}
    assert sorted(rows) == ["t1", "t2", "t3", "t4"]
    assert rows["t1"]["Error"] == "bang" and rows["t2"]["Error"] == "bang, loud"
    assert rows["t3"]["Owner"] == "ann" and rows["t4"]["Error, if any"] == "none"
