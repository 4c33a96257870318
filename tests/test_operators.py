"""Edge cases of filters, lookups, aggregates and conversations."""

import datetime as dt
import random

from pyspark.sql import functions as F

from faultsift import schemas
from faultsift.operators import aggregates, conversations, filters, joins, positions, ranking
from faultsift.plans.records import error_messages, failure_records
from faultsift.plans.report import classified, failure_report
from faultsift.sources import failure_json, landed, sheet, sinks


def errors(spark):
    rows = [(1, 1, 1, 10, 100, "t1", "ERROR", "Ann", [(3,), (None,)]),
            (1, 1, 1, 11, 101, "t2", None, None, [(2,)]),
            (1, 1, 1, 12, 102, "t3", "PASS", "Ann", [(9,)]),
            (1, 1, 1, 13, 103, "t4", "FAIL", "ann", []),
            (1, 1, 1, 14, 104, "t5", "FAIL", "Ann", None),
            (2, 1, 1, 15, 105, "t6", "FAIL", "Ann", [(5,)])]
    return spark.createDataFrame(rows, schemas.ERROR_SUMMARY)


def names(df, column="TestName"):
    return sorted(row[column] for row in df.collect())


def test_filters(spark):
    df = errors(spark)
    assert names(df.where(filters.not_passed())) == ["t1", "t2", "t4", "t5", "t6"]
    assert names(df.where(filters.owned_by("Ann"))) == ["t1", "t3", "t5", "t6"]
    assert df.where(filters.owned_by("ALL")).count() == 6
    assert names(df.where(filters.owned_by_any_case("ANN"))) == ["t1", "t3", "t4", "t5", "t6"]
    assert names(df.where(filters.min_failing_builds(3))) == ["t1", "t3", "t6"]
    assert names(df.where(filters.min_failing_builds(0))) == ["t1", "t2", "t3", "t6"]
    counts = df.select("TestName", aggregates.failure_count().alias("n")).collect()
    assert dict(map(tuple, counts)) == {"t1": 3, "t2": 2, "t3": 9, "t4": 0, "t5": 0, "t6": 5}


def test_failure_records(spark):
    dim = lambda *rows: spark.createDataFrame(rows, schemas.PRODUCT)
    products, releases, platforms = dim((1, "P1"), (2, "P2")), dim((1, "1.0")), dim((1, "Linux"))
    payloads = [(10, '{"message": " a\\r\\nb "}'), (11, '"bare"'), (15, '{"message": null}')]
    messages = spark.createDataFrame(payloads, schemas.TEST_MESSAGE).select(
        "TestResultId", landed.message_text(F.col("payload")).alias("Message"))
    lists = spark.createDataFrame(
        [(100, 1, 1, [("first", "WI-7 8"), ("second", "9")])], schemas.INVESTIGATION_LISTS)
    found = failure_records(errors(spark), messages, landed.flatten_investigations(lists),
                            products, releases, platforms, ["P1", "P2"], ["1.0"], "Linux only")
    rows = {row["TestName"]: row for row in found.collect()}
    assert sorted(rows) == ["t1", "t2"]                 # t6 has a null message and is lost
    assert rows["t1"]["FailureMessage"] == "a b" and rows["t1"]["WorkItemId"] == "78"
    assert rows["t1"]["InvestigationReport"] == "first" and rows["t1"]["HasInvestigation"]
    assert rows["t2"]["FailureMessage"] == "bare" and not rows["t2"]["HasInvestigation"]
    assert rows["t2"]["WorkItemId"] is None
    grid = joins.scope_grid(products, releases, platforms, ["P1", "P2"], ["1.0"], ["Linux"])
    counts = aggregates.fetch_counts(grid, errors(spark), filters.not_passed()).collect()
    assert sorted((r["Product"], r["seen"], r["kept"]) for r in counts) == [
        ("P1", 5, 4), ("P2", 1, 1)]


def test_message_text(spark):
    given = {'{"message": "m"}': "m", '{"other": 1}': "", '{"message": null}': None, '"s"': "s",
             "12": "12", "null": "None", "true": "True"}
    rows = spark.createDataFrame([(p,) for p in given], "payload STRING").select(
        "payload", landed.message_text(F.col("payload")).alias("m")).collect()
    assert {row["payload"]: row["m"] for row in rows} == given


def test_messy_files(spark, tmp_path):
    raw = '[{"TestName": "t1", "Result": "ERROR", "FailureMessage": ' \
          '"<MESSAGE RESULT=\\"ERROR\\">x\n\ty</MESSAGE>"}, {"Result": "ERROR", ' \
          '"FailureMessage": "<MESSAGE RESULT=\\"ERROR\\">z</MESSAGE>", "HasInvestigation": true}]'
    (tmp_path / "a.json").write_text(raw)
    (tmp_path / "b.json").write_text(raw[:-3])
    (tmp_path / "c.txt").write_text(raw)
    records = failure_json.read_failure_json(spark, str(tmp_path))
    rows = error_messages(records).orderBy("Message").collect()
    assert [(r["TestName"], r["Message"], r["WorkItemId"]) for r in rows] == [
        ("t1", "x y", "N/A"), ("Unknown Test", "z", "N/A")]
    assert records.count() == 2
    skipped = failure_json.unparsed_files(spark, str(tmp_path)).collect()
    assert [row["file"].rsplit("/", 1)[1] for row in skipped] == ["b.json"]


def test_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Test Name, Error ,Assignee\n a , "Expected, Actual" ,Bo\n\n , ,\nb,Images differ\n')
    rows = sheet.read_sheet(spark, str(path))
    assert rows.columns == ["Test Name", "Error", "Assignee"]
    report = classified(rows.withColumn("ord", F.lit(0))).collect()
    assert sorted((r["Test"], r["Owner"]) for r in report) == [("a", "Bo"), ("b", "Unknown")]


def test_prediction_csv(spark, tmp_path):
    rows = spark.createDataFrame([(' a "x" ', None)], "Test STRING, Items STRING")
    sinks.write_prediction_csv(rows, str(tmp_path / "out"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert '"a ""x""",""' in lines


def test_top_with_other(spark):
    for n in (5, 6):
        report = spark.createDataFrame([(i, f"p{i}", "o") for i in range(n)],
                                       "ord BIGINT, Pattern STRING, Owner STRING")
        chart = ranking.top_with_other(aggregates.count_by(report, "Pattern"), "Pattern")
        rows = [r["Pattern"] for r in chart.collect()]
        assert sorted(rows) == [*["Other"] * (n - 5), *(f"p{i}" for i in range(5))]
        assert (chart.where("Pattern = 'Other'").count() == 1) == (n > 5)


def test_report_tables(spark):
    rows = [(i, "t", "Images differ" if i % 2 else f"m{i}. x", f"o{i % 3}") for i in range(7)]
    sheet_rows = spark.createDataFrame(rows, "ord BIGINT, Name STRING, Error STRING, User STRING")
    tables = failure_report(classified(sheet_rows))
    assert tuple(tables["summary"].first()) == (7, 5)
    first = tables["patterns"].first()
    assert (first["Pattern"], first["tests"], first["pct"]) == ("Image validation error", 3, 43)
    assert tables["samples"].count() == 7
    assert [r["Owner"] for r in tables["owner_chart"].collect()] == ["o0", "o1", "o2"]


def test_percentages(spark):
    row = spark.range(1).select(
        aggregates.percent(F.lit(1), F.lit(200)).alias("up"),
        aggregates.percent_half_even(F.lit(1), F.lit(200)).alias("even"),
        aggregates.percent(F.lit(0), F.lit(0)).alias("none")).first()
    assert tuple(row) == (1, 0, 0)
    empty = spark.createDataFrame([], "ord BIGINT, Pattern STRING, Owner STRING")
    assert tuple(aggregates.failure_summary(empty).first()) == (0, 0, 0, 0)


def test_workitems(spark):
    rows = [(0, "t", "A", "2; 1"), (1, "t", "B", "1"), (2, "t", "C", "-"), (3, "u", "D", "-"),
            (4, "v", "E", None), (5, "v", "F", " ")]
    df = spark.createDataFrame(rows, "ord INT, TestName STRING, Owner STRING, "
                                     "PredictedWorkItemId STRING")
    got = {r["TestName"]: (r["Owner"], r["WorkItems"])
           for r in aggregates.workitems_by_test(df).collect()}
    assert got == {"t": ("A", "1, 2"), "u": ("D", "-"), "v": ("E", "-")}


def turns_of(spark):
    rng = random.Random(1)
    rows = []
    for conv, length in ((1, 40), (2, 3), (3, 1)):
        at = 0
        for _ in range(length):
            at += rng.randint(1, 6)
            rows.append((conv, at, f"x{at}", rng.choice([None, None, "a", "b"])))
    return rows, spark.createDataFrame(rows, "conv INT, turn INT, text STRING, entity STRING")


def test_chunked_windows_equal_plain_ones(spark):
    rows, df = turns_of(spark)
    by_conv = {}
    for conv, turn, text, entity in sorted(rows):
        by_conv.setdefault(conv, []).append((turn, text, entity))
    slots, texts, places = {}, {}, {}
    for conv, turns in by_conv.items():
        last = "d"
        for i, (turn, _, entity) in enumerate(turns):
            last = entity or last
            slots[conv, turn], places[conv, turn] = last, i
            texts[conv, turn] = [t[1] for t in turns[max(0, i - 4):i + 1]]
    got = conversations.carry_slot(df, "conv", "turn", "entity", "slot", "d", width=7).collect()
    assert {(r["conv"], r["turn"]): r["slot"] for r in got} == slots
    for width in (4, 7, 4096):
        got = conversations.history(df, "conv", "turn", "text", width=width).collect()
        assert {(r["conv"], r["turn"]): r["history"] for r in got} == texts
    got = positions.position_in_key(df, "conv", "turn", width=5).collect()
    assert {(r["conv"], r["turn"]): r["position"] for r in got} == places


def test_number_rows(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("k"))
    got = positions.number_rows(df.repartition(5), ["k"], "n").collect()
    assert all(row["k"] == row["n"] for row in got) and len(got) == 1000


def test_sessions(spark):
    start = dt.datetime(2024, 1, 1, 0, 59)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    rows = [(1, at(0)), (1, at(59)), (1, at(59)), (1, at(119)), (1, at(120)), (2, at(5))]
    got = conversations.sessions(spark.createDataFrame(rows, "u INT, ts TIMESTAMP"), "u", "ts")
    assert sorted((r["u"], r["session_start"], r["n_events"]) for r in got.collect()) == [
        (1, at(0), 3), (1, at(119), 2), (2, at(5), 1)]


def test_plans(spark):
    """No cross join anywhere, and the rank limit is below the shuffle."""
    df = errors(spark)
    dims = spark.createDataFrame([(1, "x")], schemas.PRODUCT)
    plan = joins.in_scope(df, dims, dims, dims)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    report = spark.createDataFrame([(0, "t", "e", "o", "p")],
                                   "ord BIGINT, Test STRING, Error STRING, Owner STRING, "
                                   "Pattern STRING")
    plan = ranking.sample_per_pattern(report)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
