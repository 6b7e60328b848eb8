"""Readers, requests and writers on files the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.sources import readers, writers
from wardflow.sources.requests import as_request, parse_requests

HEADER = "|".join(S.RAW_FILE.names)


def line(hour, hr="NaN", label=0):
    values = {"HR": hr, "Age": "60", "Gender": "1", "HospAdmTime": "-3.5", "ICULOS": hour, "SepsisLabel": label}
    return "|".join(str(values.get(c, "NaN")) for c in S.RAW_FILE.names)


@pytest.fixture(scope="module")
def psv(tmp_path_factory):
    folder = tmp_path_factory.mktemp("psv")
    for name, rows in {
        "p000002.psv": [line(1), line(2, 61.5)],
        "p100001.psv": [line(1, 80, 1)],
        "p100002.psv": [line(1, 80, 1)],
        "notes.txt": ["no data"],
    }.items():
        (folder / name).write_text("\n".join([HEADER, *rows]) + "\n")
    return str(folder)


def test_patient_files(spark, psv):
    df = readers.patient_files(spark, psv)
    assert [f.name for f in df.schema] == S.OBSERVATIONS.names
    got = [(r["Patient_ID"], r["ICULOS"], r["HR"], r["Temp"], r["SepsisLabel"]) for r in df.orderBy("Patient_ID", "ICULOS").collect()]
    assert got == [("p000002", 1, None, None, 0), ("p000002", 2, 61.5, None, 0), ("p100001", 1, 80.0, None, 1), ("p100002", 1, 80.0, None, 1)]


@pytest.mark.parametrize("rule,want", [("file_name", "p000002"), ("trimmed", "00002"), ("after_p", "000002"), ("stem", "p000002")])
def test_id_rules(spark, psv, rule, want):
    assert want in {r[0] for r in readers.patient_files(spark, psv, rule).select("Patient_ID").collect()}


def test_no_files(spark, psv):
    with pytest.raises(readers.NoFiles):
        readers.patient_files(spark, psv, name_glob="*.csv")


def test_contents_and_other_files(spark, psv):
    counted = readers.count_contents(spark, psv, "*.psv").first()
    assert tuple(counted) == (3, 2)
    assert [r["file"] for r in readers.other_files(spark, psv).collect()] == ["notes.txt"]


def test_ingest_refuses_broken_records(spark, tmp_path):
    good, extra = line(1, 80), f"{line(2)}|1"
    (tmp_path / "Patient_ID=p7").mkdir()
    (tmp_path / "Patient_ID=p7" / "a.psv").write_text("\n".join([HEADER, good, "1|torn", line(3, "high"), extra]) + "\n")
    (tmp_path / "p000009.psv").write_text("\n".join([HEADER, line(1)]) + "\n")
    (tmp_path / "empty.psv").write_text("")
    rows, rejects = readers.ingest_files(spark, str(tmp_path))
    assert rows.columns == S.OBSERVATIONS.names
    assert sorted((r["Patient_ID"], r["ICULOS"], r["HR"]) for r in rows.collect()) == [("a", 1, 80.0), ("p000009", 1, None)]
    assert sorted(r["record"] for r in rejects.collect()) == sorted(["1|torn", line(3, "high"), extra])
    assert {r["file"].rsplit("/", 1)[1] for r in rejects.collect()} == {"a.psv"}
    rows, _ = readers.ingest_files(spark, str(tmp_path), id_rule="folder")
    assert {r["Patient_ID"] for r in rows.collect()} == {"p7", None}


def test_ingest_of_some_columns(spark, tmp_path):
    (tmp_path / "p1.psv").write_text("HR|ICULOS\n60.5|1\nNaN|2\n61\n")
    rows, rejects = readers.ingest_files(spark, str(tmp_path), columns=["HR", "ICULOS"])
    assert rows.columns == S.OBSERVATIONS.names
    assert sorted((r["ICULOS"], r["HR"], r["Age"], r["Patient_ID"]) for r in rows.collect()) == [(1, 60.5, None, "p1"), (2, None, None, "p1")]
    assert [r["record"] for r in rejects.collect()] == ["61"]
    with pytest.raises(readers.NoFiles):
        readers.ingest_files(spark, str(tmp_path), name_glob="*.csv")


def test_first_rows(spark, psv):
    rows = readers.first_rows(readers.patient_files(spark, psv), 2).collect()
    assert [(r["Patient_ID"], r["ICULOS"]) for r in rows] == [("p000002", 1), ("p000002", 2)]


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_merged_table_round_trip(spark, psv, tmp_path, form):
    df = readers.patient_files(spark, psv)
    path = f"{tmp_path}/merged.{form}"
    (writers.save_csv if form == "csv" else writers.save_table)(df, path)
    back = readers.observation_table(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_cohort_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "cohort string, x int")
    writers.save_csv(df, f"{tmp_path}/c", "|", ["cohort"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2


def test_profile_is_made_once(spark, psv, tmp_path):
    df = readers.patient_files(spark, psv)
    first = readers.profile_or_new(spark, df, f"{tmp_path}/p")
    again = readers.profile_or_new(spark, df.limit(0), f"{tmp_path}/p")
    assert sorted(map(str, first["statistics"].collect())) == sorted(map(str, again["statistics"].collect()))
    assert first["schema"].count() == 42


def test_latest_run(spark, tmp_path):
    with pytest.raises(readers.NoFiles):
        readers.latest_run(spark, f"{tmp_path}/models")
    for name in ("model-run-20240617-014341", "model-run-20240617-120000", "model-run-20231231-235959", "other"):
        (tmp_path / "models" / name).mkdir(parents=True)
    found = readers.latest_run(spark, f"{tmp_path}/models")
    assert (found["run"], found["stamp"]) == ("model-run-20240617-120000", 20240617120000)


def test_next_model_path(spark, tmp_path):
    models = tmp_path / "models"
    assert writers.next_model_path(spark, str(models), "lr", "s").endswith("lr_s_v1.model")
    for name in ("lr_x_v2.model", "lr_x_v10.model", "rf_x_v40.model", "lr.model"):
        (models / name).mkdir(parents=True)
    assert writers.next_model_path(spark, str(models), "lr", "s").endswith("lr_s_v11.model")


def test_versions(spark, tmp_path):
    data = writers.Versioned(spark, f"{tmp_path}/v")
    assert data.read() is None
    data.switch(data.stage(spark.range(3)))
    staged = data.stage(spark.range(5))
    assert data.read().count() == 3
    data.switch(staged)
    assert data.read().count() == 5
    data.switch(data.stage(spark.range(7)))
    data.revert()
    assert data.read().count() == 5
    data.revert()
    assert data.read().count() == 3
    with pytest.raises(ValueError):
        data.revert()


def test_scoring_log_appends(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert writers.read_log(spark, path).count() == 0
    row = spark.createDataFrame([(2, 0.5, 0.25)], "n_input_rows int, total_latency double, average_latency_per_row double")
    for _ in range(2):
        writers.append_log(row.withColumn("timestamp", F.current_timestamp()), path)
    assert writers.read_log(spark, path).count() == 2
    writers.append_scored(row, f"{tmp_path}/rows")
    assert "created_at" in spark.read.parquet(f"{tmp_path}/rows").columns


def values(**known):
    known = {"Patient_ID": "p1", "ICULOS": 1, **known}
    return [known.get(c) for c in S.REQUEST_COLUMNS]


CASES = {
    "good": {"data": [values(HR=60), values(HR=61.5, ICULOS=2)], "columns": S.REQUEST_COLUMNS},
    "flat": {"data": values(HR=62), "columns": S.REQUEST_COLUMNS},
    "shuffled": {"data": [values(HR=63)[::-1]], "columns": S.REQUEST_COLUMNS[::-1]},
    "empty": {},
    "no_data": {"columns": S.REQUEST_COLUMNS},
    "no_columns": {"data": [values()]},
    "extra": {"data": [[*values(), 1]], "columns": [*S.REQUEST_COLUMNS, "Extra"]},
    "missing": {"data": [values()[1:]], "columns": S.REQUEST_COLUMNS[1:]},
    "narrow": {"data": [values(), values()[:-1]], "columns": S.REQUEST_COLUMNS},
    "bad_number": {"data": [values(HR="high")], "columns": S.REQUEST_COLUMNS},
}


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([(n, json.dumps(c)) for n, c in CASES.items()] + [("blank", "")], "request string, value string")
    rows, rejects = parse_requests(lines)
    return rows.collect(), {r["request"]: r["reason"] for r in rejects.collect()}


def test_good_requests(parsed):
    got = {(r["request"], r["row"]): r["HR"] for r in parsed[0]}
    assert got == {("good", 0): 60.0, ("good", 1): 61.5, ("flat", 0): 62.0, ("shuffled", 0): 63.0, ("bad_number", 0): None}
    assert {r["Patient_ID"] for r in parsed[0]} == {"p1"}


def test_refused_requests(parsed):
    assert parsed[1] == {
        "empty": "no JSON payload", "blank": "no JSON payload", "no_data": "'data' field is missing",
        "no_columns": "'columns' field is missing", "extra": "extra or missing columns: Extra",
        "missing": "extra or missing columns: HR", "narrow": "invalid input shape",
    }


def test_request_round_trip(spark, psv):
    df = readers.patient_files(spark, psv).withColumns({"request": F.col("Patient_ID"), "row": F.col("ICULOS") - 1})
    lines = as_request(df, S.REQUEST_COLUMNS, rows_per_request=1)
    assert lines.count() == 4
    rows, rejects = parse_requests(lines)
    assert rejects.count() == 0
    names = S.REQUEST_COLUMNS
    assert sorted(map(str, rows.select(names).collect())) == sorted(map(str, df.select(names).collect()))


def test_two_writers_get_a_version_each(spark, tmp_path):
    from multiprocessing.pool import ThreadPool

    data = [writers.Versioned(spark, f"{tmp_path}/data") for _ in range(6)]
    staged = [d.stage(spark.range(i + 1)) for i, d in enumerate(data)]
    with ThreadPool(6) as pool:
        pool.map(lambda x: x[0].switch(x[1]), zip(data, staged))
    pointers = data[0]._pointers().orderBy("version").collect()
    assert [p["version"] for p in pointers] == [1, 2, 3, 4, 5, 6]
    assert {p["path"] for p in pointers} == set(staged)
    assert [p["parent"] for p in pointers] == [None, 1, 2, 3, 4, 5]


def test_a_batch_is_in_the_log_once(spark, tmp_path):
    log = writers.BatchLog(spark, f"{tmp_path}/log")
    for batch, n in ((0, 3), (1, 4), (0, 3)):
        assert log.append(spark.range(n).withColumn("created_at", F.current_timestamp()), batch).count() == n
    spark.range(50).withColumn("created_at", F.current_timestamp()).write.parquet(f"{log.folder}/rows/batch=2/attempt=a-lost")
    got = {r["batch"]: r["count"] for r in log.read().groupBy("batch").count().collect()}
    assert got == {0: 3, 1: 4}
    assert not writers.create_file(spark, f"{log.folder}/ledger/0.json", "{}")


def test_generated_code_of_request_rows_can_be_compiled(spark, capsys):
    """The JVM never compiles a method of more than 8,000 bytes."""
    import re

    from wardflow.plans import model_catalog
    from wardflow.session import settings

    with settings(spark, {"spark.sql.adaptive.enabled": False}):
        model_catalog.request_parse(spark, "/root/testdata/sf0.001").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_cells_that_do_not_parse_are_null_one_by_one(spark):
    names = list(reversed(S.REQUEST_COLUMNS))
    cells = {"HR": "81.5", "Temp": "warm", "Gender": "1", "ICULOS": "1.5", "Age": None, S.KEY: "p1"}
    body = json.dumps({"data": [[cells.get(n) for n in names]], "columns": names})
    rows, rejects = parse_requests(spark.createDataFrame([("r", body)], "request string, value string"))
    (row,) = rows.collect()
    assert (row.HR, row.Temp, row.Gender, row.ICULOS, row.Age, row[S.KEY], row.row) == (81.5, None, 1, None, None, "p1", 0)
    assert rejects.count() == 0
