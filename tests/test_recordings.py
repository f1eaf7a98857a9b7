"""Raw files to segment tables on small folders that hold every edge case."""

import pytest
from pyspark.sql import functions as F

from cohortwave.functions import names
from cohortwave.functions.scalars import signed_log1p
from cohortwave.operators import quality, segments
from cohortwave.plans.recordings import build_segments
from cohortwave.sources import readers, writers

COLUMNS = ["Timestamp", "MarkerIndex", "EEG.Interpolated", "CQ.Overall", "CQ.AF3", "CQ.F7", "POW.AF3.Theta", "PM.Focus.Scaled"]
SPEC = quality.QualitySpec("subject", "EEG_Interpolated", "CQ_Overall", ["CQ_AF3", "CQ_F7"])


def line(ts, marker="", interpolated=0, overall=0.9, af3=4, f7=4, theta=1.0, focus=0.5):
    return ",".join(str(v) for v in (ts, marker, interpolated, overall, af3, f7, theta, focus))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("cohort")

    def subject(name, rows, markers):
        folder = base / name
        folder.mkdir()
        (folder / "data.csv").write_text("\n".join(["title: " + name, ",".join(COLUMNS), *rows]) + "\n")
        (folder / "marker.csv").write_text("\n".join(["marker_id,type", *markers]) + "\n")

    subject("ba01", [
        line(1, 1), line(2, theta=3.0), line(3, theta="abc"), line(4, theta="NaN"), line(5, -1, theta=5.0),
        line(6, 2, interpolated=1), line(7, -2),           # the start lies on a bad sample
        line(10, -3), line(11, 3),                         # the end comes first
        line(12, 4), line(13, theta=""), line(14, -4),     # not a reference task
        line(20, 5, theta=""), line(21, -5, theta=""),     # reference feature missing throughout
        line(30, 6, theta=9.0), line(31, 7, theta=2.0), line(32, f7=""), line(33, -6, theta=4.0), line(34, -7, theta=1.0),
        line(40, overall=0.5),
    ], ["1,Image_happy ", "2,gyrus_coord", "3,valdo1", "4,phase_calibration", "5,temporal1", "6,prefrontal1",
        "7,first name", "7,prefrontal2"])
    subject("BA02", [line(1, 1, overall=95), line(2, overall=69, theta=100.0), line(3, -1, overall=70, theta=2.0)],
            ["1,image_happy"])
    subject("ba03", [line(1, 1, overall=""), line(2, -1, overall="")], ["1,image_happy"])
    (base / "meta.csv").write_text(
        "title\nID;Average Sleep Hours per Night;Gender\nba01;6,5;M\n BA02 ;8;F\n;7;F\nba03;x;M\n")
    (base / "stimuli.csv").write_text(
        "original_stimuli_name,description,cognitive_domain\n Image_Happy,a,b\nvaldo1,,\ngyrus_coord,,\ntemporal1,,\n"
        "prefrontal1,,\nprefrontal2,,\neyesopen,,\n")
    return str(base)


@pytest.fixture(scope="module")
def tables(spark, root):
    rec = readers.read_recordings(spark, f"{root}/*/data.csv", COLUMNS).withColumnsRenamed(
        {"Timestamp": "ts", "MarkerIndex": "marker"})
    lines = readers.read_markers(spark, f"{root}/*/marker.csv")
    markers = segments.last_wins_lookup(lines, ["subject", "marker_id"], "task", ["block", "line"])
    meta = readers.read_metadata(spark, f"{root}/meta.csv")
    allowed = readers.read_lookup(spark, f"{root}/stimuli.csv", exclude=("eyesopen", "eyesclose"))
    return rec, markers, meta, allowed


def test_readers(tables):
    rec, markers, meta, allowed = tables
    assert {r["subject"]: r["count"] for r in rec.groupBy("subject").count().collect()} == {"BA01": 20, "BA02": 3, "BA03": 2}
    assert {r["ts"] for r in rec.where("subject = 'BA01' and POW_AF3_Theta is null").collect()} == {3, 4, 13, 20, 21}
    assert markers.where("subject = 'BA01' and marker_id = 7").first()["task"] == "prefrontal2"
    assert {(r["subject"], r["hours"], r["gender"]) for r in meta.collect()} == \
        {("BA01", 6.5, "M"), ("BA02", 8.0, "F"), ("BA03", None, "M")}
    assert "eyesopen" not in {r["task"] for r in allowed.collect()}


def test_quality_scale_is_per_recording(tables):
    ok = quality.quality_mask(tables[0], SPEC).where("ok")
    assert [r["ts"] for r in ok.where("subject = 'BA02'").orderBy("ts").collect()] == [1, 3]
    assert ok.where("subject = 'BA03'").isEmpty()
    assert ok.where("subject = 'BA01' and ts in (6, 32, 40)").isEmpty()


def test_segments(spark, tables):
    out = build_segments(*tables, SPEC, ["POW_AF3_Theta", "PM_Focus_Scaled"], "POW_AF3_Theta")
    status = {(r["subject"], r["marker_id"]): r for r in out.diagnostics.collect()}
    assert {k: v["status"] for k, v in status.items()} == {
        ("BA01", 1): "ok", ("BA01", 2): "missing_start_or_end", ("BA01", 3): "bad_timestamps",
        ("BA01", 4): "not_allowed_by_reference_tasks", ("BA01", 5): "all_reference_fft_nan",
        ("BA01", 6): "ok", ("BA01", 7): "ok", ("BA02", 1): "ok", ("BA03", 1): "missing_start_or_end"}
    assert (status["BA01", 1]["segment_rows"], status["BA01", 1]["duration_ticks"]) == (5, 4)
    assert (status["BA01", 1]["raw_rows"], status["BA01", 1]["clean_rows"]) == (20, 17)
    assert status["BA01", 3]["t_start"] == 11 and status["BA01", 5]["t_start"] is None

    windows = out.windows.where("subject = 'BA01' and marker_id = 1").orderBy("window_index").collect()
    assert [r["window_index"] for r in windows] == [1, 2, 5]   # numbered before rows were dropped
    assert windows[-1]["window_id"] == "Image_happy -BA01-window5"
    medians = {(r["subject"], r["task"]): r for r in out.medians.collect()}
    first = medians["BA01", "Image_happy "]
    assert (first["POW_AF3_Theta"], first["num_windows"], first["hours"], first["gender"]) == (3.0, 3, 6.5, "M")
    assert medians["BA02", "image_happy"]["POW_AF3_Theta"] == 1.5
    # overlapping segments share rows
    assert medians["BA01", "prefrontal1"]["num_windows"] == 3 and medians["BA01", "prefrontal2"]["num_windows"] == 3


def test_manifest_and_skipped_subjects(spark, root, tables):
    manifest = spark.createDataFrame([("S1", f"{root}/ba01/data.csv"), ("S2", f"{root}/BA02/data.csv")],
                                     "Subject_ID string, Data_File string")
    rec, missing = readers.read_by_manifest(spark, manifest, COLUMNS)
    assert missing.isEmpty()
    report = {r["subject"]: r for r in quality.quality_report(rec, SPEC).collect()}
    assert report["S1"]["usable_pct"] == 95.0 and report["S2"]["overall_pass_pct"] == 66.67
    expected = spark.createDataFrame([("BA01",), ("BA99",)], "subject string")
    loaded, skipped = readers.read_tolerant(spark, f"{root}/*/data.csv", expected, COLUMNS)
    assert [tuple(r) for r in skipped.collect()] == [("BA99", "no file")] and loaded.count() == 25
    assert readers.resolve_root(spark, f"{root}/none", root) == root
    with pytest.raises(FileNotFoundError):
        readers.resolve_root(spark, f"{root}/none")


def test_columns_are_found_by_name(spark, tmp_path):
    header = "Timestamp,EEG.Counter,MarkerIndex,EEG.AF3,CQ.Overall"
    for folder, text in {"a1": f"title: x\n{header}\n1,7,11,4200,90\n", "a 2": "title: x\nCQ.Overall,MarkerIndex,Timestamp\n80,12,2\n"}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data.csv").write_text(text)
    names_ = ["Timestamp", "MarkerIndex", "CQ.Overall"]
    rows = {tuple(r) for r in readers.read_recordings(spark, f"{tmp_path}/*/data.csv", names_).collect()}
    assert rows == {("A1", 1.0, 11.0, 90.0), ("A%202", 2.0, 12.0, 80.0)} or rows == {("A1", 1.0, 11.0, 90.0), ("A 2", 2.0, 12.0, 80.0)}
    with pytest.raises(ValueError, match="no column CQ.AF4"):
        readers.read_recordings(spark, f"{tmp_path}/*/data.csv", [*names_, "CQ.AF4"])
    manifest = spark.createDataFrame([("S1", f"{tmp_path}/a1/data.csv"), ("S2", f"file:{tmp_path}/a 2/data.csv"),
                                      ("S3", f"{tmp_path}/a3/data.csv")], "Subject_ID string, Data_File string")
    rec, missing = readers.read_by_manifest(spark, manifest, names_)
    assert {tuple(r) for r in rec.collect()} == {("S1", 1.0, 11.0, 90.0), ("S2", 2.0, 12.0, 80.0)}
    assert [r["subject"] for r in missing.collect()] == ["S3"]


def test_a_cut_file_leaves_its_subject_out(spark, tmp_path):
    import gzip
    body = "title: x\nTimestamp,MarkerIndex\n" + "".join(f"{i},{i * 7919 % 1000}\n" for i in range(50_000))
    for folder, share in (("b1", 1.0), ("b2", 0.5)):
        (tmp_path / folder).mkdir()
        data = gzip.compress(body.encode())
        (tmp_path / folder / "data.csv.gz").write_bytes(data[: int(len(data) * share)])
    expected = spark.createDataFrame([("B1",), ("B2",), ("B3",)], "subject string")
    loaded, skipped = readers.read_tolerant(spark, f"{tmp_path}/*/data.csv.gz", expected, ["Timestamp", "MarkerIndex"])
    assert {r["subject"]: r["count"] for r in loaded.groupBy("subject").count().collect()} == {"B1": 50_000}
    reasons = dict(map(tuple, skipped.collect()))
    assert set(reasons) == {"B2", "B3"} and reasons["B3"] == "no file" and "EOF" in reasons["B2"]


def test_a_cut_file_is_never_read_in_part(spark, tmp_path):
    """The head of the file is whole, so only reading on tells; a space stands in its path."""
    import gzip
    numbers = [f"{i};{i * 7919 % 1000}" for i in range(50_000)]
    heads_ = {"data": ("title: x\nTimestamp,MarkerIndex\n", ","), "marker": ("marker_id,type\n", ","),
              "meta": ("title\nID;Average Sleep Hours per Night;Gender\n", ";"),
              "lookup": ("original_stimuli_name,description,cognitive_domain\n", ",")}
    for folder, share in (("c1", 1.0), ("c 2", 0.5)):
        (tmp_path / folder).mkdir()
        for name, (head, sep) in heads_.items():
            data = gzip.compress((head + "".join(x.replace(";", sep) + "\n" for x in numbers)).encode())
            (tmp_path / folder / f"{name}.csv.gz").write_bytes(data[: int(len(data) * share)])
    wanted = ["Timestamp", "MarkerIndex"]
    reads = {"data": lambda p: readers.read_recordings(spark, p, wanted), "marker": lambda p: readers.read_markers(spark, p),
             "meta": lambda p: readers.read_metadata(spark, p), "lookup": lambda p: readers.read_lookup(spark, p)}
    for name, read in reads.items():
        assert read(f"{tmp_path}/c1/{name}.csv.gz").count() == 50_000
        with pytest.raises(Exception):
            read(f"{tmp_path}/*/{name}.csv.gz").collect()
    manifest = spark.createDataFrame([(f, f"{tmp_path}/{f}/data.csv.gz") for f in ("c1", "c 2")], "Subject_ID string, Data_File string")
    rec, missing = readers.read_by_manifest(spark, manifest, wanted)
    assert {r["subject"]: r["count"] for r in rec.groupBy("subject").count().collect()} == {"c1": 50_000}
    assert [r["subject"] for r in missing.collect()] == ["c 2"] and "EOF" in missing.first()["problem"]
    loaded, skipped = readers.read_tolerant(spark, f"{tmp_path}/*/data.csv.gz", manifest.selectExpr("upper(Subject_ID) as subject"), wanted)
    assert loaded.count() == 50_000 and sum("EOF" in r["reason"] for r in skipped.collect()) == 1


def test_downsample_even_spacing(spark):
    rows = [("a", i, i + 1) for i in range(80)] + [("b", i, i + 1) for i in range(81)] + [("c", i, i + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "seg string, ts long, window_index long")
    out = segments.downsample_even(df, ["seg"], ["ts"], 80)
    for seg, n in (("a", 80), ("b", 81), ("c", 500)):
        kept = out.where(F.col("seg") == seg).orderBy("ts").collect()
        want = list(range(80)) if n == 80 else [i * (n - 1) // 79 for i in range(80)]
        assert [r["ts"] for r in kept] == want
        assert [r["window_index_downsampled"] for r in kept] == list(range(1, 81))


def test_names_and_scalars(spark):
    assert len(readers.recording_columns()) == 4 + 14 + 70 + 7
    cols = [names.spark_name(c) for c in names.power_columns()]
    assert sorted(names.band_columns(cols)) == ["Alpha", "Beta", "Gamma", "Theta"]
    assert len(names.band_columns(cols)["Beta"]) == 28 and len(names.channel_columns(cols)["AF3"]) == 5
    catalog = names.feature_catalog(spark, ["POW.AF3.Theta", "PM.Focus.Scaled"]).collect()
    assert tuple(catalog[0]) == ("POW_AF3_Theta", "POW", "AF3", "Theta")
    df = spark.createDataFrame([(-3.0,), (0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(signed_log1p(F.col("x"))).collect()]
    assert got[0] == pytest.approx(-1.3862943611) and got[1] == 0 and got[2] is None
    with pytest.raises(ValueError, match="missing 1 columns"):
        names.require_columns(df, ["x", "z"])


def test_write_table_keeps_spaces(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1)], "name string, n int")
    writers.write_table(df, f"{tmp_path}/t", "csv")
    back = spark.read.schema("name string, n int").option("header", True).csv(f"{tmp_path}/t")
    assert back.first()["name"] == " a "
