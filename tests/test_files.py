"""Many small files: each folder is written by one task, roots are found without listing, files can be written again."""

import gzip
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortwave.plans.files import write_titled
from cohortwave.sources import heads, readers, writers


def test_a_folder_holds_one_file(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).selectExpr("id", "id % 20 AS subject")
    writers.write_table(rows, str(tmp_path / "out"), "parquet", ["subject"])
    files = list((tmp_path / "out").glob("subject=*/*.parquet"))
    assert len(files) == 20
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", F.col("subject").cast("long")).collect())) == sorted(map(tuple, rows.collect()))


def test_a_large_folder_is_dealt_to_several_tasks(spark):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "CASE WHEN id < 900 THEN -1 ELSE id % 10 END AS subject")
    dealt = writers.deal_folders(rows, ["subject"], file_rows=100).withColumn("p", F.spark_partition_id())
    assert dealt.count() == 1000
    assert dealt.where("subject = -1").select("p").distinct().count() > 3
    assert writers.deal_folders(rows, ["subject"], per_task=2).rdd.getNumPartitions() == 6
    assert writers.deal_folders(rows.limit(0), ["subject"]).count() == 0


def test_the_first_root_that_exists_is_found_without_listing_it(spark, tmp_path):
    (tmp_path / "here").mkdir()

    class Lists:
        @property
        def read(self):
            raise AssertionError("the tree was listed")

    assert readers.resolve_root(Lists(), str(tmp_path / "here"), "elsewhere") == str(tmp_path / "here")
    assert readers.resolve_root(spark, f"{tmp_path}/absent", f"file:{tmp_path}/here") == f"file:{tmp_path}/here"


def test_titled_files_are_whole_and_can_be_written_again(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 6).selectExpr("id", "id % 7 AS subject", "id % 2 AS chunk", "nullif(id % 5, 0) AS x")
    for _ in range(2):
        write_titled(rows, str(tmp_path / "t"), ["subject", "chunk"], "a;b", [F.col("id"), F.col("x")], ";", "title")
    files = sorted(Path(tmp_path / "t").glob("*/*/*.txt"))
    assert len(files) == 14
    seen = []
    for f in files:
        lines = f.read_text().split("\n")
        assert lines[:2] == ["title", "a;b"] and lines[-1] == ""
        subject, chunk = (int(p.split("=")[1]) for p in f.parts[-3:-1])
        for line in lines[2:-1]:
            a, b = line.split(";")
            assert int(a) % 7 == subject and int(a) % 2 == chunk and b == (str(int(a) % 5) if int(a) % 5 else "")
            seen.append(int(a))
    assert sorted(seen) == list(range(30_000))


def test_patterns_are_followed_as_sparks_reader_does(spark, tmp_path):
    for at in ("b/subject=1/x.csv", "b/subject=2/x.csv", "b/subject=2/_no.csv", "b/subject=2/.x.csv.crc", "b/subject 3/x.csv", "c/subject=1/y.txt", "c/deep/er/z%.csv", "c/[d]/x.csv"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("a\n1\n")
    for pattern in ("b/*/*.csv", "*/subject=[12]/*", "b", "{b,c}/s*1/?.{csv,txt}", "b/subject=[!1]/x.csv", "c/*", "b/subject 3/x.csv"):
        want = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(f"{tmp_path}/{pattern}").select(F.col("_metadata.file_path")).collect()
        got = heads.listed(spark, f"{tmp_path}/{pattern}")
        assert sorted(r[0] for r in got.select("file").collect()) == sorted(r[0] for r in want) and want
        assert got.where("size = 4").count() == len(want)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        heads.listed(spark, f"{tmp_path}/none/*")


def test_lines_are_those_of_sparks_reader(spark, tmp_path, monkeypatch):
    """Ends of lines, blank lines, a mark of the byte order, quotes, missing and further cells, and files cut into pieces of any size."""
    texts = [b"\xef\xbb\xbfh,i\r\n1,2\r\n\r\n  \n3,\"a,b\"\r4\n", b"\nh,i\n", b"h,i\n" + b"".join(b"%d,%s\r\n" % (i, b"x" * (i % 7)) for i in range(200)), b"h,i\n1,\"\",3,4", b""]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes(text)
    plain = spark.read.schema("_c0 string, _c1 string").option("header", True).csv(f"{tmp_path}/*.csv")
    want = sorted(plain.select(F.col("_metadata.file_path"), "*").collect(), key=str)
    files = heads.listed(spark, f"{tmp_path}/*.csv").withColumn("name", F.col("file"))
    for size in (1 << 20, 2, 3, 13, 100):
        monkeypatch.setattr(heads, "BYTES_PER_TASK", size)
        rows = heads.lines(files, ["name"]).withColumn("c", F.from_csv("_line", "_c0 string, _c1 string", {"mode": "PERMISSIVE"})).select("name", "c.*")
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, want), key=str)
    monkeypatch.setattr(heads, "BATCH_BYTES", 3)
    assert sorted(map(tuple, heads.lines(files, ["name"]).select("name").groupBy("name").count().collect())) == \
        sorted(map(tuple, plain.select(F.col("_metadata.file_path").alias("name")).groupBy("name").count().collect()))


def test_many_folders_are_read_without_the_drivers_list(spark, tmp_path, monkeypatch):
    """Each reader gives the rows and asks Spark for no list of files; the tasks are few."""
    rows = spark.range(0, 3000, 1, 4).selectExpr("id", "id % 600 AS subject", "concat(' a\"', id % 3, ', ') AS type", "id % 9 AS marker_id")
    writers.write_table(rows.select("subject", "marker_id", "type"), str(tmp_path / "m"), "csv", ["subject"])
    plain = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert sorted(map(tuple, plain.select("marker_id", "type", F.col("subject").cast("string")).collect())) == \
        sorted(map(tuple, rows.selectExpr("string(marker_id)", "type", "string(subject)").collect()))
    write_titled(rows, str(tmp_path / "t"), ["subject"], "Timestamp,MarkerIndex", [F.col("id"), F.col("marker_id")])
    asked = []
    monkeypatch.setattr(type(spark.read), "load", lambda *a, **k: asked.append(a))
    monkeypatch.setattr(type(spark.read), "csv", lambda *a, **k: asked.append(a))
    read = readers.read_markers(spark, f"{tmp_path}/m/*/*.csv", r"subject=([^/]+)/")
    assert sorted(map(tuple, read.select("subject", "marker_id", "task").collect())) == \
        sorted(map(tuple, rows.selectExpr("string(subject)", "marker_id", "type").collect()))
    assert read.rdd.getNumPartitions() <= 16
    manifest = heads.listed(spark, f"{tmp_path}/t/*/*.txt").select(F.regexp_extract("file", r"subject=([^/]+)/", 1).alias("Subject_ID"), F.col("file").alias("Data_File"))
    twice = manifest.unionByName(spark.createDataFrame([("none", f"{tmp_path}/none.txt"), ("again", f"{tmp_path}/t/subject=1/part-0.txt")], manifest.schema))
    loaded, missing = readers.read_by_manifest(spark, twice, ["Timestamp", "MarkerIndex"])
    assert loaded.count() == 3005 and loaded.where("subject = 'again'").count() == 5 and [r.subject for r in missing.collect()] == ["none"]
    (tmp_path / "t/subject=7/cut.gz").write_bytes(gzip.compress(b"title\nTimestamp,MarkerIndex\n1,2\n" * 50)[:-9])
    kept, skipped = readers.read_tolerant(spark, f"{tmp_path}/t/*/*", spark.createDataFrame([("1",), ("x",)], "subject string"), ["Timestamp", "MarkerIndex"],
                                          pattern=r"subject=([^/]+)/")
    assert kept.count() == 2995 and kept.where("subject = '7'").isEmpty() and {r.subject for r in skipped.collect()} == {"7", "x"}
    assert not asked


def test_folders_of_csv_are_spelled_as_by_spark(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1, "x"), ("a/b=c%", 2, " y,\"z\" "), ("", 3, ""), (None, 4, None), ("ü:", None, "1")], "k string, v int, `t,u` string")
    writers.write_table(rows, str(tmp_path / "own"), "csv", ["k"])
    rows.write.partitionBy("k").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "spark"))
    texts = [{p.parent.name: sorted(p.read_text().split("\n")) for p in (tmp_path / name).glob("*/*.csv")} for name in ("own", "spark")]
    several = [{k: v for k, v in t.items() if k != "k=__HIVE_DEFAULT_PARTITION__"} for t in texts]
    assert several[0] == several[1] and len(several[0]) == 3
    back = [sorted(map(str, spark.read.option("header", True).csv(f"{tmp_path}/{name}").collect())) for name in ("own", "spark")]
    assert back[0] == back[1] and (tmp_path / "own/_SUCCESS").exists()
