"""Readers of recordings, markers, metadata, lookups and prepared tables.

A cohort lies as one folder per subject under a root. Recording and metadata files carry a
title line above the header line.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import metric_columns, power_columns, quality_columns, spark_name
from ..functions.scalars import clean_key, nan_to_null, to_double
from ..operators.scale import attach, settle
from .heads import by_name, heads, is_there, lines, listed, split_header

TIME, MARKER, INTERPOLATED, OVERALL = "Timestamp", "MarkerIndex", "EEG.Interpolated", "CQ.Overall"


def recording_columns() -> list[str]:
    return [TIME, MARKER, INTERPOLATED, OVERALL, *quality_columns(), *power_columns(), *metric_columns()]


SUBJECT_FOLDER = r"([^/]+)/[^/]+$"


def subject_from_path(pattern: str = SUBJECT_FOLDER) -> Column:
    """Subject id from the folder a file lies in, in upper case."""
    return F.upper(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def resolve_root(spark: SparkSession, *roots: str) -> str:
    """The first root that exists, on whatever file system it names.

    Spark lists a whole tree to say yes; it is asked only about a path that is not found without it.
    """
    for root in roots:
        if is_there(root):
            return root
        try:
            spark.read.format("binaryFile").load(root)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            return root
    raise FileNotFoundError(f"none of {list(roots)} exists")


def _found(spark: SparkSession, paths, line: int) -> DataFrame:
    """The heads of files that must all be readable, with the file's name as ``_path``."""
    found = settle(heads(listed(spark, paths), line))
    _all_readable(found)
    return found.withColumn("_path", F.col("file"))


def _named_csv(found: DataFrame, columns: list[str], carried: list[str] = (), sep: str = ",", titled: bool = True) -> DataFrame:
    """The wanted columns, as text, of files that may differ in what else they hold and in what order.

    With ``titled`` line 1 is a title and line 2 the header. The heads of all files are in ``found``; there are as many
    branches as different headers. A file without a wanted column is an error that names both. Columns of ``found`` in ``carried`` go along
    with each line, and ``_block`` is where its piece of the file begins. Files without a header are not read; any other that cannot be read to its end is an error.
    """
    found = settle(found)
    kinds = [r[0] for r in found.where("header is not null").select("header").distinct().orderBy("header").collect()]
    headers = [split_header(h, sep) for h in kinds]
    lacking = [(i, [c for c in columns if c not in h]) for i, h in enumerate(headers)]
    for i, names in lacking:
        if names:
            example = found.where(F.col("header") == kinds[i]).first()["file"]
            raise ValueError(f"{example} has no column {', '.join(names)}")
    if not headers:
        return found.sparkSession.createDataFrame([], T.StructType([*[found.schema[c] for c in carried], T.StructField("_block", T.LongType()),
                                                                    *_text_schema(columns)]))
    number = F.create_map(*[x for i, h in enumerate(kinds) for x in (F.lit(h), F.lit(i))])
    known = found.where("header is not null").withColumn("_kind", number[F.col("header")])
    wide = ", ".join(f"_c{i} string" for i in range(max(map(len, headers))))
    rows = lines(known, [*carried, "_kind"]).withColumn("_cells", F.from_csv("_line", wide, {"sep": sep, "mode": "PERMISSIVE"}))
    rows = rows.select(*carried, "_block", "_kind", "_cells.*")
    out = rows.select(*carried, "_block", *[by_name(rows, headers, F.col("_kind"), c).alias(c) for c in columns])
    if not titled:  # line 1, which is the header, is not among the lines
        return out
    first = F.trim(F.col(f"`{columns[0]}`"))
    return out.where(first.isNull() | (first != columns[0]))


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _numbers(df: DataFrame, columns: list[str]) -> list[Column]:
    return [to_double(F.col(f"`{c}`")).alias(spark_name(c)) for c in columns]


def _subject(pattern: str) -> Column:
    return F.upper(F.regexp_extract(F.col("_path"), pattern, 1)).alias("subject")


def read_recordings(spark: SparkSession, paths, columns: list[str] | None = None,
                    pattern: str = SUBJECT_FOLDER) -> DataFrame:
    """subject and the recording's columns as numbers; what is no number is missing."""
    columns = columns or recording_columns()
    rows = _named_csv(_found(spark, paths, 1).withColumn("subject", _subject(pattern)), columns, ["subject"])
    return rows.select("subject", *_numbers(rows, columns))


def _all_readable(found: DataFrame) -> None:
    bad = found.where("problem is not null").first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: {bad['problem']}")


def read_markers(spark: SparkSession, paths, pattern: str = SUBJECT_FOLDER) -> DataFrame:
    """subject, marker_id and task, and the line's place, by which a repeated id is settled."""
    rows = _named_csv(_found(spark, paths, 0).withColumn("subject", _subject(pattern)), ["marker_id", "type"], ["subject"], titled=False)
    return rows.select("subject", F.col("marker_id").try_cast("double").cast("long").alias("marker_id"),
                       F.col("type").alias("task"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_metadata(spark: SparkSession, paths, columns: list[str] | None = None) -> DataFrame:
    """subject, hours and gender; semicolons, decimal commas, rows without an id dropped."""
    columns = columns or ["ID", "Average Sleep Hours per Night", "Gender"]
    rows = _named_csv(_found(spark, paths, 1), columns, sep=";")
    key, label, gender = (F.col(f"`{c}`") for c in columns[:3])
    return (rows.where(key.isNotNull() & (F.trim(key) != ""))
            .select(clean_key(key, upper=True).alias("subject"),
                    to_double(F.replace(label, F.lit(","), F.lit("."))).alias("hours"), F.trim(gender).alias("gender")))


def read_lookup(spark: SparkSession, paths, key: str = "original_stimuli_name", exclude: tuple[str, ...] = ()) -> DataFrame:
    """The stimuli lookup with its cleaned key ``task``, without the listed resting tasks."""
    rows = _named_csv(_found(spark, paths, 0), [key, "description", "cognitive_domain"], titled=False).drop("_block")
    return with_clean_key(rows, key).where(~F.col("task").isin(list(exclude)) if exclude else F.lit(True))


def with_clean_key(df: DataFrame, key: str, out: str = "task") -> DataFrame:
    return df.withColumn(out, clean_key(F.col(key)))


def read_by_manifest(spark: SparkSession, manifest: DataFrame, columns: list[str] | None = None,
                     subject: str = "Subject_ID", path: str = "Data_File") -> tuple[DataFrame, DataFrame]:
    """The recordings a mapping table names, with the subject it gives them; and its rows whose file cannot be read.

    Rows and files meet by decoded path, so that a space or a differently spelled scheme loses nothing.
    """
    columns = columns or recording_columns()
    named = settle(manifest.select(F.col(subject).alias("subject"), F.col(path).alias("file")))
    tried = settle(heads(named.select("file").where("file is not null").distinct(), 1, whole=True))
    missing = named.join(tried.where("header is not null").select("file"), "file", "left_anti").join(
        tried.select("file", "problem"), "file", "left").select(
        "subject", "file", F.coalesce("problem", F.lit("no file named")).alias("problem"))
    files = tried.where("header is not null").join(named, "file").dropDuplicates(["place", "subject"])
    rows = _named_csv(files, columns, ["subject"])
    return rows.select("subject", *_numbers(rows, columns)), missing


def read_tolerant(spark: SparkSession, paths, expected: DataFrame, columns: list[str] | None = None,
                  subject: str = "subject", pattern: str = SUBJECT_FOLDER) -> tuple[DataFrame, DataFrame]:
    """The recordings of subjects all of whose files are whole, and (subject, reason) of the others.

    Every file is probed first, compressed ones to their end. A subject with a broken file is left out as a whole.
    """
    columns = columns or recording_columns()
    found = settle(heads(listed(spark, paths), 1, whole=True))
    lacking = F.lit(None).cast("string")
    for h in [r[0] for r in found.where("header is not null").select("header").distinct().collect()]:
        names = [c for c in columns if c not in split_header(h, ",")]
        if names:
            lacking = F.when(F.col("header") == h, f"no column {', '.join(names)}").otherwise(lacking)
    found = found.withColumn("problem", F.coalesce("problem", lacking)).withColumn("_path", F.col("file"))
    found = found.withColumn("header", F.when(F.col("problem").isNull(), F.col("header")))
    of = settle(found.select(_subject(pattern), "problem", "file", "place", "header", "size"))
    broken = of.where("problem is not null").groupBy("subject").agg(F.min("problem").alias("reason"))
    broken = settle(broken)
    rows = _named_csv(attach(of.where("problem is null"), broken.select("subject"), ["subject"], "left_anti"), columns, ["subject"])
    loaded = rows.select("subject", *_numbers(rows, columns))
    absent = (expected.select(F.col(subject).alias("subject")).distinct().join(of.select("subject").distinct(), "subject", "left_anti")
              .withColumn("reason", F.lit("no file")))
    return loaded, broken.unionByName(absent).withColumnRenamed("subject", subject)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A prepared feature table; NaN becomes missing once, here."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats})
