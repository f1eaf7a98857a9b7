"""Writers of tables, metric reports and models."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heads import is_there, store_of

FILE_ROWS = 5_000_000
FOLDERS_PER_TASK = 500
# files go to their place as each task ends, side by side, and not one after the other when all have ended
AT_ONCE = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def deal_folders(df: DataFrame, folder: list[str], file_rows: int = FILE_ROWS, per_task: int = FOLDERS_PER_TASK,
                 whole: bool = False) -> DataFrame:
    """Rows dealt so that a folder's lie in one task, and a large folder's in several of about ``file_rows`` rows, unless it is to stay ``whole``.

    Without it every task writes a file to every folder it meets. The number of tasks grows with that of folders, as opening files is the work.
    """
    sizes = df.groupBy(*folder).agg(F.count(F.lit(1)).alias("n"))
    count, largest, rows = sizes.agg(F.count("n"), F.max("n"), F.sum("n")).first()
    parts = 1 if whole else (largest or 0) // file_rows + 1
    tasks = max(1, math.ceil(count * parts / per_task), math.ceil((rows or 0) / file_rows))
    own = [F.pmod(F.xxhash64(*df.columns), F.lit(parts))] if parts > 1 else []
    return df.repartition(tasks, *folder, *own)


def texts_by_folder(path: str, head: bytes, name: str = "part-0.txt"):
    """Rows (folder, value) sorted by folder to one text file per folder, ``head`` first; gives the number of files.

    Files are written batch by batch, as Spark's own writer spends most of its time on making each of very many small files. Their names are fixed,
    so a task that is repeated writes the same files again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(path)
        own = name.format(task=TaskContext.get().partitionId())
        now, out, files = None, None, 0
        for batch in batches:
            names = batch.column("folder")
            lines = batch.column("value").to_pylist()
            ends = [0, *(pc.indices_nonzero(pc.not_equal(names[1:], names[:-1])).to_numpy() + 1).tolist(), len(names)]
            for low, high in zip(ends, ends[1:]):
                if low < high and names[low].as_py() != now:
                    if out is not None:
                        out.close()
                    now, files = names[low].as_py(), files + 1
                    store.create_dir(f"{base}/{now}", recursive=True)
                    out = store.open_output_stream(f"{base}/{now}/{own}", compression=None)
                    out.write(head)
                out.write(("\n".join(lines[low:high]) + "\n").encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": [files]}, pa.schema([("files", pa.int64())]))

    return run


TEXT = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # names and texts are kept as they are, spaces included
FOLDERS_OF_TEXTS = 2_000
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_value(value: str | None) -> str:
    """A partition's value as Spark spells it in the folder's name."""
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE


def _write_csv_folders(df: DataFrame, path: str, folder: list[str]) -> None:
    """The files that Spark's writer makes, with a header line, in tasks that each write many folders."""
    cells = [c for c in df.columns if c not in folder]
    head = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(cells)]), TEXT)).first()[0]
    dealt = deal_folders(df, folder, per_task=FOLDERS_OF_TEXTS)

    @F.pandas_udf("string")
    def spelled(values: pd.Series) -> pd.Series:
        own = {v: folder_value(v) for v in values.unique()}
        return pd.Series([own[v] for v in values], dtype=object)

    parts = [F.concat(F.lit(f"{c}="), spelled(F.col(f"`{c}`").cast("string"))) for c in folder]
    rows = dealt.select(F.concat_ws("/", *parts).alias("folder"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells]), TEXT).alias("value"))
    rows.sortWithinPartitions("folder").mapInArrow(texts_by_folder(path, f"{head}\n".encode(), "part-{task:05d}.csv"), "files long").agg(F.sum("files")).collect()
    store, base = store_of(path)
    store.create_dir(base, recursive=True)
    store.open_output_stream(f"{base}/_SUCCESS").close()


def _can_open(path: str) -> bool:
    try:
        store_of(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (), mode: str = "overwrite") -> None:
    if partition_by and fmt == "csv" and _can_open(path) and not is_there(path):
        _write_csv_folders(df, path, list(partition_by))
        return
    if partition_by:
        df = deal_folders(df, list(partition_by))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).options(**TEXT)
    if partition_by:
        writer = writer.partitionBy(*partition_by).options(**AT_ONCE)
    writer.save(path)


def tidy_metrics(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """One row per metric: ids, metric, value."""
    values = [c for c in metrics.columns if c not in ids]
    numbers = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return numbers.unpivot(ids, values, "metric", "value")


def write_metrics(metrics: DataFrame, path: str, ids: list[str], fmt: str = "parquet") -> None:
    write_table(tidy_metrics(metrics, ids), path, fmt)


def save_model(model: PipelineModel, path: str) -> None:
    """The model with its feature order, which its assembler holds."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
