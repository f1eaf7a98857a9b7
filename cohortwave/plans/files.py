"""Cohort folders written from the given tables, for the readers to read back."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import shared_dir
from ..sources.heads import listed, spread, store_of
from ..sources.writers import FILE_ROWS, deal_folders, texts_by_folder


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


FOLDERS_PER_TASK = 2_000


def chunk(df: DataFrame, subject: str, key: str, rows: int = FILE_ROWS) -> Column:
    """A chunk number that keeps any one file of a subject near ``rows`` rows."""
    largest = df.groupBy(subject).count().agg(F.max("count")).first()[0] or 0
    return F.pmod(F.xxhash64(key), F.lit(largest // rows + 1)).cast("int")


def write_titled(df: DataFrame, path: str, folder: list[str], header: str, cells: list[Column], sep: str = ",",
                 title: str = "title: cohort recording") -> str:
    """One text file per folder value: a title line, the header line, then the rows.

    ``folder`` names the columns that make the folders; give a large subject several.
    """
    line = F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    name = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in folder])
    run = texts_by_folder(path, f"{title}\n{header}\n".encode())
    rows = deal_folders(df.select(name.alias("folder"), line.alias("value")), ["folder"], per_task=FOLDERS_PER_TASK, whole=True)
    rows.sortWithinPartitions("folder").mapInArrow(run, "files long").agg(F.sum("files")).collect()
    return path


def copy_compressed(spark, paths: str, folder: str, subject_pattern: str, cut_every: int) -> str:
    """Compressed copies of the files; those of every ``cut_every``-th subject end in the middle. A task that is repeated writes the same files again."""
    def run(batches):
        store, base = store_of(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            for path in names:
                subject = re.search(subject_pattern, path)[1]
                own, place = store_of(path)
                with own.open_input_stream(place, compression=None) as stream:
                    data = gzip.compress(stream.read(), 1)
                store.create_dir(f"{base}/subject={subject}", recursive=True)
                with store.open_output_stream(f"{base}/subject={subject}/{hashlib.md5(path.encode()).hexdigest()}.gz", compression=None) as out:
                    out.write(data[: len(data) // 2] if int(subject) % cut_every == 0 else data)
            yield pa.RecordBatch.from_pydict({"files": [len(names)]}, pa.schema([("files", pa.int64())]))

    spread(listed(spark, paths), "size").mapInArrow(run, "files long").agg(F.sum("files")).collect()
    return folder
