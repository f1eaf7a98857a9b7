"""Very many text files: which there are, which columns each one holds, whether it can be read to its end, and its lines.

Files of a cohort come from several exports, whose columns differ in number and order. One job
reads the first lines of every file; the readers then take columns by name.

Folders are listed and files are opened in tasks, many a task: the driver never holds the names of the files, and no file is a task.
"""

from __future__ import annotations

import csv
import gzip
import io
import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import settle

SCHEMA = "file string, place string, header string, problem string, size long"
FILES_PER_TASK = 1_000
BYTES_PER_TASK = 128 << 20   # also where a large plain file is cut
FOLDERS = 200                # folders from which on the rest of a pattern is followed side by side
BATCH_BYTES = 4 << 20


def place_of(path: str) -> str:
    """The path without scheme and authority, decoded: what two spellings of one file share."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    return re.sub("/+", "/", bare if bare == path else unquote(bare))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("^[A-Za-z][A-Za-z0-9+.-]*:", path):
        scheme, _, rest = path.partition(":")
        uri = "file://" + re.sub("^/+", "/", rest) if scheme == "file" else path
        return (fs.LocalFileSystem(), place_of(uri)) if scheme == "file" else fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


def is_there(path: str) -> bool:
    """Whether the path is found without Spark; what is not may still lie in a store that only Spark can open."""
    try:
        store, base = store_of(path)
        return store.get_file_info(base).type != fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def _open(path: str) -> io.BufferedIOBase:
    store, base = store_of(path)
    raw = store.open_input_stream(base, compression=None, buffer_size=1 << 16)
    return gzip.GzipFile(fileobj=raw) if base.endswith(".gz") else io.BufferedReader(raw)


def _probe(path: str, line: int, whole: bool) -> tuple[str | None, str | None]:
    """Header line and what is wrong with the file. A compressed file is read to its end if ``whole``."""
    try:
        with _open(path) as stream:
            lines = [stream.readline() for _ in range(line + 1)]
            if whole and path.endswith(".gz"):
                while stream.read(1 << 20):
                    pass
        header = lines[line].decode("utf-8-sig" if line == 0 else "utf-8", "replace").strip("\r\n")
        return (header, None) if header else (None, "no header line")
    except (OSError, EOFError, zlib.error) as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def spread(rows: DataFrame, size: str | None = None) -> DataFrame:
    """A row per file dealt to tasks by number and, where it is known, by size; few files to as many tasks as there are cores."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum(size) if size else F.lit(0)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-count // FILES_PER_TASK), -(-(total or 0) // BYTES_PER_TASK), min(cores, -(-count // 16))))


def heads(files: DataFrame, line: int, whole: bool = False) -> DataFrame:
    """(file, place, header, problem, size) per row of ``files``, which has the paths in ``file``."""
    def size_of(path: str) -> int | None:
        try:
            store, base = store_of(path)
            return store.get_file_info(base).size
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f, place_of(f), *_probe(f, line, whole), size_of(f)) for f in pdf["file"]]
            yield pd.DataFrame(found, columns=["file", "place", "header", "problem", "size"]).astype({"size": "Int64"})

    sized = whole and "size" in files.columns
    return spread(files.select("file", "size") if sized else files.select("file"), "size" if sized else None).mapInPandas(run, SCHEMA)


# --- listing

def alternatives(pattern: str) -> list[str]:
    """A pattern without its outer braces, once per alternative."""
    low = re.search(r"(?<!\\)\{", pattern)
    if low is None:
        return [pattern]
    depth, cuts = 0, [low.start()]
    for i in range(low.start(), len(pattern)):
        c = pattern[i]
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 1:
            cuts.append(i)
        if depth == 0:
            cuts.append(i)
            return [x for a, b in zip(cuts, cuts[1:]) for x in alternatives(pattern[: low.start()] + pattern[a + 1 : b] + pattern[i + 1 :])]
    raise ValueError(f"{pattern} has an open brace")


def _matcher(part: str) -> re.Pattern | None:
    """What a part of a path with wildcards stands for; None for a plain name."""
    if not re.search(r"[*?\[]", part):
        return None
    text = re.sub(r"\\.|\*|\?|\[[\^!]?[^\]]+\]|.", lambda m: {"*": ".*", "?": "."}.get(m[0]) or (
        re.sub(r"^\[!", "[^", m[0]) if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0][-1])), part, flags=re.S)
    return re.compile(text, re.S)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _inside(store: fs.FileSystem, at: str) -> Iterator[fs.FileInfo]:
    """The files of a folder and those below it."""
    for e in store.get_file_info(fs.FileSelector(at)):
        if not _hidden(e.base_name):
            yield from _inside(store, e.path) if e.type == fs.FileType.Directory else [e]


def _follow(store: fs.FileSystem, at: str, rest: str, once: bool) -> Iterator[tuple[str, str | None, int | None]]:
    """(path, rest, size) of what a path and the rest of a pattern lead to; with ``once`` only up to the next wildcard. A file has no rest."""
    part, _, later = rest.partition("/")
    if not rest:
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            yield from ((e.path, None, e.size) for e in _inside(store, at))
        elif info.type != fs.FileType.NotFound and not _hidden(info.base_name):
            yield at, None, info.size
        return
    match = _matcher(part)
    if match is None:
        yield from _follow(store, f"{at}/{part}", later, once)
        return
    for e in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if not match.fullmatch(e.base_name):
            continue
        if e.type == fs.FileType.Directory:
            if once:
                yield e.path, later, None
            else:
                yield from _follow(store, e.path, later, once)
        elif not later and not _hidden(e.base_name):
            yield e.path, None, e.size


def spelled(path: str) -> str:
    """A path as Spark names files: what a URI may not hold is escaped."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=/@\u00a1-\U0010ffff]", lambda m: quote(m[0]), path)


def _step(once: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores: dict[str, fs.FileSystem] = {}
        for pdf in batches:
            for root, at, rest in zip(pdf["root"], pdf["at"], pdf["rest"]):
                if root not in stores:
                    stores[root] = fs.LocalFileSystem() if root == "file://" else fs.FileSystem.from_uri(root + "/")[0]
                held = []
                for found in _follow(stores[root], at, rest, once):
                    held.append((root, *found))
                    if len(held) == 10_000:
                        yield _paths(held)
                        held = []
                yield _paths(held)

    return run


def _paths(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["root", "at", "rest", "size"]).astype({"size": "Int64"})


def listed(spark: SparkSession, paths) -> DataFrame:
    """(file, size) of the files of one or several paths or patterns, without reading them. Written.

    Wildcards are followed one after the other until there are many folders, whose rest is then followed in tasks.
    """
    start = []
    for path in [paths] if isinstance(paths, str) else list(paths):
        root, bare = re.match("^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(.*)$", path, re.S).groups()
        root = "file://" if not root or root.startswith("file:") else root
        for one in alternatives(os.path.abspath(bare) if root == "file://" else bare):
            start.append((root, "", one.lstrip("/")))
    plan = "root string, at string, rest string, size long"
    todo, found = spark.createDataFrame(start, "root string, at string, rest string"), []
    count = len(start)
    while count:
        many = count >= FOLDERS
        done = settle((spread(todo) if many or found else todo.coalesce(1)).mapInPandas(_step(not many), plan))
        found.append(done.where("rest IS NULL").select("root", "at", "size"))
        todo = done.where("rest IS NOT NULL").select("root", "at", "rest")
        count = todo.count()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    name = F.udf(lambda root, at: ("file:" if root == "file://" else root) + spelled(at))
    out = settle(out.select(name("root", "at").alias("file"), "size"))
    if out.isEmpty():
        spark.read.format("binaryFile").load(paths)  # says what is not there
    return out


# --- lines

def _split(stream, start: int, end: int | None) -> Iterator[bytes]:
    """The lines that begin at ``start`` or later and before ``end``; a line ends as for Spark's readers at LF, CR or both."""
    at, rest = start, b""
    if start:
        stream.seek(start - 1)
        at, skip = start - 1, True
    else:
        skip = False
    while True:
        data = stream.read(BATCH_BYTES)
        rest += data
        whole = rest.splitlines(keepends=True)
        # what may go on in the next read
        keep = b"" if not data else whole.pop() if whole and (not whole[-1].endswith(b"\n")) else b""
        for line in whole:
            if skip:
                skip = False
            elif end is not None and at >= end:
                return
            else:
                yield line.rstrip(b"\r\n") if line.endswith((b"\n", b"\r")) else line
            at += len(line)
        rest = keep
        if not data:
            return


def _read_lines(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        rows: list[tuple[int, dict]] = []
        size = 0

        def close() -> pa.RecordBatch:
            columns = [pa.array([v for n, row in rows for v in [row[c]] * n], kinds[c]) for c in carried]
            blocks = pa.array([v for n, row in rows for v in [row["start"]] * n], pa.int64())
            return pa.RecordBatch.from_arrays([*columns, blocks, pa.array(held, pa.string())], [*carried, "_block", "_line"])

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in carried}
            for row in batch.to_pylist():
                count = 0
                with _open(row["file"]) if row["until"] is None else _seekable(row["file"]) as stream:
                    first = row["start"] == 0
                    for line in _split(stream, row["start"], row["until"]):
                        if first and count == 0:
                            line = line.removeprefix(b"\xef\xbb\xbf")
                        if not line.strip(BLANK):
                            continue
                        if first:  # as Spark's reader does with a header
                            first = False
                            continue
                        held.append(line.decode("utf-8", "replace"))
                        count, size = count + 1, size + len(line)
                        if size >= BATCH_BYTES:
                            rows.append((count, row))
                            yield close()
                            held, rows, size, count = [], [], 0, 0
                rows.append((count, row))
            if held:
                yield close()
            held, rows, size = [], [], 0

    return run


BLANK = bytes(range(33))


def _seekable(path: str):
    store, base = store_of(path)
    return store.open_input_file(base)


def lines(files: DataFrame, carried: list[str]) -> DataFrame:
    """``_line`` of each line of the files (file, size) but the first, with the ``carried`` columns of its file and ``_block``, where its piece of the file begins.

    Lines of white space are left out. Large plain files are cut into pieces; a piece's lines are in order.
    """
    cut = ~F.col("file").endswith(".gz") & (F.col("size") > BYTES_PER_TASK)
    starts = F.when(cut, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(BYTES_PER_TASK).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = files.select("file", *carried, "size", cut.alias("cut"), F.explode(starts).alias("start"))
    until = F.when(F.col("cut"), F.least(F.col("start") + BYTES_PER_TASK, "size"))
    bytes_ = F.when(F.col("cut"), F.least(F.lit(BYTES_PER_TASK), F.col("size") - F.col("start"))).otherwise(F.col("size"))
    pieces = settle(pieces.select("file", *carried, "start", until.alias("until"), bytes_.alias("bytes")))
    schema = ", ".join([*[f"`{c}` {files.schema[c].dataType.simpleString()}" for c in carried], "_block long, _line string"])
    return spread(pieces, "bytes").mapInArrow(_read_lines(carried), schema)


def split_header(header: str, sep: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([header], delimiter=sep))]


def by_name(rows: DataFrame, headers: list[list[str]], kind: Column, column: str) -> Column:
    """The cell of ``column``, wherever the file's header has it; ``kind`` numbers the headers."""
    cells = [F.col(f"_c{h.index(column)}") for h in headers]
    if len({h.index(column) for h in headers}) == 1:
        return cells[0]
    case = F.when(kind == 0, cells[0])
    for i, cell in enumerate(cells[1:], 1):
        case = case.when(kind == i, cell)
    return case
