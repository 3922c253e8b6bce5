"""Folders as streams: lines of files that grow, and files that come, change and go.

Both are streaming data sources of their own: an offset names what of each file has been taken, is kept in the query's
checkpoint, and so a query that is started again goes on where it was. Register with `register(spark)`, then
`spark.readStream.format("growing_lines").load(folder)`. The folder is one that the driver and executors reach alike, by any
address that pyarrow's file systems know. An offset has an entry for each file.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one task's share of a file's new lines; rows of one task's share of changes.
PIECE_BYTES, PIECE_ROWS = 16 << 20, 10_000
_TAIL = 1 << 16


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _files(folder: str) -> list[fs.FileInfo]:
    """The files below a folder; names that begin with a dot or an underscore are left out, as Spark's readers do."""
    system, path = _opened(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return [f for f in found if f.is_file and not any(p[:1] in "._" for p in f.path[len(path) :].split("/") if p)]


class Piece(InputPartition):
    """Lines of a file that begin at `start` or later and before `end`; the new part of the file is `first` to `last`."""

    def __init__(self, path: str, first: int, start: int, end: int, last: int):
        self.path, self.first, self.start, self.end, self.last = path, first, start, end, last


class LinesReader(DataSourceStreamReader):
    def __init__(self, folder: str, piece_bytes: int):
        self.folder, self.piece_bytes = folder, piece_bytes
        self.known: dict[str, tuple[int, int, int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _complete(self, system: fs.FileSystem, info: fs.FileInfo) -> int:
        """Bytes up to the end of the last whole line: an unfinished one waits. Files that look as they did aren't opened."""
        size, at = info.size, int(info.mtime_ns or 0)
        if (was := self.known.get(info.path)) and was[:2] == (size, at):
            return was[2]
        done = 0
        with system.open_input_file(info.path) as file:
            end = size
            while end > 0 and not done:
                begin = max(0, end - _TAIL)
                block = file.read_at(end - begin, begin)
                done = begin + block.rfind(b"\n") + 1 if b"\n" in block else 0
                end = begin
        self.known[info.path] = (size, at, done)
        return done

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = _opened(self.folder)
        return {f.path: self._complete(system, f) for f in _files(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, to in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if to < at else at  # a file that has become shorter is another one
            out += [Piece(path, at, a, min(a + self.piece_bytes, to), to) for a in range(at, to, self.piece_bytes)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        with io.BufferedReader(system.open_input_file(partition.path), 1 << 20) as file:
            at = partition.start
            file.seek(at)
            if at > partition.first:  # the line that goes over from the piece before is that one's
                file.seek(at - 1)
                at = at - 1 + len(file.readline())
            rows: list[tuple[str, int, str]] = []
            while at < partition.end:
                if not (line := file.readline()):
                    break  # it has become shorter since
                rows.append((partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                at += len(line)
                if len(rows) >= PIECE_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None: ...


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    path, at, line = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(at, pa.int64()), pa.array(line, pa.string())], names=["path", "at", "line"])


class GrowingLines(DataSource):
    """Each whole line of the folder's files once: path, where it begins, and the line without its end."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LinesReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))


class Rows(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int | None]]):
        self.rows = rows


class ChangesReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f.path: [f.size, int(f.mtime_ns or 0)] for f in _files(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [(p, "created" if p not in start else "changed", v[0]) for p, v in sorted(end.items()) if start.get(p) != v]
        rows += [(p, "removed", None) for p in sorted(start.keys() - end.keys())]
        return [Rows(rows[k : k + PIECE_ROWS]) for k in range(0, len(rows), PIECE_ROWS)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None: ...


class ChangedFiles(DataSource):
    """Files of the folder that came, changed (in size or time) or went since the batch before: path, change, size."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "path string, change string, size long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangesReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (GrowingLines, ChangedFiles):
        spark.dataSource.register(source)
