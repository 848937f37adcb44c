"""Logs that grow, as a stream of lines: a streaming source with a byte offset for each file.

Spark's file source reads a file once; a log is written on. Here a batch goes from the offsets of the last one to those of now: in each file up to the last
line end, so that a line that is still being written waits for its end. A file that has become shorter, or another file of its name
(its first bytes differ), was rotated and is read from its start. A run's marker file ends its log: the rest counts as a last line,
and a row says that it is done. Offsets are in the query's checkpoint, so that a restart goes on where it ended and no line comes twice.

Files are opened by pyarrow's file systems (local, mounted or by a URI) wherever a task runs; the driver lists the folder and reads the few
bytes that tell where the last line ends. A batch's files are split at line ends into pieces of bounded size, each a task's.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, line string, done boolean"
#: Bytes that a task reads, and bytes by which a file is known.
PIECE, HEAD = 64 << 20, 256
LOOK = 1 << 16


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else pyarrow.fs.FileSystem.from_uri(f"file://{path}")


def _bytes(fs: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(max(0, end - start), start)


def last_line_end(fs: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> int:
    """The offset after the last line end between start and end; start if there is none."""
    at = end
    while at > start:
        low = max(start, at - LOOK)
        found = _bytes(fs, path, low, at).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, done: bool) -> None:
        self.path, self.start, self.end, self.done = path, start, end, done


class TailReader(DataSourceStreamReader):
    """Offsets: file -> [bytes read, crc32 of its head, bytes of that head, whether it is done]."""

    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.marker = options["path"].rstrip("/"), options.get("suffix", ".log"), options.get("marker", ".done")

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        fs, root = _open(self.folder)
        listed = {i.path: i for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file}
        found = {}
        for path, info in sorted(listed.items()):
            if path.endswith(self.suffix):
                head = min(HEAD, info.size)
                done = path + self.marker in listed
                end = info.size if done else last_line_end(fs, path, 0, info.size)
                found[path] = [end, zlib.crc32(_bytes(fs, path, 0, head)), head, done]
        return {"files": json.dumps(found)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        fs, _ = _open(self.folder)
        before, now, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, (upto, _, _, done) in now.items():
            read, crc, head, was_done = before.get(path, [0, 0, 0, False])
            if read > upto or zlib.crc32(_bytes(fs, path, 0, head)) != crc:
                read = 0  # rotated
                was_done = False
            at = read
            while upto - at > PIECE:
                cut = last_line_end(fs, path, at, at + PIECE)
                cut = cut if cut > at else _next_line_end(fs, path, at + PIECE, upto)
                out.append(Piece(path, at, cut, False))
                at = cut
            if upto > at or (done and not was_done):
                out.append(Piece(path, at, upto, done and not was_done))
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        fs, _ = _open(self.folder)
        at = partition.start
        with fs.open_input_file(partition.path) as f:
            f.seek(at)
            rest = b""
            while at < partition.end:
                block = f.read(min(LOOK, partition.end - at))
                if not block:
                    break
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                place = at - len(rest) - sum(len(x) + 1 for x in lines)
                for line in lines:
                    yield partition.path, place, line.decode("utf-8", "replace"), False
                    place += len(line) + 1
        if rest:
            yield partition.path, partition.end - len(rest), rest.decode("utf-8", "replace"), False
        if partition.done:
            yield partition.path, partition.end, None, True

    def commit(self, end: dict) -> None:
        pass


def _next_line_end(fs: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> int:
    """For a line that is longer than a piece."""
    at = start
    while at < end:
        found = _bytes(fs, path, at, min(end, at + LOOK)).find(b"\n")
        if found >= 0:
            return at + found + 1
        at += LOOK
    return end


class GrowingLogs(DataSource):
    """path: a folder; suffix: of log files; marker: a file of a log's name and this suffix says that nothing follows."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def growing(spark: SparkSession, folder: str, suffix: str = ".log", marker: str = ".done") -> DataFrame:
    """A stream of file, at (the byte where a line begins), line, done (a last row without a line). Lines keep their terminal codes; see functions.text.strip_terminal."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("path", folder).option("suffix", suffix).option("marker", marker).load()
