"""Text files that grow, as a streaming source whose offsets are bytes.

The files of a folder are followed by (file, byte). An offset ends behind the last line end that is there, so a line that
is still being written waits, and each line is read once: offsets are kept by the query's checkpoint, and a query that
starts again goes on at the byte where it has stopped. New files begin at their first byte; a file that has become
shorter has been written anew and is read from its start.

What has been added since the last batch is cut into pieces of ``pieceBytes``, which are read by tasks of their own; a
line belongs to the piece in which it begins. The driver looks at sizes and at the last bytes of files only.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, array, int64, string
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE_BYTES = 8 << 20
#: Bytes that are looked through at a time for the last end of a line.
LOOK_BYTES = 1 << 16
#: Lines of one Arrow batch.
LINES_AT_ONCE = 1 << 14


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int
    first: bool  # whether a line begins at start


def last_line_end(f, size: int) -> int:
    """The byte behind the last line end among the first size bytes."""
    end = size
    while end > 0:
        start = max(0, end - LOOK_BYTES)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def lines(f, piece: Piece) -> Iterator[tuple[int, str]]:
    """(byte, line) of the lines that begin in a piece; the last one may end behind it."""
    at = piece.start
    f.seek(at)
    if not piece.first:
        f.seek(at - 1)
        at += len(f.readline()) - 1
    while at < piece.end:
        line = f.readline()
        if not line.endswith(b"\n"):
            break
        yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
        at += len(line)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, piece_bytes: int):
        self.path, self.piece_bytes = path, piece_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = FileSystem.from_uri(self.path)
        found = {}
        for info in system.get_file_info(FileSelector(root, allow_not_found=True)):
            if info.type == FileType.File and not info.base_name.startswith((".", "_")):
                with system.open_input_file(info.path) as f:
                    end = last_line_end(f, info.size)
                if end:
                    found[info.path] = end
        return found

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, upto in sorted(end.items()):
            begin = start.get(file, 0)
            begin = begin if begin <= upto else 0
            pieces += [Piece(file, a, min(a + self.piece_bytes, upto), a == begin) for a in range(begin, upto, self.piece_bytes)]
        return pieces

    def read(self, piece: Piece) -> Iterator[RecordBatch]:
        system, _ = FileSystem.from_uri(self.path)
        rows: list[tuple[int, str]] = []

        def batch() -> RecordBatch:
            at, text = zip(*rows, strict=True)
            return RecordBatch.from_arrays([array([piece.file] * len(rows), string()), array(at, int64()), array(text, string())], names=["file", "byte", "value"])

        with system.open_input_file(piece.file) as raw:
            for row in lines(io.BufferedReader(ArrowRaw(raw), 1 << 20), piece):
                rows.append(row)
                if len(rows) == LINES_AT_ONCE:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class ArrowRaw(io.RawIOBase):
    """What a buffered reader needs of an Arrow file."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        return self.f.seek(at, whence)

    def readinto(self, into) -> int:
        data = self.f.read(len(into))
        into[: len(data)] = data
        return len(data)


class GrowingLines(DataSource):
    """format("growing_lines"): file, byte, value of every line of the files of a folder (option path)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, byte bigint, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))


def growing_lines(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The lines of the files of a folder as a stream: file, byte, value."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("pieceBytes", piece_bytes).load(path)
