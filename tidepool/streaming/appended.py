"""Follow files that grow (S12): a streaming source of appended lines.

Spark's file stream sees new files only. This source keeps a byte offset for every
file of a folder in the stream's checkpoint: each batch is what was appended
since, up to the last whole line of each file; half a line waits for its end.
A restart goes on where the last batch ended. A file that got shorter was
started anew and is read from its beginning.

Files are read where the tasks run, in ranges of bounded size, through
pyarrow's file systems (local, ``hdfs://``, ``s3://`` and others by the path's scheme).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 16


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int, first: int, end: int):
        self.file, self.start, self.stop, self.first, self.end = file, start, stop, first, end


def file_system(path: str):
    """pyarrow's file system for a path or address, and the path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(f, start: int, size: int) -> int:
    """The place behind the last newline of a file of ``size`` bytes, ``start`` if there is none after it."""
    stop = size
    while stop > start:
        at = max(start, stop - BLOCK_BYTES)
        f.seek(at)
        cut = f.read(stop - at).rfind(b"\n")
        if cut >= 0:
            return at + cut + 1
        stop = at
    return start


class AppendedLines(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs
        files, folder = file_system(self.folder)
        now = {}
        for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                known = self.ends.get(info.base_name, 0)
                known = 0 if known > info.size else known
                with files.open_input_file(info.path) as f:
                    now[info.base_name] = whole_lines(f, known, info.size)
        self.ends = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            first = 0 if first > stop else first
            out += [Range(file, at, min(stop, at + self.range_bytes), first, stop) for at in range(first, stop, self.range_bytes)]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.stop <= part.start:
            return
        files, folder = file_system(self.folder)
        with files.open_input_file(f"{folder.rstrip('/')}/{part.file}") as f:
            f.seek(part.start - (part.start > part.first))
            at = f.tell()
            held = b""
            if part.start > part.first:  # the line that began before the range is the other range's
                while b"\n" not in held:
                    more = f.read(min(BLOCK_BYTES, part.end - at - len(held)))
                    if not more:
                        return
                    held += more
                skipped = held.index(b"\n") + 1
                held, at = held[skipped:], at + skipped
            while at < part.stop:
                cut = held.find(b"\n")
                if cut < 0:
                    more = f.read(min(BLOCK_BYTES, part.end - at - len(held)))
                    if not more:
                        return
                    held += more
                    continue
                yield part.file, at, held[:cut].removesuffix(b"\r").decode("utf-8", "replace")
                held, at = held[cut + 1:], at + cut + 1

    def commit(self, end: dict) -> None:
        pass


class AppendedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> AppendedLines:
        return AppendedLines(self.options)


def follow(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (file, at, value): every line appended to the files of ``folder``, with the byte it begins at."""
    spark.dataSource.register(AppendedSource)
    return spark.readStream.format("appended_lines").option("path", folder).option("rangeBytes", range_bytes).load()


def write_lines(lines: DataFrame, folder: str, ended: bool = True) -> int:
    """Write (file, place, value) as text files of ``folder``, each by one task and put in its place
    whole; without ``ended`` the last line of each has no newline yet. The number of lines.

    A file written again with more lines has grown, as its readers see it; a task that
    runs again writes the same."""
    def run(batches):
        import pyarrow as pa
        files, to = file_system(folder)
        files.create_dir(to, recursive=True)
        name, out, held, n = None, None, None, 0

        def done():
            if out is not None:
                out.write(held + (b"\n" if ended else b""))
                out.close()
                files.move(f"{to}/.{name}", f"{to}/{name}")

        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    done()
                    name, out, held = file, files.open_output_stream(f"{to}/.{file}"), None
                if held is not None:
                    out.write(held + b"\n")
                held, n = value.encode(), n + 1
        done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    sent = lines.select("file", "place", "value").repartition("file").sortWithinPartitions("file", "place").select("file", "value")
    return sum(r[0] for r in sent.mapInArrow(run, "n long").collect())
