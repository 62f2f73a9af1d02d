"""Lines of text files as a data source, `recall_lines`: byte ranges of a file are read by several tasks, and a stream reads what files have grown by.

A file whose name ends in .gz is one range, as compressed text can't be read from its middle; its offsets are those of the text.

A line belongs to the range that its first byte is in; a task skips the end of the line that began before its range and reads its own last line to the end.
So offsets are exact, and no task holds more than some blocks and one line.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, split long, nth long, offset long, ended boolean, line string"
#: Bytes of a range, and of a read.
SPLIT, BLOCK = 64 << 20, 4 << 20
#: How names of compressed files end, and the end of a range whose size is only known when it is read.
PACKED, OPEN_END = ".gz", 1 << 62


class Range(InputPartition):
    """Lines that begin in [start, end) of a file; low: where reading the file begins."""

    def __init__(self, file: str, low: int, start: int, end: int):
        self.file, self.low, self.start, self.end = file, low, start, end


class _Text:
    """The text of a compressed file, which is read forwards."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def read(self, n: int) -> bytes:
        """n bytes, fewer only at the end."""
        found = []
        while n > 0 and (block := self.stream.read(n)):
            found.append(block)
            n -= len(block)
            self.at += len(block)
        return b"".join(found)

    def seek(self, at: int) -> None:
        while self.at < at:
            if not self.read(min(BLOCK, at - self.at)):
                raise ValueError(f"a compressed file has {self.at} bytes of text and was read up to {at}")


def _open(file: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    return _Text(system.open_input_stream(path, compression="gzip")) if file.endswith(PACKED) else system.open_input_file(path)


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """Files at or below the paths with their sizes, in order; those whose names begin with _ or . are no data."""
    from pyarrow import fs

    out = []
    for p in paths:
        system, path = fs.FileSystem.from_uri(p)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = p[: p.index(path.rstrip("/"))]
        inside = lambda x: x[len(path) :].split("/") if info.type != fs.FileType.File else []
        out += [(scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and not any(n[:1] in ("_", ".") for n in inside(x.path))]
    return sorted(set(out))


def ranges(files: list[tuple[str, int]], since: dict[str, int], split: int) -> list[Range]:
    """Byte ranges of all files, from where `since` has one on."""
    out = []
    for file, size in files:
        low = since.get(file, 0)
        if file.endswith(PACKED):
            out.append(Range(file, low, low, OPEN_END))
            continue
        if size < low:
            raise ValueError(f"{file} has {size} bytes and was read up to {low}")
        out += [Range(file, low, i, min(size, i + split)) for i in range(low, size, split)]
    return out


def read_range(r: Range, whole_lines: bool = False) -> Iterator[pa.RecordBatch]:
    """SCHEMA of the lines that begin in the range; nth counts from 0 in it. A last line without newline is not ended; with whole_lines it is left out."""
    with _open(r.file) as f:
        at, nth = r.start, 0
        if r.start > r.low:
            at -= 1
            f.seek(at)
            while True:
                block = f.read(BLOCK)
                if not block:
                    return
                k = block.find(b"\n")
                if k >= 0:
                    at += k + 1
                    break
                at += len(block)
        f.seek(at)
        held: list[bytes] = []
        while at < r.end:
            block = f.read(BLOCK)
            cut = block.rfind(b"\n")
            if block and cut < 0:
                held.append(block)
                continue
            data = b"".join([*held, block])
            if not block:
                if data and not whole_lines:
                    yield _batch(r, nth, [data], np.array([at]), False)
                return
            cut = len(data) - len(block) + cut
            lines = data[:cut].split(b"\n")
            sizes = np.array([len(x) + 1 for x in lines])
            starts = at + np.cumsum(sizes) - sizes
            n = int(np.searchsorted(starts, r.end))
            if n:
                yield _batch(r, nth, lines[:n], starts[:n], True)
            nth += n
            at += cut + 1
            held = [data[cut + 1 :]]


def _batch(r: Range, nth: int, lines: list[bytes], starts: np.ndarray, ended: bool) -> pa.RecordBatch:
    n = len(lines)
    try:
        text = pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # malformed UTF-8 counts as U+FFFD
        text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
    columns = [pa.array([r.file] * n, pa.string()), pa.array(np.full(n, r.start)), pa.array(np.arange(nth, nth + n)), pa.array(starts.astype(np.int64)), pa.array([ended] * n), text]
    return pa.RecordBatch.from_arrays(columns, names=["file", "split", "nth", "offset", "ended", "line"])


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.split, self.since = json.loads(options["paths"]), int(options.get("split", SPLIT)), json.loads(options.get("since", "{}"))

    def partitions(self):
        # Spark wants one partition at least: an empty range has no lines.
        return ranges(listed(self.paths), self.since, self.split) or [Range("", 0, 0, 0)]

    def read(self, partition):
        return read_range(partition) if partition.file else iter(())


class LineStreamReader(DataSourceStreamReader):
    """A stream's place is where the last whole line of each file ends; a line is read when its newline is there."""

    def __init__(self, options):
        self.paths, self.split = json.loads(options["paths"]), int(options.get("split", SPLIT))

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return {file: end for file, size in listed(self.paths) if (end := _last_newline(file, size))}

    def partitions(self, start, end):
        grown = [(f, e) for f, e in sorted(end.items()) if e > start.get(f, 0)]
        packed = [Range(f, start.get(f, 0), start.get(f, 0), e) for f, e in grown if f.endswith(PACKED)]
        return ranges([x for x in grown if not x[0].endswith(PACKED)], start, self.split) + packed

    def read(self, partition):
        return read_range(partition, True)

    def commit(self, end):
        pass


def _last_newline(file: str, size: int) -> int:
    """The byte after the last newline of the first size bytes, 0 without one."""
    with _open(file) as f:
        if file.endswith(PACKED):
            at = end = 0
            while block := f.read(BLOCK):
                end = at + k + 1 if (k := block.rfind(b"\n")) >= 0 else end
                at += len(block)
            return end
        at = size
        while at > 0:
            low = max(0, at - BLOCK)
            f.seek(low)
            k = f.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return 0


class LineSource(DataSource):
    @classmethod
    def name(cls):
        return "recall_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return LineStreamReader(self.options)
