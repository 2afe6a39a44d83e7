"""Growing files of lines as a stream: resumed by byte offset, torn last lines left for later, rewritten files read anew.

Register it with `spark.dataSource.register(LineSource)` and read it with `spark.readStream.format("growing_lines").option("path", folder)`.
The folder lies on a file system that the driver and all executors see; names beginning with `.` or `_` are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MAX_LINE = 32 << 20  # longer lines are skipped whole
CHUNK = 8 << 20  # bytes of a file that one task reads
TAIL = 256  # bytes before an offset whose hash tells whether a file was rewritten


def _fs(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def tail_hash(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=8).hexdigest()


def last_line_end(read, size: int, start: int) -> int:
    """The place after the last line end of the first `size` bytes, not before `start`; read(at, n) gives bytes."""
    end = size
    while end > start:
        at = max(start, end - (1 << 16))
        i = read(at, end - at).rfind(b"\n")
        if i >= 0:
            return at + i + 1
        end = at
    return start


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, stop: int):
        self.path, self.start, self.end, self.stop = path, start, end, stop


class LineReader(DataSourceStreamReader):
    """Offsets are {file: [bytes read, hash of the bytes before]}, all of them at line ends."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.longest = int(options.get("maxLine", MAX_LINE))
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _reader(self, path: str):
        system, inner = _fs(path)
        f = system.open_input_file(inner)
        return lambda at, n: f.read_at(n, at)

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, inner = _fs(self.path)
        now: dict[str, list] = {}
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if info.type != fs.FileType.File or info.base_name[:1] in "._":
                continue
            was = self.known.get(info.path, [0, ""])
            if info.size == was[0]:
                now[info.path] = was
                continue
            read = self._reader(self._uri(info.path))
            start = was[0] if self._same(read, was, info.size) else 0
            end = last_line_end(read, info.size, start)
            now[info.path] = [end, tail_hash(read(max(0, end - TAIL), min(end, TAIL)))] if end else [0, ""]
        self.known = now
        return {"files": json.dumps(now, sort_keys=True)}

    def _uri(self, inner: str) -> str:
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        return f"{scheme}://{inner}"

    def _same(self, read, was: list, size: int) -> bool:
        """Whether a file still begins with what was read of it: it did not shrink, and its bytes before the offset are the same."""
        at, mark = was
        return at == 0 or (size >= at and tail_hash(read(max(0, at - TAIL), min(at, TAIL))) == mark)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.known = dict(new) if not self.known else self.known
        out: list[InputPartition] = []
        for path, (stop, _) in sorted(new.items()):
            was = old.get(path, [0, ""])
            if stop == was[0] and new[path] == was:
                continue
            begin = was[0] if stop > was[0] and self._same(self._reader(self._uri(path)), was, stop) else 0
            out += [Range(self._uri(path), at, min(at + CHUNK, stop), stop) for at in range(begin, stop, CHUNK)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        """The lines that begin in the range; a line that goes on behind it is read to its end."""
        read = self._reader(part.path)
        at = part.start
        if at and read(at - 1, 1) != b"\n":  # the line before reaches into this range
            at = self._after(read, at, part.stop)
        while at < part.end:
            end = self._after(read, at, part.stop)
            if end - at - 1 <= self.longest:
                yield part.path, at, read(at, end - at - 1).decode("utf-8", "replace").rstrip("\r")
            at = end

    @staticmethod
    def _after(read, at: int, stop: int) -> int:
        """The place after the line end at or behind `at`."""
        while at < stop:
            data = read(at, min(1 << 16, stop - at))
            i = data.find(b"\n")
            if i >= 0:
                return at + i + 1
            at += len(data)
        return stop

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at bigint, line string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options)
