"""Growing transcripts as a stream: lines that are appended to files, each once.

A Python data source: its offset is, for every file, how many bytes are taken and how often the file has shrunk. A tick takes what has been
appended up to the last line feed, ``CAP`` bytes of a file at most; a partial last line waits. A file that has become shorter is taken again
from its beginning. The driver lists the files and looks for one line feed in the last bytes of those that have grown; the bytes in between
are read by tasks, one for each file and tick.

A reader that starts again knows where it was from the stream's checkpoint only once it is asked for a range; so that its first tick keeps
to the cap too, it notes what is done at ``progress``, if that is given. Files are read by ``pyarrow.fs``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.workers import importable

#: Bytes of a file that a tick takes.
CAP = 32 << 20
#: Bytes that are looked through for a line feed at a time.
LOOK = 64 << 10
SCHEMA = "file string, line_no bigint, value string"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def cut_before(f, lo: int, hi: int) -> int:
    """The place behind the last line feed in [lo, hi), or ``lo``."""
    while hi > lo:
        at = max(lo, hi - LOOK)
        f.seek(at)
        found = f.read(hi - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        hi = at
    return lo


class Piece(InputPartition):
    """Bytes [lo, hi) of a file: whole lines."""

    def __init__(self, file: str, lo: int, hi: int):
        self.file, self.lo, self.hi = file, lo, hi


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, cap: int, progress: str | None):
        self.path, self.suffix, self.cap, self.progress = path, suffix, cap, progress
        self.done: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _known(self) -> dict | None:
        """What is taken already: as this reader last told, else as it was last noted; None if neither is known."""
        if self.done is None and self.progress:
            store, at = _store(self.progress)
            from pyarrow import fs

            if store.get_file_info(f"{at}/done.json").type == fs.FileType.File:
                with store.open_input_file(f"{at}/done.json") as f:
                    self.done = json.loads(f.read())
            else:
                self.done = {}
        return self.done

    def latestOffset(self) -> dict:
        from pyarrow import fs

        known, (store, root) = self._known(), _store(self.path)
        out = {f: dict(x) for f, x in (known or {}).items()}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            own = out.get(info.path, {"at": 0, "shrunk": 0})
            if info.size < own["at"]:
                own = {"at": 0, "shrunk": own["shrunk"] + 1}
            if info.size > own["at"]:
                with store.open_input_file(info.path) as f:
                    own = {**own, "at": cut_before(f, own["at"], info.size if known is None else min(info.size, own["at"] + self.cap))}
            out[info.path] = own
        self.done = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, to in end.items():
            was = start.get(file, {"at": 0, "shrunk": 0})
            lo = was["at"] if was["shrunk"] == to["shrunk"] else 0
            if to["at"] > lo:
                pieces.append(Piece(file, lo, to["at"]))
        if self.done is None:
            self.done = end
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            f.seek(partition.lo)
            left, at, rest = partition.hi - partition.lo, partition.lo, b""
            while left > 0:
                data = f.read(min(left, 4 << 20))
                if not data:
                    break  # the file has shrunk since; what is there now comes with a later tick
                left -= len(data)
                whole, _, tail = (rest + data).rpartition(b"\n")
                places, values = [], []
                for line in whole.split(b"\n") if whole or len(tail) < len(rest) + len(data) else ():
                    if line.strip():
                        places.append(at)
                        values.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                rest = tail
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(values), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], ["file", "line_no", "value"])

    def commit(self, end: dict) -> None:
        if self.progress:
            store, at = _store(self.progress)
            store.create_dir(at, recursive=True)
            name = f"{at}/{uuid.uuid4().hex}"
            with store.open_output_stream(name) as f:
                f.write(json.dumps(end).encode())
            store.move(name, f"{at}/done.json")


class Tail(DataSource):
    """Options: path, suffix, cap (bytes of a file a tick), progress."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"], o.get("suffix", ".jsonl"), int(o.get("cap", CAP)), o.get("progress"))


def growing_files(spark: SparkSession, path: str, progress: str | None = None, suffix: str = ".jsonl", cap: int = CAP) -> DataFrame:
    """A stream of (file, line_no, value) of the files below ``path``, an absolute path or URI that all executors see. Lines are numbered by
    the byte they begin at: in order, but other numbers than a batch read gives."""
    importable(spark)
    spark.dataSource.register(Tail)
    options = {"path": path, "suffix": suffix, "cap": str(cap)} | ({"progress": progress} if progress else {})
    return spark.readStream.format("tail").options(**options).load()
