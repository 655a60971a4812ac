"""Admission control in the source (O3): a stream of landed files that waits for enough of them.

``LandedFiles`` is a Python streaming data source.  Its offset is the number of the last admitted batch; it
stays where it is until ``min_files`` new files are there, or the oldest of them has waited ``max_wait``
seconds, and then admits at most ``max_files``, oldest first.  What a batch holds is written to a log before
its offset is given to Spark, so a restart, also one in the middle of a batch, reads the same files again, and
a file that lands with an old time stamp is still new.

    spark.dataSource.register(LandedFiles)
    files = (spark.readStream.format("landed_files").option("path", root).option("log", checkpoint + "/_admitted")
             .option("glob", "*.csv").option("min_files", 10).option("max_files", 100).option("max_wait", 600).load())
"""

from __future__ import annotations

import fnmatch
import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length bigint"


def _store(uri: str):
    """The file system of a path (any that Arrow knows) and the path in it."""
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Files(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class LandedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.min_files = int(self.options.get("min_files", 1))
        self.max_files = int(self.options.get("max_files", 100))
        self.max_wait = float(self.options.get("max_wait", "inf"))
        if self.min_files < 1 or self.max_files < self.min_files:
            raise ValueError("need 1 <= min_files <= max_files")

    # -- the log of admitted batches: one file a batch, its name the batch's number

    def _log(self):
        from pyarrow import fs
        store, path = _store(self.options["log"])
        store.create_dir(path, recursive=True)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".json")]
        return store, path, sorted(int(n.removesuffix(".json")) for n in names)

    def _admitted(self, start: int, end: int) -> list:
        store, path, numbers = self._log()
        rows: list = []
        for n in numbers:
            if start < n <= end:
                with store.open_input_stream(f"{path}/{n}.json") as f:
                    rows += json.loads(f.read())
        return rows

    def _admit(self, number: int, rows: list) -> None:
        store, path, _ = self._log()
        with store.open_output_stream(f"{path}/{number}.tmp") as f:
            f.write(json.dumps(rows).encode())
        store.move(f"{path}/{number}.tmp", f"{path}/{number}.json")

    def _landed(self) -> list:
        from pyarrow import fs
        store, path = _store(self.options["path"])
        head = "" if "://" not in self.options["path"] and not self.options["path"].startswith("file:") else "file:"
        glob = self.options.get("glob", "*")
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted([f.mtime_ns, f"{head}{f.path}", f.size] for f in found if f.is_file and fnmatch.fnmatch(f.base_name, glob)
                      and not any(p.startswith(("_", ".")) for p in f.path.removeprefix(path).split("/")))

    # -- the stream

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        numbers = self._log()[2]
        last = numbers[-1] if numbers else 0
        done = {(path, time_ns) for time_ns, path, _ in self._admitted(0, last)}
        waiting = [r for r in self._landed() if (r[1], r[0]) not in done]
        waited = time.time() - min((r[0] for r in waiting), default=0) / 1e9
        if waiting and (len(waiting) >= self.min_files or waited >= self.max_wait):
            self._admit(last + 1, waiting[:self.max_files])
            last += 1
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Files(self._admitted(start["batch"], end["batch"]))]

    def read(self, partition: Files) -> Iterator[tuple]:
        for time_ns, path, size in partition.rows:
            yield path, datetime.fromtimestamp(time_ns / 1e9, timezone.utc), size

    def commit(self, end: dict) -> None:
        pass


class LandedFiles(DataSource):
    """Options: path, log, glob, min_files, max_files, max_wait (seconds).  A file that is written again is new."""

    @classmethod
    def name(cls) -> str:
        return "landed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandedReader(dict(self.options))
