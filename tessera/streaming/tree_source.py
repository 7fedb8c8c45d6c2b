"""Changes of a folder as a stream: files that came, changed and went, found by comparing snapshots of the folder.

An offset is the number of a snapshot. A snapshot is a listing (path, size, time of change) that is written below
``snapshots`` before its number is given out, cut into slices by path; a micro-batch compares the slices of its first
and last snapshot, each slice in a task of its own. The same offsets therefore give the same rows, whatever happens to
the folder in between, also after a restart. A number is valid once its summary is there, which is written last.

The driver lists the folder; what it holds is a line for each file. Both folders may be in any file system that Arrow
opens (a local path that driver and executors share, ``hdfs://``, ``s3://`` ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, change string, size long, mtime timestamp, ts timestamp, seq long"
SLICES = 16


def source() -> type[DataSource]:
    """The data source, for ``spark.dataSource.register``. It is made within a function so that it travels as a whole:
    the processes that run it do not all have the files that are added to the session."""

    class Slice(InputPartition):
        def __init__(self, first: int, last: int, number: int):
            self.first, self.last, self.number = first, last, number

    class Reader(DataSourceStreamReader):
        def __init__(self, folder: str, snapshots: str, slices: int):
            self.folder, self.snapshots, self.slices = folder.rstrip("/"), snapshots.rstrip("/"), slices

        def _open(self, where: str):
            from pyarrow import fs

            return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)

        def _put(self, name: str, text: str) -> None:
            import os

            system, base = self._open(self.snapshots)
            system.create_dir(os.path.dirname(f"{base}/{name}"), recursive=True)
            with system.open_output_stream(f"{base}/{name}.part") as out:
                out.write(text.encode())
            system.move(f"{base}/{name}.part", f"{base}/{name}")

        def _get(self, name: str) -> str:
            system, base = self._open(self.snapshots)
            with system.open_input_stream(f"{base}/{name}") as stream:
                return stream.read().decode()

        def _numbers(self) -> list[int]:
            from pyarrow import fs

            system, base = self._open(self.snapshots)
            names = [f.base_name for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True))]
            return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

        def _listing(self) -> list[tuple[str, int, int]]:
            from pyarrow import fs

            system, base = self._open(self.folder)
            found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            return sorted((f.path[len(base) :].lstrip("/"), f.size, f.mtime_ns // 1000) for f in found if f.is_file)

        def initialOffset(self) -> dict:
            return {"snapshot": 0}

        def latestOffset(self) -> dict:
            import hashlib
            import json
            import time
            import zlib

            lines = [json.dumps(entry) for entry in self._listing()]
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            last = (self._numbers() or [0])[-1]
            if digest == (json.loads(self._get(f"{last}.json"))["digest"] if last else hashlib.sha256(b"").hexdigest()):
                return {"snapshot": last}
            dealt: list[list[str]] = [[] for _ in range(self.slices)]
            for line in lines:
                dealt[zlib.crc32(json.loads(line)[0].encode()) % self.slices].append(line)
            for k, own in enumerate(dealt):
                self._put(f"{last + 1}/{k}", "\n".join(own))
            self._put(f"{last + 1}.json", json.dumps({"digest": digest, "slices": self.slices, "us": time.time_ns() // 1000}))
            return {"snapshot": last + 1}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Slice(start["snapshot"], end["snapshot"], k) for k in range(self.slices)]

        def read(self, partition: Slice):
            import datetime as dt
            import json

            def held(number: int) -> dict[str, tuple[int, int]]:
                if not number:
                    return {}
                return {path: (size, us) for path, size, us in map(json.loads, filter(None, self._get(f"{number}/{partition.number}").split("\n")))}

            if partition.first == partition.last:
                return
            stamp = lambda us: dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc)
            before, now = held(partition.first), held(partition.last)
            seen = json.loads(self._get(f"{partition.last}.json"))["us"]
            for path in sorted(before.keys() | now.keys()):
                if before.get(path) != now.get(path):
                    change = "add" if path not in before else "unlink" if path not in now else "change"
                    size, us = now.get(path, (None, None))
                    yield (path, change, size, None if us is None else stamp(us), stamp(seen), partition.last)

        def commit(self, end: dict) -> None:
            """Snapshots before the one before ``end`` are needed by no batch any more."""
            system, base = self._open(self.snapshots)
            for number in self._numbers():
                if number < end["snapshot"] - 1:
                    system.delete_file(f"{base}/{number}.json")
                    system.delete_dir(f"{base}/{number}")

    class TreeChanges(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tree_changes"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options["path"], self.options["snapshots"], int(self.options.get("slices", SLICES)))

    return TreeChanges


def tree_changes(spark: SparkSession, folder: str, snapshots: str, slices: int = SLICES) -> DataFrame:
    """(path, change, size, mtime, ts, seq) as a stream: ``change`` is add, change or unlink, ``ts`` the time at which
    it was seen, ``seq`` the snapshot's number. A file that changes twice between two looks changed once.

    ``snapshots`` belongs to the stream as its checkpoint does, and lies outside of ``folder``.
    """
    spark.dataSource.register(source())
    return spark.readStream.format("tree_changes").option("path", folder).option("snapshots", snapshots).option("slices", slices).load()
