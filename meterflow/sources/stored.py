"""Tables that are changed as a whole: data is written aside, then one small manifest makes it the table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders of one level that are merged into one of the next level.
FAN = 8
#: Manifests that are kept for readers which have begun with an older one.
KEPT_VERSIONS = 10

#: A name and a number that grows with each load of that name, such as a stream and its batch.
Load = tuple[str, int]


class ConcurrentChange(RuntimeError):
    """Somebody else has published the version this change was based on a successor of."""


@dataclass(frozen=True)
class Manifest:
    """One version of a table: its folders with their levels, the last load of each name, and marks."""

    version: int = -1
    folders: list[list] = field(default_factory=list)
    loads: dict[str, int] = field(default_factory=dict)
    marks: dict[str, Any] = field(default_factory=dict)


class Files:
    """The few file operations that are not reading or writing tables, on whatever store a path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A file that is there whole or not at all; False if it has been there."""
        target, draft = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            done = not self._fs.exists(target) and self._fs.rename(draft, target)
        except Py4JJavaError:
            done = False
        if not done:
            self._fs.delete(draft, False)
        return done

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class StoredTable:
    """A table of Parquet folders below ``path``.

    A manifest names the folders that make up a version; readers list one folder of at most ``KEPT_VERSIONS``
    manifests and open what the newest names. A change writes a folder of its own and then creates the next
    manifest, so a failure leaves the version before. Changes carry a load (name, number): a load that is in the
    manifest already changes nothing, so a batch or a file can be loaded again after any failure.

    Appended folders are merged by ``FAN`` once there are that many of one level, so a table of n appends has in
    the order of log n folders, and each row is rewritten in the order of log n times. ``merge`` may combine rows then.
    A reader that began with one of the last ``KEPT_VERSIONS`` versions finds its folders; those of older ones are deleted.
    There is one writer at a time; a second one is told by ``ConcurrentChange``.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        partition_by: Sequence[str] = (),
        merge: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.schema, self.partition_by, self.merge = spark, path.rstrip("/"), schema, list(partition_by), merge
        self._files = Files(spark, path)

    def manifest(self) -> Manifest:
        names = [n for n in self._files.names(f"{self.path}/_manifest") if n.endswith(".json")]
        return Manifest(**json.loads(self._files.text(f"{self.path}/_manifest/{max(names)}"))) if names else Manifest()

    def _open(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.select(*self.schema.names)

    def read(self) -> DataFrame:
        return self._open([name for name, _ in self.manifest().folders])

    def holds(self, load: Load) -> bool:
        return self.manifest().loads.get(load[0], -1) >= load[1]

    def _write(self, rows: DataFrame) -> str:
        name = f"data={uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names)
        if self.partition_by:
            # Few files for each partition; a partition of most rows is still split over tasks.
            rows = rows.hint("rebalance", *self.partition_by)
        writer = rows.write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{name}")
        return name

    def _publish(self, old: Manifest, folders: list[list], load: Load | None = None, marks: Mapping[str, Any] | None = None) -> None:
        new = Manifest(
            old.version + 1,
            folders,
            old.loads | ({load[0]: load[1]} if load else {}),
            old.marks | dict(marks or {}),
        )
        if not self._files.create(f"{self.path}/_manifest/{new.version:012d}.json", json.dumps(asdict(new))):
            raise ConcurrentChange(f"{self.path} has a version {new.version} already")
        if new.version >= KEPT_VERSIONS:
            self._expire(new.version - KEPT_VERSIONS)

    def _expire(self, version: int) -> None:
        """Delete a manifest and the folders that its successor, and so any later version, has no more."""
        at = [f"{self.path}/_manifest/{v:012d}.json" for v in (version, version + 1)]
        old, following = ({f for f, _ in json.loads(self._files.text(p))["folders"]} for p in at)
        for name in old - following:
            self._files.delete(f"{self.path}/{name}")
        self._files.delete(at[0])

    def append(self, rows: DataFrame, load: Load, marks: Mapping[str, Any] | None = None) -> bool:
        """Add rows, once for each load. False if the load is there already."""
        old = self.manifest()
        if old.loads.get(load[0], -1) >= load[1]:
            return False
        self._publish(old, [*old.folders, [self._write(rows), 0]], load, marks)
        self._merge_level(0)
        return True

    def overwrite(self, rows: DataFrame, load: Load, marks: Mapping[str, Any] | None = None) -> bool:
        """Put rows in place of all others. They may be read from this table."""
        old = self.manifest()
        if old.loads.get(load[0], -1) >= load[1]:
            return False
        self._publish(old, [[self._write(rows), 0]], load, marks)
        return True

    def _merge_level(self, level: int) -> None:
        old = self.manifest()
        mine = [name for name, at in old.folders if at == level]
        if len(mine) < FAN:
            return
        rows = self._open(mine)
        rows = self.merge(rows) if self.merge else rows
        merged = self._write(rows if self.partition_by else rows.hint("rebalance"))
        self._publish(old, [*[f for f in old.folders if f[1] != level], [merged, level + 1]])
        self._merge_level(level + 1)

    def vacuum(self) -> int:
        """Delete folders that no kept manifest names, such as those of failed writes. To be called by the only writer."""
        names = self._files.names(f"{self.path}/_manifest")
        used = {f for n in names if n.endswith(".json") for f, _ in json.loads(self._files.text(f"{self.path}/_manifest/{n}"))["folders"]}
        unused = [n for n in self._files.names(self.path) if n.startswith("data=") and n not in used]
        for name in unused:
            self._files.delete(f"{self.path}/{name}")
        return len(unused)


__all__ = ["ConcurrentChange", "FAN", "KEPT_VERSIONS", "Load", "Manifest", "StoredTable"]
