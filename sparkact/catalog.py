"""Versioned Parquet folders: a version is written whole to a folder of its own, checked, and
made current by creating a small pointer file that names the folder. Readers stay on the version
that they opened."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.operators.messages import winners


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> int:
        """The current version; 0 if there is none. A pointer without content (its writer is at
        work, or died) doesn't count."""
        if not self.fs.exists(self._path("")):
            return 0
        found = [int(s.getPath().getName().removeprefix("current-")) for s in self.fs.listStatus(self._path("")) if s.getPath().getName().startswith("current-") and s.getLen()]
        return max(found, default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if not version:
            raise LookupError(f"{self.path} has no version yet")
        if not self.fs.exists(self._path(f"current-{version}")):
            raise LookupError(f"{self.path} has no version {version}")
        pointer = self.fs.open(self._path(f"current-{version}"))
        try:
            folder = bytes(pointer.readAllBytes()).decode()
        finally:
            pointer.close()
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def publish(self, df: DataFrame, version: int, check: Callable[[DataFrame], bool] | None = None) -> int:
        """Write ``df`` as ``version`` and make it current. Of two writers of one version, each
        with its own folder, the second to finish fails; a version that is current already is
        left as it is."""
        if version <= self.current():
            return self.current()
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        if check and not check(self.spark.read.parquet(f"{self.path}/{folder}")):
            raise ValueError(f"version {version} failed its check")
        pointer = self._path(f"current-{version}")
        try:
            out = self.fs.create(pointer, False)
        except Py4JJavaError:
            if not self.fs.exists(pointer):
                raise
            raise RuntimeError(f"version {version} was published meanwhile") from None
        try:
            out.write(bytearray(folder.encode()))
        finally:
            out.close()
        return version

    def upsert(self, new: DataFrame, keys: list[str], version: int, latest: Sequence[str] = ()) -> int:
        """The current rows with those of ``new`` in the place of rows of equal keys. Of rows of
        ``new`` with equal keys the greatest stays, by the columns ``latest``, then by the others.
        Null keys are equal."""
        if version <= self.current():
            return self.current()
        others = [c for c in new.columns if c not in keys]
        new = winners(new, keys, list(latest), others).select(*new.columns) if others else new.distinct()
        if self.current():
            old = self.read()
            known = new.select(*[F.col(k).alias(f"_new_{i}") for i, k in enumerate(keys)]).distinct()
            same = reduce(and_, [old[k].eqNullSafe(known[f"_new_{i}"]) for i, k in enumerate(keys)])
            new = new.unionByName(old.join(known, same, "left_anti"))
        return self.publish(new, version)

    def retain(self, versions: int = 2) -> list[int]:
        """Delete all but the newest ``versions`` (at least one), pointers first, so that no reader
        opens what goes. Returns the deleted ones."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        found = sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))
        gone = found[: -max(1, versions)]
        for v in gone:
            self.fs.delete(self._path(f"current-{v}"), False)
        for n in names:
            if any(n.startswith(f"v{v}-") for v in gone):
                self.fs.delete(self._path(n), True)
        return gone
