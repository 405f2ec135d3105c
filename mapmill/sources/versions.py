"""Tables in versions: a new one is written beside the old ones and then put in force by one atomic step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleBase(RuntimeError):
    """Another writer has put a version in force since the base of this one was read."""


class VersionedTable:
    """A Parquet table in ``root``, any folder that Spark can write to.

    ``data/`` holds a folder a version, ``heads/`` one pointer file a number, named ``<number>`` and holding the name of its
    folder. The table is what the pointer of the largest number says. A pointer is written aside and renamed to its place, which
    fails if there is one: of two writers on the same base one wins, and the other gets StaleBase. A write that is killed
    leaves a folder that no pointer names; readers never see it. A reader keeps the version that it has opened.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("heads").getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("heads").toUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("heads"))

    def versions(self) -> list[int]:
        """Numbers of all versions that were put in force, oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("heads"))]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> int:
        """The number of the version in force, 0 before the first one."""
        return max(self.versions(), default=0)

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._path(f"heads/{number:09d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame:
        """The version in force, or the one of a number; what is put in force later does not change the frame."""
        return self.spark.read.parquet(f"{self.root}/data/{self._folder(number or self.current())}")

    def stage(self, df: DataFrame) -> str:
        """Write the rows of a version to be, and return the name of its folder."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{name}")
        return name

    def swap(self, folder: str, base: int) -> int:
        """Put a staged folder in force as the version after ``base``; StaleBase if there is one already."""
        aside = self._path(f"heads/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(folder.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            if self.current() != base:
                raise StaleBase(f"version {base} is not in force any more")
            self._context.rename(aside, self._path(f"heads/{base + 1:09d}"), none)
        except Exception as e:
            self._fs.delete(aside, False)
            if isinstance(e, StaleBase) or "already exist" in str(e):
                raise StaleBase(f"version {base} is not in force any more") from e
            raise
        return base + 1

    def commit(self, df: DataFrame, base: int) -> int:
        """Write ``df``, made from version ``base``, and put it in force; returns its number."""
        return self.swap(self.stage(df), base)

    def orphans(self) -> list[str]:
        """Folders that no pointer names: of killed writes, or of writes that are not finished yet."""
        data = self._path("data")
        there = {s.getPath().getName() for s in self._fs.listStatus(data)} if self._fs.exists(data) else set()
        return sorted(there - {self._folder(n) for n in self.versions()})
