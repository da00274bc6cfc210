"""A vector table kept as buckets of files: a sync writes only the buckets that change, and a pointer makes it visible.

path/v=N/bucket=K holds the files that version N wrote for bucket K; path/manifests/N.json says for each bucket which
version has it; path/CURRENT names the version that readers see, and is put in place by one rename. A sync that fails
before the rename leaves readers with the old version; its folder is written over by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.operators.sync import diff_index

BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Files:
    """Small files beside the data, in whatever store Spark reads."""

    spark: SparkSession
    root: str

    def _at(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file whole or not at all: written beside its place and renamed over it."""
        beside, fs = self._at(f"{name}.next")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        option[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(self._at(name)[0]), option)


@dataclass
class Snapshot:
    """The table at path, with a column id that is its key and a column hash of what a row was made from."""

    spark: SparkSession
    path: str
    schema: str
    buckets: int = BUCKETS
    files: Files = field(init=False)

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.path)

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(version, bucket to the version that wrote it); 0 and nothing before the first sync."""
        if not self.files.exists("CURRENT"):
            return 0, {}
        version = int(self.files.read("CURRENT"))
        held = json.loads(self.files.read(f"manifests/{version}.json"))
        if held["buckets"] != self.buckets:
            raise ValueError(f"the table has {held['buckets']} buckets")
        return version, {int(k): v for k, v in held["of"].items()}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their folders are listed."""
        of = {k: v for k, v in self.manifest()[1].items() if buckets is None or k in buckets}
        paths = [f"{self.path}/v={v}/bucket={k}" for k, v in sorted(of.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def sync(self, wanted: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Make the table hold wanted(id, hash, ...): new and changed rows through embed, stale ones gone, others as they are.

        Returns how many rows were in which state. What passes the driver is one row for each bucket and state.
        """
        version, of = self.manifest()
        states = diff_index(self.read().select("id", "hash"), wanted.select("id", "hash"))
        counts = states.groupBy(bucket_of(F.col("id"), self.buckets).alias("bucket"), "state").agg(F.count("*").alias("n")).collect()
        told = {s: sum(r["n"] for r in counts if r["state"] == s) for s in ("new", "changed", "same", "stale")}
        touched = {r["bucket"] for r in counts if r["state"] != "same"}
        if not touched and version:
            return told
        inside = bucket_of(F.col("id"), self.buckets).isin(sorted(touched))
        due, had = wanted.filter(inside), self.read(touched)
        old = had.select("id", F.col("hash").alias("old"))
        same = had.join(due.select("id", F.col("hash").alias("now")), "id").filter(F.col("hash").eqNullSafe(F.col("now"))).select(*had.columns)
        todo = due.join(old, "id", "left").filter(F.col("old").isNull() | ~F.col("old").eqNullSafe(F.col("hash"))).select(*wanted.columns)
        rows = same.unionByName(embed(todo).select(*had.columns)).withColumn("bucket", bucket_of(F.col("id"), self.buckets))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version + 1}")
        full = {r["bucket"] for r in counts if r["state"] != "stale"}
        after = {k: version + 1 if k in touched else of[k] for k in full}
        self.files.write(f"manifests/{version + 1}.json", json.dumps({"buckets": self.buckets, "of": after}))
        self.files.write("CURRENT", str(version + 1))
        return told
