"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame functions alone.

Arrivals become small shards. Runs of shards in the same size tier are merged into files of
about the target size. A version is one small file that names its manifest, a Parquet
table of live shards, and their schema; it comes into being whole, in one step that fails if another writer
has made that version. Readers take a version and see its shards only; a writer that fails or dies leaves
no trace in it and blocks nobody.

A writer leaves an intent before it writes its first file and takes it away when it is done;
``vacuum`` spares the files of open intents, and whatever a version younger than its retention lists.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a merged file, the growth of a tier, the fewest shards that are merged.
TARGET, TIER, FEWEST = 64 << 20, 4, 2
#: Shards of a tier that one task of the plan puts in order.
TOGETHER = 4096
#: Seconds that files outlive their last version, and that an intent holds.
RETENTION = 7 * 24 * 3600.0
SCHEMA = "shard string, bytes long, rows long, tier int, added long"


class Conflict(RuntimeError):
    """Another writer committed the version first, or this writer's files are gone."""


@dataclass
class Store:
    """A folder of shards: files below data/<writer>, tables manifest/<writer>, versions version/v<n>, open writers intent/<writer>."""

    spark: SparkSession
    root: str

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, time of change) of what a folder holds."""
        fs, path = self._fs()
        top = path(f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(top)] if fs.exists(top) else []

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max((int(n[1:]) for n, _ in self._listed("version") if n.startswith("v")), default=0)

    def state(self, version: int) -> tuple[str | None, T.StructType]:
        """(manifest folder, schema) of a version; (None, no columns) of version 0."""
        if not version:
            return None, T.StructType([])
        told = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/version/v{version:09d}").collect()))
        return told["manifest"], T.StructType.fromJson(told["schema"])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: shard (its path below root), bytes, rows, tier, added (the version that wrote it)."""
        folder, _ = self.state(self.version() if version is None else version)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], SCHEMA)

    def commit(self, shards: DataFrame, base: int, schema: T.StructType, writer: str | None = None) -> int:
        """Makes shards the version after base, or raises Conflict; with writer only if its data folder is as it was."""
        fs, path = self._fs()
        folder, before = f"manifest/{uuid.uuid4().hex}", self.weight(writer)
        shards.select("shard", "bytes", "rows", "tier", "added").coalesce(8).write.parquet(f"{self.root}/{folder}")
        draft, final = path(f"{self.root}/draft/{uuid.uuid4().hex}"), path(f"{self.root}/version/v{base + 1:09d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"manifest": folder, "schema": json.loads(schema.json())}).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        try:
            if self.weight(writer) != before:
                raise Conflict(f"files of data/{writer} are gone")
            if not self._publish(fs, draft, final):
                raise Conflict(f"version {base + 1} is taken")
        finally:
            fs.delete(draft, False)
        return base + 1

    def _publish(self, fs, draft, final) -> bool:  # noqa: ANN001
        """Gives draft its final name in one step; False if that name is taken."""
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":
                # a rename within a local folder would overwrite; a link does not
                jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(x.toUri().getPath()).toPath() for x in (final, draft)))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Exception:
            if fs.exists(final):
                return False
            raise
        return True

    def weight(self, writer: str | None) -> tuple[int, int]:
        """(files, bytes) of a writer's data folder."""
        fs, path = self._fs()
        top = path(f"{self.root}/data/{writer}")
        if writer is None or not fs.exists(top):
            return 0, 0
        told = fs.getContentSummary(top)
        return told.getFileCount(), told.getLength()

    @contextlib.contextmanager
    def writing(self, base: int) -> Iterator[str]:
        """The name of a writer, whose intent lasts as long as the context."""
        fs, path = self._fs()
        writer = f"{base + 1:09d}-{uuid.uuid4().hex[:12]}"
        intent = path(f"{self.root}/intent/{writer}")
        fs.createNewFile(intent)
        try:
            yield writer
        finally:
            fs.delete(intent, False)

    def written(self, writer: str, schema: T.StructType, added: int, target: int) -> DataFrame:
        """The shards with rows in a writer's folder, their sizes and row counts as the scan tells them."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/data/{writer}")
        file = rows.metadataColumn("_metadata")
        rows = rows.select(below_root(file["file_path"]).alias("shard"), file["file_size"].alias("bytes"))
        return rows.groupBy("shard").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows")).select("shard", "bytes", "rows", tier_of(F.col("bytes"), target).alias("tier"), F.lit(added).cast("long").alias("added"))

    def scan(self, shards: list[str], schema: T.StructType) -> DataFrame:
        """The rows of shards; the last column is their shard, called ``shard`` with underscores before it if the rows have such a column. A column that a shard lacks is null."""
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s}" for s in shards])
        return rows.withColumn(free("shard", rows.columns), below_root(rows.metadataColumn("_metadata")["file_path"]))

    def append(self, df: DataFrame, target: int = TARGET, most_tries: int = 16) -> int:
        """Writes df as new shards, one for each partition with rows, and commits the next version. Rows stay as they are,
        with nulls, repeats and columns of any name; a frame without rows adds a version but no shard.

        Columns that the store lacks are added to its schema, columns that df lacks are null in its
        rows; a column that changes its type raises ValueError before anything is written. If other
        writers commit meanwhile, the files are kept and committed after theirs.
        """
        base = self.version()
        merged(self.state(base)[1], df.schema)
        with self.writing(base) as writer:
            df.write.option("compression", "zstd").parquet(f"{self.root}/data/{writer}")
            for _ in range(most_tries):
                base = self.version()
                new = self.written(writer, df.schema, base + 1, target)
                try:
                    return self.commit(self.manifest(base).unionByName(new), base, merged(self.state(base)[1], df.schema), writer)
                except Conflict:
                    if self.version() == base:
                        raise
        raise Conflict(f"other writers came first {most_tries} times")

    def plan(self, version: int, target: int = TARGET, fewest: int = FEWEST) -> DataFrame:
        """(shard, tier): the shards to merge. In each tier below the full one, shards in the order of
        their names fill stretches of about target bytes; stretches of fewer than fewest shards wait.
        A tier of many shards is dealt by hash to groups of about TOGETHER, so that no task orders a whole tier."""
        small = self.manifest(version).where("tier > 0")
        many = small.groupBy("tier").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).alias("groups"))
        small = small.join(many, "tier").withColumn("g", F.pmod(F.xxhash64("shard"), "groups"))
        order = Window.partitionBy("tier", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        runs = small.withColumn("run", F.floor((F.sum("bytes").over(order) - F.col("bytes")) / F.lit(target)))
        return runs.withColumn("n", F.count("*").over(Window.partitionBy("tier", "g", "run"))).where(F.col("n") >= fewest).select("shard", "tier")

    def compact(self, target: int = TARGET, fewest: int = FEWEST) -> int:
        """Merges the planned shards of each tier into files of about target bytes and commits the next version; the same version where nothing is to merge. Conflict if another writer came first."""
        base = self.version()
        _, schema = self.state(base)
        tiers: dict[int, list[str]] = {}
        for r in self.plan(base, target, fewest).sort("tier", "shard").collect():
            tiers.setdefault(r.tier, []).append(r.shard)
        if not tiers:
            return base
        with self.writing(base) as writer:
            with self.packed(target):
                for tier, shards in tiers.items():
                    rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{x}" for x in shards])
                    rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{writer}/{tier}")
            moved = self.spark.createDataFrame([(x,) for shards in tiers.values() for x in shards], "shard string")
            live = self.manifest(base).join(moved, "shard", "left_anti")
            return self.commit(live.unionByName(self.written(writer, schema, base + 1, target)), base, schema, writer)

    @contextlib.contextmanager
    def packed(self, target: int) -> Iterator[None]:
        """Meanwhile a scan packs whole files to tasks of target bytes at most, so that each run is read and written by one task, without a shuffle."""
        wanted = {"maxPartitionBytes": target, "openCostInBytes": 0, "minPartitionNum": 1}
        before = {k: self.spark.conf.get(f"spark.sql.files.{k}", None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(f"spark.sql.files.{k}", str(v))
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(f"spark.sql.files.{k}") if v is None else self.spark.conf.set(f"spark.sql.files.{k}", v)

    def vacuum(self, retention: float = RETENTION) -> int:
        """Deletes the files that neither the last version nor one committed within retention seconds lists, and tells how many.

        Files of open intents stay; an intent that is older than retention belongs to a dead writer
        and holds no longer, so retention must exceed the longest write. Readers of older versions must be done.
        """
        fs, path = self._fs()
        now, last = time.time(), self.version()
        kept = [v for n, t in self._listed("version") if (v := int(n[1:])) == last or t >= now - retention]
        opened = {n for n, t in self._listed("intent") if t >= now - max(retention, 1.0)}
        states = [self.state(v)[0] for v in kept if v]
        for n, t in self._listed("manifest"):
            if f"manifest/{n}" not in states and t < now - retention:
                fs.delete(path(f"{self.root}/manifest/{n}"), True)
        if not fs.exists(path(f"{self.root}/data")):
            return 0
        live = self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{x}" for x in states]) if states else self.spark.createDataFrame([], SCHEMA)
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
        there = there.where(F.col("modificationTime") < F.timestamp_millis(F.lit(int((now - retention) * 1000)))).select(below_root(F.col("path")).alias("shard"))
        there = there.where(~F.split_part("shard", F.lit("/"), F.lit(2)).isin(sorted(opened))) if opened else there
        gone = 0
        for r in there.join(live.select("shard").distinct(), "shard", "left_anti").toLocalIterator():
            gone += fs.delete(path(f"{self.root}/{r.shard}"), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their shard as last column; for a version without a shard an empty frame of its schema."""
        version = self.version() if version is None else version
        _, schema = self.state(version)
        shards = [r.shard for r in self.manifest(version).select("shard").collect()]
        return self.scan(shards, schema) if shards else self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(free("shard", schema.names), T.StringType())]))


def below_root(file: Column) -> Column:
    return F.concat(F.lit("data/"), F.element_at(F.split(file, "/data/"), -1))


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of old, then those that only new has; all may be null."""
    out = {f.name.lower(): T.StructField(f.name, f.dataType) for f in old.fields}
    for f in new.fields:
        own = out.setdefault(f.name.lower(), T.StructField(f.name, f.dataType))
        if own.dataType != f.dataType:
            raise ValueError(f"{f.name} is {own.dataType.simpleString()} in the store and {f.dataType.simpleString()} here")
    return T.StructType(list(out.values()))


def free(name: str, columns: list[str]) -> str:
    """name, with underscores put before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def tier_of(size: Column, target: int) -> Column:
    """0 for full shards (over half the target), then one more for each factor TIER that they are smaller."""
    return F.greatest(F.lit(0), F.floor(F.log(float(TIER), F.lit(float(target)) / F.greatest(size, F.lit(1)) / 2)) + 1).cast("int")
