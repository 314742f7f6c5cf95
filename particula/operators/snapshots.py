"""A keyed table whose writes are single commits.

An upsert writes its rows once, as a delta beside the older ones, and then a
manifest of the new version: a small JSON text that names the data folders and
the hours each one holds. A version exists when its manifest has its name, which
the file system gives to one writer only (rename without overwriting). So a
reader sees all of a write or nothing of it, whatever fails on the way, and an
older version stays readable until `vacuum`.

Reading merges per key and column the last non-NULL value (`sinks.keep_last_at_once`),
only for hours that several folders hold; an hour in one folder is read as it
stands. `compact` writes such hours anew as one folder. Folders are partitioned
by date and hour and sorted by key, as `sinks.write_table` lays them out (by
date alone, ``slots=("date",)``, where a day is small; what is said of hours then
holds for days); the driver handles names of folders and hours, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks as SK

RETRIES = 20


class Conflict(Exception):
    """Another writer took the version."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, key=SK.READINGS_KEY, by: str = "timestamp", slots=SK.SLOT):
        self.spark, self.path, self.key, self.by, self.slots = spark, path.rstrip("/"), tuple(key), by, tuple(slots)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    # ---- the log

    def versions(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.path}/_log/*.json"))
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found or [])

    def manifest(self, version: int | None = None) -> dict:
        """The entries of a version (default: the newest): data folder, sequence, hours."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "entries": []}
        stream = self._files.open(self._path(f"{self.path}/_log/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Make the manifest the version it names, or raise Conflict."""
        draft = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"{self.path}/_log/{manifest['version']:020d}.json")
        try:
            self._context.rename(draft, target, self._no_overwrite)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(target):
                raise Conflict(manifest["version"]) from e
            raise

    def _commit(self, change) -> int:
        """Publish what ``change`` makes of the newest manifest; again where another writer came first."""
        for _ in range(RETRIES):
            now = self.manifest()
            after = change(now) | {"version": now["version"] + 1}
            try:
                self._publish(after)
                return after["version"]
            except Conflict:
                continue
        raise Conflict(f"no version was free in {RETRIES} attempts")

    # ---- data folders

    def _write(self, df: DataFrame) -> tuple[str, list[str]]:
        """Rows as a new folder: (its name, the hours that it holds)."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={name}"
        SK._clustered(df, self.key).write.partitionBy(*self.slots).parquet(folder)
        hours = self._files.globStatus(self._path("/".join([folder, *(f"{c}=*" for c in self.slots)]))) or []
        return name, sorted("/".join(h.getPath().toString().split("/")[-len(self.slots) :]) for h in hours)

    def _load(self, places: list[tuple[str, str]], schema: T.StructType) -> DataFrame:
        types = {"date": T.DateType(), "hour": T.IntegerType()}
        full = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), *(T.StructField(c, types[c]) for c in self.slots)])
        if not places:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path}/data/commit={name}/{hour}" for name, hour in places]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)

    # ---- operations

    def read(self, version: int | None = None, hours: list[str] | None = None) -> DataFrame:
        """The table at a version, all of it or the given hours (`date=…/hour=…`) only."""
        return self._merged(self.manifest(version), hours).drop(*self.slots)

    def _merged(self, manifest: dict, hours: list[str] | None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"no version of {self.path}")
        schema = T.StructType.fromJson(manifest["schema"])
        wanted, holders = None if hours is None else set(hours), {}
        for e in manifest["entries"]:
            for h in e["hours"]:
                if wanted is None or h in wanted:
                    holders.setdefault(h, []).append(e["data"])
        single = [(names[0], h) for h, names in holders.items() if len(names) == 1]
        several = [(n, h) for h, names in holders.items() if len(names) > 1 for n in names]
        out = self._load(single, schema).drop("commit")
        if several:
            sequence = F.create_map(*[F.lit(x) for e in manifest["entries"] for x in (e["data"], e["sequence"])])
            rows = self._load(several, schema).withColumn("_ingest", F.element_at(sequence, F.col("commit"))).drop("commit")
            merged = SK.keep_last_at_once(rows, key=(*self.key, *(c for c in self.slots if c not in self.key)))
            out = out.unionByName(merged.select(*out.columns)) if single else merged.select(*out.columns)
        return out

    def hours_since(self, version: int) -> list[str]:
        """The hours that commits after ``version`` wrote to."""
        return sorted({h for e in self.manifest()["entries"] if e["sequence"] > version for h in e["hours"]})

    def upsert(self, batch: DataFrame, sequence: str | None = None, note=None) -> int:
        """Merge a batch by key as one commit; its rows alone are written. The new version.

        A ``note`` (a JSON value, such as how far a source was read) becomes part of the same commit. Within a batch the row with the larger ``sequence`` (default: the order of arrival) comes later. Rows whose
        key or time is NULL are refused. Columns of another type than the stored ones fail the batch.
        """
        new = batch.dropna(subset=[*self.key, self.by])
        new = new.withColumn("_ingest", F.col(sequence) if sequence else F.monotonically_increasing_id())
        new = SK._with_slot(new, self.by).drop(*(c for c in SK.SLOT if c not in self.slots))
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema if f.name not in ("_ingest", *self.slots)])
        self._columns(self.manifest(), columns)
        name, hours = self._write(SK.keep_last_at_once(new, key=(*self.key, *(c for c in self.slots if c not in self.key))))

        def change(now: dict) -> dict:
            entry = {"data": name, "sequence": now["version"] + 1, "hours": hours}
            return now | {"schema": self._columns(now, columns).jsonValue(), "entries": [*now["entries"], entry]} | ({} if note is None else {"note": note})

        return self._commit(change)

    def _columns(self, manifest: dict, columns: T.StructType) -> T.StructType:
        """The stored columns and the new ones among ``columns``."""
        stored = T.StructType.fromJson(manifest["schema"]).fields if manifest["schema"] else []
        types = {f.name: f.dataType for f in stored}
        clash = [f.name for f in columns if f.name in types and types[f.name] != f.dataType]
        if clash:
            raise ValueError(f"types differ from the stored table: {', '.join(clash)}")
        return T.StructType([*stored, *(f for f in columns if f.name not in types)])

    def compact(self) -> int | None:
        """Write the hours that several folders hold as one folder; None where there are none.

        Deltas that arrive meanwhile come after it, since it takes the sequence of the newest folder that it merges.
        """
        base = self.manifest()
        counts: dict[str, int] = {}
        for e in base["entries"]:
            for h in e["hours"]:
                counts[h] = counts.get(h, 0) + 1
        hours = {h for h, n in counts.items() if n > 1}
        if not hours:
            return None
        merged = [e["data"] for e in base["entries"] if hours & set(e["hours"])]
        name, written = self._write(self._merged(base, sorted(hours)))
        sequence = max(e["sequence"] for e in base["entries"] if e["data"] in merged)

        def change(now: dict) -> dict:
            if not set(merged) <= {e["data"] for e in now["entries"]}:
                raise RuntimeError("another compaction came first")
            entries = [e | {"hours": [h for h in e["hours"] if e["data"] not in merged or h not in hours]} for e in now["entries"]]
            entries.append({"data": name, "sequence": sequence, "hours": written})
            return now | {"entries": sorted((e for e in entries if e["hours"]), key=lambda e: e["sequence"])}

        return self._commit(change)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the newest ``keep`` versions do not name, their own manifests apart. No write may be under way."""
        versions = self.versions()
        named = {e["data"] for v in versions[-keep:] for e in self.manifest(v)["entries"]}
        gone = []
        for f in self._files.globStatus(self._path(f"{self.path}/data/commit=*")) or []:
            name = f.getPath().getName().removeprefix("commit=")
            if name not in named:
                self._files.delete(f.getPath(), True)
                gone.append(name)
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.path}/_log/{v:020d}.json"), False)
        return gone


def upsert(spark: SparkSession, batch: DataFrame, path: str, key=SK.READINGS_KEY, by: str = "timestamp", sequence: str | None = None) -> None:
    """`sinks.upsert_table` on a table of snapshots: pass it to `start_stream_job`."""
    Snapshots(spark, path, key, by).upsert(batch, sequence)
