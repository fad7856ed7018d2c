"""Shards of a growing dataset, kept by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards, one or more a task. A
compaction sorts shards smaller than the target into tiers by size, each ``RATIO``
times the one below; wherever ``RUNS`` or more of one tier have gathered, they are
merged, as many at a time as fit the target size. Merging goes on until no tier has
that many. Merged shards are new files; nothing is changed in place.

The state of a dataset is a manifest, a list of shards with rows and bytes. Every
append and every round of compaction commits the next version of it: the manifest is
written under a name of its own and then renamed to its version, which fails if another
writer took that version first; the loser reads the new state and tries again (or, if
shards that it merged are gone, leaves its work). Readers of a version see that version
only, whatever is committed later. ``vacuum`` removes the files that no kept version lists.

Tasks write shards under new names and report them through Spark's committed output,
so repeated and lost attempts never get into a manifest. A merge moves no rows between
tasks: each merge is one task that streams row groups from its inputs to its output.

Defined results. Very long texts are stored whole. A read returns every appended row as often as it was appended, with
all columns; clashing column names are kept, as columns are stored by place. Appends
need the columns and types of the dataset. Null values, empty texts and empty tables
are stored like others (an empty append commits a version without new shards).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files, scratch

TARGET_BYTES = 512 << 20
#: Rows of at most so many bytes in memory make one shard of an arrival.
ARRIVAL_BYTES = 32 << 20
RUNS = 4
RATIO = 4.0
#: The largest size of the lowest tier.
TIER_BYTES = 4 << 20
_GROUP_BYTES = 16 << 20

SHARDS = "path string, rows long, bytes long, replaces string"


class Conflict(RuntimeError):
    """Another writer removed shards that this one built on."""


def _rows(found: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*found, strict=True)) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "rows", "bytes", "replaces"])


class _Out:
    """One shard being written."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.path = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.file = files.create(self.path)
        self.writer = pq.ParquetWriter(self.file, schema, compression="zstd", compression_level=1)
        self.rows = self.held_bytes = self.bytes = 0
        self.held: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        size = batch.get_total_buffer_size() if hasattr(batch, "get_total_buffer_size") else batch.nbytes
        size = min(size, batch.nbytes)
        self.held_bytes += size
        self.bytes += size
        if self.held_bytes > _GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held))
            self.held, self.held_bytes = [], 0

    def close(self, replaces: list[str]) -> tuple[str, int, int, str]:
        self._flush()
        self.writer.close()
        size = self.file.tell()
        self.file.close()
        return self.path, self.rows, size, json.dumps(replaces)


def _append(folder: str, arrival_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, found = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, int(batch.num_rows * min(1.0, _GROUP_BYTES / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                out = out or _Out(folder, batch.schema)
                out.add(batch.slice(at, step))
                if out.bytes > arrival_bytes:
                    found.append(out.close([]))
                    out = None
        if out:
            found.append(out.close([]))
        yield _rows(found)

    return run


def _merge(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in batch.column("paths").to_pylist():
                out = None
                for path in paths:
                    with files.read_at(path) as f:
                        for part in pq.ParquetFile(f).iter_batches(batch_size=4096):
                            out = out or _Out(folder, part.schema)
                            out.add(part)
                if out:
                    yield _rows([out.close(paths)])

    return run


def plan(shards: list[dict], target: int, runs: int = RUNS, ratio: float = RATIO, tier_bytes: int = TIER_BYTES) -> list[list[str]]:
    """The merges that are due: lists of paths, two or more each."""
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if s["bytes"] < target / 2:
            tier = max(0, math.ceil(math.log(max(1, s["bytes"]) / tier_bytes, ratio)))
            tiers.setdefault(tier, []).append(s)
    due = []
    for tier in sorted(tiers):
        if len(tiers[tier]) < runs:
            continue
        group: list[str] = []
        size = 0
        for s in sorted(tiers[tier], key=lambda s: (s["bytes"], s["path"])):
            if group and size + s["bytes"] > target:
                due.append(group)
                group, size = [], 0
            group.append(s["path"])
            size += s["bytes"]
        due.append(group)
    return [g for g in due if len(g) > 1]


@dataclass
class Dataset:
    """A versioned dataset in a folder that all executors share."""

    spark: SparkSession
    folder: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit() and len(n) == 17)

    def read_manifest(self, version: int) -> dict:
        with files.read_at(self._manifest(version)) as f:
            return json.loads(f.read())

    def current(self) -> tuple[int, dict]:
        found = self.versions()
        return (found[-1], self.read_manifest(found[-1])) if found else (0, {"schema": None, "names": None, "shards": []})

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether the version is now this manifest; false if another writer has it."""
        draft = f"{self.folder}/manifests/.{uuid.uuid4().hex}"
        with files.create(draft) as f:
            f.write(json.dumps(manifest).encode())
        jvm = self.spark._jvm
        fs, _ = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self._manifest(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(draft), at, none)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            fs.delete(jvm.org.apache.hadoop.fs.Path(draft), False)
            return False
        return True

    def commit(self, added: list[dict], removed: set[str], **more: object) -> int:
        """The version that has the shards added and not those removed."""
        while True:
            version, manifest = self.current()
            have = {s["path"] for s in manifest["shards"]}
            if not removed <= have:
                raise Conflict("shards to be replaced are no longer listed")
            shards = [s for s in manifest["shards"] if s["path"] not in removed] + added
            if self._publish(version + 1, manifest | more | {"version": version + 1, "shards": shards}):
                return version + 1

    def append(self, rows: DataFrame, arrival_bytes: int = ARRIVAL_BYTES) -> int:
        """Adds the rows as small shards; the version that has them."""
        _, manifest = self.current()
        places = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in places.schema.fields]).json()
        if manifest["schema"] is not None and (manifest["schema"], manifest["names"]) != (schema, rows.columns):
            raise ValueError("rows don't have the dataset's columns")
        done = scratch.save(places.mapInArrow(_append(f"{self.folder}/shards", arrival_bytes), SHARDS), "sharding-append")
        added = [{"path": r.path, "rows": r.rows, "bytes": r.bytes} for r in done.collect()]  # file names and sizes
        return self.commit(added, set(), schema=schema, names=rows.columns)

    def compact(self, target: int = TARGET_BYTES, runs: int = RUNS, ratio: float = RATIO, tier_bytes: int = TIER_BYTES, keep: int | None = None) -> int:
        """Merges until no tier has enough shards; the last version. All older versions stay readable, or with
        ``keep`` only the last so many: for use when nothing else reads or writes."""
        version, manifest = self.current()
        while due := plan(manifest["shards"], target, runs, ratio, tier_bytes):
            jobs = self.spark.createDataFrame([(i, g) for i, g in enumerate(due)], "job int, paths array<string>").repartitionById(len(due), "job")
            done = scratch.save(jobs.select("paths").mapInArrow(_merge(f"{self.folder}/shards"), SHARDS), "sharding-merge").collect()
            added = [{"path": r.path, "rows": r.rows, "bytes": r.bytes} for r in done]
            try:
                version = self.commit(added, {p for r in done for p in json.loads(r.replaces)})
            except Conflict:
                for s in added:  # another compaction was there first
                    files.remove(s["path"])
            if keep is not None:
                self.vacuum(keep, 0)
            _, manifest = self.current()
        return version

    def vacuum(self, keep: int = 1, grace: float = 86_400) -> list[str]:
        """Removes all but the last keep versions, the shards that only they list, and shards
        that none lists and that are older than ``grace`` seconds (younger ones may be about
        to be committed). For use when no older version is being read."""
        found = self.versions()
        old, live = found[:-keep], found[-keep:]
        listed = {s["path"] for v in live for s in self.read_manifest(v)["shards"]}
        gone = {s["path"] for v in old for s in self.read_manifest(v)["shards"]} - listed
        known = {p.rpartition("/")[2] for p in listed}
        gone |= {f"{self.folder}/shards/{name}" for name, age in files.ages(f"{self.folder}/shards") if name not in known and age >= grace}
        for path in sorted(gone):
            files.remove(path)
        for v in old:
            files.remove(self._manifest(v))
        return sorted(gone)

    def shards(self, version: int | None = None) -> list[dict]:
        return (self.read_manifest(version) if version else self.current()[1])["shards"]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the current one by default."""
        manifest = self.read_manifest(version) if version else self.current()[1]
        if manifest["schema"] is None:
            raise ValueError("the dataset is empty and has no columns yet")
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [s["path"] for s in manifest["shards"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.toDF(*manifest["names"])


def create(spark: SparkSession) -> Dataset:
    """A new dataset in the shared folder."""
    return Dataset(spark, scratch.new_path(spark, "dataset"))


def arrivals(rows: DataFrame, by: str, parts: int) -> list[DataFrame]:
    """rows in so many parts by ranges of a number, as if they had arrived one after the other; rows without it come first."""
    cuts = sorted(set(rows.select(F.col(by).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01)))
    key = F.col(by).cast("double")
    out = []
    for i in range(len(cuts) + 1):
        part = key <= cuts[i] if i < len(cuts) else F.lit(True)
        out.append(rows.filter((key.isNull() | part) if i == 0 else part & (key > cuts[i - 1])))
    return out
