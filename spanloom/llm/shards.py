"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder with immutable runs (Parquet folders) and manifests ``manifest-<version>.json``. Arrivals are appended
as small runs. Compaction looks for runs of similar size; ``fanout`` or more of them are rewritten as one run whose files
have about the target size, without a shuffle: small files are only read together. A change becomes visible by renaming a
finished manifest to the next version, which fails if another writer took that version; readers keep the version they
opened, until :meth:`ShardStore.vacuum` removes the folders that none of the versions to keep lists (and a failed job's).
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators.tables import ROW_GROUPS


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 256 << 20, fanout: int = 4, similar: float = 2.0):
        self.spark, self.root, self.target_bytes, self.fanout, self.similar = spark, root.rstrip("/"), target_bytes, fanout, similar
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/data"))

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _list(self, folder: str) -> list:
        return list(self.fs.listStatus(self._path(folder)))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list(self.root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "schema", "runs": [{"path", "bytes", "files"}]}``; version 0 is the empty store."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self.fs.open(self._path(f"{self.root}/manifest-{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, runs: list[dict], schema: str) -> dict:
        after = {"version": base["version"] + 1, "schema": schema, "runs": runs}
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(json.dumps(after).encode()))
        finally:
            stream.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # atomic, and an error if the version exists
            context.rename(self._path(draft), self._path(f"{self.root}/manifest-{after['version']:08d}.json"), options)
        except Exception:
            self.fs.delete(self._path(draft), False)
            raise
        return after

    def _run(self, path: str) -> dict:
        files = [s for s in self._list(path) if s.getPath().getName().startswith("part-")]
        return {"path": path, "bytes": sum(s.getLen() for s in files), "files": len(files)}

    def append(self, df: DataFrame) -> dict:
        """One arrival as one run of as many files as ``df`` has partitions; returns the new manifest."""
        base, path = self.manifest(), f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.options(**ROW_GROUPS).parquet(path)
        return self._commit(base, [*base["runs"], self._run(path)], df.schema.json())

    def append_arrivals(self, df: DataFrame, arrival: str) -> dict:
        """As one :meth:`append` for each value of the column ``arrival`` (which is not stored), in one job and one commit."""
        base, path = self.manifest(), f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.options(**ROW_GROUPS).partitionBy(arrival).parquet(path)
        runs = sorted((s.getPath().toString() for s in self._list(path) if s.isDirectory()))
        return self._commit(base, [*base["runs"], *[self._run(p) for p in runs]], df.drop(arrival).schema.json())

    def _similar(self, runs: list[dict]) -> list[dict]:
        """The first ``fanout`` or more runs, by size (of equal sizes the earlier one), of which the largest is at most ``similar`` times the smallest."""
        ordered = sorted((r for r in runs if r["files"]), key=lambda r: r["bytes"])
        while ordered:
            group = [r for r in ordered if r["bytes"] <= self.similar * max(1, ordered[0]["bytes"])]
            if len(group) >= self.fanout:
                return group
            ordered = ordered[len(group) :]
        return []

    def compact(self) -> dict:
        """Merges similar runs until no tier has ``fanout``; runs in whole target-sized files already are left alone.

        Merged runs stay for readers of older versions, until :meth:`vacuum`.
        """
        base = self.manifest()
        while group := self._similar([r for r in base["runs"] if r["bytes"] < r["files"] * self.target_bytes * 0.5 or r["files"] == 1 and r["bytes"] < self.target_bytes]):
            paths = [r["path"] for r in group]
            schema = StructType.fromJson(json.loads(base["schema"]))
            n = max(1, math.ceil(sum(r["bytes"] for r in group) / self.target_bytes))
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*paths).coalesce(n).write.options(**ROW_GROUPS).parquet(path)
            base = self._commit(base, [*[r for r in base["runs"] if r["path"] not in paths], self._run(path)], base["schema"])
        return base

    def vacuum(self, keep: int = 1, min_age_s: float = 86_400.0) -> int:
        """Removes folders under ``data`` that none of the newest ``keep`` manifests lists; returns how many. Older versions cannot be read then.

        A folder changed within ``min_age_s`` seconds stays: it may be an append or a compaction that has not committed yet.
        """
        if keep < 1:
            raise ValueError("the newest version stays")
        used = [r["path"].removeprefix("file:").lstrip("/") for v in self.versions()[-keep:] for r in self.manifest(v)["runs"]]
        latest = (time.time() - min_age_s) * 1000
        unused = [s for s in self._list(f"{self.root}/data") if not any(s.getPath().getName() in u.split("/") for u in used)]
        stale = [s.getPath() for s in unused if self._changed(s) <= latest]
        for path in stale:
            self.fs.delete(path, True)
        return len(stale)

    def _changed(self, status) -> int:
        """When the newest file below a folder was written, in milliseconds."""
        return max([status.getModificationTime(), *(self._changed(s) for s in self._list(status.getPath().toString()) if status.isDirectory())])

    @staticmethod
    def own_columns(names: list[str]) -> tuple[str, str, str]:
        """Names for run, shard and version beside the stored columns: with underscores in front where they would clash, whatever their case."""
        taken, out = {n.lower() for n in names}, []
        for name in ("run", "shard", "version"):
            while name in taken:
                name = f"_{name}"
            out.append(name)
        return tuple(out)

    def read(self, version: int | None = None) -> DataFrame:
        """Stored rows with ``run`` (its number in the manifest), ``shard`` (the file's number in the run) and ``version``, or :meth:`own_columns`."""
        state = self.manifest(version)
        schema = StructType.fromJson(json.loads(state["schema"])) if state["schema"] else StructType()
        names, out = self.own_columns(schema.names), None
        for number, run in enumerate(state["runs"]):
            if run["files"]:
                part = self.spark.read.schema(schema).parquet(run["path"])
                shard = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
                part = part.select(*[F.col(f"`{c}`") for c in part.columns], F.lit(number).alias(names[0]), shard.alias(names[1]), F.lit(state["version"]).alias(names[2]))
                out = part if out is None else out.unionByName(part)
        if out is None:
            for name in names:
                schema.add(name, IntegerType())
            return self.spark.createDataFrame([], schema)
        return out


def sharded(docs: DataFrame, root: str, *, id_col: str = "doc_id", arrivals: int = 8, target_bytes: int = 64 << 20, fanout: int = 4) -> ShardStore:
    """A store of all rows of ``docs``: ``arrivals`` batches by hash of the id, appended in one job, then compacted.

    Any rows are kept as they are: nulls, repeated rows, very long texts; a null id is a value like any other. Columns may
    have any names; where one is called ``run``, ``shard`` or ``version``, the store's own get another name
    (:meth:`ShardStore.own_columns`). An empty table makes a manifest without files.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes=target_bytes, fanout=fanout)
    arrival = "__arrival"
    while arrival in {c.lower() for c in docs.columns}:
        arrival = f"_{arrival}"
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    store.append_arrivals(docs.withColumn(arrival, F.pmod(F.xxhash64(key, F.lit("arrival")), F.lit(arrivals)).cast("int")), arrival)
    store.compact()
    return store
