"""A catalog that is kept up by small writes: merge on read, with compaction by bucket.

A catalog is a folder of Parquet tables. Each append adds a delta: the last row of each key that it
changes, with its seq and whether it is deleted, in folders by hash bucket of the key. A version file
names what makes up the catalog: for each bucket the folder of its base rows, and the deltas since.
Version files are written once, under the next free number, and never changed: whoever comes second
for a number fails and tries again on what is there now, and a reader sees one whole version, however
many writers there are. Readers put the deltas over the base, the largest seq of a key first.

Bytes written by an append follow the appended rows. Compaction rewrites the buckets that deltas
touch when there are MOST_DELTAS of them, or for one bucket when its deltas weigh a share of its base;
so each row is rewritten about once for every so many changes of its bucket. Folders that no version
of the last few names are removed. Nothing but the list of folders passes through the driver.

A batch that runs again (same batch id) adds nothing twice. Rows of equal key and seq: the one of the
later append stays. A key that was deleted comes back with a larger seq only, however late a smaller
one comes: tombstones stay in the base, but for those below a seq that a compaction is told to forget.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, DELETED, ORDER = "__bucket", "__deleted", "__append"


class Conflict(Exception):
    """Another writer has taken the version number."""


class Catalog:
    """The catalog at `path`: rows of `schema` by `key`, of which that of the largest `seq` counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, seq: str = "seq", buckets: int = 64, most_deltas: int = 16, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.seq = spark, path.rstrip("/"), schema, key, seq
        self.buckets, self.most_deltas, self.keep = buckets, most_deltas, keep
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._Path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop.Path(f"{self.path}/versions"))

    # ---- versions

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._Path(f"{self.path}/versions")) if f.getPath().getName().isdigit())

    def version(self, number: int | None = None) -> dict:
        """{number, base: bucket -> folder, deltas: [{folder, append, buckets: bucket -> bytes}], batches, appends, bytes}"""
        number = number if number is not None else max(self.versions(), default=0)
        if not number:
            return {"number": 0, "base": {}, "deltas": [], "batches": {}, "appends": 0, "bytes": {}}
        stream = self._fs.open(self._Path(f"{self.path}/versions/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Writes the version file whole under another name and gives it the next number, if that is still free."""
        state["number"] += 1
        aside, to = self._Path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._Path(f"{self.path}/versions/{state['number']:012d}")
        out = self._fs.create(aside, True)
        out.write(json.dumps(state).encode())
        out.close()
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            self._fs.delete(aside, False)
            raise Conflict(str(to))

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _sizes(self, folder: str) -> dict[str, int]:
        """Bytes of each bucket in a folder."""
        found = {}
        if self._fs.exists(self._Path(folder)):
            for f in self._fs.listStatus(self._Path(folder)):
                name = f.getPath().getName()
                if name.startswith(f"{BUCKET}="):
                    found[name.partition("=")[2]] = self._fs.getContentSummary(f.getPath()).getLength()
        return found

    # ---- reading

    @property
    def _stored(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields) + f", {DELETED} boolean, {ORDER} long"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(*paths) if paths else self.spark.createDataFrame([], self._stored)

    def _merged(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        """The last row of each key, tombstones too, of some buckets or all: only keys in deltas are aggregated."""
        some = lambda names: [b for b in names if buckets is None or b in buckets]
        base = self._read([f"{state['base'][b]}/{BUCKET}={b}" for b in some(state["base"])])
        delta = self._read([f"{d['folder']}/{BUCKET}={b}" for d in state["deltas"] for b in some(d["buckets"])])
        columns = base.columns
        last = delta.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(self.seq, ORDER)).alias("__d"))
        met = base.join(last, self.key, "full_outer") if state["deltas"] else base.withColumn("__d", F.lit(None).cast(delta.select(F.struct(*columns).alias("d")).schema["d"].dataType))
        newer = F.col("__d").isNotNull() & (F.col(ORDER).isNull() | (F.struct(F.col(f"__d.{self.seq}"), F.col(f"__d.{ORDER}")) >= F.struct(F.col(self.seq), F.col(ORDER))))
        return met.select(*(F.when(newer, F.col(f"__d.{c}")).otherwise(F.col(c)).alias(c) for c in columns))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._merged(self.version(number)).where(f"not {DELETED}").select(*(f"`{f.name}`" for f in self.schema.fields))

    # ---- writing

    def append(self, changes: DataFrame, batch: int | None = None, stream: str = "", deleted: str = "false") -> bool:
        """Adds the rows of changes; those for which the expression `deleted` holds take their key away. A batch that the
        catalog already has from `stream` is left out: False."""
        state = self.version()
        if batch is not None and batch <= state["batches"].get(stream, -1):
            return False
        columns = [f.name for f in self.schema.fields]
        marked = changes.select(*(F.col(f"`{c}`") for c in columns), F.coalesce(F.expr(deleted), F.lit(False)).alias(DELETED))
        last = marked.groupBy(self.key).agg(F.max_by(F.struct(*marked.columns), self.seq).alias("__r")).select("__r.*")
        folder = f"{self.path}/deltas/{uuid.uuid4().hex}"
        number = state["appends"] + 1
        self._bucket(last.withColumn(ORDER, F.lit(number).cast("long"))).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        sizes = self._sizes(folder)
        while True:
            if sizes:
                state["deltas"].append({"folder": folder, "append": number, "buckets": sizes})
            state["appends"] = max(state["appends"], number)
            if batch is not None:
                state["batches"][stream] = batch
            try:
                self._commit(state)
                return True
            except Conflict:
                state = self.version()
                if batch is not None and batch <= state["batches"].get(stream, -1):
                    return False

    def compact(self, share: float = 0.5, whole: bool = False, forget=None) -> list[str]:
        """Puts deltas into the base of the buckets that are due, and returns those: all that deltas touch if there are
        more than most_deltas of them, or if `whole`; else those whose deltas weigh `share` of their base. Tombstones of
        a seq below `forget` go: nothing older may come any more."""
        state = self.version()
        weight: dict[str, int] = {}
        for d in state["deltas"]:
            for b, size in d["buckets"].items():
                weight[b] = weight.get(b, 0) + size
        every = whole or len(state["deltas"]) > self.most_deltas
        due = {b for b, size in weight.items() if every or size > share * max(1, state["bytes"].get(b, 0)) and state["bytes"].get(b)}
        if whole and forget is not None:
            due |= set(state["base"])
        if not due:
            return []
        folder = f"{self.path}/base/{uuid.uuid4().hex}"
        rows = self._merged(state, due)
        rows = rows if forget is None else rows.where(~F.col(DELETED) | (F.col(self.seq) >= forget))
        self._bucket(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        sizes, taken = self._sizes(folder), {d["append"] for d in state["deltas"]}
        while True:
            for b in due:
                state["base"].pop(b, None)
                state["bytes"].pop(b, None)
                if b in sizes:
                    state["base"][b], state["bytes"][b] = folder, sizes[b]
            for d in state["deltas"]:
                if d["append"] in taken:
                    d["buckets"] = {b: size for b, size in d["buckets"].items() if b not in due}
            state["deltas"] = [d for d in state["deltas"] if d["buckets"]]
            try:
                self._commit(state)
                return sorted(due)
            except Conflict:
                now = self.version()
                if now["base"] != self.version(state["number"] - 1)["base"]:
                    raise  # another compaction: what was read here is no longer the base
                state = now

    def clean(self) -> int:
        """Removes versions but the last `keep`, and the folders that none of those names; how many folders went."""
        numbers = self.versions()
        kept = [self.version(n) for n in numbers[-self.keep :]]
        used = {f for v in kept for f in [*v["base"].values(), *(d["folder"] for d in v["deltas"])]}
        newest = max((self._modified(f) for f in used), default=0)
        for n in numbers[: -self.keep]:
            self._fs.delete(self._Path(f"{self.path}/versions/{n:012d}"), False)
        gone = 0
        for part in ("base", "deltas"):
            at = self._Path(f"{self.path}/{part}")
            for f in self._fs.listStatus(at) if self._fs.exists(at) else ():
                folder = f"{self.path}/{part}/{f.getPath().getName()}"
                # what is newer than all that is named may be a writer's that has not got its version yet
                if folder not in used and f.getModificationTime() <= newest:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone

    def _modified(self, folder: str) -> int:
        return self._fs.getFileStatus(self._Path(folder)).getModificationTime() if self._fs.exists(self._Path(folder)) else 0

    def bytes_of(self, number: int) -> int:
        """Bytes of the delta that a version added; 0 for a compaction."""
        before = {d["folder"] for d in self.version(number - 1)["deltas"]} if number > 1 else set()
        return sum(sum(d["buckets"].values()) for d in self.version(number)["deltas"] if d["folder"] not in before)


def index_stream(source: DataFrame, catalog: Catalog, checkpoint: str, deleted: str = "false", stream: str = "index"):
    """A writer that appends each micro-batch of source to the catalog and compacts what is due."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if catalog.append(batch, batch_id, stream, deleted):
            catalog.compact()
            catalog.clean()

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def on_request(requests: DataFrame, run, checkpoint: str):
    """A writer that calls run(wanted) once a micro-batch, with the distinct rows asked for in it. All requests that
    come while a run is under way are in the next batch, so they are one more run, and none is lost: give requests no
    limit of rows or files a trigger."""

    def once(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.distinct()
        if not wanted.isEmpty():
            run(wanted)

    return requests.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).outputMode("append")
