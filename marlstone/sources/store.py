"""A collection in a folder: versioned Parquet snapshots, a log of changes, and a manifest that names what counts.

A change is a Parquet folder of its own; it counts once the manifest names it. The manifest is replaced in one step, so
a change that was cut off leaves files behind but no trace in the collection. One writer at a time: a lock file is made
for each change, and a second writer is refused. What a checkpoint replaces stays until the next one, for readers that
still scan it.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.mutations import fold
from marlstone.sources.files import FormatError

VERSION, OLDEST = 2, 1
#: Milliseconds after which a lock counts as left behind by a writer that is gone.
LEASE = 3_600_000


class LockedError(RuntimeError):
    """Another writer is at work."""


class Folder:
    """A folder in any store that Spark writes to, with a manifest that is replaced in one step, and a writer's lock."""

    def __init__(self, spark: SparkSession, path: str, empty: dict) -> None:
        self.spark, self.path, self._empty = spark, path.rstrip("/"), empty
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._held = 0

    def _p(self, name: str):
        return self._at(f"{self.path}/{name}")

    def manifest(self) -> dict:
        if not self._fs.exists(self._p("MANIFEST")):
            return {"version": VERSION} | json.loads(json.dumps(self._empty))
        try:
            stream = self._fs.open(self._p("MANIFEST"))
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        except Exception as e:
            raise FormatError(f"the manifest of {self.path} can't be read") from e
        if not OLDEST <= found.get("version", 0) <= VERSION:
            raise FormatError(f"{self.path} has an unknown version")
        return json.loads(json.dumps(self._empty)) | found

    def _create(self, name: str, data: bytes, replace: bool) -> None:
        out = self._fs.create(self._p(name), replace)
        out.write(bytearray(data))
        out.close()

    def publish(self, m: dict) -> None:
        name = f"MANIFEST-{uuid.uuid4().hex}"
        self._create(name, json.dumps(m | {"version": VERSION}).encode(), True)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p(name).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark.sparkContext._gateway.new_array(rename, 1)
        modes[0] = rename.OVERWRITE
        context.rename(self._p(name), self._p("MANIFEST"), modes)

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """Holds the lock; a second writer gets a LockedError. A lock older than LEASE is taken over."""
        if self._held:  # this writer's own
            self._held += 1
            try:
                yield
            finally:
                self._held -= 1
            return
        at = self._p("LOCK")
        if self._fs.exists(at) and time.time_ns() // 1_000_000 - self._fs.getFileStatus(at).getModificationTime() > LEASE:
            self._fs.delete(at, False)
        try:
            self._create("LOCK", uuid.uuid4().hex.encode(), False)
        except Exception as e:
            raise LockedError(f"another writer changes {self.path}") from e
        self._held = 1
        try:
            yield
        finally:
            self._held = 0
            self._fs.delete(at, False)

    def delete(self, names: list[str]) -> None:
        for name in names:
            self._fs.delete(self._p(name), True)

    def bytes(self) -> int:
        return self._fs.getContentSummary(self._at(self.path)).getLength()


def checksum(df: DataFrame):
    """A sum over all rows that doesn't depend on their order."""
    return F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


class Store(Folder):
    """path: a folder in any store that Spark writes to. keep: snapshots that stay after a checkpoint."""

    def __init__(self, spark: SparkSession, path: str, id: str = "id", keep: int = 2) -> None:
        super().__init__(spark, path, {"lsn": 0, "snapshots": [], "log": [], "indexes": [], "gone": [], "batches": {}})
        self.id, self.keep = id, keep

    def _written(self, df: DataFrame, kind: str) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        found = self._read({"name": name})
        rows, total = found.agg(F.count("*"), checksum(found)).first()
        return {"name": name, "rows": rows, "checksum": total, "schema": json.loads(df.schema.json())}

    def append(self, changes: DataFrame, op: str, batch: tuple[str, int] | None = None) -> int:
        """Logs rows (upsert) or ids (remove) as one change; its number.

        batch: a stream's name and the number of its batch. One that has been logged before changes nothing.
        """
        if op not in ("upsert", "remove"):
            raise ValueError(f"unknown change {op!r}")
        with self.writing():
            m = self.manifest()
            if batch is not None:
                if m["batches"].get(batch[0], -1) >= batch[1]:
                    return m["lsn"]
                m["batches"][batch[0]] = batch[1]
            m["lsn"] += 1
            m["log"].append(self._written(changes, "log") | {"lsn": m["lsn"], "op": op})
            self.publish(m)
        return m["lsn"]

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        if rows.groupBy(self.id).count().where(f"count > 1 or `{self.id}` is null").limit(1).count():
            raise ValueError("ids must be there and differ within a change")
        return self.append(rows, "upsert", batch)

    def remove(self, ids: DataFrame) -> int:
        return self.append(ids.select(self.id).distinct(), "remove")

    def set(self, **changes) -> None:
        """Other entries of the manifest."""
        with self.writing():
            self.publish(self.manifest() | changes)

    def _read(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{entry['name']}")

    def load(self) -> DataFrame | None:
        """The collection as it is now: the newest snapshot, and the last change of each id since then."""
        m = self.manifest()
        base = self._read(m["snapshots"][-1]) if m["snapshots"] else None
        parts = [self._read(e).withColumns({"lsn": F.lit(e["lsn"]), "op": F.lit(e["op"])}) for e in m["log"]]
        if not parts:
            return base
        log = parts[0]
        for p in parts[1:]:
            log = log.unionByName(p, allowMissingColumns=True)
        if base is None:
            return fold(log, self.id)
        kept = base.join(log.select(self.id).distinct(), self.id, "left_anti")
        return kept.unionByName(fold(log, self.id), allowMissingColumns=True)

    def checkpoint(self) -> None:
        """A new snapshot of the collection; the log begins anew. What the checkpoint before has replaced is deleted."""
        with self.writing():
            now, m = self.load(), self.manifest()
            if now is None:
                return
            before, m["gone"] = m["gone"], [e["name"] for e in m["log"]]
            m["snapshots"].append(self._written(now, "snapshot") | {"lsn": m["lsn"]})
            m["gone"] += [e["name"] for e in m["snapshots"][: -self.keep]]
            m["snapshots"], m["log"] = m["snapshots"][-self.keep :], []
            self.publish(m)
            self.delete(before)

    def verify(self) -> None:
        """FormatError unless every part that the manifest names is there with its rows, unchanged."""
        m = self.manifest()
        for e in [*m["snapshots"], *m["log"]]:
            try:
                df = self._read(e)
                rows, total = df.agg(F.count("*"), checksum(df)).first()
            except Exception as x:
                raise FormatError(f"{e['name']} can't be read") from x
            if rows != e["rows"]:
                raise FormatError(f"{e['name']} has {rows} rows, not {e['rows']}")
            if total != e.get("checksum", total):
                raise FormatError(f"{e['name']} holds other values than were written")

    def identify(self) -> dict:
        m = self.manifest()
        return {"kind": "collection", "version": m["version"], "lsn": m["lsn"], "snapshots": len(m["snapshots"]), "segments": len(m["log"]), "bytes": self.bytes(), "indexes": m["indexes"]}


def shared_folder(spark: SparkSession) -> str:
    """Where tables that all executors read are put: below spark.checkpoint.dir, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return f"{root.rstrip('/')}/marlstone"
