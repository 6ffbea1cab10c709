"""Periodic ingest as Structured Streaming: micro-batches are deduplicated and upserted into a bucketed snapshot, and each run is logged.

A snapshot is a list of buckets (by hash of the link), each a folder of files. A batch reads and rewrites the buckets that its links fall
into and no other; its manifest names, for every bucket, the version whose folder holds it, and is what commits the batch. Versions are named by batch id, so a
batch that is run again after a failure starts from the manifest before it and writes the same folders again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.feed import upsert_items
from newsloom.storage import hadoop_path

RUN = "batch_id long, status string, error string, received long, links long, inserted long, updated long, touched int, started_at string, finished_at string"


def _now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class Store:
    """One table keyed by link under ``path``, in ``buckets`` buckets (a bucket should fit a task). Readers take the last manifest.

    ``keep`` manifests stay readable; folders that none of them names are deleted.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    keep: int = 2

    # --- manifests

    def _list(self, name: str) -> list[str]:
        p, fs = hadoop_path(self.spark, f"{self.path}/{name}")
        return [PurePosixPath(s.getPath().toString()).name for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Committed batches, ascending."""
        done = []
        for d in self._list("manifests"):
            p, fs = hadoop_path(self.spark, f"{self.path}/manifests/{d}/_SUCCESS")
            if d.startswith("v") and fs.exists(p):
                done.append(int(d[1:]))
        return sorted(done)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows; one row a bucket."""
        known = [v for v in self.versions() if before is None or v < before]
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.path}/manifests/v{known[-1]}").collect()} if known else {}

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The snapshot, or some of its buckets; None while there is nothing."""
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(self.manifest(before).items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    # --- writing

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Within a batch the last row of a link wins (largest fetched_at, then id). Adds a row to ``runs`` either way."""
        started = _now()
        try:
            counts = self._upsert(batch, batch_id)
        except Exception as e:
            self._log(batch_id, "failed", started, error=str(e)[:200])
            raise
        self._log(batch_id, "success", started, **counts)

    def _upsert(self, batch: DataFrame, batch_id: int) -> dict[str, int]:
        wrote = Observation()
        rest = [c for c in batch.columns if c not in ("link", "fetched_at", "id")]
        rows = batch.groupBy("link").agg(F.max(F.struct("fetched_at", "id", *rest)).alias("r"), F.count("*").alias("n"))
        new = rows.select(*["link" if c == "link" else F.col(f"r.{c}").alias(c) for c in batch.columns], "n").persist()
        try:
            bucket = F.pmod(F.xxhash64("link"), F.lit(self.buckets)).cast("int")
            by = {r.b: (r.n, r.links) for r in new.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("links")).collect()}  # a row for each bucket
            received, links = (sum(x[i] for x in by.values()) for i in (0, 1))
            if not by:
                return {}
            before = self.manifest(batch_id)
            old = self.read(batch_id, set(by))
            merged = upsert_items(old, new.drop("n")) if old is not None else new.drop("n").withColumn("inserted", F.lit(True))
            out = merged.observe(wrote, F.count_if("inserted").alias("inserted")).drop("inserted").withColumn("bucket", bucket).repartition("bucket")
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{batch_id}")
            now = before | dict.fromkeys(by, batch_id)
            self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/v{batch_id}")
            self._clean()
            inserted = wrote.get["inserted"]
            return {"received": received, "links": links, "inserted": inserted, "updated": links - inserted, "touched": len(by)}
        finally:
            new.unpersist()

    def _clean(self) -> None:
        """Drops manifests but the last ones, and the folders of buckets that none of these names."""
        versions = self.versions()
        held = {(v, b) for at in versions[-self.keep :] for b, v in self.manifest(at + 1).items()}
        for d in self._list("data"):
            for b in self._list(f"data/{d}"):
                if b.startswith("bucket=") and int(d[1:]) <= versions[-1] and (int(d[1:]), int(b[7:])) not in held:
                    p, fs = hadoop_path(self.spark, f"{self.path}/data/{d}/{b}")
                    fs.delete(p, True)
        for v in versions[: -self.keep]:
            p, fs = hadoop_path(self.spark, f"{self.path}/manifests/v{v}")
            fs.delete(p, True)

    # --- runs

    def _log(self, batch_id: int, status: str, started: str, error: str = "", **counts: int) -> None:
        row = {"batch_id": batch_id, "status": status, "error": error, "started_at": started, "finished_at": _now()} | {k: counts.get(k, 0) for k in ("received", "links", "inserted", "updated", "touched")}
        names = [c.split()[0] for c in RUN.split(", ")]
        self.spark.createDataFrame([tuple(row[k] for k in names)], RUN).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def runs(self) -> DataFrame:
        """Every run with its figures; a batch that was run again has a row for each try."""
        return self.spark.read.schema(RUN).parquet(f"{self.path}/runs") if self._list("runs") else self.spark.createDataFrame([], RUN)


def start(items: DataFrame, store: Store, checkpoint: str, every: str | None = None):
    """Starts the query: once over what is there (``every`` None), or on a timer. Status: the returned StreamingQuery."""
    writer = items.writeStream.foreachBatch(store.upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Scheduler:
    """Runs of a capped batch query, one at a time, each ``interval`` seconds after the last, at once when triggered or capped.

    ``items`` makes the streaming rows; its source bounds what one batch reads (maxFilesPerTrigger and the like). A run takes
    ``max_batches`` micro-batches at most; one that stops at that cap is followed by the next run without a pause, from its checkpoint.
    """

    def __init__(self, items: Callable[[], DataFrame], store: Store, checkpoint: str, interval: float, max_batches: int = 1, run_on_start: bool = True):
        self.items, self.store, self.checkpoint, self.interval, self.max_batches, self.run_on_start = items, store, checkpoint, interval, max_batches, run_on_start
        self._stop, self._wake, self._lock = threading.Event(), threading.Event(), threading.Lock()
        self._thread: threading.Thread | None = None
        self._state = {"is_running": False, "last_tick_at": None, "last_error": "", "runs": 0, "batches": 0}

    def state(self) -> dict:
        with self._lock:
            return dict(self._state)

    def _set(self, **values) -> None:
        with self._lock:
            self._state |= values

    def run_once(self) -> bool:
        """One run; whether it ended at its cap. An error is kept in the state, not raised."""
        self._set(is_running=True)
        done, query, full = 0, None, threading.Event()

        def batch(rows: DataFrame, batch_id: int) -> None:
            nonlocal done
            if done >= self.max_batches:
                full.set()
                raise _Capped
            self.store.upsert(rows, batch_id)
            done += 1

        try:
            query = self.items().writeStream.foreachBatch(batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            self._set(last_error="")
        except Exception as e:
            self._set(last_error="" if full.is_set() else str(e)[:200])
        finally:
            state = self.state()
            self._set(is_running=False, last_tick_at=_now(), runs=state["runs"] + 1, batches=state["batches"] + done)
        return full.is_set()

    def _loop(self) -> None:
        now = self.run_on_start
        while not self._stop.is_set():
            if not now:
                self._wake.wait(self.interval)
                self._wake.clear()
                if self._stop.is_set():
                    break
            now = self.run_once()

    def start(self) -> None:
        """Does nothing while it runs already."""
        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=self._loop, daemon=True)
            self._thread.start()

    def trigger_now(self) -> None:
        self._wake.set()

    def stop(self, timeout: float = 5) -> None:
        """No further run; the present one is waited for, ``timeout`` seconds at most."""
        self._stop.set()
        self._wake.set()
        if self._thread is not None:
            self._thread.join(timeout)


class _Capped(Exception):
    """Ends a run at its cap: the batch is not committed, so the next run starts with it."""
