"""Build requests as a stream of events, their queue, and status events.

Events (event_id, ts, kind, area) are appended: `enqueue` adds an area, `cancel` takes
out the earliest waiting request of that area. Queue state is derived by pairing the
n-th cancel of an area with the n-th enqueue before it, so it needs no sequential scan.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.sources.tables import importable

#: Names of status events.
UPDATING, UPDATED, REMOVED, COUNTED, STARTED, COMPLETED = (
    "updatingRoutes",
    "routesUpdated",
    "genRequestRemoved",
    "updateIntersectionCount",
    "searchStarted",
    "searchCompleted",
)

QUEUED = "genRequestQueued"
#: Rows of requests that wait, beside the status events of a batch.
WAITS = "waits"


class Cancelled(Exception):
    """The request was taken back while its area was built; nothing is written."""


def queue_state(events: DataFrame) -> DataFrame:
    """area, enqueued, cancelled, waiting per area. Within an area, a cancel without a
    waiting request has no effect: the queue length is a sum that never falls below 0,
    which is the running sum less its least prefix."""
    w = Window.partitionBy("area").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "enqueue", 1).otherwise(-1)
    run = events.where(F.col("kind").isin("enqueue", "cancel")).withColumn("run", F.sum(step).over(w))
    last = F.max_by("run", F.struct("ts", "event_id"))
    return run.groupBy("area").agg(
        F.sum(F.when(F.col("kind") == "enqueue", 1).otherwise(0)).alias("enqueued"),
        F.sum(F.when(F.col("kind") == "cancel", 1).otherwise(0)).alias("cancelled"),
        (last - F.least(F.lit(0), F.min("run"))).alias("waiting"),
    )


def as_events(events: DataFrame) -> DataFrame:
    """The `events` table as requests: areas are 25 user blocks."""
    kind = F.when(F.col("event_type").isin("signup", "view"), "enqueue").when(F.col("event_type") == "error", "cancel")
    return events.select("event_id", "ts", kind.alias("kind"), (F.col("user_id") % 25).alias("area")).where(kind.isNotNull())


class Waiting(StatefulProcessor):
    """State of one area: its waiting requests in order of arrival, across batches.

    Rows (event_id, us, kind, request): `enqueue` appends, `cancel` takes out the earliest,
    `finish` the request that it names. Gives a row per status event (name, request), and a
    row `WAITS` per request that still waits, or one of null request if none does.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("waiting", "request long, us long")

    def handleInputRows(self, key, rows, timerValues):
        waiting = [tuple(map(int, r)) for r in self.queue.get()]
        told = []
        events = sorted((int(r.us), int(r.event_id), r.kind, r.request) for part in rows for r in part.itertuples())
        for us, event, kind, request in events:
            if kind == "enqueue":
                waiting.append((event, us))
                told.append((QUEUED, event, us))
            elif kind == "cancel" and waiting:
                told.append((REMOVED, *waiting.pop(0)))
            elif kind == "finish":
                told += [(UPDATED, *w) for w in waiting if w[0] == request]
                waiting = [w for w in waiting if w[0] != request]
        if waiting:
            self.queue.put(waiting)
        else:
            self.queue.clear()
        out = [*told, *((WAITS, *w) for w in waiting)] if waiting else [*told, (WAITS, None, None)]
        yield pd.DataFrame({"area": [int(key[0])] * len(out), "name": [x[0] for x in out], "request": pd.array([x[1] for x in out], "Int64"), "us": pd.array([x[2] for x in out], "Int64")})

    def close(self) -> None:
        pass


class BuildQueue:
    """Build requests from files, a stream with state, and the builds that they ask for.

    `start` takes in the files that came (enqueue, cancel, finish) and keeps per area who
    waits, in a state store that lives with the checkpoint: a cancel of a later file takes
    out a request of an earlier one, and a restarted queue goes on where it was. `run`
    builds what waits, the earliest first, until nothing does. Before each step of a
    build new files are taken in, so a cancel stops the build that it meets (`Cancelled`).
    A failing build is reported and does not end the queue.
    """

    SCHEMA = "event_id long, ts timestamp_ntz, kind string, area long"
    PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, build: Callable[..., object], report: Callable[[str, dict], None]) -> None:
        """`build(spark, area, report, cancelled)` makes the graph of an area."""
        self.spark, self.path, self.checkpoint, self.build, self.report = spark, path, checkpoint, build, report
        self.table = f"{checkpoint.rstrip('/')}-waiting"

    def _batch(self, df: DataFrame, batch_id: int) -> None:
        path = f"{self.table}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)  # a batch that runs again replaces itself
        told = self.spark.read.parquet(path).where(F.col("name") != WAITS)
        for r in told.orderBy("us", "request", "name").toLocalIterator():
            if r["name"] != UPDATED:  # builds report their end themselves
                self.report(r["name"], {"area": r.area, "request": r.request})

    def start(self):
        importable(self.spark)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", self.PROVIDER)
        stream = self.spark.readStream.schema(self.SCHEMA + ", request long").parquet(self.path)
        rows = stream.select("area", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", "request")
        kept = rows.groupBy("area").transformWithStateInPandas(Waiting(), "area long, name string, request long, us long", "update", "none")
        return kept.writeStream.outputMode("update").foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def waiting(self) -> DataFrame:
        """area, request, us of the requests that wait: of each area, what its last batch left."""
        rows = self.spark.read.schema("area long, name string, request long, us long, batch long").parquet(self.table).where(F.col("name") == WAITS)
        last = F.max("batch").over(Window.partitionBy("area"))
        return rows.withColumn("__last", last).where((F.col("batch") == F.col("__last")) & F.col("request").isNotNull()).select("area", "request", "us")

    def _take_in(self) -> None:
        self.start().awaitTermination()

    def _finish(self, area: int, request: int) -> None:
        done = self.spark.range(1).select(
            F.expr("unix_micros(current_timestamp())").alias("event_id"), F.expr("cast(current_timestamp() as timestamp_ntz)").alias("ts"),
            F.lit("finish").alias("kind"), F.lit(area).cast("long").alias("area"), F.lit(request).cast("long").alias("request"),
        )
        done.coalesce(1).write.mode("append").parquet(self.path)

    def run(self) -> int:
        """Builds what waits; gives the number of builds that came to their end."""
        built = 0
        while True:
            self._take_in()
            first = self.waiting().orderBy("us", "request").first()
            if first is None:
                return built
            area, request = first.area, first.request

            def cancelled() -> bool:
                self._take_in()
                return self.waiting().where((F.col("area") == area) & (F.col("request") == request)).isEmpty()

            self.report(UPDATING, {"area": area, "request": request})
            end: dict = {"area": area, "request": request}
            try:
                self.build(self.spark, area, lambda name, values: self.report(name, {"area": area, **values}), cancelled)
                built += 1
            except Cancelled:
                continue  # its cancel was reported when it was taken in
            except Exception as error:  # the request fails, the queue goes on
                end["error"] = str(error)
            self.report(UPDATED, end)
            self._finish(area, request)


def status_counts(events: DataFrame) -> DataFrame:
    """Status events that the requests lead to, counted by name."""
    names = F.when(F.col("kind") == "enqueue", F.array(F.lit(UPDATING), F.lit(UPDATED))).otherwise(F.array(F.lit(REMOVED)))
    return events.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("events"))
