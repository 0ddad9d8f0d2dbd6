"""A sliding-window rate limiter, over tables and over streams.

Only accepted requests count, so a window function can't tell the outcome: each request
depends on the ones accepted before. Clients are independent of each other until a limit over
all clients is reached; only from there on all requests are taken one after the other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lawloom.session import shared_path

MINUTE, DAY = 60.0, 86_400.0
CELL = 3600.0
STEP = 1 << 20  # requests that one task goes through while a limit over all clients binds
# Accepted requests of a client in 60 seconds and in 24 hours, and of all clients in 24 hours.
PER_MINUTE, PER_DAY, ALL_PER_DAY = 6, 60, 3000
RESULT = "client string, id long, at double, accepted boolean, reason string"
HELD = "client string, id long, at double"


class Accepted:
    """Times of accepted requests, the oldest first; those older than a day go."""

    def __init__(self, times: Iterable[float] = ()) -> None:
        self.day = deque(times)
        self.minute = deque(self.day)

    def prune(self, at: float) -> None:
        for times, age in ((self.day, DAY), (self.minute, MINUTE)):
            while times and at - times[0] > age:
                times.popleft()

    def reason(self, at: float, per_minute: int, per_day: int) -> str | None:
        if at != at:
            return "time"
        self.prune(at)
        return "day" if len(self.day) >= per_day else "minute" if len(self.minute) >= per_minute else None

    def add(self, at: float) -> None:
        self.day.append(at)
        self.minute.append(at)


def _walk(rows: DataFrame, per_minute: int, per_day: int, all_per_day: int | None) -> DataFrame:
    """The requests of ``rows`` (client, id, at, held) decided; held ones were accepted before and only fill the state."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, own, last = Accepted(), {}, object()
        for batch in batches:
            reasons = []
            for client, at, held in zip(batch["client"], batch["at"], batch["held"], strict=True):
                if all_per_day is not None and not held and len(every.day) >= all_per_day and at - every.day[0] <= DAY:
                    reasons.append("all")  # full, and the oldest accepted request is still of the day
                    continue
                if client != last and all_per_day is None:
                    own = {}
                last = client
                times = own.setdefault(client, Accepted())
                reason = None if held else times.reason(at, per_minute, per_day)
                if all_per_day is not None:
                    every.prune(at)
                    if not held and at == at and len(every.day) >= all_per_day:
                        reason = "all"
                    if len(own) > 2 * all_per_day:  # clients without a request in the last day are forgotten
                        own = {c: x for c, x in own.items() if c == client or (x.day and at - x.day[-1] <= DAY)}
                if reason is None:
                    times.add(at)
                    every.add(at)
                reasons.append(reason)
            yield batch.drop(columns="held").assign(accepted=[r is None for r in reasons], reason=reasons)[~batch["held"]]

    # Held requests are earlier than all others; they come first where times are equal.
    if all_per_day is None:
        rows = rows.repartition("client").sortWithinPartitions("client", "at", F.desc("held"), "id")
    else:
        rows = rows.coalesce(1).sortWithinPartitions("at", F.desc("held"), "id")
    return rows.mapInPandas(walk, RESULT)


def _walk_in_turn(rows: DataFrame, held: DataFrame, per_minute: int, per_day: int, all_per_day: int, step: int) -> DataFrame:
    """``_walk`` with a limit over all clients, by ranges of (at, id) with about ``step`` rows, one after the other.

    ``rows`` are written once, dealt by range. Each range is sorted and gone through by a task of its own, which is given what was
    accepted in the day before it: at most ``all_per_day`` rows, which come to the driver between the ranges.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "walk")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    ranges = max(1, -(-rows.count() // step))
    rows.repartitionByRange(ranges, "at", "id").withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{path}/rows")
    dealt = spark.read.schema("client string, id long, at double, held boolean, range int").parquet(f"{path}/rows")
    state = held.collect()
    for k in range(ranges):
        before = spark.createDataFrame(state, HELD)
        own = dealt.where(F.col("range") == k).drop("range").unionByName(before.withColumn("held", F.lit(True)))
        out = f"{path}/decided/batch={k}"
        _walk(own, per_minute, per_day, all_per_day).write.parquet(out)
        accepted = spark.read.schema(RESULT).parquet(out).where("accepted").select("client", "id", "at").unionByName(before)
        newest = accepted.agg(F.max("at")).first()[0]
        state = accepted.where(F.col("at") >= (newest or 0.0) - DAY).collect()
    return decided(spark, path)


def first_full(accepted: DataFrame, all_per_day: int) -> float | None:
    """A time before which less than ``all_per_day`` of the accepted requests (at) stand in any day, or None where that holds for all.

    Counted by hours: the 25 hours that a day can touch hold at least what the day holds. One row an hour is looked at.
    """
    hour = F.floor(F.col("at") / CELL)
    cells = accepted.where("accepted").groupBy(hour.alias("cell")).agg(F.count("*").alias("n"))
    # Each hour counts in its own day and in those of the 24 hours after it.
    days = cells.select(F.explode(F.sequence("cell", F.col("cell") + int(DAY // CELL))).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))
    cell = days.where(F.col("n") >= all_per_day).agg(F.min("cell")).first()[0]
    return None if cell is None else cell * CELL


def limit_rows(
    requests: DataFrame,
    *,
    per_minute: int = PER_MINUTE,
    per_day: int = PER_DAY,
    all_per_day: int | None = None,
    held: DataFrame | None = None,
    step: int = STEP,
) -> DataFrame:
    """client, id, at (seconds), accepted, reason of requests (client, id, at).

    Requests are dealt by client and sorted by time and id; each task goes through them once. In hand are the
    accepted times of the last day of one client, at most per_day, so a client with very many requests costs
    time in proportion to them. A request exactly 60 seconds old still counts. ``held`` (client, id, at) are
    requests accepted before all of these, as far as they are of the last day.

    With ``all_per_day`` a request depends on all before it once that limit is reached, but not before. So clients
    are decided apart first, the hours are found in which their accepted requests could fill a day, and only
    requests from the first such hour on are gone through one after the other, by ranges of about ``step`` requests, a task
    for each, with at most all_per_day times in hand; without such an hour no request is. That needs jobs at once, as many as
    ranges, and the requests are read again. Requests without a time are refused ("time"); a null client is a client; an empty table gives no rows.
    """
    fields = ["client", F.col("id").cast("long").alias("id"), F.nanvl(F.col("at").cast("double"), F.lit(None)).alias("at")]
    rows = requests.select(*fields, F.lit(False).alias("held"))
    kept = rows.limit(0) if held is None else held.select(*fields, F.lit(True).alias("held"))
    apart = _walk(rows if held is None else rows.unionByName(kept), per_minute, per_day, None)
    if all_per_day is None:
        return apart
    known = kept.select("at", F.lit(True).alias("accepted"))
    start = first_full(apart.select("at", "accepted").unionByName(known), all_per_day)
    if start is None:
        return apart
    # A decision needs nothing later, so only earlier requests are decided apart once more.
    past = rows.where((F.col("at") < start) | F.col("at").isNull())
    early = _walk(past if held is None else past.unionByName(kept), per_minute, per_day, None)
    before = early.where("accepted").select("client", "id", "at").unionByName(kept.select("client", "id", "at")).where(F.col("at") >= start - DAY)
    return early.unionByName(_walk_in_turn(rows.where(F.col("at") >= start), before, per_minute, per_day, all_per_day, step))


def limit_stream_all(
    requests: DataFrame, path: str, checkpoint: str, *, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, all_per_day: int = ALL_PER_DAY, **trigger: object
) -> StreamingQuery:
    """A stream of requests (client, id, at) with a limit over all clients; see ``decided`` for its answers.

    Each batch goes through ``limit_rows`` with what was accepted in the day before it. That is the whole state: a
    table of at most all_per_day rows, written anew with each batch below ``path``, so idle clients go from
    it by themselves after a day. Answers and state are named by the batch's number and written over when a batch is
    run again, so a restart neither loses nor repeats any. Batches must come in order of time; in a batch, requests
    are taken in order of time and id. Triggers as in ``DataStreamWriter.trigger``; by default what is there is run to its end.
    """

    def step(batch: DataFrame, number: int) -> None:
        held, out = spark.read.schema(HELD).parquet(f"{path}/held/{number - 1}"), f"{path}/decided/batch={number}"
        limit_rows(batch.persist(), per_minute=per_minute, per_day=per_day, all_per_day=all_per_day, held=held).write.mode("overwrite").parquet(out)
        batch.unpersist()
        accepted = spark.read.schema(RESULT).parquet(out).where("accepted").select("client", "id", "at").unionByName(held)
        newest = accepted.agg(F.max("at")).first()[0]
        last = accepted.where(F.col("at") >= (newest or 0.0) - DAY)
        last.coalesce(1).write.mode("overwrite").parquet(f"{path}/held/{number}")
        # The state before the last one is what a repeated batch reads; those before it go.
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/held/{number - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    spark = requests.sparkSession
    spark.createDataFrame([], HELD).write.mode("overwrite").parquet(f"{path}/held/-1")
    spark.createDataFrame([], RESULT).write.mode("overwrite").parquet(f"{path}/decided/batch=-1")
    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def decided(spark: SparkSession, path: str) -> DataFrame:
    """client, id, at, accepted, reason of all batches that ``limit_stream_all`` has written below ``path``."""
    return spark.read.schema(RESULT).parquet(f"{path}/decided/batch=*")


def limit_stream(requests: DataFrame, *, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, evict: bool = True, idle: float = DAY) -> DataFrame:
    """The same for a stream of requests (client, id, at), keyed by client.

    A client's state is its accepted times of the last day; with ``evict`` it is dropped when the
    client was idle for a day (``idle`` seconds), by the clock, which needs a trigger that goes on running. Requests of a batch are taken in order of time; batches must come in that order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Accepted(state.get[0] if state.exists else ())
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            reason = own.reason(r.at, per_minute, per_day)
            if reason is None:
                own.add(r.at)
            rows.append((key[0], r.id, r.at, reason is None, reason))
        state.update((list(own.day),))
        if evict:
            state.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame(rows, columns=["client", "id", "at", "accepted", "reason"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout
    return requests.groupBy("client").applyInPandasWithState(run, RESULT, "times array<double>", "append", timeout)
