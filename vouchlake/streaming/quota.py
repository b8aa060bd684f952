"""Quotas that are decided at each arrival, as keyed state of a stream.

A user's counter is value state. A request is decided by the counter as it stands when the request arrives: in order
of event time within a micro-batch, and of batches between them. What was decided is list state, a row for a user's decisions in a
micro-batch, which is written at once and read only for users that were seen before: a user costs a few calls to the state store a
micro-batch, however many requests there are. So a request that comes again (a client's retry, a source that sends twice) gets its first decision and is not counted
twice; a micro-batch that Spark replays after a failure starts from the state of the batch before, so it counts once too.
Decisions are forgotten some days after they were made; counters stay.

Late requests are decided like others, on arrival: a quota has no watermark. A micro-batch's rows of one user are ordered in
memory, so the source's rate limit (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds what a hot user may take at once. The remembered decisions of a user pass
by one row of state at a time; their number costs time in each micro-batch that has the user.

Needs the RocksDB state store (`state_store`), which keeps state on disk and not in the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import email_key
from .sink import drained

MOST = 10
REMEMBERED = 7 * 24 * 3600 * 1000
#: A row of state: decisions of one user in one micro-batch. Rows of at least PACKED decisions, at most PACKS of them.
PACK = "request array<string>, used array<bigint>, allowed array<boolean>, remaining array<bigint>"
PACKED, PACKS = 1000, 100
DECIDED = "email string, request string, at timestamp, size bigint, used bigint, allowed boolean, remaining bigint, repeated boolean"


def state_store(spark: SparkSession) -> None:
    """State in RocksDB, which transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Gate(StatefulProcessor):
    """Decides a user's requests one after another.

    An allowed request adds its size to the counter; a refused one adds nothing, so that a smaller one after it may
    still pass. A user without limit is always allowed and never counted.
    """

    def __init__(self, most: int = MOST, remembered: int = REMEMBERED):
        self.most, self.remembered = most, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("used", "used bigint")
        self.decided = handle.getListState("decisions", PACK, ttlDurationMs=self.remembered)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r["at"] is None, r["at"], r["request"] or ""))
        held = self.count.get()
        used = before = held[0] if held else 0
        known = self._known({r["request"] for r in rows} - {None}) if held else {}
        new = []
        for r in rows:
            name = r["request"]
            if again := name in known:
                was, allowed, remaining = known[name]
            else:
                was = 0 if r["pro"] else used
                allowed = r["pro"] or used + r["size"] <= self.most
                if allowed and not r["pro"]:
                    used += r["size"]
                remaining = max(0, self.most - (used if allowed else was))
                if name is not None:
                    known[name] = was, allowed, remaining
                    new.append((name, was, allowed, remaining))
            yield Row(email=key[0], request=name, at=r["at"], size=r["size"], used=was, allowed=allowed, remaining=remaining, repeated=again)
        if new:
            many = max(PACKED, -(-len(new) // PACKS))
            self.decided.appendList([tuple(map(list, zip(*new[i : i + many], strict=True))) for i in range(0, len(new), many)])
        if used != before or not held:  # a user without a counter has not been seen
            self.count.update((used,))

    def _known(self, names: set[str]) -> dict[str, tuple[int, bool, int]]:
        """What was decided on these requests before."""
        found = {}
        for past in self.decided.get() if names else ():
            for name, *what in zip(*past, strict=True):
                if name in names:
                    found.setdefault(name, tuple(what))
        return found

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, pro: DataFrame, most: int = MOST, remembered_ms: int = REMEMBERED) -> DataFrame:
    """A stream of decisions over a stream of requests(email, request, at, size).

    Addresses are keyed as the counters' are. pro(email) is a table of accounts without a limit. A null or empty address
    is a user like others; a null size is 1; requests without a name (null) are never repeats.
    """
    listed = pro.select(email_key(F.col("email")).alias("email"), F.lit(True).alias("pro")).distinct()
    keyed = requests.select(F.coalesce(email_key(F.col("email")), F.lit("")).alias("email"), F.col("request").cast("string").alias("request"), F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("size").cast("bigint"), F.lit(1)).alias("size"))
    rows = keyed.join(listed, "email", "left").withColumn("pro", F.coalesce("pro", F.lit(False)))
    return rows.groupBy("email").transformWithState(statefulProcessor=Gate(most, remembered_ms), outputStructType=DECIDED, outputMode="Append", timeMode="ProcessingTime")


def decided(requests: DataFrame, pro: DataFrame, most: int = MOST, checkpoint: str | None = None) -> DataFrame:
    """All decisions over what the stream's source has now, as a table. With a checkpoint, a later call goes on from it."""
    state_store(requests.sparkSession)
    return drained(decisions(requests, pro, most), "quota", checkpoint, empty_batches=False)

