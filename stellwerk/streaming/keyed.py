"""Continuous sync with keyed state: every link that ever came is held in a state store on disk."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stellwerk.operators.sync import new_postings
from stellwerk.sources.sinks import append_master, read_master

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Links are handed to the state in so many groups, since a group has a cost of its own. A checkpoint keeps to the number it began with.
GROUPS = 1 << 14
_GROUP = "_group"


def _grouped(df: DataFrame) -> DataFrame:
    return df.withColumn(_GROUP, F.pmod(F.xxhash64("link"), F.lit(GROUPS)))


class FirstOfLink(StatefulProcessor):
    """Passes the first posting of each link of a group by ``order``, once; links of the initial state never."""

    def __init__(self, order: tuple[str, ...]):
        self._order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getMapState("known", "link string", "known boolean")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._known.updateValue((initialState["link"],), (True,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # One pass that holds one row of each link, however many postings of the link a batch has.
        firsts: dict[str, tuple[tuple, Row]] = {}
        for row in rows:
            place = tuple((row[c] is None, row[c] if row[c] is not None else 0) for c in self._order)
            held = firsts.get(row["link"])
            if held is None or place < held[0]:
                firsts[row["link"]] = place, row
        for link, (_, first) in firsts.items():
            if not self._known.containsKey((link,)):
                self._known.updateValue((link,), (True,))
                yield first

    def close(self) -> None:
        pass


def start_keyed_sync(
    stream: DataFrame,
    master_path: str,
    checkpoint: str,
    order: tuple[str, ...] = ("run_id", "seq"),
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Append postings with links that neither the master nor the stream had before.

    The master's links are the state's beginning, read when the stream starts for the first time; from then on
    a batch costs its own links' look-ups, whatever the master's size. The stream must be the master's only
    writer. Within a batch the first posting of a link by ``order`` counts; postings without a link are left out.

    After a restart the first batch may be one whose rows were written but not committed, so it alone
    is held against the master again; the state store goes back to the last commit by itself.
    """
    spark = stream.sparkSession
    linked = _grouped(stream.where(F.coalesce(F.col("link"), F.lit("")) != ""))
    known = _grouped(read_master(spark, master_path).select("link").where("link IS NOT NULL").distinct())
    first = linked.groupBy(_GROUP).transformWithState(
        FirstOfLink(order), linked.schema, "Append", "None", initialState=known.groupBy(_GROUP)
    ).drop(_GROUP)
    repeated = [True]

    def append(batch: DataFrame, _: int) -> None:
        batch.persist()  # the append samples its rows before it writes them, and each reading would ask the state again
        try:
            new = new_postings(batch, read_master(batch.sparkSession, master_path), list(order)) if repeated[0] else batch
            append_master(new, master_path)
        finally:
            batch.unpersist()
        repeated[0] = False

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the query keeps the setting that it starts with
    try:
        writer = first.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)
