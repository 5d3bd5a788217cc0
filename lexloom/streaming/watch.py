"""Page watch with keyed state: one state per url in the state store, judged in event order.

Snapshots wait in the state of their url until the watermark has passed them, so the verdicts do not depend on the order
of arrival; what comes later than the watermark allows is dropped by Spark. A url's state is its last hash and time, the
links seen on it, and what waits. A timer drops urls not heard of for long. All of it lies in the query's checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERDICTS = "url string, ts timestamp, state string, hash string, new_links array<string>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageState(StatefulProcessor):
    """Verdicts on the snapshots of a url. ``forget_ms`` after its last snapshot a url's state is dropped."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "hash string, ts bigint")
        self.links = handle.getMapState("links", "link string", "seen boolean")
        self.waiting = handle.getMapState("waiting", "ts bigint, tie string", "hash string, links array<string>, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, digest, links in zip(part["at"], part["hash"], part["links"]):
                digest = None if pd.isna(digest) else digest
                place = (int(at), "~" if digest is None else digest)
                n = self.waiting.getValue(place)[2] if self.waiting.containsKey(place) else 0
                self.waiting.updateValue(place, (digest, [] if links is None else list(links), n + 1))
                self.handle.registerTimer(-(-int(at) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(place for place in self.waiting.keys() if place[0] <= now * 1000)
        before, last = self.known.get() if self.known.exists() else (None, None)
        out = []
        for place in due:
            digest, links, n = self.waiting.getValue(place)
            self.waiting.removeKey(place)
            last = place[0]
            for _ in range(n):
                if digest is None:
                    out.append((last, "unreachable", before, []))
                    continue
                fresh = [x for x in dict.fromkeys(links) if not self.links.containsKey((x,))]
                for x in fresh:
                    self.links.updateValue((x,), (True,))
                out.append((last, "new" if before is None else "same" if before == digest else "changed", digest, fresh))
                before = digest
        if due:
            self.known.update((before, last))
            self.handle.registerTimer(last // 1000 + self.forget_ms)
        elif last is not None and now >= last // 1000 + self.forget_ms and not any(True for _ in self.waiting.keys()):
            self.known.clear()
            self.links.clear()
        if out:
            at, state, digest, fresh = zip(*out)
            stamps = pd.to_datetime(list(at), unit="us")
            yield pd.DataFrame({"url": [key[0]] * len(out), "ts": stamps, "state": state, "hash": digest, "new_links": fresh})

    def close(self) -> None:
        pass


def verdicts(stream: DataFrame, delay: str, forget_days: int, extension: str | None = "pdf") -> DataFrame:
    """(url, ts, state, hash, new_links) of a stream of (url, ts, body), each once the watermark has passed it.

    First sight is ``new``; a null body is ``unreachable`` and keeps hash and links. ``new_links`` are the page's links to
    files of ``extension`` that no earlier snapshot of it had. ``delay`` is how late a snapshot may come.
    """
    seen = stream.withWatermark("ts", delay).where("url is not null and ts is not null")
    read = seen.select(
        "url",
        "ts",
        F.unix_micros("ts").alias("at"),
        F.sha2("body", 256).alias("hash"),
        F.coalesce(text.page_links(F.col("body"), extension), F.array().cast("array<string>")).alias("links"),
    )
    state = PageState(forget_days * 86_400_000)
    return read.groupBy("url").transformWithStateInPandas(state, VERDICTS, "Append", "EventTime")


def watch(stream: DataFrame, target: str, checkpoint: str, delay: str = "1 day", forget_days: int = 400, extension: str | None = "pdf") -> StreamingQuery:
    """Judge what is new in a stream and stop; verdicts are appended to ``target``, state stays in ``checkpoint``.

    Sets the session's state store to the one keyed state needs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    found = verdicts(stream, delay, forget_days, extension)
    writer = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
