"""Streams of pages and events: reading as pages arrive, deliveries once, counts in event time, timers with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.reading import read_page

__all__ = ["deduplicated", "fire_timers", "page_stream", "read_stream", "tumbling_counts"]


def page_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Pages as their parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def read_stream(pages: DataFrame) -> DataFrame:
    """A stream (or table) of pages with their readings."""
    return pages.select("page_id", "url", read_page(F.col("html"), F.col("url")).alias("reading")).select("page_id", "url", "reading.*")


def deduplicated(rows: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """Rows of a stream once per key, remembered as long as the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, keys, events) by windows of event time; late rows count up to the watermark."""
    w = F.window(time, width)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def fire_timers(timers: DataFrame, horizon_ms: int = 10_000) -> DataFrame:
    """(page_id, timer_id, due_ms): timers of each page fired in order of their due times by a clock kept as state.

    ``timers``: a stream of (page_id, timer_id, delay_ms, repeat). The state is the page's clock; each batch's timers are due from there.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else (0,)
        out = []
        for pdf in batches:
            for t in pdf.itertuples():
                due, period = now + max(int(t.delay_ms), 0), max(int(t.delay_ms), 1)
                while due <= horizon_ms:
                    out.append((key[0], int(t.timer_id), due))
                    if not t.repeat:
                        break
                    due += period
        out.sort(key=lambda r: (r[2], r[1]))
        state.update((max([now, *(r[2] for r in out)]),))
        yield pd.DataFrame(out, columns=["page_id", "timer_id", "due_ms"])

    return timers.groupBy("page_id").applyInPandasWithState(step, "page_id bigint, timer_id bigint, due_ms bigint", "now bigint", "append", GroupStateTimeout.NoTimeout)
