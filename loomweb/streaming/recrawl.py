"""A recrawl feed as a stream: each URL once within a watermark, answers by window, and a budget for each host."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import urls


def once(feed: DataFrame, late: str = "1 hour") -> DataFrame:
    """feed (url, ts, ...) with normalized_url; repeats within the watermark go."""
    return feed.withColumn("normalized_url", urls.normalise_expr(F.col("url"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["normalized_url"])


def answers_by_window(feed: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Answers of each host and status class in windows."""
    host = urls.host(F.col("url"))
    return feed.withWatermark("ts", late).groupBy(F.window("ts", width), host.alias("host"), F.floor(F.col("status_code") / 100).alias("class")).agg(F.count("*").alias("answers"), F.avg("fetch_time_sec").alias("mean_seconds"))


def host_budget(feed: DataFrame, most: int = 100) -> DataFrame:
    """host, url, admitted: up to `most` URLs of a host in the life of the stream; the count is keyed state."""

    def run(key, frames, state):
        (used,) = state.get if state.exists else (0,)
        for f in frames:
            n = used + pd.RangeIndex(1, len(f) + 1)
            used += len(f)
            yield pd.DataFrame({"host": key[0], "url": f["url"], "admitted": n <= most})
        state.update((used,))

    keyed = feed.withColumn("host", urls.host(F.col("url")))
    return keyed.groupBy("host").applyInPandasWithState(run, "host string, url string, admitted boolean", "used int", "append", GroupStateTimeout.NoTimeout)
