"""Snapshots, adaptive delay and TTL reuse as keyed state over a stream.

Rows of a key are ordered within a micro-batch; across batches they are taken as they
arrive. How much one key brings at once is bounded by the source's trigger options.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from leafmill.operators.changes import line_diff
from leafmill.operators.folds import next_delay

CHANGES = (
    "url string, seen_at timestamp, status string, previous_seen_at timestamp, added_lines int, removed_lines int, diff string"
)

# A call for a key costs milliseconds however few rows it has; with a million keys a bucket holds some 120.
BUCKETS = 8_192
NEVER = np.iinfo("int64").min  # microseconds that stand for no time


def _ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    held = list(frames)
    return pd.concat(held).sort_values(order, kind="stable") if held else pd.DataFrame()


def _columns(frames: Iterator[pd.DataFrame], order: list[str]) -> dict[str, np.ndarray]:
    """The columns of a key's rows in order. Most keys have few rows, where each call of pandas costs more than they do."""
    held = list(frames)
    rows = held[0] if len(held) == 1 else pd.concat(held)
    columns = {name: rows[name].to_numpy() for name in rows.columns}
    turn = np.lexsort([columns[name] for name in reversed(order)])
    return {name: values[turn] for name, values in columns.items()}


def stream_changes(pages: DataFrame, context: int = 2) -> DataFrame:
    """A change row for every (url, content, seen_at) that arrives."""

    def check(key, frames, state):
        rows = _ordered(frames, ["seen_at"])
        held = state.get if state.exists else None
        out = []
        for content, seen_at in zip(rows["content"], rows["seen_at"]):
            digest = hashlib.sha256(content.encode("utf-8", "replace")).hexdigest()
            plus = minus = 0
            diff, status, previous = "", "new", None
            if held is not None:
                previous = held[2]
                status = "same" if held[1] == digest else "changed"
            if status == "changed":
                plus, minus, diff = line_diff(held[0], content, context)
            held = (content, digest, seen_at)
            out.append((key[0], seen_at, status, previous, plus, minus, diff))
        if held is not None:
            state.update(held)
        names = [c.split(" ")[0] for c in CHANGES.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"previous_seen_at": "datetime64[ns]"})

    return (
        pages.select("url", "content", "seen_at")
        .groupBy("url")
        .applyInPandasWithState(
            check, CHANGES, "content string, digest string, seen_at timestamp", "append", GroupStateTimeout.NoTimeout
        )
    )


def stream_delays(log: DataFrame, base_s: float = 1.0) -> DataFrame:
    """The delay of a domain after every outcome (domain, ts, event_id, blocked)."""
    out = "domain string, ts timestamp, event_id bigint, blocked int, delay_s double"

    def fold(key, frames, state):
        rows = _columns(frames, ["ts", "event_id"])
        delay = state.get[0] if state.exists else base_s
        delays = []
        for blocked in rows["blocked"].tolist():
            delay = next_delay(delay, blocked, base_s)
            delays.append(delay)
        state.update((delay,))
        yield pd.DataFrame({**{name: rows[name] for name in ("domain", "ts", "event_id", "blocked")}, "delay_s": delays})

    slim = log.select("domain", "ts", "event_id", F.col("blocked").cast("int").alias("blocked"))
    return slim.groupBy("domain").applyInPandasWithState(
        fold, out, "delay double", "append", GroupStateTimeout.NoTimeout
    )


def stream_reuse(requests: DataFrame, ttl_s: int = 300, lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Whether each request is served by a stored capture.

    Keys (url, js_render) are held by the bucket, so that a batch costs at most ``buckets`` calls whatever the number of its
    keys; the number is part of the state and stays as a stream began. A capture is dropped once the watermark has
    passed its time to live, as no request on time could use it any more: when its bucket is next seen, or with the last of its bucket.
    """
    out = "event_id bigint, url string, js_render boolean, ts timestamp, from_cache boolean, stored_at timestamp"
    ttl = int(ttl_s * 1_000_000)

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _columns(frames, ["ts", "event_id"])
        held = {(url, js): at for url, js, at in json.loads(state.get[0])} if state.exists else {}
        served, origin = [], []
        times = rows["ts"].astype("datetime64[us]").astype("int64")
        for url, js, at, bypass in zip(*(column.tolist() for column in (rows["url"], rows["js_render"], times, rows["bypass"]))):
            if bypass:
                served.append(False)
                origin.append(NEVER)
                continue
            stored = held.get((url, js))
            hit = stored is not None and ttl > 0 and at - stored <= ttl
            if not hit:
                held[url, js] = stored = at
            served.append(hit)
            origin.append(stored)
        watermark = state.getCurrentWatermarkMs()
        live = [(url, js, at) for (url, js), at in held.items() if (at + ttl) // 1000 >= watermark]
        if live:
            state.update((json.dumps(live),))
            state.setTimeoutTimestamp(max((max(at for _, _, at in live) + ttl) // 1000, watermark + 1))
        elif state.exists:
            state.remove()
        same = {name: rows[name] for name in ("event_id", "url", "js_render", "ts")}
        yield pd.DataFrame({**same, "from_cache": served, "stored_at": np.array(origin, dtype="datetime64[us]")})

    bucket = F.pmod(F.xxhash64("url", "js_render"), F.lit(buckets)).alias("bucket")
    slim = requests.select(bucket, "event_id", "url", "js_render", "ts", "bypass").withWatermark("ts", lateness)
    return slim.groupBy("bucket").applyInPandasWithState(fold, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process all input there is, write it as Parquet below ``folder`` and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
