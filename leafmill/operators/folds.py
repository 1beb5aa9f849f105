"""Ordered folds over request logs: adaptive delay per domain and reuse within a TTL.

Both folds run per sorted run (see ``runs``), so a domain or URL that holds a third of
the log is folded by as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.runs import sorted_runs

# Delays in seconds and the decay after a success.
MAX_DELAY_S, BACKOFF_SEED_S, DECAY, SNAP_S = 60.0, 0.5, 0.9, 1e-6
NOTHING = -(2**62)  # time of a capture that was never stored


def next_delay(delay: float, blocked: int, base: float) -> float:
    """One step: double on a block up to the cap, decay towards the base on a success."""
    if blocked:
        return min((delay or BACKOFF_SEED_S) * 2, MAX_DELAY_S)
    delay = max(base, delay * DECAY)
    return base if delay - base < SNAP_S else delay


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple]:
    """Consecutive rows of one key as (key, new key?, columns, rows), batch by batch."""
    last = None
    for batch in batches:
        if batch.empty:
            continue
        columns = {name: batch[name].to_numpy() for name in batch.columns}
        changed = np.zeros(len(batch), dtype=bool)
        changed[0] = True
        for name in keys:
            changed[1:] |= columns[name][1:] != columns[name][:-1]
        starts = np.flatnonzero(changed)
        for start, stop in zip(starts, [*starts[1:], len(batch)]):
            key = tuple(columns[name][start] for name in keys)
            yield key, key != last, columns, slice(start, stop)
            last = key


class _DelayMap:
    """What a run does to the delay it starts from, whatever that delay is.

    A block is min(2d, cap) and a success max(0.9d, base). Such clamped scalings compose
    into one of their kind: clamp(scale * d, low, high).

    Without a base delay a success can also snap a small delay to zero, from where the
    next block jumps to the seed. Which delays snap depends on the smallest scale so
    far; every new minimum adds one step (delays below ``limit`` end at ``value``), and
    as each is at least a tenth lower than the last there are few of them. Paths that
    start at zero are followed exactly, equal ones as one.
    """

    def __init__(self, base: float) -> None:
        self.base, self.scale, self.low, self.high = base, 1.0, base, MAX_DELAY_S
        self.least, self.open = 1.0, base == 0
        self.steps: list[tuple[float, int]] = []  # (limit, path)
        self.paths = [0.0]  # current delay of each path begun at zero; the first began with the run

    def add(self, blocked: int) -> None:
        base = self.base
        if base > 0:
            self.low, self.high = next_delay(self.low, blocked, base), next_delay(self.high, blocked, base)
            self.scale = 0.0 if self.low == self.high else self.scale * (2 if blocked else DECAY)
            return
        self.paths = [next_delay(d, blocked, base) for d in self.paths]
        if not self.open:
            return
        self.scale *= 2 if blocked else DECAY
        self.high = min(self.high * 2, MAX_DELAY_S) if blocked else self.high * DECAY
        if blocked or (self.scale >= self.least and self.high >= SNAP_S):
            return
        self.least = min(self.least, self.scale)
        self.open = self.high >= SNAP_S
        if 0.0 not in self.paths:
            self.paths.append(0.0)
        self.steps.append((SNAP_S / self.least if self.open else float("inf"), self.paths.index(0.0)))

    def row(self) -> tuple:
        limits, values = [s[0] for s in self.steps], [self.paths[s[1]] for s in self.steps]
        return (self.paths[0], self.scale, self.low, self.high, limits, values)


def _delay_summaries(base: float):
    """One row per run: its delay map."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for key_now, fresh, columns, rows in _blocks(batches, ["domain", "run"]):
            if fresh:
                if state:
                    out.append((*key, *state.row()))
                key, state = key_now, _DelayMap(base)
            for blocked in columns["blocked"][rows]:
                state.add(blocked)
        if state:
            out.append((*key, *state.row()))
        yield pd.DataFrame(out, columns=["domain", "run", "zero", "scale", "low", "high", "limits", "ends"])

    return summarise


def _delay_fold(base: float, keys: list[str]):
    """The delay after each row; a key starts from its ``entering`` delay."""

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        delay, last = base, None
        for batch in batches:
            delays = np.empty(len(batch))
            for key, fresh, columns, rows in _blocks(iter([batch]), keys):
                if key != last:
                    delay, last = float(columns["entering"][rows.start]), key
                for i in range(rows.start, rows.stop):
                    delay = delays[i] = next_delay(delay, columns["blocked"][i], base)
            yield batch.drop(columns=[c for c in ("entering", "run") if c in batch]).assign(delay_s=delays)

    return trace


def _chain_delays(base: float):
    """Walk each domain's summaries in run order; there is one row per run, so few."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, delay = None, base
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                entering = delay if r.domain == last else base
                step = int(np.searchsorted(r.limits, entering, side="right"))
                if entering == 0:
                    delay = r.zero
                elif step < len(r.limits):
                    delay = r.ends[step]
                else:
                    delay = min(r.high, max(r.low, r.scale * entering))
                out.append((r.domain, r.run, entering, delay, r.domain == last))
                last = r.domain
            yield pd.DataFrame(out, columns=["domain", "run", "entering", "leaving", "later"])

    return chain


def entering_delays(runs: DataFrame, base: float) -> DataFrame:
    """(domain, run, entering, leaving, later): the delay each run starts and ends with."""
    schema = (
        "domain string, run int, zero double, scale double, low double, high double, limits array<double>, ends array<double>"
    )
    sums = runs.select("domain", "run", "blocked").mapInPandas(_delay_summaries(base), schema)
    return (
        sums.repartition("domain")
        .sortWithinPartitions("domain", "run")
        .mapInPandas(_chain_delays(base), "domain string, run int, entering double, leaving double, later boolean")
    )


def _enter(runs: DataFrame, entering: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """Attach the state that enters each run, leaving the rows where they are.

    Only the first key of a partition can continue from the partition before it, so
    ``entering`` has fewer rows than there are partitions and is safe to broadcast.
    """
    return runs.join(F.broadcast(entering), [*keys, "run"], "left").withColumn("entering", F.coalesce("entering", default))


def delay_trace(
    log: DataFrame, base_s: float = 1.0, order: tuple[str, ...] = ("ts", "event_id"), partitions: int | None = None
) -> DataFrame:
    """The delay after every logged outcome of each domain.

    ``log`` holds domain, blocked (0/1) and the ``order`` columns.
    """
    columns = ["domain", *order, "blocked"]
    slim = log.select(*columns)
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in columns) + ", delay_s double"
    runs = sorted_runs(slim, ["domain"], list(order), partitions)
    later = entering_delays(runs, base_s).filter("later").select("domain", "run", "entering")
    entered = _enter(runs, later, ["domain"], F.lit(float(base_s)))
    return entered.select(*columns, "run", "entering").mapInPandas(_delay_fold(base_s, ["domain", "run"]), schema)


def current_delays(
    log: DataFrame, base_s: float = 1.0, order: tuple[str, ...] = ("ts", "event_id"), partitions: int | None = None
) -> DataFrame:
    """The delay of each domain after its whole log."""
    runs = sorted_runs(log.select("domain", *order, "blocked"), ["domain"], list(order), partitions)
    return entering_delays(runs, base_s).groupBy("domain").agg(F.max_by("leaving", "run").alias("delay_s"))


def _jump_table(times: np.ndarray, ttl: int) -> np.ndarray:
    """Index of the last stored capture if a run's storing starts at each index.

    From a stored capture at i the next one is the first request later than its time
    plus the ttl. Pointer doubling follows every chain to its end at once.
    """
    n = len(times)
    jump = np.searchsorted(times, times + ttl, side="right")
    at = np.arange(n)
    hop = np.where(jump < n, jump, at)
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            return hop
        hop = further


def _reuse_summaries(ttl: int):
    """Per run: how the capture stored when it begins decides the one it ends with.

    The map from the entering capture's time to the leaving one is a step function;
    chains merge fast, so only the steps where the outcome changes are kept.
    """

    def one(key: tuple, times: np.ndarray) -> tuple:
        final = times[_jump_table(times, ttl)]
        first = np.searchsorted(times, times[0] + ttl, side="right")
        window = np.arange(first)  # the requests that can be the first miss, or none is
        ends = final[window]
        steps = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        # An entering capture at a makes times[k] the first miss for the smallest k with
        # times[k] > a + ttl, so step k begins where a + ttl >= times[k - 1].
        since = [int(times[k - 1]) if k else NOTHING for k in steps]
        after = int(final[first]) if first < len(times) else NOTHING
        return (*key, since, [int(ends[k]) for k in steps], int(times[first - 1]), after)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for key_now, fresh, columns, rows in _blocks(batches, ["url", "js_render", "run"]):
            if fresh and held:
                out.append(one(key, np.concatenate(held)))
                held = []
            key = key_now
            held.append(columns["t"][rows])
        if held:
            out.append(one(key, np.concatenate(held)))
        names = ["url", "js_render", "run", "since", "ends", "window_end", "after"]
        yield pd.DataFrame(out, columns=names)

    return summarise


def _reuse_apply(ttl: int):
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored, last = None, None
        for batch in batches:
            origin, served = np.empty(len(batch), dtype="int64"), np.ones(len(batch), dtype=bool)
            for key, _, columns, rows in _blocks(iter([batch]), ["url", "js_render", "run"]):
                times = columns["t"]
                if key != last:
                    entering, last = columns["entering"][rows.start], key
                    stored = None if entering == NOTHING else int(entering)
                i = rows.start
                while i < rows.stop:
                    if stored is None or times[i] - stored > ttl:
                        stored, served[i] = int(times[i]), False
                    stop = rows.start + int(np.searchsorted(times[rows], stored + ttl, side="right"))
                    origin[i:stop] = stored
                    i = stop
            yield batch.drop(columns=["entering", "run", "t"]).assign(from_cache=served, stored_us=origin)

    return apply


def _chain_captures(ttl: int):
    """Walk each key's summaries in run order; there is one row per run, so few."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stored = None, NOTHING
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                key = (r.url, r.js_render)
                entering = stored if key == last else NOTHING
                reach = entering + ttl
                if reach < r.window_end:
                    stored = int(r.ends[int(np.searchsorted(r.since, reach, side="right")) - 1])
                else:
                    stored = entering if r.after == NOTHING else r.after
                out.append((*key, r.run, entering))
                last = key
            yield pd.DataFrame(out, columns=["url", "js_render", "run", "entering"])

    return chain


def _entering_captures(runs: DataFrame, ttl: int) -> DataFrame:
    schema = (
        "url string, js_render boolean, run int, since array<bigint>, ends array<bigint>, window_end bigint, after bigint"
    )
    sums = runs.select("url", "js_render", "run", "t").mapInPandas(_reuse_summaries(ttl), schema)
    return (
        sums.repartition("url", "js_render")
        .sortWithinPartitions("url", "js_render", "run")
        .mapInPandas(_chain_captures(ttl), "url string, js_render boolean, run int, entering bigint")
    )


def _micros(log: DataFrame, column: str) -> Column:
    """Microseconds since 1970, also of a timestamp without a time zone."""
    if log.schema[column].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', `{column}`)")
    return F.unix_micros(column)


def reuse_log(
    requests: DataFrame, ttl_s: int = 300, order: str = "ts", key: str = "event_id", partitions: int | None = None
) -> DataFrame:
    """For each request, whether a stored capture served it and when that was stored.

    ``requests`` holds url, js_render, bypass, ``order`` (a timestamp) and a unique
    ``key``. A stored capture serves requests up to ``ttl_s`` after it was stored; a later
    one is stored in its place. Requests that bypass the store neither read nor write it.
    """
    base = requests.select(key, "url", "js_render", "bypass", _micros(requests, order).alias("t"))
    if ttl_s <= 0:
        return base.select(key, "url", "js_render", F.lit(False).alias("from_cache"), F.col("t").alias("stored_us"))
    ttl = int(ttl_s * 1_000_000)
    through = base.filter(F.col("bypass")).select(
        key, "url", "js_render", F.lit(False).alias("from_cache"), F.lit(None).cast("bigint").alias("stored_us")
    )
    runs = sorted_runs(base.filter(~F.col("bypass")).drop("bypass"), ["url", "js_render"], ["t", key], partitions)
    entering = _entering_captures(runs, ttl)
    later = entering.filter(F.col("entering") != NOTHING)
    entered = _enter(runs, later, ["url", "js_render"], F.lit(NOTHING))
    kind = base.schema[key].dataType.simpleString()
    applied = entered.select(key, "url", "js_render", "t", "run", "entering").mapInPandas(
        _reuse_apply(ttl), f"{key} {kind}, url string, js_render boolean, from_cache boolean, stored_us bigint"
    )
    return applied.unionByName(through)
