import difflib
import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators import changes, folds
from leafmill.operators.runs import sorted_runs
from leafmill.streaming import stateful

START = datetime(2024, 1, 1)


def _snapshots(spark):
    """One URL holds a third of all checks."""
    rng = random.Random(2)
    texts = [f"line {i}\n" * 3 + f"tail {i}" for i in range(4)]
    rows = []
    for url, n in (("https://hot.example/", 120), *((f"https://u{i}.example/", 8) for i in range(30))):
        for k in range(n):
            rows.append((url, rng.choice(texts), START + timedelta(hours=k)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "url string, content string, seen_at timestamp")


def _history(rows):
    out, last = {}, {}
    for url, content, at in sorted(rows, key=lambda r: (r[0], r[2])):
        digest = hashlib.sha256(content.encode()).hexdigest()
        before = last.get(url)
        status = "new" if before is None else "same" if before[0] == digest else "changed"
        out[url, at] = (status, None if before is None else before[1], None if status != "changed" else before[2])
        last[url] = (digest, at, content)
    return out


def test_sorted_runs_cut_a_hot_key(spark):
    _, df = _snapshots(spark)
    runs = sorted_runs(df.select("url", "seen_at"), ["url"], ["seen_at"], partitions=6)
    spread = runs.filter(F.col("url").contains("hot")).select("run").distinct().count()
    assert spread > 1
    assert runs.select(F.spark_partition_id().alias("p"), "run").filter("p <> run").count() == 0


@pytest.mark.parametrize("partitions", [None, 1, 6])
def test_change_history(spark, partitions):
    rows, df = _snapshots(spark)
    want = _history(rows)
    got = {(r.url, r.seen_at): (r.status, r.previous_seen_at) for r in changes.change_history(df, partitions=partitions).collect()}
    assert got == {k: v[:2] for k, v in want.items()}


def test_history_diffs(spark):
    rows, df = _snapshots(spark)
    want = _history(rows)
    texts = {(u, at): c for u, c, at in rows}
    got = changes.history_diffs(df).collect()
    assert len(got) == sum(v[0] == "changed" for v in want.values())
    for r in got:
        lines = list(difflib.unified_diff(want[r.url, r.seen_at][2].splitlines(), texts[r.url, r.seen_at].splitlines(), "before", "after", n=2, lineterm=""))
        assert r["diff"] == "\n".join(lines)
        assert r.added_lines == sum(x.startswith("+") and not x.startswith("+++") for x in lines)


def test_long_diffs_are_whole_unless_a_summary_is_asked_for():
    old, new = "\n".join(f"a{i}" for i in range(500)), "\n".join(f"b{i}" for i in range(500))
    plus, minus, body = changes.line_diff(old, new)
    assert (plus, minus) == (500, 500) and len(body.splitlines()) == 1003
    plus, minus, body = changes.line_diff(old, new, max_lines=200)
    assert (plus, minus) == (500, 500) and len(body.splitlines()) == 201


def test_checks_at_the_same_time_leave_one_snapshot(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 1), ("b", "z", 2)], "url string, content string, seen_at int")
    assert sorted(r.url for r in changes.latest_snapshots(df).collect()) == ["a", "b"]


def test_compare_advances_the_store(spark):
    first = spark.createDataFrame([("a", "x\ny", 1), ("b", "same", 1)], "url string, content string, seen_at int")
    found, store = changes.compare_snapshots(None, first)
    assert {r.status for r in found.collect()} == {"new"}
    second = spark.createDataFrame([("a", "x\nz", 2), ("b", "same", 2), ("c", "n", 2)], first.schema)
    found, store = changes.compare_snapshots(store, second)
    got = {r.url: (r.status, r.previous_seen_at, r.added_lines, r.removed_lines) for r in changes.with_diff(found).collect()}
    assert got == {"a": ("changed", 1, 1, 1), "b": ("same", 1, 0, 0), "c": ("new", None, 0, 0)}
    third = spark.createDataFrame([("a", "x\nz", 3)], first.schema)
    found, store = changes.compare_snapshots(store, third)
    assert [(r.status, r.previous_seen_at) for r in found.collect()] == [("same", 2)]
    assert [(r.url, r.seen_at, r.size) for r in changes.tracked(store).collect()] == [("a", 3, 3), ("b", 2, 4), ("c", 2, 1)]
    left, report = changes.forget(store, spark.createDataFrame([("a",), ("zz",)], "url string"))
    assert {r.url: r.forgotten for r in report.collect()} == {"a": True, "zz": False}
    assert sorted(r.url for r in left.collect()) == ["b", "c"]


# ----------------------------------------------------------------------------- delays


def _log(spark, seed=4, share=0.15):
    rng = random.Random(seed)
    rows = []
    for domain, n in (("hot.example", 400), *((f"d{i}.example", rng.randint(1, 40)) for i in range(25))):
        at = START
        for _ in range(n):
            at += timedelta(seconds=rng.choice([0, 1, 30]))
            rows.append((len(rows), domain, at, int(rng.random() < share)))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "event_id bigint, domain string, ts timestamp, blocked int")


def _trace(rows, base):
    delay, out = {}, {}
    for event, domain, _, blocked in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        d = delay.get(domain, base)
        if blocked:
            d = min((d if d > 0 else 0.5) * 2, 60.0)
        else:
            d = max(base, d * 0.9)
            d = base if d - base < 1e-6 else d
        delay[domain] = out[event] = d
    return out, delay


@pytest.mark.parametrize(("base", "share", "partitions"), [(1.0, 0.15, 7), (1.0, 0.15, None), (0.25, 0.13, 9), (5.0, 0.5, 7), (0.0, 0.2, None), (0.0, 0.02, 9), (0.0, 0.005, 7), (0.0, 0.13, 12)])
def test_delays_equal_a_sequential_fold(spark, base, share, partitions):
    rows, df = _log(spark, share=share)
    want, last = _trace(rows, base)
    got = {r.event_id: r.delay_s for r in folds.delay_trace(df, base, partitions=partitions).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    ends = {r.domain: r.delay_s for r in folds.current_delays(df, base, partitions=partitions).collect()}
    assert ends == pytest.approx(last, rel=1e-9)


# ------------------------------------------------------------------------------ reuse


def _requests(spark, seed=9):
    rng = random.Random(seed)
    rows = []
    for url, n in (("https://hot.example/", 500), *((f"https://u{i}.example/", rng.randint(1, 25)) for i in range(25))):
        at = START
        for _ in range(n):
            at += timedelta(seconds=rng.choice([0, 3, 10, 10, 40, 90]))
            rows.append((len(rows), url, rng.random() < 0.3, at, rng.random() < 0.1))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "event_id bigint, url string, js_render boolean, ts timestamp, bypass boolean")


def _reuse(rows, ttl):
    stored, out = {}, {}
    for event, url, js, at, bypass in sorted(rows, key=lambda r: (r[3], r[0])):
        if bypass:
            out[event] = (False, None)
            continue
        held = stored.get((url, js))
        hit = ttl > 0 and held is not None and (at - held).total_seconds() <= ttl
        if not hit:
            stored[url, js] = held = at
        out[event] = (hit, held)
    return out


@pytest.mark.parametrize(("ttl", "partitions"), [(60, 8), (60, None), (1000, 8), (5, 8), (20_000, 8)])
def test_reuse_equals_a_sequential_cache(spark, ttl, partitions):
    rows, df = _requests(spark)
    want = _reuse(rows, ttl)
    got = {
        r.event_id: (r.from_cache, r.at)
        for r in folds.reuse_log(df, ttl, partitions=partitions).select("event_id", "from_cache", F.timestamp_micros("stored_us").alias("at")).collect()
    }
    assert got == want


def test_no_ttl_never_reuses(spark):
    rows, df = _requests(spark)
    assert folds.reuse_log(df, 0).filter("from_cache").count() == 0


# -------------------------------------------------------------------------- streaming


def _stream(spark, df, tmp_path, order, build, name, files=4):
    """Run a streaming form over files that arrive in time order."""
    schema = df.schema
    total = df.count()
    ordered = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    for i in range(files):
        part = ordered[i * total // files : (i + 1) * total // files]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = (
        build(source).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name).collect()


def test_streamed_changes_equal_batch(spark, tmp_path):
    rows, df = _snapshots(spark)
    want = _history(rows)
    got = _stream(spark, df, tmp_path, ("seen_at", "url"), stateful.stream_changes, "streamed_changes")
    assert {(r.url, r.seen_at): (r.status, r.previous_seen_at) for r in got} == {k: v[:2] for k, v in want.items()}
    assert all((r.added_lines > 0) == (r.status == "changed") for r in got)


def test_streamed_delays_equal_batch(spark, tmp_path):
    rows, df = _log(spark)
    want, _ = _trace(rows, 1.0)
    got = _stream(spark, df, tmp_path, ("ts", "event_id"), stateful.stream_delays, "streamed_delays")
    assert {r.event_id: r.delay_s for r in got} == pytest.approx(want)


def test_streamed_reuse_equals_batch(spark, tmp_path):
    rows, df = _requests(spark)
    want = _reuse(rows, 60)
    build = lambda s: stateful.stream_reuse(s, 60, lateness="1 day")
    got = _stream(spark, df, tmp_path, ("ts", "event_id"), build, "streamed_reuse")
    assert {r.event_id: (r.from_cache, r.stored_at) for r in got} == want


def test_checks_of_a_page_at_one_time_are_one_check(spark):
    rows = [("u", 1, "a\nb"), ("u", 1, "a\nb"), ("u", 2, "a\nc"), ("u", 2, "a\nd"), ("u", 3, "a\nd"), ("v", 1, "x")]
    df = spark.createDataFrame(rows, "url string, seen_at int, content string")
    kept = max(("a\nc", "a\nd"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    history = changes.change_history(df).collect()
    assert len(history) == 4
    diffs = {r["seen_at"]: (r["added_lines"], r["removed_lines"], r["diff"].splitlines()[-1]) for r in changes.history_diffs(df).collect()}
    want = {2: (1, 1, f"+{kept[-1]}")} | ({} if kept == "a\nd" else {3: (1, 1, "+d")})
    assert diffs == want
