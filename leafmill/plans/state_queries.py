"""Queries over histories: snapshots, request logs and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import changes, folds
from leafmill.plans.registry import ORACLES, query
from leafmill.plans.views import VIEWS, portable, run, table, view
from leafmill.session import scratch_path
from leafmill.streaming import stateful

_HISTORY = f"""h AS (SELECT url, turn, content, lag(content) OVER (PARTITION BY url ORDER BY turn) AS before,
 lag(turn) OVER (PARTITION BY url ORDER BY turn) AS previous_seen_at FROM ({portable('snapshots')}) s)"""
_STATUS = "CASE WHEN previous_seen_at IS NULL THEN 'new' WHEN sha256(before) = sha256(content) THEN 'same' ELSE 'changed' END"


@query(
    "change_history",
    f"WITH {_HISTORY} SELECT url, turn, sha256(content) AS digest, {_STATUS} AS status, previous_seen_at FROM h",
)
def change_history(spark, sf):
    return changes.change_history(view(spark, sf, "snapshots"), order="turn")


@query("change_diffs")
def change_diffs(spark, sf):
    return changes.history_diffs(view(spark, sf, "snapshots"), order="turn")


@query(
    "change_line_balance",
    f"""WITH {_HISTORY} SELECT url, turn, CAST(len(string_split(content, chr(10))) - len(string_split(before, chr(10))) AS BIGINT) AS balance,
 true AS shown FROM h WHERE content <> before""",
)
def change_line_balance(spark, sf):
    """Lines added less lines removed, which the texts alone must bear out."""
    found = changes.history_diffs(view(spark, sf, "snapshots"), order="turn")
    balance = (F.col("added_lines") - F.col("removed_lines")).cast("bigint")
    return found.select("url", "turn", balance.alias("balance"), F.col("diff").startswith("--- before").alias("shown"))


@query(
    "snapshot_check",
    f"""WITH {_HISTORY}, l AS (SELECT url, max(turn) AS turn FROM h GROUP BY url)
 SELECT h.url, {_STATUS} AS status, previous_seen_at FROM h JOIN l ON h.url = l.url AND h.turn = l.turn""",
)
def snapshot_check(spark, sf):
    """The last check of every page against the store that all earlier checks left."""
    checks = view(spark, sf, "snapshots").withColumnRenamed("turn", "seen_at")
    last = checks.groupBy("url").agg(F.max("seen_at").alias("seen_at"))
    earlier = changes.latest_snapshots(checks.join(last, ["url", "seen_at"], "left_anti"))
    found, _ = changes.compare_snapshots(earlier, checks.join(last, ["url", "seen_at"], "left_semi"))
    return found.select("url", "status", "previous_seen_at")


@query(
    "tracked_pages",
    f"""SELECT url, max(turn) AS turn, CAST(arg_max(length(content), turn) AS BIGINT) AS size FROM ({portable('snapshots')}) s GROUP BY url""",
)
def tracked_pages(spark, sf):
    store = changes.latest_snapshots(view(spark, sf, "snapshots"), order="turn")
    return changes.tracked(store, order="turn").withColumn("size", F.col("size").cast("bigint"))


@query(
    "forgotten_pages",
    """SELECT 'https://t.example/' || CAST(p_partkey * 2 AS VARCHAR) AS url, p_partkey * 2 IN (SELECT conv_id FROM conversations)
 AS forgotten FROM part""",
)
def forgotten_pages(spark, sf):
    store = changes.latest_snapshots(view(spark, sf, "snapshots"), order="turn")
    asked = table(spark, sf, "part").select(
        F.concat(F.lit("https://t.example/"), (F.col("p_partkey") * 2).cast("string")).alias("url")
    )
    return changes.forget(store, asked)[1]


_FOLD = """list_reduce(list_prepend({start}, list(CASE event_type WHEN 'error' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id)),
 lambda d, b: CASE WHEN b = 1 THEN least(CASE WHEN d = 0 THEN 0.5 ELSE d END * 2, 60.0)
 ELSE CASE WHEN greatest({base}, d * 0.9::DOUBLE) - {base} < 1e-6 THEN {base} ELSE greatest({base}, d * 0.9::DOUBLE) END END)"""


@query(
    "current_delays",
    f"""SELECT 'd' || CAST(user_id AS VARCHAR) || '.example' AS domain,
 round({_FOLD.format(start='1.0::DOUBLE', base='1.0::DOUBLE')}, 6) AS delay_s FROM events GROUP BY user_id""",
)
def current_delays(spark, sf):
    found = folds.current_delays(view(spark, sf, "fetch_log"))
    return found.select("domain", F.round("delay_s", 6).alias("delay_s"))


@query(
    "current_delays_no_base",
    f"""SELECT 'd' || CAST(user_id AS VARCHAR) || '.example' AS domain,
 round({_FOLD.format(start='0.0::DOUBLE', base='0.0::DOUBLE')}, 6) AS delay_s FROM events GROUP BY user_id""",
)
def current_delays_no_base(spark, sf):
    found = folds.current_delays(view(spark, sf, "fetch_log"), base_s=0.0)
    return found.select("domain", F.round("delay_s", 6).alias("delay_s"))


@query(
    "delay_trace",
    f"""SELECT domain, event_id, round({{fold}}, 6) AS delay_s FROM (SELECT 'd' || CAST(user_id AS VARCHAR) || '.example' AS domain,
 event_id, list(CASE event_type WHEN 'error' THEN 1.0 ELSE 0.0 END::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen
 FROM events) w""".format(
        fold="""list_reduce(list_prepend(1.0::DOUBLE, seen), lambda d, b: CASE WHEN b = 1 THEN least(d * 2, 60.0)
 ELSE CASE WHEN greatest(1.0, d * 0.9::DOUBLE) - 1.0 < 1e-6 THEN 1.0::DOUBLE ELSE greatest(1.0, d * 0.9::DOUBLE) END END)"""
    ),
)
def delay_trace(spark, sf):
    found = folds.delay_trace(view(spark, sf, "fetch_log"))
    return found.select("domain", "event_id", F.round("delay_s", 6).alias("delay_s"))


TTL_S = 86_400


@query(
    "ttl_reuse",
    f"""WITH RECURSIVE r AS (SELECT event_id, 'https://u.example/' || CAST(user_id AS VARCHAR) AS url, event_type = 'view' AS js_render,
 event_type = 'error' AS bypass, epoch_us(ts) AS t FROM events),
 u AS (SELECT *, row_number() OVER (PARTITION BY url, js_render ORDER BY t, event_id) AS n FROM r WHERE NOT bypass),
 f AS (SELECT event_id, url, js_render, n, t, t AS stored_us, false AS from_cache FROM u WHERE n = 1
 UNION ALL SELECT u.event_id, u.url, u.js_render, u.n, u.t, CASE WHEN u.t - f.stored_us <= {TTL_S * 1_000_000} THEN f.stored_us ELSE u.t END,
 u.t - f.stored_us <= {TTL_S * 1_000_000} FROM f JOIN u ON u.url = f.url AND u.js_render = f.js_render AND u.n = f.n + 1)
 SELECT event_id, url, js_render, from_cache, stored_us FROM f
 UNION ALL SELECT event_id, url, js_render, false, NULL FROM r WHERE bypass""",
)
def ttl_reuse(spark, sf):
    return folds.reuse_log(view(spark, sf, "request_log"), ttl_s=TTL_S)


# ------------------------------------------------------------------------- planted diffs

_EDITED = """SELECT 'https://e.example/' || CAST(p_partkey AS STRING) AS url, v AS turn, 'one' || chr(10) || 'two' || chr(10) || 'three'
 || chr(10) || CASE v WHEN 0 THEN p_name ELSE p_type END || chr(10) || 'five' || chr(10) || 'six' || chr(10) || 'seven' AS content
 FROM (SELECT *, explode(array(0, 1)) AS v FROM @part) t"""


@query(
    "planted_diffs",
    """SELECT 'https://e.example/' || CAST(p_partkey AS VARCHAR) AS url, CAST(1 AS BIGINT) AS added_lines, CAST(1 AS BIGINT) AS removed_lines,
 '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -2,5 +2,5 @@' || chr(10) || ' two' || chr(10) || ' three' || chr(10) || '-' || p_name
 || chr(10) || '+' || p_type || chr(10) || ' five' || chr(10) || ' six' AS diff FROM part WHERE p_name <> p_type""",
)
def planted_diffs(spark, sf):
    found = changes.history_diffs(run(spark, sf, _EDITED, dealt="part"), order="turn")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("added_lines", "removed_lines")]
    return found.select("url", *counts, "diff")


# ---------------------------------------------------------------------------- streaming


def _stream(spark, sf, name: str, view_name: str | None = None, sql: str | None = None):
    """A table as a stream, seen through a view that needs no other rows."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    # A pattern, as a stream takes no bare path to a single file.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    text = (sql or VIEWS[view_name]).replace(f"@{name}", "{rows}")
    return spark.sql(text, rows=rows)


@query("streamed_delays", ORACLES["delay_trace"])
def streamed_delays(spark, sf):
    log = _stream(spark, sf, "events", "fetch_log").withColumn("ts", F.col("ts").cast("timestamp"))
    done = stateful.run_available(stateful.stream_delays(log), scratch_path(spark, "delays"))
    return done.select("domain", "event_id", F.round("delay_s", 6).alias("delay_s"))


@query("streamed_reuse", f"SELECT event_id, url, js_render, from_cache FROM ({ORACLES['ttl_reuse']}) r")
def streamed_reuse(spark, sf):
    log = _stream(spark, sf, "events", "request_log").withColumn("ts", F.col("ts").cast("timestamp"))
    done = stateful.run_available(stateful.stream_reuse(log, TTL_S, lateness="1 day"), scratch_path(spark, "reuse"))
    return done.select("event_id", "url", "js_render", "from_cache")


@query(
    "streamed_changes",
    """SELECT url, turn, CASE WHEN p IS NULL THEN 'new' WHEN p = text THEN 'same' ELSE 'changed' END AS status FROM (
 SELECT 'https://t.example/' || CAST(conv_id AS VARCHAR) AS url, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p
 FROM conversations) h""",
)
def streamed_changes(spark, sf):
    pages = _stream(
        spark, sf, "conversations",
        sql="SELECT 'https://t.example/' || CAST(conv_id AS STRING) AS url, text AS content, timestamp_seconds(turn) AS seen_at FROM @conversations",
    )
    done = stateful.run_available(stateful.stream_changes(pages), scratch_path(spark, "changes"))
    return done.select("url", F.unix_seconds("seen_at").alias("turn"), "status")
