"""What several operators share: word hashing in Arrow batches, written steps, components, digests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.session import scratch_path

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back: it survives lost executors and cuts lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step._step_path = path
    return step


def discard(*steps: DataFrame) -> None:
    """Delete written steps that nothing will read again: what was made of them is written itself."""
    for step in steps:
        jvm, session = step.sparkSession._jvm, step.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(step._step_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have been written and are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def octets(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def ascii_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs without ASCII white space (0x09-0x0D and 0x20); A-Z lower-cased if asked."""
    if text is None:
        return []
    return (text.translate(LOWER) if lower else text).split()


def hashes(words: Iterable[bytes], size: int | None = None) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words) if size is None else size)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word hashes; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out = out * _STEP + h[j : j + m]
    out ^= out >> _SHIFT
    out *= _MIX
    out ^= out >> _SHIFT
    return out


def arrow_rows(source: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch; string columns come as bytes."""
    columns = []
    for name in names:
        column = source.column(source.schema.get_field_index(name))
        text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        columns.append(octets(column) if text else column.to_pylist())
    return zip(*columns, strict=True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of few rows, so that a worker holds few texts as Python objects at a time. A task's memory goes back to the
    system at its end: Spark keeps idle workers, and they would hold on to it beside the workers of the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(sliced(batches))
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def first_by_hash(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows whose key has the least hash (all rows of an equal key): keys are chosen first, so only they move."""
    chosen = df.select(F.xxhash64(key).alias("h")).distinct().orderBy("h").limit(limit)
    name = free_name(df, "h")
    hashed = df.withColumn(name, F.xxhash64(key))
    return hashed.join(F.broadcast(chosen), hashed[name] == chosen["h"], "left_semi").drop(name)  # at most ``limit`` numbers


def proven_from(counts: list[tuple[float, float, float]], precision: float, certainty: float) -> float | None:
    """The least score from which on the share of hits is proven to be ``precision``: the lower end of the Wilson interval of ``certainty`` standard
    errors reaches it. ``counts``: (score, hits, all). The fewer there are, the purer they must be; a handful proves nothing."""
    found, yes, n, z2 = None, 0.0, 0.0, certainty**2
    for score, hits, every in sorted(counts, reverse=True):
        yes, n = yes + hits, n + every
        p = yes / n
        if (p + z2 / (2 * n) - certainty * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n) >= precision:
            found = score
    return found


def shards(total: float, per_shard: float) -> int:
    """As many shards as hold ``per_shard`` each."""
    return max(1, math.ceil(total / per_shard))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): every node that has an edge to another, with the smallest node it reaches.

    Alternating large-star and small-star rounds: each round links a node's larger, then its smaller
    neighbours to the smallest, so paths shorten geometrically. A node with very many neighbours
    is pre-aggregated for its minimum, and its join is one that Spark can split. Nulls and loops are dropped.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(now.filter("a > b").distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        before, now = now, written(small.filter("a > b").distinct(), "links")
        discard(before)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(row) == seen and row[0] == row[2]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(row)
