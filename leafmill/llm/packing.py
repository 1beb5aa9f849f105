"""Best-fit packing of documents into bins of fixed capacity, without conflicts inside a bin.

Two documents conflict if they come from one source, are copies, or belong to one cluster of near duplicates. Near duplicates need no join: one
pass over the texts gives each document min-hash band keys of its five-word shingles, and a key that two documents share is a cluster. Pieces are
dealt to shards of bounded size by a hash of the document, so a hot source or cluster is spread evenly and packing needs one slim shuffle and no
text. In a shard, pieces go longest first into the fullest bin that takes them: bins stand in order of what they
have left, each with a bitmap of its sources and one of its clusters, and the search goes on from the first that is large enough
to the first that is also compatible. A new bin opens if there is none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_rows, ascii_words, gram_hashes, hashes, map_arrow, shards, written

CAPACITY = 2048
SHARD_PIECES = 2_000
SHINGLE = 5
BANDS, ROWS = 14, 3  # a pair of similarity 0.75 shares a band key with probability 0.9995, one of 0.3 with 0.32


def _multipliers() -> np.ndarray:
    """An odd number for each of the BANDS x ROWS orders of shingles."""
    return np.array([xxhash.xxh3_64_intdigest(b"order %d" % k) | 1 for k in range(BANDS * ROWS)], np.uint64)


def band_keys(words: list[bytes], multipliers: np.ndarray) -> list[int]:
    """A key per band: the least shingles in ROWS orders. Documents of fewer words than a shingle are one shingle; without words there is none."""
    if not words:
        return []
    h = hashes(words)
    grams = np.unique(gram_hashes(h, SHINGLE) if len(h) >= SHINGLE else gram_hashes(h, len(h)))
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 4096):
        part = grams[start : start + 4096, None] * multipliers
        part ^= part >> np.uint64(29)
        least = np.minimum(least, part.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) >> 1 for k, row in enumerate(rows)]


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(size, source, cluster) pieces, longest first, to (bin, offset) of each. Null sources and clusters conflict with none. A tuple
    is several clusters, of which one in common is a conflict."""
    sources: dict[object, int] = {}
    clusters: dict[object, int] = {}
    order: list[tuple[int, int]] = []  # (room, bin)
    taken: list[list[int]] = []  # per bin: bitmap of sources, bitmap of clusters
    out = []
    for size, source, cluster in pieces:
        bit_s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        bit_c = 0
        for c in cluster if isinstance(cluster, tuple) else (cluster,):
            bit_c |= 0 if c is None else 1 << clusters.setdefault(c, len(clusters))
        at = bisect_left(order, (size, -1))
        while at < len(order):
            maps = taken[order[at][1]]
            if not (maps[0] & bit_s or maps[1] & bit_c):
                break
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(taken)
            taken.append([0, 0])
        taken[number][0] |= bit_s
        taken[number][1] |= bit_c
        out.append((number, capacity - room))
        if room > size:
            insort(order, (room - size, number))
    return out


def _read_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    multipliers = _multipliers()
    for batch in batches:
        same, sizes, near = [], [], []
        for (text,) in arrow_rows(batch, "text"):
            words = ascii_words(text, lower=True)
            sizes.append(len(words))
            same.append(None if text is None else str(xxhash.xxh3_64_intdigest(b" ".join(words))))
            near.append(band_keys(words, multipliers))
        columns = [batch.column("doc_id"), batch.column("source"), pa.array(same, pa.string()), pa.array(sizes, pa.int64()), pa.array(near, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "cluster", "n", "near"])


def best_fit(documents: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None, near: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_words, bin_id, bin_offset.

    Sizes are words (runs without ASCII white space). A longer document is cut into pieces of whole capacity, which fill
    a bin each, and a rest; so every word of every text is in one piece and no bin holds more than ``capacity``. Null, empty
    and blank texts have no words and come back as one piece of none in no bin (bin_id null). Copies of a text, but for case and ASCII
    white space, conflict. With ``near``, so do documents that share a min-hash band key of their lower-cased five-word shingles: all pairs of
    similarity 0.75 or more but one in two thousand, and some less similar ones. ``clusters`` has (doc_id, cluster: long): documents of one cluster
    conflict too; only ids move, and an id with several clusters is in each. Null sources and rows without an id conflict with nothing by source or id; repeated rows are packed each. Bins are
    numbered within their shard: ``bin_id`` is shard-number. Other columns are ignored.
    """
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    if near:
        slim = map_arrow(slim, _read_bands, "doc_id long, source string, cluster string, n long, near array<long>")
    else:
        words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
        same = F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")))
        slim = slim.select("doc_id", "source", same.cast("string").alias("cluster"), F.coalesce(words, F.lit(0)).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("near"))
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("long") - 1, F.lit(0))
    cut = written(slim.select("doc_id", "source", "cluster", "n", "near", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")), "pieces")
    cut = cut.withColumn("start", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("n") - F.col("start")))
    rests = cut.filter((F.col("n_words") > 0) & (F.col("n_words") < capacity))
    k = shards(rests.count(), SHARD_PIECES)
    if clusters is not None:
        given = clusters.groupBy("doc_id").agg(F.collect_set(F.col("cluster").cast("long")).alias("given"))
        rests = rests.join(given, "doc_id", "left").withColumn("near", F.concat(F.coalesce("near", F.array().cast("array<long>")), F.coalesce("given", F.array().cast("array<long>"))))
    whole = cut.filter((F.col("n_words") == 0) | (F.col("n_words") == capacity))
    alone = whole.select(
        "doc_id", "piece", "start", "n_words", F.when(F.col("n_words") > 0, F.concat_ws("-", F.lit("whole"), F.col("doc_id"), F.col("piece"), F.monotonically_increasing_id())).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset")
    )
    shard = F.pmod(F.xxhash64("doc_id", "n_words", "cluster"), F.lit(k)).cast("int")
    dealt = rests.withColumn("shard", shard).repartition(k, "shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "cluster")
    names = ["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["shard"] != row["shard"]:
                    yield packed(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield packed(rows)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        held = Counter(key for r in rows for key in {r["cluster"], *(r["near"] or ())})  # a key held once needs no bit
        places = pack([(r["n_words"], r["source"], tuple(key for key in (r["cluster"], *(r["near"] or ())) if held[key] > 1)) for r in rows], capacity)
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in names[:4]]
        bins = pa.array([f"{r['shard']}-{number}" for r, (number, _) in zip(rows, places, strict=True)])
        return pa.RecordBatch.from_arrays([*columns, bins, pa.array([at for _, at in places], pa.int64())], names=names)

    schema = "doc_id long, piece long, start long, n_words long, bin_id string, bin_offset long"
    return map_arrow(dealt.select("doc_id", "piece", "start", "n_words", "source", "cluster", "near", "shard"), fill, schema).unionByName(alone)
