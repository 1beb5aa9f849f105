"""Multi-index hashing: nearest vectors by cosine through learned, rotated binary codes.

Codes are signs of the centred vectors after learned rotations (iterative quantisation, several of them side by side). A code is cut into
``SUBS`` substrings of 16 bits and every row is indexed under each. Two codes within r bits share, by the pigeonhole principle, a substring that
differs in at most r // SUBS bits. The radius that true neighbours need is learned from a sample, and gives that number of flips: probing all
neighbours of a query's substrings with up to as many flips finds every code within the radius. Candidates are reranked by the exact
cosine of the original vectors.

Probing pays while a substring's neighbours are few: up to ``FLIPS`` flips. Where the radius asks for more, as with nearly isotropic vectors,
one flip is probed for queries whose neighbours score as high as a sample proves to be within its reach, if there are such scores; the
others, queries whose buckets are crowded, as those of a large group of near copies, and queries with too few codes within the radius, scan the codes in blocks, which finds the same codes that full probing would: every one within the
radius.

Equal vectors are one entry of the index with its smallest ids, as many as an answer can name: no answer can hold more of them, and a very
common vector is no hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import map_arrow, release, shards, written

SAMPLE = 4_000  # vectors that rotations and radius are learned from
BITS = 256
WIDTH = 16  # bits of a substring
SUBS = BITS // WIDTH
FLIPS = 3  # bits by which a probed substring may differ at most: 697 of 65,536 values
CROWD = 1_024  # entries in all of a query's buckets up to which probing pays, or as many as a ``CROWD_SHARE`` of the index
CROWD_SHARE = 64
BLOCK = 2_048  # vectors of a block
SET = 1 << 25  # bytes of blocks of queries that a task holds while blocks of entries pass by, or a block
NEAR = SUBS * 2 - 1  # bits within which probing with one flip finds every code
PAIRS = 200  # true neighbours of about one score that must show that they are within NEAR bits
RECALL = 0.99  # of the true neighbours in the sample, within the radius


@dataclass
class Codes:
    """``flips`` is how many bits of a substring probing flips; 0 where probing answers nothing."""

    centre: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    radius: int
    sure: float = float("inf")  # score from which ``RECALL`` of true neighbours are within ``NEAR`` bits

    @property
    def flips(self) -> int:
        wanted = self.radius // SUBS
        return wanted if 1 <= wanted <= FLIPS else 1 if wanted == 0 or self.sure < float("inf") else 0

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Unit vectors to codes: 64-bit words."""
        bits = (unit - self.centre) @ self.rotations > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of ``a`` to all of ``b``."""
    return sum(np.bitwise_count(a[:, k, None] ^ b[None, :, k]).astype(np.int32) for k in range(a.shape[1]))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn(sample: np.ndarray, k: int, bits: int = BITS, rounds: int = 25) -> Codes:
    """Rotations by iterative quantisation from several starts, the radius that ``RECALL`` of true neighbours need, and the score from
    which probing is enough. Without enough true neighbours of the highest scores in the sample none is.

    The sample is thinner than the table, so its neighbours are farther apart than the table's and the radius is on the safe side.
    """
    rng = np.random.default_rng(11)
    size = sample.shape[1]
    unit = unit_rows(sample)
    centre = unit.mean(axis=0)
    centred = unit - centre
    parts = []
    for _ in range(-(-bits // size)):
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for _ in range(rounds if len(sample) > 1 else 0):
            u, _, v = np.linalg.svd(np.where(centred @ turn > 0, 1.0, -1.0).T @ centred)
            turn = (u @ v).T
        parts.append(turn)
    codes = Codes(centre, np.concatenate(parts, axis=1)[:, :bits], bits)
    coded, needed, reached = codes.of(unit), [], []
    for start in range(0, len(unit), 100):
        scores = unit[start : start + 100] @ unit.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -2
        best = np.argpartition(-scores, min(k, len(unit) - 1) - 1, axis=1)[:, :k] if len(unit) > 1 else np.zeros((1, 0), np.int64)
        needed.append(np.take_along_axis(distances(coded[start : start + 100], coded), best, axis=1))
        reached.append(np.take_along_axis(scores, best, axis=1))
    if len(unit) > 1:
        codes.radius = int(np.ceil(np.quantile(np.concatenate(needed[:4]).ravel(), RECALL)))
        codes.sure = sure_from(np.concatenate(reached).ravel(), np.concatenate(needed).ravel())
    return codes


def sure_from(scores: np.ndarray, apart: np.ndarray) -> float:
    """The least score such that from there on, in each run of ``PAIRS`` neighbours by score, ``RECALL`` are within ``NEAR`` bits."""
    order = np.argsort(-scores, kind="stable")
    inside = np.concatenate(([0], np.cumsum(apart[order] <= NEAR)))
    held = inside[PAIRS:] - inside[:-PAIRS] >= RECALL * PAIRS
    runs = len(held) if held.all() else int(held.argmin())
    return float(scores[order[runs + PAIRS - 2]]) if runs else float("inf")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v in double precision; rows that are null, zero or hold null or non-finite components are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(sound & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query row, by cosine, ties to the smaller id.

    ``is_query`` is a condition on ``id``. A query's own id is no candidate; equal vectors under other ids are. Rows whose vector is null,
    zero or holds null or non-finite components take no part, nor rows without an id. Repeated rows (same id, same vector) count
    once; of one id with different vectors each is a candidate and the best counts. Vectors of another length than most are compared with
    their like only. With fewer than ``k`` candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    every = usable(vectors, id_col, vector_col).distinct()
    first = Window.partitionBy("v").orderBy("id")
    entries = every.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    entries = written(entries.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.xxhash64("v")), "entries")
    queries = written(every.filter(is_query).select(F.col("id").alias("query_id"), "v"), "queries")
    release(spark)
    sizes = [r[0] for r in entries.select(F.size("v").alias("d")).distinct().collect()]
    out = None
    for size in sorted(sizes):
        part = _nearest_of_size(entries.filter(F.size("v") == size), queries.filter(F.size("v") == size), size, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _coded(rows: DataFrame, codes, size: int, columns: list[str]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codes(*codes.value)
        for batch in batches:
            v = matrix(batch.column(batch.schema.get_field_index("v")), size)
            words = coder.of(unit_rows(v)).view(np.int64)
            column = pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), words.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), column], names=[*columns, "code"])

    kinds = dict(rows.dtypes)
    return map_arrow(rows, scan, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", code array<bigint>")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _substrings(code: str):
    """(place, value) of each substring of a code."""
    per = 64 // WIDTH
    cut = lambda w, k: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: F.struct((k * per + j).alias("place"), F.call_function("shiftright", w, j * WIDTH).bitwiseAND((1 << WIDTH) - 1).cast("int").alias("value")))
    return F.flatten(F.transform(F.col(code), cut))


def _cosine_rank(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: query_id, vec_id, score."""
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_size(entries: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    spark = entries.sparkSession
    sample = entries.orderBy("key").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    learned = learn(matrix(sample, size), k)
    codes = spark.sparkContext.broadcast((learned.centre, learned.rotations, learned.radius))
    sure = learned.sure
    index = written(_coded(entries, codes, size, ["key", "ids", "v"]), "index")
    asked = written(_coded(queries, codes, size, ["query_id", "v"]), "asked")

    if not learned.flips:
        return _cosine_rank(written(_scan(index, asked, codes, size, k), "scanned"), k)
    # Probing: the substring itself and those that differ in up to so many bits.
    reach = SUBS * (learned.flips + 1) - 1
    masks = [sum(1 << b for b in bits) for n in range(learned.flips + 1) for bits in combinations(range(WIDTH), n)]
    subs = asked.select("query_id", "code", F.explode(_substrings("code")).alias("s"))
    probes = subs.select("query_id", "code", F.col("s.place").alias("place"), F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("s.value").bitwiseXOR(m))).alias("value"))
    table = index.select(F.col("key"), F.col("code").alias("other"), F.explode(_substrings("code")).alias("s")).select("key", "other", F.col("s.place").alias("place"), F.col("s.value").alias("value"))
    # A group of near copies shares its buckets: its queries would meet all of it in every place. They scan, which meets each entry once.
    held = table.groupBy("place", "value").agg(F.count("*").alias("n"))
    met_by = _merged(probes, held, ["place", "value"]).groupBy("query_id").agg(F.sum("n").alias("n"))
    crowded = written(met_by.filter(F.col("n") > max(CROWD, index.count() // CROWD_SHARE)).select("query_id"), "crowded")
    probes = probes.join(crowded, "query_id", "left_anti")
    apart = F.aggregate(F.zip_with("code", "other", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    found = _merged(probes, table, ["place", "value"]).filter(apart <= reach).select("query_id", "key").distinct()
    met = _merged(_merged(found, index.select("key", "v", "ids"), ["key"]), asked.select("query_id", F.col("v").alias("q")), ["query_id"])
    scored = _scored(met, size).select("query_id", "vec_id", "score")
    probed = written(scored.filter("query_id <> vec_id"), "probed")
    # A query is answered if it has k neighbours within reach, and reach is what true neighbours need, or the k-th scores as those do that are hardly ever beyond it.
    good = probed if learned.radius <= reach else probed.filter(F.col("score") >= sure)
    done = good.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k).select("query_id")
    done = written(done, "done")
    rest = asked.join(done, "query_id", "left_anti")
    release(spark)
    scanned = written(_scan(index, rest, codes, size, k), "scanned")
    release(spark)
    answers = probed.join(done, "query_id", "left_semi").unionByName(scanned)
    return _cosine_rank(answers, k)


def _merged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join that shuffles both sides, never a broadcast: what explode makes of a row, and vectors that pack well in a file, are many times
    the bytes that the planner takes them for, and a broadcast would go through the driver."""
    return left.join(right.hint("merge"), on)


def _scored(pairs: DataFrame, size: int) -> DataFrame:
    """Exact cosines in double precision of (query_id, q, v, ids), one row per id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, q = matrix(batch.column(1), size), matrix(batch.column(2), size)
            score = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), batch.column(3)], names=["query_id", "score", "ids"])

    rows = map_arrow(pairs.select("query_id", "v", "q", "ids"), scan, "query_id long, score double, ids array<long>")
    return rows.select("query_id", F.explode("ids").alias("vec_id"), "score")


def _place_of(number: str):
    """The partition and the place in it that ``monotonically_increasing_id`` has put into a number."""
    return F.shiftright(F.col(number), 33), F.col(number).bitwiseAND(F.lit((1 << 33) - 1))


def _scan(index: DataFrame, queries: DataFrame, codes, size: int, k: int) -> DataFrame:
    """Every index entry within the learned radius of each query, found block by block; the best ``k`` of each block of entries.

    Queries and entries are packed into blocks, which meet in a grid, so work spreads however few queries there are and no side is broadcast. A query
    with fewer than ``k`` entries of a block within the radius takes that block's nearest codes as well, so an answer is never short.
    """

    def block_of(df: DataFrame, columns: list[str], label: str) -> DataFrame:
        ids, flat = columns

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for batch in batches:
                rows.extend(zip(batch.column(0).to_pylist(), matrix(batch.column(1), size), strict=True))
                while len(rows) >= BLOCK:
                    yield as_batch(rows[:BLOCK])
                    rows = rows[BLOCK:]
            if rows:
                yield as_batch(rows)

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            kept = pa.array([[r[0]] if isinstance(r[0], int) else r[0] for r in rows], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([kept.to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([np.stack([r[1] for r in rows]).tobytes()], pa.binary())], names=["ids", "m"])

        packed = df.select(ids, flat).mapInArrow(scan, "ids array<array<long>>, m binary")
        return written(packed.withColumn("b", F.monotonically_increasing_id()), label)

    left = block_of(index, ["ids", "v"], "index-blocks").withColumnsRenamed({"ids": "their", "m": "theirs", "b": "t"})
    right = block_of(queries.repartition(shards(queries.count(), BLOCK)), ["query_id", "v"], "query-blocks")
    asked, (entries, most) = right.count(), left.agg(F.count("*"), F.max(_place_of("t")[1])).first()
    if not asked or not entries:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    # A grid of cells, each a group of blocks of entries with a set of blocks of queries. A block of entries is copied once a set and a block of
    # queries once a group: as many groups as make both copies about equal, or as keep all tasks busy.
    sets = shards(asked, max(1, SET // (BLOCK * size * 8)))
    groups = min(entries, max(entries * sets // asked, 4 * queries.sparkSession.sparkContext.defaultParallelism))
    part, place = _place_of("t")
    meets = left.withColumn("g", F.pmod(part * (most + 1) + place, F.lit(groups))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    held = right.withColumn("h", F.pmod(_place_of("b")[0], F.lit(sets)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = _merged(meets, held, ["g", "h"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                their, theirs, ids, m = (batch.column(c)[row].as_py() for c in ("their", "theirs", "ids", "m"))
                v, q = np.frombuffer(theirs).reshape(-1, size), np.frombuffer(m).reshape(-1, size)
                yield from answers(their, v, [x[0] for x in ids], q)

    def answers(their: list, v: np.ndarray, ids: list, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        coder = Codes(*codes.value)
        coded, radius = coder.of(unit_rows(v)), coder.radius
        norms = np.sqrt((v * v).sum(axis=1))
        out: tuple[list, list, list] = ([], [], [])
        for start in range(0, len(q), 128):
            part = q[start : start + 128]
            apart = distances(coder.of(unit_rows(part)), coded)
            enough = np.sort(apart, axis=1)[:, min(k, apart.shape[1] - 1)]
            for i, limit in enumerate(np.maximum(enough, radius).tolist()):
                at = np.flatnonzero(apart[i] <= limit)
                score = (v[at] * part[i]).sum(axis=1) / (norms[at] * np.sqrt((part[i] * part[i]).sum()))
                least = score.min() if len(at) <= k + 1 else np.sort(score)[-(k + 1)]
                for j, s in zip(at[score >= least].tolist(), score[score >= least].tolist(), strict=True):
                    for vec in their[j]:
                        if vec != ids[start + i]:
                            out[0].append(ids[start + i]), out[1].append(vec), out[2].append(s)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], names=["query_id", "vec_id", "score"])

    return map_arrow(pairs.select("their", "theirs", "ids", "m"), scan, "query_id long, vec_id long, score double")
