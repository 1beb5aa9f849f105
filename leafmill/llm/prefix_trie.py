"""A prefix trie of conversations, packed as double arrays.

A conversation is a path of turns. Equal paths are one path with a count. Paths are sorted and cut into prefix shards of bounded size;
a shard gives its turns dense ids and packs its trie into two arrays: the child of node s by turn t stands in cell BASE[s] + t, whose CHECK
is s. Traversing the arrays with the shard's paths gives its nodes and their aggregates.

A node lies in several shards only if it is a prefix of a shard's first or last path. Of such upper nodes every shard gives its share, under
the hash of the node's prefix, and the shares are merged globally: counts add up, and what an upper node itself is worth to the nodes
above is added along one path that holds it. So neither a hot first turn nor a hot conversation makes a task larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import shards, written

SHARD_TURNS = 200_000
TRIES = 16  # free cells tried for a node's children before they go behind all others
CHUNK_IDS = 4_096
PERIOD, HEADS = 5, 9

_PATH = "array<struct<k1:bigint,k2:bigint,bytes:bigint>>"
_NODE = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
_UPPER = ("k1", "k2", "up1", "up2", "bytes")


def turn_paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv long, path): each conversation's turns in order, null turns first, as hashes of (role, text) and the bytes of the text.

    Null roles and texts are empty. Equal turns stand by role, then by hash; repeated rows are turns of their own. Rows without an id belong to
    no conversation. Texts do not move, but a conversation's turns, 40 bytes each, are put in order in one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("k1"), F.xxhash64(text, F.lit(1), role).alias("k2"), F.octet_length(text).cast("long").alias("bytes"))
    slim = conversations.select(F.col(conv_col).cast("long").alias("conv"), turn.alias("turn")).filter("conv is not null")
    ordered = slim.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv", F.transform("turns", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["bytes"].alias("bytes"))).alias("path"))


def rebuilt(paths: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """Every conversation c with its first h turns replaced by the first h of conversation c - c % ``period`` (the remainder has c's sign), all of
    them if it has fewer, none if it is absent; h is the CRC-32 of c's decimal digits, modulo ``heads``."""
    h = F.expr(f"CAST(crc32(CAST(conv AS STRING)) % {heads} AS INT)")
    mine = paths.select("conv", "path", (F.col("conv") - F.col("conv") % period).alias("base"), h.alias("h"))
    first = paths.filter(F.col("conv") % period == 0).select(F.col("conv").alias("base"), F.slice("path", 1, heads - 1).alias("head"))
    none = F.array().cast(_PATH)
    path = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("path", F.col("h") + 1, F.size("path")))
    return mine.join(first, "base", "left").select("conv", path.alias("path"))


class DoubleArray:
    """BASE and CHECK over the labels of children; cell 0 is the root."""

    def __init__(self):
        self.base, self.check, self.taken, self.low = [0], [0], bytearray(b"\1"), 0

    def place(self, parent: int, labels: list[int]) -> int:
        """Put the children of ``parent`` into free cells; their ``labels`` ascend. Returns BASE."""
        taken, least = self.taken, labels[0]
        at = self.low = self._free(self.low)
        for _ in range(TRIES):
            shift = at - least
            if len(labels) == 1 or not any(shift + label < len(taken) and taken[shift + label] for label in labels):
                break
            at = self._free(at + 1)
        else:
            at = len(taken)
        base = at - least
        more = base + labels[-1] + 1 - len(taken)
        if more > 0:
            taken.extend(bytes(more))
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
        for label in labels:
            taken[base + label] = 1
            self.check[base + label] = parent
        self.base[parent] = base
        return base

    def _free(self, at: int) -> int:
        found = self.taken.find(0, at)
        return len(self.taken) if found < 0 else found

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.base), np.array(self.check)


def pack(offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of the trie of sorted paths; path k is ids[offsets[k]:offsets[k + 1]]."""
    trie, long = DoubleArray(), np.diff(offsets)
    alive, state, depth = np.flatnonzero(long > 0), np.zeros(int((long > 0).sum()), np.int64), 0
    while len(alive):
        label = ids[offsets[alive] + depth]
        starts = _starts(state, label)
        parents, labels = state[starts], label[starts]
        cuts = np.append(_starts(parents), len(parents))
        cells = np.empty(len(parents), np.int64)
        listed = labels.tolist()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            cells[a:b] = trie.place(int(parents[a]), listed[a:b]) + labels[a:b]
        state = np.repeat(cells, np.diff(np.append(starts, len(state))))
        depth += 1
        alive, state = alive[long[alive] > depth], state[long[alive] > depth]
    return trie.arrays()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def dense_ids(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Turns numbered from 0 in the order of their hashes."""
    order = np.lexsort((k2, k1))
    starts = _starts(k1[order], k2[order])
    ids = np.empty(len(k1), np.int64)
    ids[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k1))))
    return ids


class Nodes:
    """The aggregates of a shard's nodes, by cell: what traversing the double array with its paths gives."""

    def __init__(self, offsets: np.ndarray, k1: np.ndarray, k2: np.ndarray, size: np.ndarray, weight: np.ndarray, first: np.ndarray):
        self.offsets, self.ids = offsets, dense_ids(k1, k2)
        self.base, self.check = pack(offsets, self.ids)
        cells, long = len(self.check), np.diff(offsets)
        self.n, self.depth, self.bytes = (np.zeros(cells, np.int64) for _ in range(3))
        self.first = np.full(cells, np.iinfo(np.int64).max)
        self.end = np.full(cells, -1)
        alive, state, depth = np.arange(len(long)), np.zeros(len(long), np.int64), 0
        while len(alive):
            starts = _starts(state)
            cell = state[starts]
            self.n[cell] = np.add.reduceat(weight[alive], starts)
            self.first[cell] = np.minimum.reduceat(first[alive], starts)
            self.depth[cell] = depth
            self.end[state[long[alive] == depth]] = alive[long[alive] == depth]
            on = long[alive] > depth
            alive, state = alive[on], state[on]
            at = offsets[alive] + depth
            below = self.base[state] + self.ids[at]
            if (self.check[below] != state).any():
                raise AssertionError("a path leaves its trie")
            self.bytes[below] = size[at]
            state, depth = below, depth + 1

    def path(self, k: int) -> list[int]:
        """The cells of path ``k`` from the root."""
        out = [0]
        for label in self.ids[self.offsets[k] : self.offsets[k + 1]]:
            out.append(int(self.base[out[-1]] + label))
        return out

    def sums(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(children, leaves, saved) of each cell, counting only nodes that are not ``upper``."""
        full = np.flatnonzero(self.check >= 0)
        full = full[np.argsort(self.depth[full], kind="stable")]
        full = full[full != 0]
        grown = np.zeros(len(self.check), bool)
        grown[self.check[full]] = True
        mine = ~upper
        mine[self.check < 0] = False
        leaves = (mine & ~grown).astype(np.int64)
        saved = np.where(mine, (self.n - 1) * self.bytes, 0)
        children = np.bincount(self.check[full[mine[full]]], minlength=len(self.check))
        cuts = np.append(_starts(self.depth[full]), len(full))
        for a, b in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):  # deepest level first
            level = full[a:b]
            np.add.at(leaves, self.check[level], leaves[level])
            np.add.at(saved, self.check[level], saved[level])
        return children, leaves, saved


def _prefix_keys(k1: np.ndarray, k2: np.ndarray) -> list[tuple[int, int]]:
    """A 128-bit hash of each prefix of a path, from the empty one."""
    state = xxhash.xxh3_128()
    out = []
    for k in range(len(k1) + 1):
        digest = state.digest()
        out.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
        if k < len(k1):
            state.update(k1[k].tobytes() + k2[k].tobytes())
    return out


def _shard(table: pa.Table, number: int) -> Iterator[pa.Table]:
    """The nodes of a shard that are its own, then its shares of upper nodes: once for each node on its first and its last path."""
    column = table.column("path").combine_chunks()
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
    k1, k2, size = (flat.field(name).to_numpy() for name in ("k1", "k2", "bytes"))
    nodes = Nodes(offsets, k1, k2, size, table.column("n").to_numpy(), table.column("first").to_numpy())
    ends = table.column("ends").combine_chunks()
    sides = [nodes.path(0), nodes.path(table.num_rows - 1)]
    upper = np.zeros(len(nodes.check), bool)
    upper[sides[0]] = upper[sides[1]] = True
    children, leaves, saved = nodes.sums(upper)
    ended = lambda cells: ends.take(pa.array(nodes.end[cells], mask=nodes.end[cells] < 0))

    own = np.flatnonzero((nodes.check >= 0) & ~upper)
    parent = nodes.check[own]
    below = upper[parent]
    on_last = below & ~np.isin(parent, sides[0])
    refers = lambda values: pa.array(values, mask=~below)
    columns = {
        "depth": nodes.depth[own], "conv_id": nodes.first[own], "parent_conv_id": pa.array(nodes.first[parent], mask=below), "n_convs": nodes.n[own], "n_children": children[own],
        "n_leaves": leaves[own], "saved": saved[own], "ends": ended(own), "shard": refers(np.full(len(own), number)), "side": refers(on_last.astype(np.int64)), "at": refers(nodes.depth[parent]),
    }
    yield pa.table(columns)
    for side, cells in enumerate(sides):
        k = 0 if side == 0 else table.num_rows - 1
        keys = _prefix_keys(k1[offsets[k] : offsets[k + 1]], k2[offsets[k] : offsets[k + 1]])
        cell = np.array(cells)
        again = np.isin(cell, sides[0]) if side else np.zeros(len(cell), bool)  # given with the first path
        once = lambda values: np.where(again, 0, values)
        yield pa.table({
            "depth": nodes.depth[cell], "conv_id": pa.array(nodes.first[cell], mask=again), "n_convs": once(nodes.n[cell]), "n_children": once(children[cell]), "n_leaves": once(leaves[cell]),
            "saved": once(saved[cell]), "ends": ended(cell), "shard": np.full(len(cell), number), "side": np.full(len(cell), side), "at": nodes.depth[cell],
            "k1": [a for a, _ in keys], "k2": [b for _, b in keys], "up1": [None, *(a for a, _ in keys[:-1])], "up2": [None, *(b for _, b in keys[:-1])], "bytes": nodes.bytes[cell],
        })


def member_digests(members: DataFrame) -> DataFrame:
    """(p1, p2, ends): SHA-256 of each group's decimal ids, ascending and comma-joined. ``members``: p1, p2, conv.

    Ids are sorted by ranges of (group, id), so a hot group is spread; each range joins up to CHUNK_IDS ids of a group into one row, and
    the rows of a group are hashed as they stream by.
    """
    ranged = members.repartitionByRange("p1", "p2", "conv").sortWithinPartitions("p1", "p2", "conv")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, conv = (batch.column(name).to_numpy() for name in ("p1", "p2", "conv"))
            starts = _starts(p1, p2)
            starts = np.unique(np.concatenate([starts, np.arange(0, len(conv), CHUNK_IDS)]))
            said, cuts = list(map(str, conv.tolist())), [*starts.tolist(), len(conv)]
            ids = [",".join(said[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(conv) else []
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p1[starts], p2[starts], conv[starts])] + [pa.array(ids, pa.string())], names=["p1", "p2", "conv", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch.column("p1").to_pylist(), batch.column("p2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if (a, b) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _digest_rows(out)
        if now is not None:
            yield _digest_rows([(*now, state.hexdigest())])

    chunks = ranged.mapInArrow(chunked, "p1 long, p2 long, conv long, ids string")
    return chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv").mapInArrow(hashed, "p1 long, p2 long, ends string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["p1", "p2", "ends"])


def prefix_nodes(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv long, path as by ``turn_paths``).

    Columns, long but the last: conv_id, the smallest conversation that starts with the node's prefix; depth; parent_conv_id, null
    for the root; n_convs; n_children; n_leaves, nodes without children in its subtree, itself included; saved_tokens, over its subtree (n_convs - 1) times the
    bytes of a node's last text; ends_sha256 of the conversations that end there. Empty paths end at the root. No paths have no nodes.
    """
    all_paths = written(paths.select("conv", "path", F.xxhash64("path").alias("p1"), F.xxhash64(F.lit(1), "path").alias("p2")), "paths")
    counted = all_paths.groupBy("p1", "p2", "path").agg(F.count("*").alias("n"), F.min("conv").alias("first"))
    distinct = written(counted.join(member_digests(all_paths.select("p1", "p2", "conv")), ["p1", "p2"]).select("path", "n", "first", "ends"), "distinct")
    turns = distinct.agg(F.sum(F.size("path") + 1)).first()[0]
    if turns is None:
        return _named(distinct.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in _NODE) + ", ends string"))
    numbers = [c for c in (*_NODE, "shard", "side", "at", *_UPPER)]

    def trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # a shard
        if not sum(b.num_rows for b in batches):
            return
        schema = pa.schema([*((c, pa.int64()) for c in numbers), ("ends", pa.string())])
        for part in _shard(pa.Table.from_batches(batches), TaskContext.get().partitionId()):
            filled = [part.column(f.name).cast(f.type) if f.name in part.column_names else pa.nulls(part.num_rows, f.type) for f in schema]
            yield from pa.table(filled, schema=schema).to_batches(max_chunksize=10_000)

    dealt = distinct.repartitionByRange(shards(turns, SHARD_TURNS), "path").sortWithinPartitions("path")
    found = written(dealt.mapInArrow(trie, ", ".join(f"{c} long" for c in numbers) + ", ends string"), "nodes")
    own, shares = found.filter("k1 is null"), found.filter("k1 is not null")
    tops, steps = _merged(shares)
    settled = own.filter("shard is null").select(*_NODE, "ends")
    hanging = own.filter("shard is not null").drop("parent_conv_id").join(steps.withColumnRenamed("conv_id", "parent_conv_id"), ["shard", "side", "at"]).select(*_NODE, "ends")
    return _named(settled.unionByName(hanging).unionByName(tops))


def _merged(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upper nodes from the shards' shares, and the smallest conversation of each (shard, side, at)."""
    key = ["k1", "k2"]
    merged = shares.groupBy(*key).agg(
        F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_own"),
        F.max("bytes").alias("bytes"), F.max("ends").alias("ends"), F.min(F.struct("shard", "side")).alias("host"),
    )
    kids = merged.groupBy(F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count("*").alias("n_upper"))
    merged = merged.join(kids, key, "left").withColumn("n_children", F.col("n_own") + F.coalesce("n_upper", F.lit(0)))
    worth = F.struct(F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    merged = written(merged.withColumn("worth", worth), "upper")
    # What a node is worth to those above it counts along its host path alone: the first path of a shard that holds it.
    placed = shares.select(*key, "shard", "side", "at", "n_leaves", "saved").join(merged.select(*key, "conv_id", "host", "worth"), key)
    hosted = F.col("host") == F.struct("shard", "side")
    upward = Window.partitionBy("shard", "side").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    along = lambda field: F.sum(F.when(hosted, F.col(f"worth.{field}")).otherwise(0)).over(upward)
    summed = placed.withColumn("n_leaves", F.col("n_leaves") + along("leaf")).withColumn("saved", F.col("saved") + along("saved"))
    sums = summed.groupBy(*key).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    parents = merged.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    tops = merged.join(sums, key).join(parents, ["up1", "up2"], "left").select(*_NODE, "ends")
    return tops, placed.select("shard", "side", "at", "conv_id")


def _named(nodes: DataFrame) -> DataFrame:
    ends: Column = F.coalesce("ends", F.sha2(F.lit(""), 256))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"))
