"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often each pair does corpus-wide.

Both tokenizations of a text cut one byte string. Offsets where both have a token's end cut the tokens into groups; a token of A
and one of B are linked where their byte ranges overlap. Pairs of linked ids are indexed by inverted bitmaps: documents get slots in blocks
of bounded size, and a pair has, per block, one compressed bitmap of the documents that hold it and planes of the same kind with the binary digits
of how often beyond once. A pair's bitmaps of several blocks are ORed by taking their containers together, as blocks share no document; so popcounts
add up to its document count, and popcounts of planes, weighted by their digit, to its link count. Then the postings return the scores: each
pair's counts go to the blocks that hold it, and every bit of a bitmap or plane adds them to its document.

A hot pair has one row a block, however many documents hold it; a hot document id is of no account. Nothing is gathered whole: a task streams
its blocks, and only the highest count of each A id is broadcast, which has as many rows as A's vocabulary at most.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.common import map_arrow, octets, written

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_CHARS = 1 << 16, 4_000_000, 64_000_000
# Fixed value: how byte-level tokenizers of this kind split a text before they merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = 20  # a pair is (A id << 20) + B id

_POSTING = [("block", pa.int64()), ("pair", pa.int64()), ("plane", pa.int32()), ("n", pa.int32()), ("dense", pa.bool_()), ("slots", pa.binary())]
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the bytes of their tokens. ``a`` is the text of a byte-level tokenizer file, ``b`` a piece model's bytes.

    A's file is read into the library that merges by rank: ids must be in the order of the merges, and no merge may give another's entry.
    """

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tiktoken

        letters, model = _byte_letters(), json.loads(a)["model"]
        entries = {bytes(letters[c] for c in entry): k for entry, k in model["vocab"].items() if all(c in letters for c in entry)}
        merged = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)) or len(entries) != len(merged) + 256:
            raise ValueError("the merges of this file are not in the order of its ids")
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=entries, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = entry
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        ids = range(max(len(self.bytes_a), size))
        self.written = [b"%d%b" % (k, sign) for sign in (b",", b"|", b";") for k in ids]
        self.ids = len(ids)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of each text under A, which reads a space before it, and under B, which adds that itself."""
        some = [t for t in texts if t]
        b = iter(self.b.encode(some, num_threads=1) if some else [])
        for text in texts:
            yield (self.a.encode_ordinary(f" {text}"), next(b)) if text else ([], [])

    def links(self, text: str | None, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, bytes, int]:
        """(pair and count of each link, the groups as written, how many); nothing if the tokens do not spell a space and the text."""
        none = np.empty(0, np.int64)
        want = f" {text}".encode() if text else b""
        if not want or b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return none, none, b"", 0
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.long_a[ids_a]), np.cumsum(self.long_b[ids_b])
        last_b = np.searchsorted(ends_b, ends_a)
        closes = ends_b[last_b] == ends_a
        ia, ib = np.flatnonzero(closes), last_b[closes]
        # Every stretch between two neighbouring ends lies in one token of each, and is all of their overlap.
        single = np.ones(len(b), bool)
        single[ib] = False
        ends = np.sort(np.concatenate([ends_a, ends_b[single]]))
        pairs = (ids_a[np.searchsorted(ends_a, ends)] << _SHIFT) + ids_b[np.searchsorted(ends_b, ends)]
        found, times = np.unique(pairs, return_counts=True)
        # A's tokens of a group stand after those of B in the groups before, and B's after A's in their own.
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[ia], sign_b[ib] = 1, 2
        group_a, group_b = np.cumsum(sign_a == 1) - (sign_a == 1), np.cumsum(sign_b == 2) - (sign_b == 2)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], ib + 1])[group_a]] = sign_a * self.ids + ids_a
        codes[np.arange(len(b)) + (ia + 1)[group_b]] = sign_b * self.ids + ids_b
        return found, times, b"".join(map(self.written.__getitem__, codes.tolist()))[:-1], len(ia)


def containers(pairs: np.ndarray, slots: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, pa.Array]]:
    """Bitmaps of the slots of each pair, sorted by (pair, slot): (pair, popcount, dense, bitmap). A bitmap is the shorter of its slots, two
    bytes each, and a bit for each of ``docs`` slots."""
    if not len(pairs):
        return
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    sizes = np.diff(np.append(first, len(pairs)))
    width = (docs + 7) // 8
    dense = sizes * 2 > width
    loose = np.repeat(~dense, sizes)
    if loose.any():
        offsets = np.concatenate([[0], np.cumsum(sizes[~dense] * 2)]).astype(np.int32)
        data = slots[loose].astype("<u2")
        yield pairs[first[~dense]], sizes[~dense], False, pa.Array.from_buffers(pa.binary(), int((~dense).sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    if dense.any():
        which, packed = np.flatnonzero(dense), []
        for start, size in zip(first[which], sizes[which], strict=True):
            bits = np.zeros(width * 8, np.uint8)
            bits[slots[start : start + size]] = 1
            packed.append(np.packbits(bits, bitorder="little").tobytes())
        yield pairs[first[which]], sizes[which], True, pa.array(packed, pa.binary())


def slots_of(bitmap: bytes, dense: bool) -> np.ndarray:
    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


def planes(pairs: np.ndarray, slots: np.ndarray, times: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, pa.Array]]:
    """Plane 0 is the bitmap of a pair's documents; plane k > 0 those whose count less one has the digit 2 ** (k - 1)."""
    for found in containers(pairs, slots, docs):
        yield (0, *found)
    more = times - 1
    for digit in range(int(more.max(initial=0)).bit_length()):
        keep = (more >> digit & 1).astype(bool)
        for found in containers(pairs[keep], slots[keep], docs):
            yield (digit + 1, *found)


class _Block:
    """Documents that wait for their bitmaps."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.times, self.postings, self.chars = number, [], [], [], 0, 0

    def add(self, key, counts: tuple, groups: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append((key, *counts, groups))
        self.pairs.append(pairs)
        self.times.append(times)
        self.postings += len(pairs)
        self.chars += len(groups)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS or self.chars >= BLOCK_CHARS

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def filled(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            known = {"block": pa.array(np.full(n, self.number)), **columns}
            return pa.RecordBatch.from_arrays([known[f.name].cast(f.type) if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)

        docs = len(self.rows)
        if not docs:
            return
        names = ["id", *_COUNTS, "groups"]
        columns = {name: pa.array(column, schema.field(name).type) for name, column in zip(names, zip(*self.rows, strict=True), strict=True)}
        yield filled(docs, {**columns, "slot": pa.array(np.arange(docs))})
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        slots = np.repeat(np.arange(docs), [len(p) for p in self.pairs])
        order = np.argsort(pairs, kind="stable")
        for plane, found, sizes, dense, maps in planes(pairs[order], slots[order], times[order], docs):
            for at in range(0, len(found), 1 << 15):
                part = slice(at, at + (1 << 15))
                n = len(found[part])
                yield filled(n, {"pair": pa.array(found[part]), "plane": pa.array(np.full(n, plane)), "n": pa.array(sizes[part]), "dense": pa.array(np.full(n, dense)), "slots": maps[at : at + n]})


@dataclass
class LinkIndex:
    """The written index: a row per document (block, slot, id, counts, groups) and a row per bitmap (block, pair, plane, n, dense, slots)."""

    rows: DataFrame

    def documents(self) -> DataFrame:
        return self.rows.filter("slot is not null").select("id", *_COUNTS, "groups")

    def counts(self) -> DataFrame:
        """(pair, a, b, n_docs, n_links): how many documents hold each pair of ids linked, and how many links they have."""
        weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
        held = self.rows.filter("pair is not null").select("pair", "plane", F.col("n").cast("long").alias("n"), weight.alias("w"))
        summed = held.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * F.col("w")).alias("n_links"))
        return summed.select("pair", F.shiftright("pair", _SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "n_docs", "n_links")

    def scores(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum): of each document, how many links have the highest document count of their A
        id, ties included, and the sum of its links' document counts."""
        counts = self.counts().select("pair", "a", "n_docs")
        top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))  # a row for each entry of A's vocabulary at most
        priced = counts.join(F.broadcast(top), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))
        postings = self.rows.filter("pair is not null").select("block", "pair", "plane", "dense", "slots").join(priced, "pair").drop("pair")
        heads = self.rows.filter("slot is not null").select("block", "slot", "id", *_COUNTS, "groups")
        both = postings.unionByName(heads, allowMissingColumns=True)
        names = ["id", *_COUNTS, "groups"]
        schema = heads.select(*names).schema.add("n_best", "long").add("count_sum", "long")
        dealt = both.repartition("block").sortWithinPartitions("block")

        def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, waiting = None, []
            best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

            def closed() -> Iterator[pa.RecordBatch]:
                for part in waiting:
                    slot = part.column("slot").to_numpy()
                    columns = [part.column(name) for name in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(best[slot]), pa.array(total[slot])], names=[*names, "n_best", "count_sum"])

            for batch in batches:
                blocks = batch.column("block").to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else []
                for start, end in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                    if blocks[start] != now:
                        yield from closed()
                        now, waiting = blocks[start], []
                        best[:], total[:] = 0, 0
                    part = batch.slice(start, end - start)
                    here = part.column("slot").is_valid()
                    if here.true_count:
                        waiting.append(part.filter(here))
                    rows = part.filter(part.column("slot").is_null())
                    dense = rows.column("dense").to_numpy(zero_copy_only=False).astype(bool)
                    weight = np.left_shift(1, np.maximum(rows.column("plane").to_numpy() - 1, 0))
                    docs, is_best = rows.column("n_docs").to_numpy(), rows.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
                    maps = rows.column("slots")
                    loose = maps.filter(pa.array(~dense))
                    sizes = np.array([len(x) for x in loose.to_pylist()], np.int64) // 2
                    at = np.frombuffer(b"".join(loose.to_pylist()), "<u2").astype(np.int64)
                    np.add.at(total, at, np.repeat((weight * docs)[~dense], sizes))
                    np.add.at(best, at, np.repeat((weight * is_best)[~dense], sizes))
                    for k in np.flatnonzero(dense):
                        at = slots_of(maps[k].as_py(), True)
                        total[at] += weight[k] * docs[k]
                        best[at] += weight[k] * is_best[k]
            yield from closed()

        return dealt.mapInArrow(returned, schema)


def index_links(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = f"{FOLDER}/{FILE_A}", file_b: str = f"{FOLDER}/{FILE_B}", digest: bool = False) -> LinkIndex:
    """Tokenize every text once and write the index of its links to the shared folder.

    ``groups`` is the alignment of a document, ``a1,a2|b1;a3|b2,b3``: decimal A and B ids in order; with ``digest`` its SHA-256 in lower-case hex
    instead. Null and empty texts, and texts that one tokenizer does not give back byte for byte, have no tokens: zeros and an empty string.
    Repeated rows are documents each, also under one id or none; ids keep their type. Texts are read whole, a very long one in a batch
    of its own, and need some hundred bytes of a worker's memory a token. Other columns are ignored, whatever their names. An empty table gives an empty one. The
    vocabulary files are read on the driver and travel with the tasks.
    """
    spark = documents.sparkSession
    with open(file_a, encoding="utf-8") as f, open(file_b, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType
    schema = StructType.fromDDL("block long, pair long, plane int, n int, dense boolean, slots binary, slot int, n_a long, n_b long, n_groups long, n_links long, groups string").add("id", kind)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, out = None, None
        task = TaskContext.get().partitionId()
        block = _Block(task << 24)
        for batch in batches:
            if out is None:
                aligner = Aligner(*models.value)
                out = pa.schema([*_POSTING, ("slot", pa.int32()), *((name, pa.int64()) for name in _COUNTS), ("groups", pa.string()), ("id", batch.schema.field("id").type)])
            ids, texts = batch.column("id").to_pylist(), [_text(t) for t in octets(batch.column("text"))]
            for start, end in _portions([len(t or "") for t in texts]):
                for k, (a, b) in zip(range(start, end), aligner.encode(texts[start:end]), strict=True):
                    pairs, times, groups, n = aligner.links(texts[k], a, b)
                    said = "" if not n else hashlib.sha256(groups).hexdigest() if digest else groups.decode()
                    block.add(ids[k], (len(a), len(b), n, int(times.sum())) if n else (0, 0, 0, 0), said, pairs, times)
                    if block.full():
                        yield from block.batches(out)
                        block = _Block(block.number + 1)
        if out is not None:
            yield from block.batches(out)

    return LinkIndex(written(map_arrow(slim, indexed, schema), "links"))


def _text(raw: bytes | None) -> str | None:
    """A text; what is no UTF-8 has no tokens, as none spell it."""
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def _portions(sizes: list[int], chars: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters each, or of one text."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > chars:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
