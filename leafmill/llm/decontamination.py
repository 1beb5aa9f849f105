"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The test items are few and fixed while the corpus grows, so the automaton travels to the documents
and no document is shuffled. Items are cut into shards of at most ``SHARD_WORDS`` words; each shard
makes one automaton, which is what bounds every broadcast, and one pass over the documents. A
document's words are streamed through the automaton; the longest match that ends at each word
tells which windows of the items end there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.common import arrow_rows, free_name, map_arrow, shards

WINDOW = 13
SHARD_WORDS = 200_000

# A-Z become a-z, every other ASCII octet but a-z and 0-9 separates words.
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def normal_words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences, with the windows of each marked on its states.

    ``step`` maps (state, token) to a state; ``link`` and ``longest`` are the suffix link and the
    length of the longest string of a state. Windows of one length that share a state are the same
    string, so a state needs one mark per length.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]

    def _state(self, step: dict[int, int], link: int, longest: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.step) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of ``q`` for the shorter strings that arrive through ``p``."""
        copy = self._state(dict(self.step[q]), self.link[q], self.longest[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, tokens: list[int]) -> None:
        last = 0
        step, link, longest = self.step, self.link, self.longest
        for token in tokens:
            q = step[last].get(token)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else self._split(last, token, q)
                continue
            new, p = self._state({}, 0, longest[last] + 1), last
            while p >= 0 and token not in step[p]:
                step[p][token] = new
                p = link[p]
            if p >= 0:
                q = step[p][token]
                link[new] = q if longest[q] == longest[p] + 1 else self._split(p, token, q)
            last = new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each token: the state and length of the longest match that ends there."""
        step, link, longest = self.step, self.link, self.longest
        state = length = 0
        for token in tokens:
            while state and token not in step[state]:
                state = link[state]
                length = longest[state]
            to = step[state].get(token)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` tokens of a match that ends in ``state``."""
        while self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state


class ItemIndex:
    """The automaton of some items, and the items that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        vocabulary: dict[bytes, int] = {}
        coded = [(item, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]) for item, words in items if words]
        self.vocabulary = vocabulary
        self.shortest = min((min(window, len(c)) for _, c in coded), default=0)
        self.machine = machine = SuffixAutomaton()
        for _, codes in coded:
            machine.add(codes)
        self.owners: dict[tuple[int, int], set[str]] = {}
        lengths: dict[int, set[int]] = {}
        for item, codes in coded:
            size = min(window, len(codes))
            for state, length in machine.matches(codes):
                if length >= size:
                    at = machine.holding(state, size)
                    self.owners.setdefault((at, size), set()).add(item)
                    lengths.setdefault(at, set()).add(size)
        self.lengths = {at: sorted(sizes, reverse=True) for at, sizes in lengths.items()}
        # The nearest state on the way to the root, itself included, that has a window.
        self.marked = [0] * len(machine.step)
        for state in sorted(range(1, len(machine.step)), key=machine.longest.__getitem__):
            self.marked[state] = state if state in lengths else self.marked[machine.link[state]]

    def windows(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """The words inside an occurrence of a window, and the items with such a window."""
        hit, items, shortest = np.zeros(len(words), bool), set(), self.shortest
        if not shortest or len(words) < shortest:
            return hit, items
        codes = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        # A match never spans a word that no item has: only long enough runs of known words are streamed.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).astype(np.int8), [0]))))
        machine = self.machine
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < shortest:
                continue
            for at, (state, length) in enumerate(machine.matches(codes[start:end].tolist()), start + 1):
                if length < shortest:
                    continue
                state, longest = self.marked[state], 0
                while state:
                    for size in self.lengths[state]:
                        if size <= length:
                            items |= self.owners[state, size]
                            longest = max(longest, size)
                    state = self.marked[machine.link[state]]
                if longest:
                    hit[at - longest : at] = True
        return hit, items


def _shard_items(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in shards of a bounded number of words (a single item may exceed it)."""
    kept = items.filter(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")
    ).distinct()
    # Words of one letter and a space each: no text has more words than half its octets.
    size = kept.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    n = shards(size, SHARD_WORDS)
    for k in range(n):
        part = kept.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else kept
        yield sorted((r["item"], r["text"].encode()) for r in part.collect())


def find_windows(
    documents: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """Every row of ``documents`` with a last column ``hits``: struct(n_words, n_hit, items, spans).

    ``items`` lists the items found, sorted as strings; ``spans`` has the flat starts and ends, in words, of
    what was hit. Null and empty texts have no words and no hits; a null item id counts as ''; null items
    and items without words are ignored; repeated items count once; repeated documents are judged each;
    an empty table gives an empty one. Other columns pass through; if one is called ``hits``, the new column
    gets underscores in front. If the items need several shards, each pass adds to the one before.
    """
    out = documents
    name = free_name(documents, "hits")
    kept = list(documents.columns)
    for k, shard in enumerate(_shard_items(items, item_col, item_text)):
        out = _pass(out, kept, name, shard, text_col, window, first=k == 0)
    return out


_HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<int>>"


def _pass(df: DataFrame, kept: list[str], name: str, shard: list, text_col: str, window: int, first: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(shard)
    schema = StructType([f for f in df.schema.fields if f.name != name]).add(name, StructType.fromDDL(f"h {_HITS}")["h"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex([(item, normal_words(text)) for item, text in shared.value], window)
        for batch in batches:
            rows = []
            before = [None] * batch.num_rows if first else batch.column(batch.schema.get_field_index(name)).to_pylist()
            for (text,), old in zip(arrow_rows(batch, text_col), before, strict=True):
                words = normal_words(text)
                hit, items = index.windows(words)
                if old:
                    flat = old["spans"]
                    for start, end in zip(flat[::2], flat[1::2], strict=True):
                        hit[start:end] = True
                    items |= set(old["items"])
                spans = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                rows.append({"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items), "spans": spans.tolist()})
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32()))])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*kept, name])

    return map_arrow(df, scan, schema)


def cut_hits(documents: DataFrame, hits: str, text_col: str = "text") -> DataFrame:
    """Remove from the texts the normalised words that were hit, with what separates them from the next word.

    Texts without hits stay as they are, octet for octet.
    """
    schema = StructType(documents.schema.fields)
    names = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(hits)).to_pylist()
            at = batch.schema.get_field_index(text_col)
            texts = []
            for (text,), seen in zip(arrow_rows(batch, text_col), found, strict=True):
                texts.append(without(text, seen["spans"]) if text and seen["spans"] else text)
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else t.decode() for t in texts], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(documents, cut, schema)


def without(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the normalised words of ``spans`` (flat starts and ends) and what follows each up to the next word."""
    octets = np.frombuffer(text.translate(_NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], octets.astype(np.int8), [0]))))
    starts, out, last = edges[::2], [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : starts[a]])
        last = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*out, text[last:]])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contaminated(hits: str) -> Column:
    """At least one word in twenty is hit."""
    n, hit = F.col(f"{hits}.n_words"), F.col(f"{hits}.n_hit")
    return (hit > 0) & (20 * hit >= n)
