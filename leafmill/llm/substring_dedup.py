"""Substring deduplication: suffix automata of reference shards, and matching statistics of what is streamed through.

A window is ``WINDOW`` consecutive words. A word goes if some window over it also starts in a document
with a smaller id. Broadcasting an automaton of every shard of the corpus to every task would cost shards
times corpus, so texts meet only the shard that can match them:

1. Every window has an anchor, its least hashed run of ``ANCHOR`` words, the same wherever the window stands.
   The windows around one occurrence of it make a passage of at most 20 words, kept as a hash of 64 bits beside its anchor's.
   Anchors of one document only are dropped by an aggregate with partial sums.
2. Equal passages are one reference with their smallest id, so a hot group of copies is one row. Words are
   fetched only for anchors with several different passages, once for each, from the document that has it first.
3. A shard is a run of anchors of bounded size. Its automaton knows for each state the smallest id
   of the passages it occurs in; the passages stream through it, and wherever the match is long enough the state of
   the last ``WINDOW`` words gives the smallest id that has that window. An anchor with very many different
   passages is not one task's: its windows are grouped each by itself.
4. The windows found go back to their documents; maximal spans of covered words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.common import arrow_rows, ascii_words, free_name, gram_hashes, hashes, map_arrow, release, written
from leafmill.llm.decontamination import SuffixAutomaton

WINDOW = 13
ANCHOR = 6
SHARD_WORDS = 20_000
HOT = 5_000  # different passages of an anchor from which its windows are grouped each by itself


def anchored(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, and the first and last window of each run of windows with that anchor occurrence."""
    none = np.empty(0, np.int64)
    if len(h) < window:
        return np.empty(0, np.uint64), none, none
    grams = gram_hashes(h, min(ANCHOR, window))
    wide = window - min(ANCHOR, window) + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(grams) - wide + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return grams[place[first]], first, last


def _text_hash(text_col: str) -> Column:
    """Tells apart different texts that share an id."""
    return F.hash(F.col(text_col).cast("string"))


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _occurrences(documents: DataFrame, window: int) -> DataFrame:
    """Each anchor occurrence of each document: the hash of its passage, and where its ``more + 1`` windows start."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for doc, key, text in arrow_rows(batch, "id", "th", "text"):
                words = ascii_words(text)
                anchors, first, last = anchored(hashes(words), window)
                if not len(anchors):
                    continue
                passages = (b" ".join(words[i : j + window]) for i, j in zip(first.tolist(), last.tolist(), strict=True))
                parts.append((anchors, hashes(passages, len(anchors)), np.full(len(anchors), doc, np.int64), np.full(len(anchors), key, np.int32), first.astype(np.int32), (last - first).astype(np.int8)))
            if parts:
                anchors, owns, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([_signed(anchors), _signed(owns), *map(pa.array, rest)], names=["anchor", "own", "id", "th", "start", "more"])

    return map_arrow(documents, scan, "anchor long, own long, id long, th int, start int, more byte")


def _passages(documents: DataFrame, window: int) -> DataFrame:
    """The words of the wanted passages, by (anchor, own), of each document: ``wanted`` has the starts and lengths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in arrow_rows(batch, "text", "wanted"):
                words = ascii_words(text)
                rows.extend((w["anchor"], w["own"], w["least"], b" ".join(words[w["start"] : w["start"] + w["more"] + window])) for w in wanted)
            if rows:
                anchors, owns, least, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors, pa.int64()), pa.array(owns, pa.int64()), pa.array(least, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["anchor", "own", "least", "passage"],
                )

    return map_arrow(documents, scan, "anchor long, own long, least long, passage string")


class Shard:
    """The automaton of some passages; each state knows the smallest id among the passages it occurs in."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], window: int) -> None:
        codes: dict[bytes, int] = {}
        self.window = window
        self.coded = [(doc, [codes.setdefault(w, len(codes)) for w in words]) for doc, words in passages]
        self.machine = machine = SuffixAutomaton()
        for _, tokens in self.coded:
            machine.add(tokens)
        self.least = least = [None] * len(machine.step)
        for doc, tokens in self.coded:
            for state, _ in machine.matches(tokens):
                if least[state] is None or doc < least[state]:
                    least[state] = doc
        for state in sorted(range(1, len(machine.step)), key=machine.longest.__getitem__, reverse=True):
            up = machine.link[state]
            if least[up] is None or least[state] < least[up]:
                least[up] = least[state]

    def owners(self, tokens: list[int]) -> list[int]:
        """For each window of the tokens, the smallest id that has it."""
        return [self.least[self.machine.holding(state, self.window)] for state, length in self.machine.matches(tokens) if length >= self.window]


def _owners(passages: DataFrame, window: int) -> DataFrame:
    """For each different passage, the smallest id of each of its windows, from the automaton of its shard."""

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        shard = Shard([(least, text.split(b" ")) for _, _, least, text in rows], window)
        mins = [shard.owners(tokens) for _, tokens in shard.coded]
        anchors, owns, *_ = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(owns, pa.int64()), pa.array(mins, pa.list_(pa.int64()))], names=["anchor", "own", "mins"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in arrow_rows(batch, "anchor", "own", "least", "passage"):
                if len(rows) * window >= SHARD_WORDS and row[0] != rows[-1][0]:
                    yield answer(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield answer(rows)

    return map_arrow(passages.repartition("anchor").sortWithinPartitions("anchor"), scan, "anchor long, own long, mins array<long>")


def _window_owners(passages: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many different passages: each window goes its own way, so no task gets them all."""
    words = F.split("passage", " ")
    starts = F.sequence(F.lit(1), F.size(words) - window + 1)
    cut = passages.select("anchor", "own", "least", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice(words, k, window), " "))).alias("k", "w"))
    least = cut.groupBy("w").agg(F.min("least").alias("m"))
    per = cut.join(least, "w").groupBy("anchor", "own").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("all"))
    return per.select("anchor", "own", F.col("all.m").alias("mins"))


def repeated_windows(documents: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id, th, starts): the windows of each (id, text hash) that also start in a document with a smaller id."""
    spark = documents.sparkSession
    known = documents.filter("id is not null and text is not null")
    every = _occurrences(known, window)
    shared = every.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("anchor")
    shared = written(shared, "anchors")
    release(spark)
    every = written(every.join(shared, "anchor"), "occurrences")
    release(spark)
    # Equal passages are one reference, that of the smallest id. A passage alone on its anchor can match only itself.
    distinct = written(every.groupBy("anchor", "own").agg(F.min("id").alias("least"), F.count("*").alias("n")), "passages")
    release(spark)
    variants = written(distinct.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1"), "variants")
    first = every.join(distinct.join(variants, "anchor"), ["anchor", "own"]).filter("id = least")
    first = first.groupBy("anchor", "own", "variants").agg(F.min(F.struct("id", "th", "start", "more")).alias("at"))
    wanted = first.groupBy("at.id", "at.th").agg(
        F.collect_list(F.struct("anchor", "own", F.col("at.id").alias("least"), "at.start", F.col("at.more").cast("int").alias("more"))).alias("wanted")
    )
    wanted = written(wanted, "wanted")
    release(spark)
    texts = written(_passages(known.join(wanted, ["id", "th"]), window).join(variants, "anchor"), "references")
    release(spark)
    owners = _owners(texts.filter(F.col("variants") < hot).drop("variants"), window)
    owners = owners.unionByName(_window_owners(texts.filter(F.col("variants") >= hot).drop("variants"), window))
    owners = written(owners, "owners")
    release(spark)
    owners = written(distinct.join(owners, ["anchor", "own"], "left"), "answers")
    release(spark)
    found = _answered(every, owners)
    windows = F.sequence(F.lit(0), F.col("more").cast("int"))
    repeated = F.filter(windows, lambda k: F.coalesce(F.element_at("mins", k + 1), F.col("least")) < F.col("id"))
    found = found.withColumn("repeated", F.when(F.col("mins").isNull() & (F.col("least") < F.col("id")), windows).when(F.col("mins").isNotNull(), repeated))
    starts = F.transform("repeated", lambda k: k + F.col("start"))
    gone = found.filter(F.size("repeated") > 0).groupBy("id", "th").agg(F.flatten(F.collect_list(starts)).alias("starts"))
    gone = written(gone, "windows")
    release(spark)
    return gone


def _answered(every: DataFrame, owners: DataFrame) -> DataFrame:
    """Each occurrence with its passage's answer. Passages with more than a quarter of a task's share of all occurrences, at most four a task,
    are answered by a broadcast, so their occurrences stay where they are."""
    keys = ["anchor", "own"]
    total, most = owners.agg(F.sum("n"), F.max("n")).first()
    share = (total or 0) / (4 * int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if (most or 0) <= share:
        return every.join(owners.drop("n"), keys)
    hot = F.broadcast(owners.filter(F.col("n") > share).drop("n"))
    return every.join(hot, keys).unionByName(every.join(hot, keys, "left_anti").join(owners.filter(F.col("n") <= share).drop("n"), keys))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``documents`` with a last column ``repeats``: struct(n_words, n_removed, kept).

    Words are runs without ASCII white space. ``kept`` holds the words that stay, joined by one space.
    Windows are judged on the input, not on what is left. Null, empty and short texts lose nothing
    (a null text has no words and kept is empty). Rows of one id are one document as far as "smaller id" goes:
    repeated rows each come back with the same result. Rows without an id lose nothing and remove nothing. Other columns pass
    through; if one is called ``repeats``, the new column gets underscores in front. Very long texts are
    whole; an empty table gives an empty one.
    """
    plain = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = repeated_windows(plain.withColumn("th", _text_hash("text")), window)
    name, th, starts = free_name(documents, "repeats"), free_name(documents, "th"), free_name(documents, "starts")
    gone = gone.select(F.col("id").alias(f"{th}_id"), F.col("th").alias(f"{th}_of"), F.col("starts").alias(starts))
    keyed = documents.withColumn(th, _text_hash(text_col))
    same = (F.col(id_col).cast("long") == F.col(f"{th}_id")) & (F.col(th) == F.col(f"{th}_of"))
    joined = keyed.join(gone, same, "left").drop(th, f"{th}_id", f"{th}_of")
    return _cut(joined, documents.columns, text_col, starts, name, window)


def _cut(joined: DataFrame, names: list[str], text_col: str, starts: str, name: str, window: int) -> DataFrame:
    kind = "struct<n_words:bigint,n_removed:bigint,kept:string>"
    schema = StructType([f for f in joined.schema.fields if f.name != starts]).add(name, StructType.fromDDL(f"r {kind}")["r"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, windows in arrow_rows(batch, text_col, starts):
                words = ascii_words(text)
                sizes.append(len(words))
                if windows:
                    delta = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.asarray(windows, np.int64))
                    delta[at] += 1
                    delta[at + window] -= 1
                    stays = np.cumsum(delta[:-1]) == 0
                    removed.append(int(len(words) - stays.sum()))
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            out = pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_words", "n_removed", "kept"]
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), out], names=[*names, name])

    return map_arrow(joined, scan, schema)
