"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Each text becomes the set of its shingles. Sets are compared by the prefix principle: with shingles in
one global order, rare ones first, two sets of similarity ``t`` share a shingle within their first
``n - ceil(t n) + 1``. Only shingles of prefixes that two different sets share are joined.

Groups of copies never become all their pairs. Equal sets are one set (its signature). In each prefix
group, every set is verified against the group's first set; sets that are thereby connected need no
further comparison. Only pairs of sets in different components are then enumerated, in blocks, and
only those that pass the length, positional and suffix filters leave the block. Each pair is verified
once, on whole sets. So no link between two components is lost, and the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ascii_words, components, discard, gram_hashes, hashes, map_arrow, octets, release, written

WORDS = 5
PERCENT = 75
CLASSES = 1 << 18  # hash classes of the frequency table: a fixed 2 MB, whatever the corpus
CHUNKS = 16
SKETCH = 256  # classes of the suffix filter
PAIRS = 200_000  # pairs that a task looks at together
BLOCK = 1024  # sets of a prefix group that are compared with as many others at a time


def shingle_set(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending; a text of fewer words is one shingle, one without words none."""
    h = hashes(ascii_words(text, lower=True))
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(n, len(h))) + np.uint64(min(n, len(h))))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


def _signatures(documents: DataFrame, n: int, seed: int) -> DataFrame:
    """Each document's set: size, two signatures and a sketch; and, once a task, what it adds to the frequency table.

    The sketch is how many shingles fall into each of ``SKETCH`` classes, at most 255. The frequency table counts the
    shingles of all documents by hash class, so it has the same size whatever the corpus.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.uint64)
        for batch in batches:
            sizes, sigs, checks, sketches = [], [], [], []
            for text in octets(batch.column(2)):
                s = shingle_set(text, n)
                raw = s.tobytes()
                np.add.at(counts, (s & np.uint64(CLASSES - 1)).astype(np.int64), np.uint64(1))
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_64_intdigest(raw, 2 * seed) if len(s) else None)
                checks.append(xxhash.xxh3_64_intdigest(raw, 2 * seed + 1) if len(s) else None)
                kinds = np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
                sketches.append(np.minimum(kinds, 255).astype(np.uint8).tobytes() if len(s) else None)
            signed = [pa.array(x, pa.uint64()).view(pa.int64()) for x in (sigs, checks)]
            nothing = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *signed, pa.array(sketches, pa.binary()), *nothing], names=names)
        if counts.any():
            parts = counts.reshape(CHUNKS, -1)
            rest = [pa.nulls(CHUNKS, kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    names = ["id", "th", "n", "sig", "chk", "sketch", "chunk", "counts"]
    return map_arrow(documents, scan, "id long, th int, n long, sig long, chk long, sketch binary, chunk int, counts binary")


def _frequencies(parts: DataFrame) -> np.ndarray:
    """How often the shingles of each hash class occur in all documents: the tasks' counts, added up chunk by chunk."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    out = np.zeros(CLASSES, np.uint64).reshape(CHUNKS, -1)
    for row in map_arrow(parts.select("chunk", "counts").repartition(CHUNKS, "chunk"), total, schema).collect():
        out[row["chunk"]] += np.frombuffer(bytes(row["counts"]), np.uint64)
    return out.ravel()


def _prefixes(documents: DataFrame, n: int, percent: int, seed: int, counts) -> DataFrame:
    """The prefix of each different set: token, set, its size, and the token's place from 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = counts.value, set()
        for batch in batches:
            tokens, sets, sizes, places = [], [], [], []
            for text in octets(batch.column(2)):
                s = shingle_set(text, n)
                if not len(s):
                    continue
                sig = xxhash.xxh3_64_intdigest(s.tobytes(), 2 * seed)
                if sig in seen:
                    continue
                seen.add(sig)
                p = prefix_length(len(s), percent)
                first = s[np.lexsort((s, often[(s & np.uint64(CLASSES - 1)).astype(np.int64)]))[:p]]
                tokens.append(first)
                sets.append(np.full(p, sig, np.uint64))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(sets).view(np.int64)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["token", "sig", "size", "place"],
                )

    return map_arrow(documents, scan, "token long, sig long, size int, place int")


def _whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """(sig, text) rows to whole sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingle_set(text, n).view(np.int64) for text in octets(batch.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *items])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["sig", "items"])

    return map_arrow(texts, scan, "sig long, items array<long>")


def _star_pairs(group: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Each prefix group's sets against its set of smallest ``rep``, where length, position and sketch allow a link.

    An overlap o of sets of a and b makes a similarity of percent if o (100 + percent) >= percent (a + b). What
    both have from the common token on bounds o, and 2 o = a + b - difference, which the sketches' distance bounds.
    """
    lead = group.groupBy("token").agg(F.min("rep").alias("lead"))
    first = group.join(lead, "token").filter("rep = lead").select(
        "token", F.col("sig").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a")
    ).distinct()
    pairs = group.join(first, "token").filter("sig <> a")
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size") - F.col("place"))
    fits = (most * (100 + percent) >= (F.col("size_a") + F.col("size")) * percent) & (F.least("size_a", "size") * 100 >= F.greatest("size_a", "size") * percent)
    pairs = pairs.filter(fits).select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b"), (F.col("size_a") + F.col("size")).alias("both")).distinct()
    one = sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("sig").alias("b"), F.col("sketch").alias("sketch_b"))
    compared = pairs.join(one, "a").join(two, "b").select("a", "b", "both", "sketch_a", "sketch_b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for k in (3, 4))
            both = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            keep = (both - apart) * (100 + percent) >= 2 * percent * both
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return map_arrow(compared, scan, "a long, b long").distinct()


def _changes(table: pa.Table) -> np.ndarray:
    """Whether the next row belongs to another pair of blocks."""
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("token", "p", "q")])
    return (keys[:, 1:] != keys[:, :-1]).any(axis=0)


def _block_pairs(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of sets in different components that pass every filter, of whole pairs of blocks laid end to end.

    Rows of a pair of blocks are put in order, those of its first block in front, so that the partners of each are neighbours; pairs are
    then numbered through and looked at ``PAIRS`` at a time.
    """
    sig, size, place, comp, own, p, q = (table.column(c).to_numpy() for c in ("sig", "size", "place", "comp", "own", "p", "q"))
    group = np.concatenate([[0], np.cumsum(_changes(table))])
    order = np.lexsort((sig, own != p, group))
    sig, comp, group, own, p, q = (x[order] for x in (sig, comp, group, own, p, q))
    size, place = size[order].astype(np.int64), place[order].astype(np.int64)
    end = np.searchsorted(group, group, "right")
    alone = p == q
    begin = np.where(alone, np.arange(len(sig)) + 1, np.searchsorted(2 * group + (own != p), 2 * group + 1, "left"))
    count = np.where(alone | (own == p), end - begin, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    sketch = None
    for start in range(0, int(done[-1]), PAIRS):
        number = np.arange(start, min(start + PAIRS, int(done[-1])))
        i = np.searchsorted(done, number, "right") - 1
        j = begin[i] + number - done[i]
        both, least = size[i] + size[j], np.minimum(size[i], size[j])
        # The overlap o satisfies o (100 + percent) >= percent (a + b), and 2 o = a + b - difference.
        fits = (comp[i] != comp[j]) & (sig[i] != sig[j]) & (least * 100 >= (both - least) * percent)
        fits &= np.minimum(size[i] - place[i], size[j] - place[j]) * (100 + percent) >= percent * both
        i, j, both = i[fits], j[fits], both[fits]
        if not len(i):
            continue
        if sketch is None:
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(sig), SKETCH)[order].astype(np.int16)
        apart = np.concatenate([np.abs(sketch[i[k : k + 4096]] - sketch[j[k : k + 4096]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 4096)])
        keep = (both - apart) * (100 + percent) >= 2 * percent * both
        found = np.unique(np.stack((np.minimum(sig[i], sig[j])[keep], np.maximum(sig[i], sig[j])[keep]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def _cross_pairs(group: DataFrame, percent: int) -> DataFrame:
    """Pairs of a prefix group's sets in different components that pass every filter, found in blocks.

    ``group``: token, sig, size, place, comp, sketch, n (sets in the group). A set meets each block of its group
    once, so a large group is spread over as many tasks as it has pairs of blocks.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    dealt = (
        group.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "sig", "size", "place", "comp", "sketch")
        .repartition("token", "p", "q")
        .sortWithinPartitions("token", "p", "q")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            ends = np.flatnonzero(_changes(table))
            last = int(ends[-1]) + 1 if len(ends) else 0
            rest = table.slice(last)
            if last:
                yield from _block_pairs(table.slice(0, last), percent)
        if rest is not None and rest.num_rows:
            yield from _block_pairs(rest, percent)

    return map_arrow(dealt, scan, "a long, b long").distinct()


def _verified(pairs: DataFrame, source: DataFrame, owners: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; each pair is looked at once.

    ``owners`` (sig, id, th) names a document of each set; only the sets of these pairs are made.
    """
    pairs = written(pairs, "pairs")
    release(source.sparkSession)
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    texts = source.join(owners.join(wanted, "sig"), ["id", "th"]).select("sig", "text")
    sets = written(_whole_sets(texts, n), "whole-sets")
    release(source.sparkSession)
    one = sets.select(F.col("sig").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("sig").alias("b"), F.col("items").alias("items_b"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    total = F.size("items_a") + F.size("items_b") - F.col("common")
    links = written(joined.filter(F.col("common") * 100 >= total * percent).select("a", "b").distinct(), "links")
    discard(pairs, sets)
    release(source.sparkSession)
    return links


def similar_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: id, n_shingles, component_id (the smallest id reachable by links).

    Two texts link if their sets of ``n``-word shingles (A-Z lower-cased) have a Jaccard similarity of at least
    ``percent`` per cent. Null, empty and blank texts have an empty set, link with nothing and are their
    own component; a shorter text is one shingle. Repeated rows come back each, in the component
    of their text; rows of one id with different texts link only by their texts. A row without an id takes no part and
    has a null component. Other columns are ignored; an empty table gives an empty one.
    """
    spark: SparkSession = documents.sparkSession
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    seed = 0
    while True:
        signed = written(_signatures(source, n, seed), "signatures")
        frequent, signed = signed.filter("chunk is not null"), signed.filter("chunk is null").drop("chunk", "counts")
        known = signed.filter("sig is not null and id is not null")
        reps = written(known.groupBy("sig").agg(F.min("id").alias("rep"), F.min("chk").alias("lo"), F.max("chk").alias("hi")), "sets")
        if reps.filter("lo <> hi").isEmpty():
            break
        seed += 1  # two different sets had one signature
    reps = reps.select("sig", "rep")
    counts = spark.sparkContext.broadcast(_frequencies(frequent))
    prefixes = written(_prefixes(source.filter("id is not null"), n, percent, seed, counts), "prefixes")
    shared = prefixes.groupBy("token").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo < hi").select("token")
    shared = written(shared, "tokens")
    release(spark)
    group = written(prefixes.join(shared, "token").distinct().join(reps, "sig"), "groups")
    discard(prefixes, shared)
    release(spark)
    owners = known.join(group.select("sig", "rep").distinct(), "sig").filter("id = rep").groupBy("sig", "id").agg(F.min("th").alias("th"), F.min("sketch").alias("sketch"))
    owners = written(owners, "owners")
    sketches, owners = owners.select("sig", "sketch"), owners.select("sig", "id", "th")

    links = _verified(_star_pairs(group, sketches, percent), source, owners, n, percent)
    comps = components(links).withColumnsRenamed({"node": "sig", "root": "comp"})
    labelled = written(group.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "labelled")
    discard(group)
    mixed = labelled.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    crossing = labelled.join(mixed.select("token", "n"), "token").join(sketches, "sig")
    links = links.unionByName(_verified(_cross_pairs(crossing, percent), source, owners, n, percent))

    one = reps.withColumnsRenamed({"sig": "a", "rep": "rep_a"})
    two = reps.withColumnsRenamed({"sig": "b", "rep": "rep_b"})
    edges = links.join(one, "a").join(two, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    roots = components(edges).withColumnsRenamed({"node": "rep"})
    classes = reps.join(roots, "rep", "left").select("sig", F.coalesce("root", "rep").alias("class"))
    out = signed.join(classes, "sig", "left")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), mine.alias("component_id"))
