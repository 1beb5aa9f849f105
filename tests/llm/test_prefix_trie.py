import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import prefix_trie as pt


def _rows(seed=5, n=90):
    rng = random.Random(seed)
    texts = ["hi", "", None, "é ü", "long " * 30, "ok", "</s>"]
    rows = []
    for c in [*range(n), 1000, 1003, -5, -10]:
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn if rng.random() > 0.02 or turn else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2], rng.choice(texts[: 1 + c % 7])))
    rows += [(2000 + k, 0, "user", "copy") for k in range(40)] + [(2005, 1, "user", "copy")] * 3
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn int, role string, text string, N_convs int").repartition(5)


@pytest.mark.parametrize("shard", [200_000, 60, 1])
def test_nodes_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(pt, "SHARD_TURNS", shard)
    rows = _rows()
    # One null turn a conversation at most, so that the order is the same here and there.
    seen = set()
    rows = [r for r in rows if r[1] is not None or not (r[0] in seen or seen.add(r[0]))]
    got = pt.prefix_nodes(pt.rebuilt(pt.turn_paths(_frame(spark, rows))))
    signed = [r for r in rows if r[0] >= 0 or r[0] % 5 == 0]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute.trie(signed)


def test_deep_and_hot_paths(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_TURNS", 500)
    monkeypatch.setattr(pt, "CHUNK_IDS", 7)
    deep = [("u", f"t{k}") for k in range(1500)]
    paths = {c: deep[: 1500 - (c % 3)] for c in range(60)} | {c: deep[:2] + [("u", f"own{c}")] for c in range(100, 160)} | {500: []}
    rows = [(c, k, role, text) for c, path in paths.items() for k, (role, text) in enumerate(path)]
    got = pt.prefix_nodes(pt.turn_paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    by = {(r["depth"], r["conv_id"]): r for r in got.collect()}
    assert got.count() == 1 + 1500 + 60
    assert by[0, 0]["n_convs"] == 120 and by[0, 0]["n_leaves"] == 61 and by[2, 0]["n_children"] == 61
    assert by[1500, 0]["ends_sha256"] == brute.sha(",".join(str(c) for c in range(0, 60, 3))) and by[1499, 0]["ends_sha256"] == brute.sha(",".join(str(c) for c in range(1, 60, 3)))
    saved = lambda d: sum((len([c for c in paths if len(paths[c]) >= k and paths[c][:k] == deep[:k]]) - 1) * len(deep[k - 1][1]) for k in range(max(d, 1), 1501))
    assert by[0, 0]["saved_tokens"] == saved(0) and by[1400, 0]["saved_tokens"] == saved(1400)


def test_base_and_check(spark):
    rng = random.Random(1)
    paths = sorted({tuple(rng.randrange(40) for _ in range(rng.randint(0, 6))) for _ in range(300)} | {tuple(range(12))})
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
    base, check = pt.pack(offsets, np.array([t for p in paths for t in p], np.int64))
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert (check >= 0).sum() == len(prefixes) and len(check) < 2 * len(prefixes) + 40
    for path in prefixes:
        state = 0
        for turn in path:
            below = base[state] + turn
            assert check[below] == state
            state = below
    state = 0
    assert all(not (0 < base[state] + t < len(check)) or check[base[state] + t] == state or (t,) not in prefixes for t in range(40))


def test_rows_without_an_id_and_empty_tables(spark):
    df = _frame(spark, [(None, 0, "user", "x"), (3, None, None, None), (3, 1, "user", "y"), (3, 1, "user", "y")])
    nodes = pt.prefix_nodes(pt.turn_paths(df)).orderBy("depth").collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"]) for r in nodes] == [(3, 0, 1), (3, 1, 1), (3, 2, 1), (3, 3, 1)]
    assert pt.prefix_nodes(pt.turn_paths(df.filter(F.lit(False)))).count() == 0
    turnless = pt.prefix_nodes(spark.createDataFrame([(4, []), (9, [])], f"conv long, path {pt._PATH}")).collect()
    assert [tuple(r)[:6] for r in turnless] == [(4, 0, None, 2, 0, 1)] and turnless[0]["ends_sha256"] == brute.sha("4,9")
