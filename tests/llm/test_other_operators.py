import gzip
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import boosting, chat, hamming_index, html_text, warc
from leafmill.session import scratch_path


def test_nearest_reaches_the_recall_and_is_exact_on_small_tables(spark):
    rng = np.random.default_rng(1)
    vectors = {k: rng.normal(size=16).astype(np.float32).tolist() for k in range(600)}
    for k in range(100, 160):
        vectors[k] = vectors[100]
    for k in range(300, 340):
        vectors[k] = (np.array(vectors[300]) + rng.normal(size=16) * 1e-3).astype(np.float32).tolist()
    rows = [*vectors.items(), (7, vectors[7]), (900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [None] * 16), (None, vectors[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in hamming_index.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute.nearest(vectors)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]


def test_nearest_with_few_or_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -1.0]), (50, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    rows = hamming_index.nearest(few, F.col("id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(rows)] == [(0, 1, 1), (0, 2, 2)]
    assert hamming_index.nearest(few.limit(0), F.col("id") % 50 == 0).count() == 0


def _record(k, payload, to=None):
    import hashlib

    return warc.record_of(k, "http://x/é\r\ny", payload, hashlib.sha256(payload).hexdigest(), to)


def test_salvage_goes_on_after_damage():
    records = [_record(k, f"payload {k} ".encode() * 30) for k in range(6)]
    members = [gzip.compress(r) for r in records]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    wrong = records[4].replace(b"payload 4 payload", b"payload 5 payload", 1)
    data = members[0] + bytes(broken) + members[2] + members[3][:-30] + b"junk" + records[5] + wrong + records[0]
    found = list(warc.salvage(data))
    assert [x[2]["record_id"] for x in found if isinstance(x[2], dict)] == [f"<urn:page:{k}>" for k in (0, 2, 5, 0)]
    assert [x[0] for x in found] == [0, *(x[1] for x in found[:-1])] and found[-1][1] == len(data)
    assert sum(isinstance(x[2], str) for x in found) == 3
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"nothing"))[0][:2] == (0, 7)


def test_archives_round_trip(spark):
    big = "<p>é</p>" * 50
    rows = [(5, "u", big), (3, "u", big), (9, "u", big), (4, None, "x"), (2, "u", "x"), (6, "u", None), (7, "u\r\nz", ""), (8, "u", "y" * 3_000_000), (10, "u", "WARC/1.1\r\n\r\n\r\n\x1f\x8b\x08" * 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    assert got == brute.archives([(a, c) for a, _, c in rows])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damaged_files_are_read_and_gaps_reported(spark):
    folder = scratch_path(spark, "warc")
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 100) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    name = warc.write_archives(pages, folder).first()["path"]
    path = f"{folder.removeprefix('file://')}/{name}"
    with open(path, "r+b") as f:
        f.seek(1000)
        f.write(b"\0" * 20)
    rows = warc.read_archives(spark, folder, payloads=True).collect()
    good = [r for r in rows if r["gap"] is None]
    assert 45 <= len(good) < 50 and sum(r["gap"] is not None for r in rows) == 1
    assert all(bytes(r["payload"]).startswith(b"<p>") for r in good)


def _read(formatted):
    read = formatted.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    return {(r["conv"], r["branch"]): ([tuple(t) for t in r["turns"]], r["loss"]) for r in read.collect()}


def test_plain_conversations_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<s>[INST] user [/INST]\n", "é🙂\n\n", "", None, "<", "[/", "a\\</s>"]
    rows = [(c, t, ("user", "assistant", "system", None, "x [/INST]\n")[(c + t) % 5], nasty[(c * 3 + t) % len(nasty)]) for c in range(6) for t in range(11)]
    df = spark.createDataFrame([*rows, (0, 0, "user", "again"), (None, 1, "assistant", "lost")], "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    got = _read(chat.format_branches(chat.as_messages(df)))
    assert set(k[0] for k in got) == {"", *map(str, range(6))}
    for c in range(1, 6):
        turns = [(r or "", x or "") for cc, _, r, x in sorted(rows, key=lambda r: r[:2]) if cc == c]
        assert got[str(c), 1] == (turns, "".join(x for r, x in turns if r == "assistant"))
    assert len(got["0", 1][0]) == 12
    assert chat.format_branches(chat.as_messages(df.limit(0))).count() == 0


def test_reply_trees_rank_their_branches(spark):
    rows = [("c", 1, None, 0.0), ("c", 2, 1, 1.0), ("c", 3, 1, 5.0), ("c", 4, 3, 0.0), ("c", 5, 2, 9.0), ("c", 6, 2, 9.0), ("c", 7, 99, 1.0), ("c", 8, 9, 1.0), ("c", 9, 8, 1.0)]
    rows += [("d", k, k - 1, 0.0) for k in range(1, 100)]
    df = spark.createDataFrame([(c, n, p, "user", str(n), s) for c, n, p, s in rows], "conv string, node long, parent long, role string, text string, score double")
    best = _read(chat.format_branches(df, best=None))
    paths = {k: [int(t[1]) for t in v[0]] for k, v in best.items()}
    assert paths == {("c", 1): [1, 2, 5], ("c", 2): [1, 2, 6], ("c", 3): [1, 3, 4], ("c", 4): [7], ("d", 1): list(range(1, 100))}
    assert set(_read(chat.format_branches(df, best=1))) == {("c", 1), ("d", 1)}


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = boosting.boost(x[:1500], y[:1500])
    assert np.mean((trees.score(x[1500:]) > 0) == (y[1500:] > 0)) > 0.95
    assert len(boosting.boost(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((4, 3)))) == 4


def test_page_blocks_and_references():
    page = html_text.Page("<p>a &amp;\n b<b>c</b><p>d<br>e<script>x('</p>')</script><style>y</style><!-- z --><ul><li>f<li>g</ul>&#233;&copy <div hidden>no</div><div>h</div")
    assert [t for _, t in page.blocks] == ["a & bc", "d", "e", "f", "g", "é©", "h"] or [t for _, t in page.blocks][:6] == ["a & bc", "d", "e", "f", "g", "é©"]
    assert html_text.Page("").blocks == [] and html_text.Page("<" * 50).blocks


def test_decoding_never_keeps_a_node_in_a_dropped_one():
    page = html_text.Page("<div><div><p>a</p><p>b</p></div></div><div><p>c</p></div>")
    rng = random.Random(1)
    for _ in range(50):
        odds = np.array([rng.uniform(-3, 3) for _ in page.tag])
        kept = page.decode((-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist())
        assert all(kept[page.parent[k]] for k in range(1, len(kept)) if kept[k])


def test_main_text_of_other_layouts(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 80))).capitalize() + "."
    rows, truth = [], {}
    for k in range(150):
        texts = [prose() for _ in range(rng.randint(2, 12))]
        body = "".join(f"<p>{t}</p>" for t in texts)
        top, end = f'<nav><a href="/">{prose()[:20]}</a></nav><div class="ad">{prose()}</div>', f"<footer>{prose()}</footer>"
        if k < 100:
            rows.append((k, "u", f"<html><body>{top}<article>{body}</article>{end}</body></html>"))
        else:
            comments = "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(3))
            rows.append((k, "u", f'<html><body>{top}<div class="post-content">{body}</div><section class="comments">{comments}</section>{end}</body></html>'))
        truth[k] = "\n".join(texts)
    rows += [(500, "u", None), (501, None, ""), (502, "u", "<p>"), (0, "u", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    out = html_text.extract(pages, html_text.fit_on(pages)).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and got[500] == got[501] == got[502] == ""
    assert sum(got[k] == truth[k] for k in range(100)) >= 98
    assert sum(got[k] == truth[k] for k in range(100, 150)) >= 45
    assert html_text.extract(pages.limit(0), html_text.fit_on(pages.limit(0))).count() == 0
