import random

from pyspark.sql import functions as F

from leafmill.llm import pii


def test_addresses_in_words_are_checked(spark):
    said = {
        "jo.x (at) host (dot) com": 1.0, "jo[at]host[dot]de": 1.0, "jo (at) host.org": 1.0, "jo(at)host (dot) COM": 1.0,
        "look (at) this. Then": 0.0, "look (at) this .then": 0.0, "jo (at) -host (dot) com": 0.0, "jo (at) host- (dot) com": 0.0, "jo (at) host (dot) cOm": 0.0, "jo (at) host (dot) zzzz": None,
    }
    rows = spark.createDataFrame(list(said), "string").select("value", pii.address(F.col("value")).alias("y")).collect()
    assert {r["value"]: r["y"] for r in rows} == said


def test_addresses_in_words_are_found_and_redacted(spark):
    rows = [(k, f"please write to jo{chr(97 + k % 26)} (at) host{chr(97 + k % 7)} (dot) com for more" if k % 2 else "we could look (at) this. Then we went on") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    detector = pii.fit_on(df)
    assert "email" in detector.needed
    out = pii.find_spans(df, detector).select("doc_id", pii.redacted(F.col("text"), F.col("personal.spans")).alias("t")).collect()
    assert {r["t"] for r in out if r["doc_id"] % 2} == {"please write to [EMAIL] for more"}
    assert {r["t"] for r in out if not r["doc_id"] % 2} == {rows[0][1]}


def test_kinds_rare_in_the_sample_have_thresholds(spark):
    rows = [(k, f"call +1 ({200 + k % 700}) 555-{1000 + k} id {k:012d} card 4{k:014d}") for k in range(1500)]
    rows += [(k, f"key AKIA{k:016d} here") for k in range(1500, 1560)]
    detector = pii.fit_on(spark.createDataFrame(rows, "doc_id long, text string"), sample=60)
    assert "secret" in detector.needed


def test_labels_reach_spans_that_no_check_decides(spark):
    """Keys without a known form and phone numbers without a plus are added beside the base spans; dates and words are not."""
    rng = random.Random(4)
    chars = "0123456789abcdef"
    rows = []
    for k in range(600):
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        key = "".join(rng.choice(chars) for _ in range(40))
        rows.append((k, f"on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} +1 {phone} wrote token = '{key}' and internationalization twice, see 4{rng.randint(10**14, 10**15 - 1)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    detector = pii.fit_on(df)
    assert {"phone", "secret"} <= set(detector.needed)
    key = "".join(rng.choice(chars) for _ in range(40))
    new = spark.createDataFrame([(1, f"reach me: 1 (702) 555-0742, on 2024-03-05, internationalization, token: '{key}'")], "doc_id long, text string")
    found = pii.find_spans(new, detector).select("text", "personal").first()
    added = {(s["kind"], found["text"][s["start"] : s["end"]]) for s in found["personal"]["spans"]}
    assert added == {("phone", "1 (702) 555-0742"), ("secret", key)} and not found["personal"]["base"]
