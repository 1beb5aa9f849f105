"""Personal data: patterns with checks, and boosted trees over wider candidates, in DataFrame operations only.

Base spans match a kind's pattern and pass its check. High-recall generators propose further, overlapping spans: groups of
digits, addresses in words, long mixed tokens. Gradient-boosted trees (Spark ML) on the format and context of candidates are fitted on a
bounded sample. Labels come from what stands around a candidate, and the trees do not see that: a token that is assigned to a name such as
``password`` is a secret, words and numbers are none; digits that a base span holds are personal without their plus sign, digits that a check refuses,
dates and parts of longer strings are not. So what the labels do not reach, a key without a name or a phone number without a plus, is judged by its
format. On the labelled candidates of all documents that the trees were not fitted on, the threshold of each kind is the lowest score from which the
asked precision is proven; without such a score nothing is added. Everything runs inside the document's row: text is neither shuffled nor sent to Python.

The patterns are written with possessive quantifiers and look-behinds, so that they take linear time and constant stack on any text;
they match exactly what the contract's patterns match from left to right.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import first_by_hash, free_name, proven_from, written

SAMPLE = 3_000  # documents with digits that the trees are fitted on, at most
TREES, DEPTH = 8, 3
PRECISION, CERTAINTY = 0.95, 1.28  # proven by so many standard errors: 32 candidates without a miss do
KINDS = ("email", "ip", "card", "phone", "secret")

# The kinds' patterns, what must be there to look for them, and words that announce personal data.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HOLD = r"[0-9]|\(at\)|\[at\]"  # what a text with candidates has
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
GENERATORS = {
    "digits": r"(?<![0-9])[0-9][0-9\x20().-]{5,24}[0-9](?![0-9])",
    "words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}",
    "token": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,128}(?![A-Za-z0-9_+/-])",
}
# An address in words: what stands for its signs, and what its host must look like. Top-level domains: any country's two letters, or one of these.
AT, DOT = r" ?(?:\(at\)|\[at\]) ?", r" ?(?:\(dot\)|\[dot\]) ?"
HOST = r"^(?!-)[A-Za-z0-9-]+(?<!-)(\.(?!-)[A-Za-z0-9-]+(?<!-))*\.([a-z]{2,24}|[A-Z]{2,24})$"
TOP = r"(?i)\.([a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|app|dev|cloud|online|site|tech|test|example|invalid)$"
LED = r"(?i)(?:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?$"  # what stands before a labelled secret
DATE = r"^(?:[12][0-9]{3}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][12][0-9]{3})(?![0-9])|^[12][0-9]{3}[ -]+[12][0-9]{3}$"
KEY_FORMS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[0-9A-Za-z-]{10,})$"
CUES = {"call": r"(?i)(tel|phone|call|mobile|fax)[^\n]{0,12}$", "pay": r"(?i)(card|visa|iban|account|credit)[^\n]{0,12}$", "secret": r"(?i)(password|passwd|pwd|token|secret|key|api)[^\n]{0,6}$", "mail": r"(?i)(mail|contact|write)[^\n]{0,12}$"}

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """Every match, left to right: array of struct(start, end, value) in code points, end exclusive.

    The text between matches and the matches are laid end to end. Positions are added up in blocks, so a text of very many
    matches takes little more than linear time.
    """
    block = 256
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(pairs: Column) -> Column:
        def add(state: Column, pair: Column) -> Column:
            start = state["at"] + pair["gap"]
            end = start + F.length(pair["value"])
            return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("out"))

        def add_block(state: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(pairs, k * block + 1, block), F.struct(state["at"].alias("at"), empty.alias("out")), add)
            return let(inner, lambda s: F.struct(s["at"].alias("at"), F.array_append(state["out"], s["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int")), start, add_block, lambda s: s["out"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def paired(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        return let(F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))), placed)

    return let(found, lambda values: F.when(F.size(values) > 0, paired(values)).otherwise(empty))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right counts twice, with its digits added."""
    n = F.length(number)
    worth = lambda i: let(F.substring(number, n - i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda s: F.when(F.length(s) <= 3, s.cast("int") <= 255).otherwise(False))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _tagged(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def _sound(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: passes(kind, m["value"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind: array of struct(start, rank, end, kind, value)."""
    none = F.array().cast(_SPAN)
    parts = []
    for kind, pattern in PATTERNS.items():
        there = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        if kind == "ip":
            there = there & text.rlike(r"[0-9]\.[0-9]")
        parts.append(F.when(there, _tagged(_sound(matches(text, pattern), kind), kind)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def address(value: Column) -> Column:
    """1 if a candidate in words, its signs written out, is an address of the base form under a known top-level domain; 0 if it has no
    valid domain (a white space beside a plain dot is a sentence's end); else null."""

    def judged(plain: Column) -> Column:
        valid = F.element_at(F.split(plain, "@"), -1).rlike(HOST)
        return F.when(~valid, 0.0).when(plain.rlike(f"^(?:{PATTERNS['email']})$") & plain.rlike(TOP), 1.0)

    return let(F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, "."), judged)


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _kind_of(generator: str, value: Column) -> Column:
    if generator == "digits":
        return F.when(F.length(digits(value)) >= 12, "card").otherwise("phone")
    return F.lit({"words": "email", "token": "secret"}[generator])


def candidates(text: Column, base: Column) -> Column:
    """What the generators propose: array of struct(start, end, kind, x, personal), x being the features of the span and its context,
    personal 1 or 0 where its label is known, else null."""
    kind = "array<struct<start:int,end:int,kind:string,x:array<double>,personal:double>>"

    def described(generator: str, m: Column) -> Column:
        value = m["value"]
        share = lambda cls: F.regexp_count(value, F.lit(cls)) / F.length(value)
        before = F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
        after = F.substring(text, m["end"] + 1, F.lit(1))
        yes = lambda c: F.when(c, 1.0).otherwise(0.0)
        number = digits(value)
        groups = F.regexp_count(value, F.lit("[0-9]+"))
        unseen = lambda c: F.lit(0.0) if generator == "token" else yes(c)  # what labels tokens is hidden from the trees
        row = lambda b, a: F.array(
            F.length(value).cast("double"), share("[0-9]"), share("[A-Z]"), share("[a-z]"), groups.cast("double"),
            F.length(number).cast("double"), F.regexp_count(value, F.lit("[().]")).cast("double"), F.regexp_count(value, F.lit("[ -]")).cast("double"),
            F.size(F.array_distinct(F.split(value, ""))) / F.length(value), yes(b.rlike(r"[A-Za-z0-9]$")), unseen(b.rlike(r"[\"'=:]\s?$")), yes(a.rlike(r"[A-Za-z0-9@]")),
            *(unseen(b.rlike(cue)) if name == "secret" else yes(b.rlike(cue)) for name, cue in CUES.items()), *(F.lit(float(g == generator)) for g in GENERATORS),
        )

        def judged(b: Column, a: Column) -> Column:
            if generator == "token":
                mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
                return F.when(value.rlike(KEY_FORMS) | (mixed & b.rlike(LED)), 1.0).when(~mixed, 0.0)
            if generator == "words":
                return address(value)
            of = _kind_of(generator, value)
            refused = F.length(number).between(12, 19) & ~F.when(F.length(number).between(12, 19), luhn(number)).otherwise(True)
            apart = b.rlike(r"[A-Za-z0-9]$") | a.rlike(r"^[A-Za-z0-9@]")
            return F.when(_overlaps(m, F.filter(base, lambda s: s["kind"] == of)), 1.0).when(refused | apart | (F.length(number) < 7) | value.rlike(DATE), 0.0)

        both = let(before, lambda b: let(after, lambda a: F.struct(row(b, a).alias("x"), judged(b, a).alias("personal"))))
        return let(both, lambda r: F.struct(m["start"].alias("start"), m["end"].alias("end"), _kind_of(generator, value).alias("kind"), r["x"].alias("x"), r["personal"].alias("personal")))

    def proposed(generator: str, pattern: str) -> Column:
        return F.transform(matches(text, pattern), lambda m: described(generator, m))

    parts = [proposed(*item) for item in GENERATORS.items()]
    return F.when(text.rlike(MAY_HOLD), F.concat(*parts)).otherwise(F.array().cast(kind))


@dataclass
class Detector:
    """Trees as nested conditions over a features array, and the score each kind needs."""

    trees: list[tuple[float, object]] = field(default_factory=list)
    needed: dict[str, float] = field(default_factory=dict)

    def score(self, x: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, cut, left, right = node
            return F.when(F.get(x, F.lit(at)) <= cut, value(left)).otherwise(value(right))

        return sum((F.lit(weight) * value(root) for weight, root in self.trees), F.lit(0.0))

    def accepted(self, found: Column, base: Column) -> Column:
        """The candidates beside the base spans that score high enough for their kind, as spans."""
        none = F.array().cast(_SPAN)
        if not self.trees or not self.needed:
            return none
        fits = lambda c: F.exists(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("from")) for k, v in self.needed.items())), lambda t: (t["kind"] == c["kind"]) & (self.score(c["x"]) >= t["from"]))
        chosen = F.filter(found, lambda c: ~_overlaps(c, base) & fits(c))
        rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1
        return F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), F.lit("").alias("value")))


_LINE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)|Predict: ([-0-9.Ee]+)")


def _parsed(debug: str):
    """A tree's printed form as nested (feature, cut, left, right) or a value."""
    lines = iter([m for line in debug.splitlines() if (m := _LINE.search(line))])

    def node():
        m = next(lines)
        if m[5] is not None:
            return float(m[5])
        left = node()
        next(lines)  # Else
        return int(m[2]), float(m[4]), left, node()

    return node()


def fit_on(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Detector:
    """Trees from two thirds of at most ``sample`` documents that may hold candidates, the first by the hash of their id. Thresholds from the
    labelled candidates of all other documents, counted by kind and score, so that a kind that is rare in the sample has its own.

    If no candidate was accepted or none refused there is nothing to learn, and the detector adds nothing.
    """
    text = F.col(text_col).cast("string").alias("text")
    some = documents.select(F.col(id_col).alias("id"), text).filter(F.col("text").rlike(MAY_HOLD))

    def checked(rows: DataFrame) -> DataFrame:
        based = rows.select(F.xxhash64("id").alias("h"), "text", base_spans(F.col("text")).alias("base"))
        return based.select("h", F.explode(candidates(F.col("text"), F.col("base"))).alias("c")).filter("c.personal is not null").select("h", "c.kind", "c.x", F.col("c.personal").alias("label"))

    chosen = written(checked(first_by_hash(some, "id", sample)), "candidates")
    last = some.select(F.xxhash64("id").alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    learn = chosen.filter("pmod(h, 3) <> 0")
    if learn.select("label").distinct().count() < 2:
        return Detector()
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(learn.withColumn("v", array_to_vector("x")))
    detector = Detector([(float(w), _parsed(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)])
    h = F.xxhash64("id")
    held = checked(some.filter((h > last) | (F.pmod(h, F.lit(3)) == 0)))
    scored = held.select("kind", "label", detector.score(F.col("x")).alias("s")).groupBy("kind", "s").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()
    for kind in KINDS:
        least = proven_from([(r["s"], r["yes"], r["n"]) for r in scored if r["kind"] == kind], PRECISION, CERTAINTY)
        if least is not None:
            detector.needed[kind] = least
    return detector


def find_spans(documents: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """Every row of ``documents`` with a last column ``personal``: struct(base, spans), each an array of struct(start, rank, end, kind, value)
    by start, then kind; ``spans`` holds the base spans and what the detector adds.

    Null and empty texts have none. Repeated rows come back each, other columns pass through; if one is called ``personal``, the
    new column gets underscores in front. Very long texts are read whole; an empty table gives an empty one.
    """
    name = free_name(documents, "personal")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, detector.accepted(candidates(text, base), base))).alias("spans"))
    return documents.withColumn(name, let(base_spans(text), both))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        lead = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(apart, F.concat(state["out"], lead, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
