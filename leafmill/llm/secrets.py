"""Secrets: patterns with checks, and strings that look random, in DataFrame operations only.

Two character Markov models, one of random strings and one of ordinary identifiers, are compared by their log-likelihood ratio: the sum over a string's
neighbouring characters of how much likelier the random model finds the second after the first. Both are counted over labelled samples of
all documents: random are the values that the base patterns accept; ordinary are long strings beside them that are words, each with a short number or
none, and numbers. Two thirds of the documents give the counts, the others the least ratio from which the asked precision is proven; strings that are
neither, such as keys without a name before them, are judged by it. Everything runs inside the document's row: only counts of character pairs
and of ratios are gathered, and both tables have a fixed size.

The random model is mixed with a uniform one by half, so that it allows for other alphabets than its samples have.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, proven_from, written
from leafmill.llm.pii import let, listed, matches

__all__ = ["Model", "find_secrets", "fit_on", "listed"]

UNIFORM = {1: 0.5, 0: 0.02}  # the share of the uniform model in the random and in the ordinary one
PRECISION, CERTAINTY = 0.95, 1.28  # proven by so many standard errors: 32 random strings without an ordinary one do
STEP, REACH = 0.5, 400  # ratios are counted in steps, up to so many steps either way
HELD_OUT = 3  # one document in so many, by the hash of its id

# The characters of a string, the kinds and their patterns, and what ordinary strings look like.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
MAY_HOLD = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
VALUE_CHARS = 12
STRING = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}+"
ORDINARY = r"^[._/=+-]*+(?:(?:[A-Za-z]++[0-9]{0,4}+|[0-9]{1,4}[A-Za-z]{0,2}[0-9]{0,4}|[0-9]++)(?:[._/=+-]++|$)){1,32}+$"

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _tagged(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def _base(text: Column, kind: str) -> Column:
    found = matches(text, PATTERNS[kind])
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(_value(m["value"])) >= VALUE_CHARS)
    return F.when(text.rlike(MAY_HOLD[kind]), _tagged(found, kind)).otherwise(F.array().cast(_SPAN))


def _value(assignment: Column) -> Column:
    return F.regexp_extract(assignment, PATTERNS["assign"], 2)


def _covered(span: Column, apart: Column) -> Column:
    """Whether ``span`` overlaps one of ``apart``, spans in order that do not overlap each other: the last one that starts before it ends is sought by halving."""
    halve = lambda s, _: let(F.floor((s["low"] + s["high"]) / 2).cast("int"), lambda mid: F.when(s["low"] >= s["high"], s).when(F.get(apart, mid)["start"] < span["end"], F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high"))))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(apart) + 1)).cast("int"))
    before = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(apart).alias("high")), halve, lambda s: s["low"])
    return F.when(F.size(apart) == 0, False).otherwise(let(before, lambda n: F.when(n == 0, False).otherwise(F.get(apart, n - 1)["end"] > span["start"])))


def _strings(text: Column, assigned: Column) -> Column:
    """Long strings that overlap no base span. Keys and hexadecimal runs are made of a string's characters, so they show in its own text."""
    plain = lambda m: ~m["value"].rlike(PATTERNS["hex"]) & ~m["value"].rlike(PATTERNS["access"]) & ~_covered(m, assigned)
    return F.filter(matches(text, STRING), plain)


def samples(text: Column) -> Column:
    """array of struct(value, random): labelled strings of a text, random 1 or 0."""
    labelled = lambda value, random: F.struct(value.alias("value"), F.lit(random).alias("random"))

    def of(assigned: Column) -> Column:
        values = F.transform(assigned, lambda s: labelled(_value(s["value"]), 1))
        others = F.transform(F.concat(_base(text, "access"), _base(text, "hex")), lambda s: labelled(s["value"], 1))
        plain = F.filter(_strings(text, assigned), lambda m: m["value"].rlike(ORDINARY))
        return F.concat(values, others, F.transform(plain, lambda m: labelled(m["value"], 0)))

    return let(_base(text, "assign"), of)


@dataclass
class Model:
    """The log-likelihood ratio of each pair of characters, and the least sum that counts as random; None adds nothing."""

    ratios: list[float]
    least: float | None

    def score(self, value: Column) -> Column:
        table = F.expr(f"array({', '.join(f'{r:.6f}D' for r in self.ratios)})")
        n = len(CHARACTERS)
        at = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(CHARACTERS)) - 1)
        pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a)), lambda x, y: x * n + y)
        return F.aggregate(let(at, pairs), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def _ratios(counts: dict[tuple[int, str], int]) -> list[float]:
    """log P(second | first) under the random less under the ordinary model, for every pair of characters."""
    out = []
    for first in CHARACTERS:
        row = {label: [counts.get((label, first + second), 0) for second in CHARACTERS] for label in (0, 1)}
        share = lambda label, k: UNIFORM[label] / len(CHARACTERS) + (1 - UNIFORM[label]) * ((row[label][k] + 1) / (sum(row[label]) + len(CHARACTERS)))  # noqa: B023, E731
        out += [math.log(share(1, k) / share(0, k)) for k in range(len(CHARACTERS))]
    return out


def fit_on(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Both models and the least ratio, from the labelled strings of all documents. Without strings of both kinds, or where the precision
    cannot be proven on the held-out documents, nothing is added."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("held")), F.lit(HELD_OUT)) == 0
    labelled = written(documents.select(held.alias("held"), F.explode(samples(text)).alias("s")).select("held", "s.value", "s.random"), "samples")
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    pairs = let(chars, lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.concat(x, y)))
    seen = labelled.filter("NOT held").select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {(r["random"], r["pair"]): r["count"] for r in seen}  # at most two for each pair of characters
    if {label for label, _ in counts} != {0, 1}:
        return Model([0.0] * len(CHARACTERS) ** 2, None)
    model = Model(_ratios(counts), None)
    step = F.greatest(F.least(F.floor(model.score(F.col("value")) / STEP), F.lit(REACH)), F.lit(-REACH))
    scored = labelled.filter("held").groupBy(step.cast("int").alias("step")).agg(F.sum("random").alias("random"), F.count("*").alias("n")).collect()
    # Not below even odds, however pure the samples are.
    model.least = proven_from([(r["step"] * STEP, r["random"], r["n"]) for r in scored if r["step"] >= 0], PRECISION, CERTAINTY)
    return model


def find_secrets(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``documents`` with a last column ``secrets``: struct(base, spans), each an array of struct(start, rank, end, kind, value) by
    start, then kind, in code points; ``spans`` holds the base spans and the strings of 12 characters or more beside them that look random.

    Null and empty texts have none. Repeated rows come back each, other columns pass through; if one is called ``secrets``, the new column
    gets underscores in front. Long texts and strings are read whole in little more than linear time; an empty table gives an empty one.
    """
    name = free_name(documents, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def both(assigned: Column) -> Column:
        base = F.array_sort(F.concat(assigned, _base(text, "access"), _base(text, "hex")))
        if model.least is None:
            return let(base, lambda b: F.struct(b.alias("base"), b.alias("spans")))
        random = F.filter(_strings(text, assigned), lambda m: ~m["value"].rlike(ORDINARY) & (model.score(m["value"]) >= model.least))
        return let(base, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, _tagged(random, "random"))).alias("spans")))

    return documents.withColumn(name, let(_base(text, "assign"), both))
