"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = sigmoid(score - threshold_k) with one weight vector for all grades and ascending thresholds. Features are
the distinct words of a text and what it has of each shape (upper case, runs of marks, repeated words), in steps, all
hashed into one table. The model is fitted on a bounded sample of rated documents, chosen by the hash of their id; every
document is scored, in whole, where it is read, so nothing but the sample and the weights moves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.common import arrow_rows, free_name, map_arrow, octets

BUCKETS = 1 << 18
SAMPLE = 12_000  # rated documents that the model is fitted on, at most
EPOCHS = 12
LEAST_STEPS = 1_500  # a small sample is gone through more often
KEEP_AT = 0.5  # documents stay from this probability of the wanted grade

_PARTS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def features(text: bytes | None) -> np.ndarray:
    """Hashed, distinct features of a whole text; the last bucket is the constant of empty texts."""
    parts = _PARTS.findall(text or b"")
    if not parts:
        return np.array([BUCKETS - 1], np.int32)
    lower = [p.lower() for p in parts]
    kinds = set(lower)
    n = len(parts)
    marks = [p for p in parts if not (p[0] >= 0x80 or p[:1].isalnum())]
    steps = {
        "marks": len(marks) / n,
        "doubled": sum(len(p) > 1 for p in marks) / n,
        "upper": sum(p.isupper() and len(p) > 1 for p in parts) / n,
        "digits": sum(p.isdigit() for p in parts) / n,
        "same": 1 - len(kinds) / n,
        "length": math.log2(1 + n) / 20,
    }
    lines = text.split(b"\n")
    steps["lines"] = 1 - len(set(lines)) / len(lines)
    shapes = {b"\0%s %d" % (name.encode(), round(20 * share)) for name, share in steps.items()}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) % (BUCKETS - 1) for x in kinds | shapes), np.int64)).astype(np.int32)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one per bucket
    thresholds: np.ndarray  # ascending, one fewer than grades

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() for x in found])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit(found: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = EPOCHS, decay: float = 1e-5) -> OrdinalModel:
    """Minimise the cumulative-link loss by AdaGrad over small batches; thresholds stay ordered by construction."""
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    share = np.array([np.mean(grades > k) if len(grades) else 0.5 for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # thresholds: the first, and the logarithms of the steps up from it
    theta = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    theta_squares = np.full(len(theta), 1e-2)
    rng = np.random.default_rng(7)

    def thresholds() -> np.ndarray:
        return theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:]))))

    rounds = max(epochs, -(-LEAST_STEPS * 64 // len(found))) if len(found) else 0
    for _ in range(rounds):
        order = rng.permutation(len(found))
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            flat = np.concatenate([found[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(found[i]) for i in rows])
            scores = np.bincount(owner, weights[flat], minlength=len(rows))
            cuts, y = thresholds(), grades[rows]
            # With F the logistic function, the gradient of -log(F(u_y) - F(u_y-1)) in the score is 1 - F(u_y) - F(u_y-1).
            upper = np.concatenate((cuts, [np.inf]))[y] - scores
            lower = np.concatenate(([-np.inf], cuts))[y] - scores
            fu, fl = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
            fu[y == len(cuts)], fl[y == 0] = 1.0, 0.0
            slope = 1 - fu - fl
            gap = np.maximum(fu - fl, 1e-9)
            d_cut = np.zeros(len(cuts))
            np.add.at(d_cut, y[y < len(cuts)], -(fu * (1 - fu) / gap)[y < len(cuts)])
            np.add.at(d_cut, y[y > 0] - 1, (fl * (1 - fl) / gap)[y > 0])
            touched, where = np.unique(flat, return_inverse=True)
            grad = np.bincount(where, slope[owner]) / len(rows) + decay * weights[touched]
            squares[touched] += grad * grad
            weights[touched] -= 0.1 * grad / np.sqrt(squares[touched])
            d_theta = np.concatenate(([d_cut.sum()], [d_cut[k:].sum() * math.exp(theta[k]) for k in range(1, len(theta))])) / len(rows)
            theta_squares += d_theta * d_theta
            theta -= 0.1 * d_theta / np.sqrt(theta_squares)
    return OrdinalModel(weights.astype(np.float32), thresholds())


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The ratings of ``labels`` as grades: 0 toxic, 1 poor, 2 good; null if both are null."""
    rated = F.coalesce(F.col(quality), F.col(toxic)).isNotNull()
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(rated, 2).cast("int")


def rated_sample(documents: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``sample`` rated documents, the first by the hash of their id.

    ``ratings``: id, grade. Ratings without an id or grade and ratings of unknown documents are ignored; several ratings of a document
    count as its lowest, and rows of one id as one document, whose text is that of the least hash. Rows without a text take part as empty texts.
    """
    known = ratings.filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` rows of two numbers
    joined = joined.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("grade").alias("grade"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in octets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["id", "grade", "found"])

    rows = map_arrow(joined.select("id", "text", "grade"), scan, "id long, grade int, found array<int>").orderBy("id").toArrow()
    column = rows.column("found").combine_chunks()
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], rows.column("grade").to_numpy().astype(np.int64)


def grade_documents(documents: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """Every row of ``documents`` with a last column ``quality``: struct(score, expected, tails).

    ``tails[k]`` is P(grade > k) and ``expected`` their sum, the expected grade. Null, empty and blank texts are scored as texts without
    words. Repeated rows get equal scores. Other columns pass through; if one is called ``quality``, the new column gets
    underscores in front. An empty table gives an empty one.
    """
    name = free_name(documents, "quality")
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    kind = StructType.fromDDL("q struct<score:double,expected:double,tails:array<double>>")["q"].dataType
    names = documents.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = OrdinalModel(*shared.value)
        for batch in batches:
            scores = fitted.score([features(t) for (t,) in arrow_rows(batch, text_col)]).astype(np.float64)
            tails = fitted.tails(scores)
            out = pa.StructArray.from_arrays(
                [pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64()))], names=["score", "expected", "tails"]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, name])

    return map_arrow(documents, scan, StructType([*documents.schema.fields]).add(name, kind))


def fit_on(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model for ``labels`` (doc_id, quality, toxic) of ``documents``."""
    ratings = labels.select(F.col("doc_id").cast("long").alias("id"), grade_of().alias("grade"))
    found, grades = rated_sample(documents, ratings, sample=sample)
    return fit(found, grades, 3)


def kept(quality: str = "quality", at: float = KEEP_AT) -> Column:
    """Whether a document stays: its grade is above toxic and above poor more likely than not. Without words there is nothing to reject."""
    return F.col(f"{quality}.tails")[1] >= at
