"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed to roughly normal ones. Each class
gets a mean and a covariance shrunk towards its diagonal; a score is the logistic
of the difference of the two Mahalanobis log densities plus the log prior odds,
worked out with Cholesky factors that are computed once and shipped to the tasks.

Every labelled row outside the held-out fold is used for the fit: tasks emit sums
of features and of their products, which the engine adds up, so the driver gets
two small matrices whatever the input.

Edge cases: null or empty texts have the statistics of an empty text and are
scored; null labels and labels of unknown documents are ignored; several labels
of one document count by their mean (a tie counts as good); a null doc_id is
scored, in no held-out fold, and never labelled; without both classes every score
is 0.5; rows repeat as they do in the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

FOLDS, HELD_OUT = 4, 2
SHRINKAGE, RIDGE, TEMPERATURE, THRESHOLD = 0.1, 1e-3, 1.0, 0.7
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT, SPACES = b"0123456789", b" \t\n\x0b\x0c\r"
HIGH = bytes(range(128, 256))
SYMBOLS = bytes(c for c in range(33, 127) if c not in UPPER + LOWER + DIGIT + b".,;:'\"?()-")
FEATURES = 14
#: Pseudo-counts: what a text is thought to hold besides its own words and characters.
WORDS, CHARS = 12, 72


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one UTF-8 text; square roots and logarithms tame the long tails."""
    n = len(text)
    size = n or 1
    kept = lambda drop: n - len(text.translate(None, drop))  # noqa: E731  how many bytes are in the set
    upper, lower, symbols, high = kept(UPPER), kept(LOWER), kept(SYMBOLS), kept(HIGH)
    letters = upper + lower + high or 1
    words = text.split()
    w = len(words) or 1
    low = text.lower().split()
    lines = text.split(b"\n")
    marked = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,")
    shouted = sum(1 for x in words if len(x) > 2 and x.isupper())
    stops = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    worst = max((len(x) - len(x.translate(None, SYMBOLS))) / len(x) if x else 0.0 for x in lines)
    a, c = w + WORDS, size + CHARS  # with the pseudo-counts, a few words can't give extreme shares
    return [
        np.log(a), np.log1p(len(lines)), np.sqrt((upper + 0.04 * CHARS) / (letters + CHARS)), np.sqrt(kept(DIGIT) / c), np.sqrt(symbols / c), np.sqrt(worst * size / c),
        np.sqrt(text.count(b"|") / a), np.sqrt(marked / a), np.sqrt(shouted / a), np.log((letters + 5 * WORDS) / a), np.sqrt((stops + 0.1 * WORDS) / a),
        (len(set(low)) + WORDS) / a, np.sqrt(kept(b"!?") / a), np.sqrt(sum(map(eq, low, low[1:])) / a),
    ]


def features(texts: pa.Array) -> np.ndarray:
    rows = [statistics(x.as_py() or b"") for x in texts.cast(pa.large_binary())]
    return np.array(rows, dtype=np.float64).reshape(len(rows), FEATURES)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


@dataclass
class Discriminant:
    """Means, Cholesky factors of the inverse covariances and constants of the two classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    @classmethod
    def of(cls, n: list[float], first: list[np.ndarray], second: list[np.ndarray], shrinkage: float) -> Discriminant:
        means, factors, constants = [], [], []
        for k in (0, 1):
            mu = first[k] / n[k]
            cov = second[k] / n[k] - np.outer(mu, mu)
            cov = (1 - shrinkage) * cov + (shrinkage * np.diag(np.diag(cov))) + RIDGE * np.eye(len(mu))
            chol = np.linalg.cholesky(cov)
            means.append(mu)
            factors.append(np.linalg.inv(chol).T)
            constants.append(float(np.log(n[k] / sum(n)) - np.log(np.diag(chol)).sum()))
        return cls(means, factors, constants)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        density = [c - 0.5 * (((x - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """None if one of the classes has no labelled document."""
    d = pick(docs, "doc_id", "text")
    y = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    y = y.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])

    x = d.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).mapInArrow(stats, "doc_id long, x array<double>").join(y, "doc_id").select("y", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + FEATURES, 1 + FEATURES))
        for b in batches:
            m = np.array(b.column("x").to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
            m = np.hstack([np.ones((len(m), 1)), m])
            k = b.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += m[k == c].T @ m[k == c]
        c, i, j = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["c", "i", "j", "v"])

    total = np.zeros((2, 1 + FEATURES, 1 + FEATURES))
    for r in x.mapInArrow(sums, "c int, i int, j int, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.c, r.i, r.j] = r.v
    if not total[0, 0, 0] or not total[1, 0, 0]:
        return None
    return Discriminant.of([t[0, 0] for t in total], [t[0, 1:] for t in total], [t[1:, 1:] for t in total], shrinkage)


def score(docs: DataFrame, model: Discriminant | None, *keep: str) -> DataFrame:
    """The columns ``keep`` of each row (``text`` may be one of them) and its ``score``."""
    d = pick(docs, *dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column("text"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s, pa.float64())], [*keep, "score"])

    return d.mapInArrow(run, schema + ", score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
