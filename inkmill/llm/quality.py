"""Quality by ordinal regression: a cumulative-link model over hashed text.

A text's features are its words as they stand, their shapes (letters folded to `a` or `A`, digits to `0`,
repeats to one), and three figures of the whole text, hashed into 2**BITS weights. For grades g1 < .. < gK
the model is P(grade > g_j) = sigmoid(w.x - t_j) with one weight vector and ordered thresholds t_1 < .. < t_K-1.
Expected grade and the tail probability P(grade >= target) follow from it; documents are kept whose tail
probability reaches `KEEP`.

The model is fitted on at most `SAMPLE_ROWS` labelled rows, chosen by a hash of doc_id, with their whole
texts. Hashing makes its size fixed.

Defined results: null and empty texts have the features of an empty text; null grades and ids teach
nothing; of several grades for one doc_id the lowest counts; one grade only, or none, gives that grade
(or null) with tail probability 1; equal texts have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm._shared import hash_order, small_batches

BITS, SAMPLE_ROWS, BROADCAST_ROWS = 18, 6000, 20_000
STEPS, RATE, SHRINK = 400, 0.05, 2e-4
KEEP = 0.5
CACHE_WORDS = 200_000
RUN = re.compile(r"(.)\1+")
FOLD = (re.compile(r"[^\W\d_]"), re.compile(r"\d"))


def shape(word: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUN.sub(r"\1", out)


def slot(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & ((1 << BITS) - 1)


class Slots(dict):
    """The two slots of a word, worked out when first asked for."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = (slot("w" + word), slot("s" + shape(word)))
        return found


def features(slots: Slots, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): each word and shape has its share of the words, square-rooted."""
    words = Counter((text or "").split())
    n = sum(words.values())
    shares: dict[int, float] = {}
    for word, c in words.items():
        for s in slots[word]:
            shares[s] = shares.get(s, 0.0) + c / n
    whole = ((slot("#repeat"), 1 - len(words) / n if n else 0.0), (slot("#short"), 1 / (1 + n)), (slot("#one"), 1.0))
    keys = np.fromiter((*shares, *(k for k, _ in whole)), np.int64)
    values = np.sqrt(np.fromiter((*shares.values(), *(v for _, v in whole)), np.float64))
    return keys, values


class Ordinal:
    """Shared weights, grades and ordered thresholds."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Ordinal:
        """Maximum likelihood with shrinkage, by Adam over all rows at once."""
        kinds = sorted(set(grades.tolist()))
        size = 1 << BITS
        if len(kinds) < 2:
            return cls(kinds, np.zeros(size), np.zeros(0))
        used, at = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
        value = np.concatenate([v for _, v in rows])
        row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        above = grades[:, None] > np.array(kinds[:-1])[None, :]
        shares = above.mean(0)
        w = np.zeros(len(used))
        # thresholds are a first one and the logs of the gaps behind it, so they stay ordered
        start = -np.log(shares / (1 - shares))
        gaps = np.log(np.maximum(np.diff(start), 1e-3))
        theta = np.r_[start[0], gaps]
        m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
        for step in range(1, STEPS + 1):
            t = theta[0] + np.r_[0, np.cumsum(np.exp(theta[1:]))]
            z = np.bincount(row, w[at] * value, len(rows))
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30)))
            tail = np.c_[np.ones(len(rows)), p, np.zeros(len(rows))]
            g = above.sum(1)
            here, nxt = tail[np.arange(len(rows)), g], tail[np.arange(len(rows)), g + 1]
            mass = np.maximum(here - nxt, 1e-9)
            up, down = here * (1 - here), nxt * (1 - nxt)
            dz = (up - down) / mass / len(rows)
            dt = np.zeros(len(t))
            np.add.at(dt, g[g > 0] - 1, (-up / mass)[g > 0] / len(rows))
            np.add.at(dt, g[g < len(t)], (down / mass)[g < len(t)] / len(rows))
            dtheta = np.r_[dt.sum(), np.exp(theta[1:]) * np.cumsum(dt[::-1])[::-1][1:]]
            grad = -np.r_[np.bincount(at, dz[row] * value, len(w)) - SHRINK * w, dtheta]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, theta = w - move[: len(w)], theta - move[len(w) :]
        weights = np.zeros(size)
        weights[used] = w
        return cls(kinds, weights, theta[0] + np.r_[0, np.cumsum(np.exp(theta[1:]))])

    def tails(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > g_j) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(self.weights[keys] @ values - self.thresholds, -30, 30)))

    def __call__(self, keys: np.ndarray, values: np.ndarray, target: int) -> tuple[float | None, float]:
        if not self.grades:
            return None, 1.0
        tails = self.tails(keys, values)
        expected = self.grades[0] + float(np.dot(tails, np.diff(self.grades)))
        below = [j for j, g in enumerate(self.grades) if g >= target]
        if not below:
            return expected, 0.0
        return expected, 1.0 if below[0] == 0 else float(tails[below[0] - 1])


def learn(docs: DataFrame, labels: DataFrame, grade: str = "quality") -> Ordinal:
    """The model from a bounded sample of the labelled rows."""
    small_batches(docs.sparkSession)
    marks = labels.where(f"{grade} is not null and doc_id is not null").groupBy(F.col("doc_id").alias("marked_id")).agg(F.min(F.col(grade).cast("int")).alias("grade"))
    n = marks.count()
    drawn = marks.where(F.pmod(hash_order("marked_id", 101), F.lit(max(1, n))) < SAMPLE_ROWS).orderBy(hash_order("marked_id", 101), "marked_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("marked_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            found = [features(slots, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([k.astype(np.int32) for k, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "grade", "keys", "vals"]
            )

    # repeated documents of one label may be more than the labels: they are bounded too
    table = rows.select("text", "doc_id", "grade").mapInArrow(run, "doc_id long, grade int, keys array<int>, vals array<float>").orderBy(hash_order("doc_id", 101), "doc_id", F.xxhash64("keys")).limit(BROADCAST_ROWS).toArrow()
    grades = np.array(table.column("grade").to_pylist(), np.int64)
    keys, vals = (table.column(c).combine_chunks() for c in ("keys", "vals"))
    found = [(np.asarray(k.values, np.int64), np.asarray(v.values, np.float64)) for k, v in zip(keys, vals)]
    return Ordinal.fit(found, grades)


def grade(docs: DataFrame, model: Ordinal, target: int) -> DataFrame:
    """doc_id, expected_grade, tail_probability and keep for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, ordinal = Slots(), shared.value
        for batch in batches:
            found = [ordinal(*features(slots, t), target) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)), pa.array([f[1] >= KEEP for f in found], pa.bool_())], names=["doc_id", "expected_grade", "tail_probability", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades of all documents; a quarter of the labels is held out from learning, as for the languages."""
    from inkmill.llm._shared import held_out

    model = learn(docs.where(~held_out("doc_id", 4, 2)), labels)
    target = model.grades[-1] if model.grades else 0
    found = grade(docs, model, target)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "expected_grade", "tail_probability", "keep")
