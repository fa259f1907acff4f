"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are labelled rows of high quality; unlabelled text is any text.
With the class prior p (the share of positives among unlabelled text, estimated
from the labelled rows) the risk to minimise is

    p * R(positives as 1) + max(0, R(unlabelled as 0) - p * R(positives as 0)),

the unbiased estimate of the full risk, held above zero; where a step would drive
the second part below zero, the step undoes that instead.  The model is linear
over square roots of byte and byte-pair frequencies and simple shape features.

The fit uses about ``most`` positives and ``most`` unlabelled ids at most, chosen by a
hash of the id, each with one row however often it is repeated; that bound is a
parameter, and about 33 MB of features at most reach the driver.  Scoring reads every
whole text.

Defined results: null texts count as empty and get the score of an empty text;
with no positives to learn from every score is the prior; rows that repeat an id
each get their row, and the fit takes the one whose features sort first; a null id
is never learned from; an empty table gives an empty table; other columns pass
whatever their names, but for the score's own, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.llm.common import carried, quoted, restored, schema_of, text_blocks
from juriscope.llm.hashing import find_words, word_hashes

PAIRS = 256
SHAPES = 6
WIDTH = 256 + PAIRS + SHAPES


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    out = np.zeros((len(column), WIDTH), np.float32)
    for start, stop, data, offsets in text_blocks(column):
        n = stop - start
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        one = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
        out[start:stop, :256] = one
        if len(data) > 1:
            pair = (data[:-1].astype(np.uint32) * np.uint32(40503) + data[1:].astype(np.uint32) * np.uint32(26687)) >> np.uint32(5)
            both = doc[1:] == doc[:-1]
            out[start:stop, 256 : 256 + PAIRS] = np.bincount(doc[1:][both] * PAIRS + (pair[both] % PAIRS), minlength=n * PAIRS).reshape(n, PAIRS)
        total = np.maximum(size, 1)[:, None]
        blank = one[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
        out[start:stop, : 256 + PAIRS] = np.sqrt(out[start:stop, : 256 + PAIRS] / total)
        out[start:stop, -4] = np.log1p(size) / 10
        out[start:stop, -3] = size / (blank + 1) / 10
        out[start:stop, -2] = one[:, 65:91].sum(axis=1) / total[:, 0]
        out[start:stop, -1] = size == 0
        starts, stops, firsts = find_words(data, offsets)
        words = word_hashes(data, starts, stops)
        text = np.repeat(np.arange(n), np.diff(firsts))
        # Words that repeat the one before or the one before that.
        for k, back in ((-5, 1), (-6, 2)):
            again = (words[back:] == words[:-back]) & (text[back:] == text[:-back])
            out[start:stop, k] = np.sqrt(np.bincount(text[back:][again], minlength=n) / np.maximum(np.diff(firsts), 1))
    return out


class Model:
    """A linear model over standardised features."""

    def __init__(self, prior: float):
        self.prior, self.mean, self.scale, self.weights, self.bias = prior, np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior)))

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) * self.scale).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-3) -> "Model":
        if not len(positive) or not len(unlabelled):
            return self
        everything = np.concatenate([positive, unlabelled])
        self.mean = everything.mean(axis=0)
        self.scale = 1 / np.maximum(everything.std(axis=0), 0.02)
        x, u = ((a - self.mean) * self.scale for a in (positive, unlabelled))
        x, u = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32), np.hstack([u, np.ones((len(u), 1))]).astype(np.float32)
        w, p = np.append(self.weights, self.bias).astype(np.float32), self.prior
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            gx, gu = np.clip(x @ w, -30, 30), np.clip(u @ w, -30, 30)
            sx, su = 1 / (1 + np.exp(-gx)), 1 / (1 + np.exp(-gu))
            # Logistic losses; their slopes are s - 1 for class 1 and s for class 0.
            below = np.logaddexp(0, gu).mean() - p * np.logaddexp(0, gx).mean()
            slope_negative = u.T @ su / len(u) - p * (x.T @ sx) / len(x)
            slope = p * (x.T @ (sx - 1)) / len(x) + slope_negative if below >= 0 else -slope_negative
            slope[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = w[:-1].astype(np.float64), float(w[-1])
        return self


def limit_of(share: float) -> int:
    """The 63-bit numbers up to which a share of all lies, however small it is."""
    return max(0, min((1 << 63) - 1, int(share * float(1 << 63))))


def _chosen(key: Column, share: float) -> Column:
    """A fixed share of ids by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("fit"), key), 1) <= limit_of(share)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 8192) -> Model:
    """A model from the rows of ``docs`` and ``labels`` where ``learnable`` (over the
    id column of either) holds."""
    seen = labels.filter(learnable & F.col(label_col).isNotNull())
    n, n_positive = seen.agg(F.count("*"), F.count_if(F.col(label_col) == 1)).head()
    model = Model(min(0.99, max(0.01, n_positive / n if n else 0.5)))
    if not n_positive:
        return model
    good = seen.filter(F.col(label_col) == 1).select(F.col(quoted(id_col)).alias("_id")).filter(_chosen(F.col("_id"), min(1.0, most / n_positive))).distinct()
    # About ``most`` ids whatever the input: they are sent to the texts, which stay where they are.
    rows = docs.filter(learnable)
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(good.withColumn("positive", F.lit(True))), "_id", "left")
    rows = rows.select("_id", F.coalesce("positive", F.lit(False)).alias("positive"), _chosen(F.col("_id"), share).alias("open"), "text").filter("_id is not null and (positive or open)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "positive", "open", "x"])

    found = rows.mapInArrow(run, schema_of(rows.select("_id", "positive", "open"), x="binary"))
    got = found.groupBy("_id", "positive", "open").agg(F.min("x").alias("x")).select("positive", "open", "x").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    positive, unlabelled = (got.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("positive", "open"))
    # The order of collected rows doesn't matter to sums beyond rounding; sorting fixes that too.
    order = np.lexsort(x[:, :8].T)
    return model.fit(x[order][positive[order]], x[order][unlabelled[order]])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added (or replaced) as ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(batch.column(1).slice(i, 2048))) for i in range(0, len(batch), 2048)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]))], ["_row", "_score"])

    rows = docs.select(carried(docs).alias("_row"), F.col(quoted(text_col)).cast("string").alias("_text"))
    done = rows.mapInArrow(run, schema_of(rows.select("_row"), _score="double"))
    return done.select(*restored(docs.columns, "_row", **{out: "_score"}))
