"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.llm.text_stats import N_FEATURES, features

#: Largest expected number of trusted positives, and of unlabelled texts, that the model is fitted on.
FIT_ROWS = 20_000


def held_out(doc_id) -> Column:
    """Rows whose labels are never read in fitting; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of the shares above a score, with its error margin.

    Above a score that only positives reach, both shares stem from positives, so that their ratio is the prior.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.98, 97))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(4 / delta) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def _descend(grad, dim: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400, decay: float = 1e-4) -> dict:
    """Linear model of logistic loss that minimises the non-negative unbiased risk.

    risk = prior * E_p[loss(+1)] + max(0, E_u[loss(-1)] - prior * E_p[loss(-1)])

    While the second term is below zero its gradient is reversed, so that the fit leaves the region where positives
    would be paid for as negatives. ``prior`` None: estimated from a plain fit of positive against unlabelled.
    """
    if not len(positive) or not len(unlabelled):
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES + 1), "prior": 0.5}
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    if prior is None:  # fitted on one half, estimated on the other
        fp, fu = p[::2], u[::2]
        plain = _descend(lambda w: -(fp.T @ _sigmoid(-(fp @ w))) / len(fp) + (fu.T @ _sigmoid(fu @ w)) / len(fu) + decay * w,
                         p.shape[1], 150, 0.05)
        ep, eu = (x[1::2] if len(x) > 1 else x for x in (p, u))
        prior = estimate_prior(ep @ plain, eu @ plain)

    def grad(w):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        if negative < 0:
            return -of_negative
        return -prior * (p.T @ (1 - sp)) / len(p) + of_negative + decay * w

    return {"mean": mean, "scale": scale, "w": _descend(grad, p.shape[1], steps, 0.03), "prior": prior}


def predict(model: dict, table: np.ndarray) -> np.ndarray:
    z = np.clip((table - model["mean"]) / model["scale"], -8, 8) @ model["w"][:-1] + model["w"][-1]
    return _sigmoid(z)


def _matrix(docs: DataFrame) -> np.ndarray:
    """Feature rows of the texts of a bounded table."""
    def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in features(b.column(0))], pa.binary())], ["features"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(featurised, "features binary").toPandas()["features"]
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, prior: float | None = None) -> dict:
    """The model, from about ``fit_rows`` trusted positives and as many unlabelled texts, chosen by hash of the texts
    over the whole tables. Trusted positives are rows with ``labels.quality`` = 1 outside the held-out fold; negative labels are
    not used. Unlabelled texts are rows of ``docs`` themselves. A doc_id with several labels counts as positive if one
    of them says so. Without positives or documents every score is 0.5.
    """
    def sampled(key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(n, 1)))

    trusted = labels.where((F.col("quality") == 1) & ~held_out("doc_id")).select("doc_id").distinct()
    # bounded by fit_rows, so it can be broadcast
    chosen = F.broadcast(trusted.where(sampled(F.col("doc_id"), trusted.count())))
    row = F.xxhash64("doc_id", "text")  # the same rows however the files are dealt out
    positive = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi")
    positives = _matrix(positive.where(sampled(row, positive.count())))
    return fit(positives, _matrix(docs.where(sampled(row, docs.count()))), prior)


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a score of every whole text as a last column; a null text counts as empty.

    Only the texts go to the Python workers; the other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(predict(shared.value, features(text).astype(np.float64)), pa.float64())

    return docs.withColumn(name, score(F.col("text").cast("string")))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS,
                  prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text, …).

    Only the text enters a score: null and empty texts get the score of a text without words. Repeated rows get a
    score each; other columns are ignored; an empty table gives no rows.
    """
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_score(kept, train(kept, labels, fit_rows, prior)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
