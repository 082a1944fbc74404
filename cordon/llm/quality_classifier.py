"""Quality classifier: kernel ridge regression by random Fourier features, then isotonic calibration.

Statistics of a document (no labels, language, source or identifier) are standardised and
mapped to cosines with random frequencies, whose inner products approximate a Gaussian
kernel. Each partition sums its part of the normal equations; the driver adds the sums,
solves the ridge system and calibrates the scores on a part of the sample that it has not
fitted. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import written
from cordon.llm.labelled import labelled_sample, remainder

#: Bound on the labelled documents of the fit.
MAX_LABELLED = 20_000
FEATURES, BANDWIDTH, RIDGE, SEED = 384, 4.0, 1e-3, 7
SUM_PARTITIONS = 8
#: Every so many labelled documents (by hash of the text) calibrate instead of fitting.
CALIBRATION_SHARE = 4
N_STATISTICS = 20

SYMBOLS = b"#*$%&|<>"


def statistics(text: str) -> list[float]:
    """Numbers that describe the whole text; all 0 for an empty one."""
    data = text.encode()
    if not data:
        return [0.0] * N_STATISTICS
    n = len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits, high = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum()), int(seen[128:].sum())
    share = seen[seen > 0] / n
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = sum(map(eq, words, words[1:]))
    pairs = set(zip(words, words[1:]))
    symbols = int(seen[list(SYMBOLS)].sum())
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        upper / max(1, upper + lower), digits / n, high / n, symbols / n, symbols / k,
        int(seen[33]) / k, int(seen[46]) / k, int(seen[44]) / k, int(seen[124]) / k,
        len(set(words)) / k, repeats / k, len(pairs) / k, len(set(lines)) / max(1, len(lines)), len(lines) / k,
        float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in [0, 1]. A thousandth is the raw score's, so that ties of the calibration keep its order."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are the mean raw scores of the pools."""
    order = np.lexsort((y, raw))
    pools: list[list[float]] = []
    for x, t in zip(raw[order], y[order]):
        pools.append([t, 1.0, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, x2 = pools.pop()
            for i, v in enumerate((t2, n2, x2)):
                pools[-1][i] += v
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def fit(sample: DataFrame) -> Model | None:
    """A model of (text, y); None if the sample lacks one of the two labels."""
    names = [f"s{i}" for i in range(N_STATISTICS)]

    def measure(batches):
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1)
            rows = np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATISTICS)
            part = pa.array([crc32(t.encode()) % CALIBRATION_SHARE for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(N_STATISTICS)), y, part], [*names, "y", "part"])

    measured = written(sample.select("text", "y").mapInArrow(measure, ", ".join(f"{n} double" for n in names) + ", y double, part int"), "quality-statistics")
    totals = measured.agg(F.count("y").alias("n"), F.sum("y").alias("good"), *[F.avg(n).alias(n) for n in names], *[F.stddev_pop(n).alias(f"{n}_d") for n in names]).first()
    if not totals["n"] or not 0 < totals["good"] < totals["n"]:
        return None
    rng = np.random.default_rng(SEED)
    model = Model(
        np.array([totals[n] for n in names]), np.maximum([totals[f"{n}_d"] for n in names], 1e-6),
        rng.normal(0, 1 / BANDWIDTH, (N_STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1),
    )

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(N_STATISTICS)])
            y, fits = batch.column(N_STATISTICS).to_numpy(), batch.column(N_STATISTICS + 1).to_numpy() > 0
            z = model.features(x[fits])
            total += z.T @ np.column_stack([z, y[fits]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    parts = measured.coalesce(SUM_PARTITIONS).mapInArrow(sums, "sums binary").collect()  # SUM_PARTITIONS rows at most
    total = sum(np.frombuffer(r["sums"]).reshape(FEATURES + 1, FEATURES + 2) for r in parts)
    ridge = RIDGE * max(1.0, total[-1, -2]) * np.eye(FEATURES + 1) / FEATURES
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])
    held = measured.where("part = 0").toPandas()
    if not 0 < held["y"].sum() < len(held):
        held = measured.toPandas()  # at most MAX_LABELLED rows
    model.knots, model.values = isotonic(model.raw(held[names].to_numpy()), held["y"].to_numpy())
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_out: int = 2, cut: float = 0.7, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1), predicted (1 if score >= cut), and with `carry` all columns as the struct `row`.

    The model is fitted on labelled documents of `fit_on`, or of `docs` where that isn't given.

    Null texts are scored as empty ones, very long ones whole. Without labels of both kinds every score is 0.5.
    Repeated rows get equal rows; an empty table gives none; other columns have no influence.
    """
    model = fit(labelled_sample(docs if fit_on is None else fit_on, labels, label_col, folds, held_out, most, id_col, text_col))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), N_STATISTICS)
            score = model.score(x) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], [*batch.schema.names[1:], "score"])

    kept = [F.col(id_col), F.coalesce(remainder(id_col, folds) == held_out, F.lit(False)).alias("held_out")] + ([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [])
    given = docs.select(F.col(text_col).alias("the_text"), *kept)
    schema = given.drop("the_text").schema.add("score", "double")
    return given.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))
