"""Networks with one hidden layer for all folds, seeds and sets of columns, fitted in shared passes over the rows.

Each model learns from the rows of all folds but its own. Rows of held-out groups are not learned from either: their
loss says which step's weights stay. A pass works out the gradients of all models at once: tasks add up the gradients of
their rows, Spark adds up those of the tasks, and the driver, which holds nothing but weights, takes a step. So rows may
be many, while models are few and small (models x (inputs + 2) x HIDDEN numbers go to the driver in each step).

Rows: fold, label (0 or 1), held_out, features (array of numbers of one length). Steps read them from a written table
whose rows are blocks of up to BLOCK rows as bytes. A row with a null label or fold, or without features, is not learned
from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.sources.storage import written

HIDDEN, STEPS, RATE, DECAY = 16, 30, 0.03, 1e-3
#: Rows of a block.
BLOCK = 2000


@dataclass
class Model:
    """One fold's model: its columns' training means and deviations, and weights (the step with the least held-out loss)."""

    fold: int
    seed: int
    name: str
    columns: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    positive: float
    weights: np.ndarray
    step: int = 0
    loss: float = float("inf")

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, ...]:
        d = len(self.columns)
        return w[: d * HIDDEN].reshape(d, HIDDEN), w[d * HIDDEN : (d + 1) * HIDDEN], w[(d + 1) * HIDDEN : (d + 2) * HIDDEN], w[-1]

    def logits(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        a, b, c, d = self.parts(self.weights if w is None else w)
        return np.tanh((x[:, self.columns] - self.mean) / self.scale @ a + b) @ c + d


class Layers:
    """The models of one set of columns side by side, with standardisation taken into their first layer, so that a block of rows passes all of them as one product of matrices.

    Rows are taken from a centre (the models' first mean), so that sums over columns far from zero keep their digits.
    """

    def __init__(self, models: list[Model], weights: list[np.ndarray]) -> None:
        self.columns, self.centre = models[0].columns, models[0].mean
        a, b, c, d = zip(*(m.parts(w) for m, w in zip(models, weights, strict=True)))
        self.a = np.concatenate([x / m.scale[:, None] for m, x in zip(models, a, strict=True)], 1)
        self.b = np.concatenate([x - (m.mean - self.centre) / m.scale @ y for m, x, y in zip(models, b, a, strict=True)])
        self.c, self.d = np.array(c), np.array(d)
        self.folds, self.positive = np.array([m.fold for m in models]), np.array([m.positive for m in models])
        self.shift, self.scale = np.array([m.mean - self.centre for m in models]), np.array([m.scale for m in models])

    def sums(self, fold: np.ndarray, y: np.ndarray, held: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Per model, over rows of other folds: the loss' gradient, loss and weight of those learned from, loss and weight of those held out."""
        z, k = x[:, self.columns] - self.centre, len(self.folds)
        h = np.tanh(z @ self.a + self.b).reshape(len(x), k, HIDDEN)
        out = np.einsum("nkh,kh->nk", h, self.c) + self.d
        other, one = fold[:, None] != self.folds, y[:, None] == 1
        each = np.where(one, self.positive, 1.0) * other
        loss = each * (np.logaddexp(0, out) - np.where(one, out, 0.0))
        g = each * ~held[:, None] * (1 / (1 + np.exp(-np.clip(out, -500, 500))) - one)
        dc = np.einsum("nkh,nk->kh", h, g)
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        h *= g[:, :, None] * self.c
        db = h.sum(0)
        da = (z.T @ h.reshape(len(x), -1)).reshape(len(self.columns), k, HIDDEN).transpose(1, 0, 2)
        da = (da - self.shift[:, :, None] * db[:, None, :]) / self.scale[:, :, None]
        return np.concatenate([da.reshape(k, -1), db, dc, g.sum(0)[:, None], *(v[mine].sum(0)[:, None] for mine in (~held, held) for v in (loss, each))], 1)


def _blocks(rows: DataFrame) -> DataFrame:
    """Complete rows as a written table of blocks: labels, folds and whether rows are held out (int32) and features (float64) as bytes."""
    rows = _complete(rows)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = np.array([part.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("fold", "label", "held_out")])
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["ids", "features"])

    return written(rows.mapInArrow(run, "ids binary, features binary"), "feature-blocks", **{"parquet.block.size": str(8 << 20)})


def _arrays(batches):
    """fold, label, held_out and features (rows x columns) of each block."""
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("features"), strict=True):
            fold, y, held = np.frombuffer(ids.as_buffer(), np.int32).reshape(3, -1)
            yield fold, y, held == 1, np.frombuffer(x.as_buffer(), np.float64).reshape(len(y), -1)


def _added(rows: DataFrame, run, key: str) -> dict[int, np.ndarray]:
    """Vectors that tasks make of their rows, added up per key; one row per key."""
    met = rows.mapInArrow(run, f"{key} int, v array<double>").groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return {r[key]: np.array(r["v"]) for r in met.collect()}


def _vectors(key: str, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], [key, "v"])


def _complete(rows: DataFrame) -> DataFrame:
    kept = rows.filter("fold is not null and label is not null and features is not null")
    return kept.select(F.col("fold").cast("int"), F.col("label").cast("int"), F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("features").cast("array<double>"))


def moments(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Per fold: rows, rows with label 1, and sums and squares of each column."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for fold, y, _, x in _arrays(batches):
            for f in np.unique(fold).tolist():
                z = x[fold == f]
                total[f] = total.get(f, 0) + np.concatenate([[len(z), y[fold == f].sum()], z.sum(0), (z * z).sum(0)])
        yield _vectors("fold", total)

    return _added(blocks, run, "fold")


def started(per_fold: dict[int, np.ndarray], seeds: list[int], sets: dict[str, list[int]], positive: float | None) -> list[Model]:
    """Models of all folds, seeds and sets of columns with drawn weights. positive: weight of label 1; None balances both labels."""
    total = sum(per_fold.values())
    out = []
    for fold, own in sorted(per_fold.items()):
        n, ones, *sums = total - own  # of all folds but this one
        if n == 0:
            raise ValueError("two folds or more are needed")
        d = len(sums) // 2
        mean = np.array(sums[:d]) / n
        scale = np.sqrt(np.maximum(np.array(sums[d:]) / n - mean * mean, 0))
        scale[scale < 1e-6] = 1.0
        weight = positive if positive is not None else (n - ones) / ones if 0 < ones < n else 1.0
        for seed in seeds:
            for k, (name, columns) in enumerate(sets.items()):
                at = np.array(columns)
                rng = np.random.default_rng([seed, fold, k])
                w = np.concatenate([rng.normal(0, len(at) ** -0.5, len(at) * HIDDEN), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), [0.0]])
                out.append(Model(fold, seed, name, at, mean[at], scale[at], weight, w))
    return out


def fit(rows: DataFrame, seeds: list[int], sets: dict[str, list[int]], positive: float | None = None, steps: int = STEPS) -> list[Model]:
    """A model for each fold of rows, seed and named set of columns (by their places in features)."""
    rows = _blocks(rows)
    models = started(moments(rows), seeds, sets, positive)
    places = [[k for k, m in enumerate(models) if m.name == name] for name in sets]
    now, first, second = ([f(m.weights) for m in models] for f in (np.copy, np.zeros_like, np.zeros_like))
    for step in range(steps + 1):
        shared = rows.sparkSession.sparkContext.broadcast((models, now))

        def run(batches):
            models, now = shared.value
            layers = [Layers([models[k] for k in some], [now[k] for k in some]) for some in places]
            total: dict[int, np.ndarray] = {}
            for block in _arrays(batches):
                for some, layer in zip(places, layers, strict=True):
                    for k, v in zip(some, layer.sums(*block), strict=True):
                        total[k] = total.get(k, 0) + v
            yield _vectors("model", total)

        met = _added(rows, run, "model")
        shared.unpersist()
        for k, m in enumerate(models):
            *gradient, _, n, loss, held = met[k]
            loss = loss / held if held else float(-step)  # without rows to choose by, the last step stays
            if loss < m.loss - 1e-12:
                m.loss, m.step, m.weights = loss, step, now[k]
            g = np.array(gradient) / max(n, 1e-12) + DECAY * now[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            now[k] = now[k] - RATE * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return models


def predicted(rows: DataFrame, models: list[Model]) -> DataFrame:
    """rows, once per seed, with seed and logit_<name> by the models of their fold, which did not learn from them. Null without fold or features."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names, seeds = list(dict.fromkeys(m.name for m in models)), sorted({m.seed for m in models})

    def run(batches):
        of = {(m.fold, m.seed, m.name): m for m in shared.value}
        for batch in batches:
            fold = batch.column("fold").to_pylist()
            lists = batch.column("features")
            known = np.array([f is not None and v for f, v in zip(fold, lists.is_valid().to_pylist())], bool)
            x = lists.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(known.sum()), -1) if known.any() else np.zeros((0, 1))
            mine = np.array([f for f, ok in zip(fold, known) if ok])
            for seed in seeds:
                out = []
                for name in names:
                    z = np.full(len(mine), np.nan)
                    for f in np.unique(mine).tolist() if len(mine) else []:
                        if (f, seed, name) in of:
                            z[mine == f] = of[f, seed, name].logits(x[mine == f])
                    full = np.full(len(fold), np.nan)
                    full[known] = z
                    out.append(pa.array(full, from_pandas=True))
                yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(np.full(len(fold), seed, np.int32)), *out], ["__row", "seed", *(f"logit_{n}" for n in names)])

    keyed = rows.withColumn("__row", F.struct(*(c for c in rows.columns if c != "features")))
    slim = keyed.select("__row", F.col("fold").cast("int").alias("fold"), F.col("features").cast("array<double>").alias("features"))
    kind = keyed.schema["__row"].dataType.simpleString()
    done = slim.mapInArrow(run, f"__row {kind}, seed int, " + ", ".join(f"logit_{n} double" for n in names))
    return done.select("__row.*", "seed", *(f"logit_{n}" for n in names))
