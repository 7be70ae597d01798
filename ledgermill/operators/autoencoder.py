"""Anomaly scores from a small autoencoder, trained by full-batch gradients over the cluster.

Every epoch each partition returns the sum of its gradients, a few hundred numbers; the driver
adds them up, takes one Adam step and sends the weights out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, materialize, ship
from ..settings import DEFAULTS, FEATURES
from .scaling import min_max, standardized


@dataclass
class Network:
    """Dense layers with ReLU between them: inputs, hidden, bottleneck, hidden, inputs."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> Network:
        sizes = [inputs, hidden, max(2, hidden // 2), hidden, inputs]
        rng = np.random.default_rng(seed)
        bound = [1 / np.sqrt(a) for a in sizes[:-1]]
        pairs = list(zip(sizes[:-1], sizes[1:], bound, strict=True))
        return cls([rng.uniform(-b, b, (m, n)) for m, n, b in pairs], [rng.uniform(-b, b, n) for _, n, b in pairs])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k + 1 < len(self.weights) else z)
        return out

    def errors(self, x: np.ndarray) -> np.ndarray:
        return ((self.forward(x)[-1] - x) ** 2).mean(axis=1)

    def gradients(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Sum over rows of the gradient of the row's mean squared error, and of that error."""
        layers = self.forward(x)
        delta = 2 * (layers[-1] - x) / x.shape[1]
        grads: list[np.ndarray] = []
        for k in range(len(self.weights) - 1, -1, -1):
            grads = [(layers[k].T @ delta).ravel(), delta.sum(axis=0), *grads]
            if k:
                delta = (delta @ self.weights[k].T) * (layers[k] > 0)
        return np.concatenate(grads), float(((layers[-1] - x) ** 2).mean(axis=1).sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for pair in zip(self.weights, self.biases, strict=True) for p in pair])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in range(len(self.weights)):
            for group in (self.weights, self.biases):
                n = group[k].size
                group[k] = flat[at : at + n].reshape(group[k].shape)
                at += n


def train(scaled: DataFrame, *, hidden: int = DEFAULTS.autoencoder_hidden, epochs: int = DEFAULTS.autoencoder_epochs, rate: float = DEFAULTS.autoencoder_rate, seed: int = DEFAULTS.seed) -> tuple[Network, list[float]]:
    """The network and the mean loss of every epoch. ``scaled`` holds standardised FEATURES."""
    ship(scaled.sparkSession)
    columns = list(FEATURES)
    net = Network.fresh(len(columns), hidden, seed)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "block": [batch.to_numpy(float).tobytes()]})

    # A batch of rows is one value, so that an epoch reads bytes and converts no row.
    blocks = materialize(scaled.select(*columns).mapInPandas(packed, "n long, block binary"))
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    losses: list[float] = []
    flat = net.flat()
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, (epochs if n else 0) + 1):

        def partial(batches: Iterator[pd.DataFrame], net: Network = net) -> Iterator[pd.DataFrame]:
            total, loss = None, 0.0
            for batch in batches:
                for block in batch.block:
                    g, e = net.gradients(np.frombuffer(block).reshape(-1, len(columns)))
                    total, loss = (g if total is None else total + g), loss + e
            if total is not None:
                yield pd.DataFrame({"g": [total.tolist()], "loss": [loss]})

        parts = blocks.select("block").mapInPandas(partial, "g array<double>, loss double").collect()  # a row per partition
        gradient = np.sum(np.sort(np.array([p.g for p in parts]), axis=0), axis=0) / n
        losses.append(sum(sorted(p.loss for p in parts)) / n)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.load(flat)
    return net, losses


def scores(features: DataFrame, **options) -> DataFrame:
    """(entity_id, autoencoder_score): reconstruction error, from 0 to 1 over all entities."""
    scaled = checkpoint(standardized(features.select("entity_id", *[F.col(c).cast("double").alias(c) for c in FEATURES]), list(FEATURES)))
    net, _ = train(scaled, **options)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"entity_id": batch.entity_id, "raw": net.errors(batch[list(FEATURES)].to_numpy(float))})

    return min_max(scaled.mapInPandas(score, "entity_id string, raw double"), "raw", "autoencoder_score").select("entity_id", "autoencoder_score")
