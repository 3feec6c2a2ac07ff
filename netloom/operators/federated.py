"""Federated averaging: local training on device shards, weighted means of weights, the round loop."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import columns as C
from netloom.operators import evaluation, network
from netloom.operators.ranking import hash_key

LEAST_CLIENTS = 2


def fedavg(weights: DataFrame) -> DataFrame:
    """(layer, pos, w): the clients' means by sample count, from (client_id, layer, pos, w, n_samples)."""
    n = F.col("n_samples")
    return weights.groupBy("layer", "pos").agg((F.sum(F.col("w") * n) / F.sum(n)).alias("w"))


def weighted_loss(fits: DataFrame, by: Sequence[str] = ("round",)) -> DataFrame:
    """Sample-weighted mean loss."""
    return fits.groupBy(*by).agg((F.sum(F.col("loss") * F.col("samples")) / F.sum("samples")).alias("loss"), F.sum("samples").alias("samples"))


def initial(df: DataFrame, features: Sequence[str], seed: int = 0) -> DataFrame:
    """(layer, pos, w) of a seeded network."""
    return df.sparkSession.createDataFrame(network.flat(network.start(len(features), seed)), "layer int, pos int, w double")


def _weights(table: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """The network of a (layer, pos, w) table: a few thousand numbers, whatever the data's size."""
    return network.unflat([(r.layer, r.pos, r.w) for r in table.select("layer", "pos", "w").collect()], len(features))


def train_local(
    shards: DataFrame, weights: DataFrame, features: Sequence[str], label: str = "label", device: str = "device_id", seed: int = 0, rate: float = network.RATE,
) -> DataFrame:
    """(client_id, layer, pos, w, n_samples, loss) after one pass over each device's shard, shuffled by ``seed``.

    Rows go to tasks by device and stream through in batches, so a task holds one
    batch and the networks of its devices, never a shard. One device is one task:
    its steps follow one another.
    """
    p = _weights(weights, features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, network.Training] = {}
        for frame in frames:
            for d, part in frame.groupby(device, sort=True):
                training = own.setdefault(int(d), network.Training(p, rate))
                x, y = part[list(features)].to_numpy(float), part[label].to_numpy(float)
                for i in range(0, len(x), network.BATCH):
                    training.update(x[i : i + network.BATCH], y[i : i + network.BATCH])
        for d, training in sorted(own.items()):
            rows = pd.DataFrame(network.flat(training.p), columns=["layer", "pos", "w"])
            yield rows.assign(client_id=d, n_samples=training.rows, loss=training.loss / max(1, training.rows))[["client_id", "layer", "pos", "w", "n_samples", "loss"]]

    rows = shards.select(F.col(device).cast("int").alias(device), *features, label, hash_key([*features, label], seed).alias("__key"))
    rows = rows.repartition(device).sortWithinPartitions(device, "__key", *features)
    return rows.mapInPandas(run, "client_id int, layer int, pos int, w double, n_samples long, loss double")


def predict(df: DataFrame, weights: DataFrame, features: Sequence[str], to: str = "probability") -> DataFrame:
    """Add the network's probability."""
    p = _weights(weights, features)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(network.probability(p, np.vstack(x.to_numpy())))

    return df.withColumn(to, score(F.array(*[F.col(c).cast("double") for c in features])))


def evaluate(df: DataFrame, weights: DataFrame, features: Sequence[str], label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row on a labelled table: counts, accuracy, precision, recall, fpr, fnr and the mean binary cross-entropy, in one pass.

    A probability above ``threshold`` says 1. An empty table has counts of 0 and a null loss.
    """
    scored = predict(df, weights, features, "__p").select(F.col(label).alias("__y"), "__p", (F.col("__p") > threshold).cast("int").alias("__said"))
    p = C.clip(F.col("__p"), 1e-15, 1 - 1e-15)
    scored = scored.withColumn("__loss", -F.when(F.col("__y") == 1, F.log(p)).otherwise(F.log(1 - p)))
    return evaluation.binary_metrics(scored, "__y", "__said", F.avg("__loss").alias("loss"))


class Watch:
    """Early stop and rate plateau, from the losses of a validation table round by round.

    Stops after ``patience`` rounds without a lower loss; ``best`` is the round to
    go back to. The rate is halved after ``rate_patience`` rounds without a loss
    lower by ``delta``, down to ``least_rate``.
    """

    def __init__(self, patience: int, rate_patience: int, rate: float = network.RATE, factor: float = 0.5, least_rate: float = 1e-6, delta: float = 1e-4):
        self.patience, self.rate_patience, self.rate, self.factor, self.least_rate, self.delta = patience, rate_patience, rate, factor, least_rate, delta
        self.best, self.lowest, self.plateau, self.waited = 0, float("inf"), float("inf"), 0

    def stops(self, number: int, loss: float) -> bool:
        if loss < self.lowest:
            self.best, self.lowest = number, loss
        if loss < self.plateau - self.delta:
            self.plateau, self.waited = loss, 0
        else:
            self.waited += 1
            if self.waited >= self.rate_patience:
                self.rate, self.waited = max(self.rate * self.factor, self.least_rate), 0
        return number - self.best >= self.patience


class Strategy:
    """What happens between rounds; override to change it."""

    def aggregate(self, number: int, fits: DataFrame) -> DataFrame:
        return fedavg(fits)

    def evaluate(self, number: int, weights: DataFrame) -> None:
        """Called after every round, and with 0 for the initial weights."""


def run_rounds(
    shards: DataFrame, features: Sequence[str], rounds: int, write: Callable[[DataFrame, int], DataFrame],
    strategy: Strategy | None = None, seed: int = 0, least: int = LEAST_CLIENTS, watch: Watch | None = None, validation: DataFrame | None = None,
) -> DataFrame:
    """The weights after all rounds, or with ``watch`` those of the round with the lowest loss on ``validation``.

    ``write`` stores a round's table and returns it re-read, which cuts the lineage.
    """
    strategy = strategy or Strategy()
    weights = best = write(initial(shards, features, seed), 0)
    strategy.evaluate(0, weights)
    for number in range(1, rounds + 1):
        fits = train_local(shards, weights, features, seed=seed + number, rate=watch.rate if watch else network.RATE)
        fits = write(fits, number)
        if fits.select("client_id").distinct().count() < least:
            raise ValueError(f"fewer than {least} clients in round {number}")
        weights = write(strategy.aggregate(number, fits), number)
        strategy.evaluate(number, weights)
        if watch:
            done = watch.stops(number, evaluate(validation, weights, features).first().loss)
            best = weights if watch.best == number else best
            if done:
                break
    return best if watch else weights


def poisson_totals(rate: float) -> list[float]:
    """The Poisson distribution function at 0, 1, ..., as far as doubles below 1 tell its values apart."""
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0**-53 and (k <= rate or k < rate + 60 + 12 * math.sqrt(rate)):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
        out.append(total)
        k += 1
    return out


def poisson_from_uniform(u: Column, rate: float) -> Column:
    """A Poisson draw from a uniform number below 1, by the inverse distribution, as a native expression; no draw is cut."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in poisson_totals(rate)]), lambda t: u > t))


def attack_ticks(ticks: DataFrame, per_minute: float = 6, tick_seconds: float = 1, time_scale: float = 10, seed: int = 0) -> DataFrame:
    """Add attacks: a seeded Poisson count for each (router_id, tick), the same in every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "router_id", F.col("tick").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    return ticks.withColumn("attacks", poisson_from_uniform(u, per_minute / 60 * tick_seconds * time_scale))
