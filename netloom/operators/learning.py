"""Training of multi-class networks over partitioned rows, and scoring with them.

Rows are dealt once into micro-batches of a fixed size, and these into steps. In a
step every task adds up the slopes of its micro-batches, a few of them at a time, tasks' sums are added in
a tree, and the driver, which holds one model, takes the step. Normalised layers
use the statistics of their own micro-batch, and dropout is seeded by step and
micro-batch, so the result doesn't depend on the number of partitions (but for the
order of sums of floating-point numbers). A lost task is computed anew from the
stored micro-batches and the step's parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators import balancing
from netloom.operators.classifiers import SCORED, TRANSFER_HEAD, Adam, Loss, Network, Scope, Sums, apply, group_sums, layer_of, moving, scored_parts, with_new_head
from netloom.operators.federated import Watch
from netloom.operators.ranking import with_position
from netloom.sources.sinks import shared_folder

#: Rows of a micro-batch and of a step; steps of a pass over all rows at most (beyond it, steps grow). Tasks whose sums one task adds.
MICRO, BATCH, MOST_STEPS, FAN = 128, 1024, 200, 16
#: Transfer: passes and rates while all but the new head is frozen, and while all layers learn.
FROZEN_EPOCHS, FROZEN_RATE, ALL_EPOCHS, ALL_RATE = 5, 1e-3, 50, 1e-4


@dataclass(frozen=True)
class Dealt:
    """Stored micro-batches: rows (micro, x, y) in a folder for each step, a folder in it for each of its tasks."""

    spark: SparkSession
    path: str
    rows: int
    steps: int
    micros: int

    def step(self, k: int) -> DataFrame:
        return self.spark.read.schema("micro long, x array<array<double>>, y array<int>").parquet(f"{self.path}/step={k}").select("micro", "x", "y")


def matrix(features: Sequence[str]) -> F.Column:
    """The feature columns as one array; a null counts as 0, as it does in scoring."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def deal(df: DataFrame, features: Sequence[str], label: str, micro: int = MICRO, batch: int = BATCH, seed: int = 0) -> Dealt:
    """Deal labelled rows (integers from 0) into micro-batches in hash order, the same ones in each run.

    Rows without a label go. Places in the order are counted over all rows and dealt
    out in turn, so equal rows spread over all micro-batches.
    """
    x = matrix(features)
    rows = df.filter(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("int").alias("y"))
    rows = with_position(rows, [F.xxhash64(F.lit(seed), "x", "y")], "at")
    n = rows.count()
    micros = max(1, -(-n // micro))
    steps = min(MOST_STEPS, max(1, -(-n // batch)), micros)
    dealt = rows.withColumn("micro", F.col("at") % micros).groupBy("micro").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("rows"))
    dealt = dealt.select("micro", F.col("rows.x").alias("x"), F.col("rows.y").alias("y"), (F.col("micro") % steps).cast("int").alias("step"))
    path = f"{shared_folder(df.sparkSession)}/netloom/micro-batches-{uuid.uuid4().hex}"
    if n:
        # A step's micro-batches lie in a file for each of its tasks, also where two of them were dealt together, so that no pass has to deal them again.
        each, cores = -(-micros // steps), df.sparkSession.sparkContext.defaultParallelism
        task = (F.col("micro") / steps).cast("long") % min(each, cores)
        dealt.withColumn("task", task).repartition(min(steps * min(each, cores), 4 * cores), "step", "task").write.partitionBy("step", "task").parquet(path)
    return Dealt(df.sparkSession, path, n, steps if n else 0, micros)


_SUMS = "rows long, loss double, slopes binary, batch binary"


def _row(rows: int, loss: float, own: np.ndarray, batch: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([loss]), pa.array([own.tobytes()], pa.binary()), pa.array([batch.tobytes()], pa.binary())], ["rows", "loss", "slopes", "batch"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for rows, loss, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = (rows, loss, *(np.frombuffer(p) for p in parts))
            total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
    if total is not None:
        yield _row(*total)


def _hold_memory() -> None:
    """A large piece that is freed again: from then on C's allocator keeps what a pass frees for the next one, instead of new pages for each."""
    np.empty(1 << 21)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(micro, x, y) of micro-batches that have as many rows each, together at most as many as are scored at once."""
    groups: dict[int, list] = {}
    for batch in batches:
        for micro, x, y in zip(*(batch.column(k) for k in range(3)), strict=True):
            labels = y.values.to_numpy()
            n = len(labels)
            group = groups.setdefault(n, [])
            group.append((micro.as_py(), x.values.flatten().to_numpy().reshape(n, -1), labels))
            if (len(group) + 1) * n > SCORED:
                yield groups.pop(n)
    yield from groups.values()


def _step_sums(micros: DataFrame, network: Network, params: dict[str, np.ndarray], loss: Loss, seed: int, frozen: Callable[[str], bool], tasks: int) -> Sums:
    """The sums of a step, from all its micro-batches."""
    names = [k for k in params if not moving(k) and not frozen(layer_of(k))]
    kept = [k for k in params if moving(k) and not frozen(layer_of(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for group in _groups(batches):
                micros, x, y = zip(*group, strict=True)
                s = group_sums(network, params, np.concatenate(x), np.concatenate(y), loss, [[seed, micro] for micro in micros], frozen)
                yield _row(s.rows, s.loss, np.concatenate([s.slopes[k].ravel() for k in names]), np.concatenate([s.batch[k] for k in kept] or [np.zeros(0)]))

        _hold_memory()
        yield from _added(each())

    # Read as they were dealt: no shuffle.
    sums = micros.coalesce(tasks).mapInArrow(run, _SUMS)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        sums = sums.repartition(tasks).mapInArrow(_added, _SUMS)
    # At most FAN rows of the model's size.
    found = sums.collect()
    own, batch = (sum(np.frombuffer(r[k]) for r in found) for k in ("slopes", "batch"))
    return Sums(sum(r.rows for r in found), sum(r.loss for r in found), _named(own, params, names), _named(batch, params, kept))


def _named(flat: np.ndarray, params: dict[str, np.ndarray], names: Sequence[str]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([0, *(params[k].size for k in names)])
    return {k: flat[a:b].reshape(params[k].shape) for k, a, b in zip(names, cuts, cuts[1:], strict=False)}


@dataclass
class Trained:
    """A network with its parameters, and (epoch, loss, validation loss, rate) of each pass."""

    network: Network
    params: dict[str, np.ndarray]
    history: list[tuple[int, float, float | None, float]] = field(default_factory=list)


def train(
    dealt: Dealt, network: Network, params: dict[str, np.ndarray], loss: Loss, epochs: int, rate: float, clip: float | None = None, seed: int = 0, tasks: int | None = None,
    frozen: Callable[[str], bool] = lambda layer: False, watch: Watch | None = None, validation: tuple[DataFrame, Sequence[str], str] | None = None, momentum: float = 0.99,
    keep: Callable[[int, dict[str, np.ndarray]], None] | None = None,
) -> Trained:
    """Passes over all steps by Adam, in an order that the seed and the epoch give.

    With ``watch`` and ``validation`` (table, features, label) the pass with the
    lowest loss there gives the parameters, the rate falls on a plateau, and training
    may end early. frozen: layers that stay as they are, bit by bit. keep: called
    with the parameters after each pass. No rows: the parameters stay.
    """
    spark = dealt.spark
    tasks = tasks or max(1, min(-(-dealt.micros // max(1, dealt.steps)), spark.sparkContext.defaultParallelism))
    adam, best, history = Adam(rate, clip), params, []
    for epoch in range(1, epochs + 1 if dealt.rows else 1):
        added = 0.0
        for k in np.random.default_rng([seed, epoch]).permutation(dealt.steps).tolist():
            sums = _step_sums(dealt.step(k), network, params, loss, (seed << 32) + adam.step, frozen, tasks)
            params = apply(params, sums, adam, momentum)
            added += sums.loss
        lost = mean_loss(validation[0], network, params, validation[1], validation[2], loss) if validation else None
        history.append((epoch, added / dealt.rows, lost, adam.rate))
        if keep:
            keep(epoch, params)
        if watch and lost is not None:
            ends = watch.stops(epoch, lost)
            best, adam.rate = params if watch.best == epoch else best, watch.rate
            if ends:
                break
    return Trained(network, best if watch and validation else params, history)


def predict(df: DataFrame, model: Trained, features: Sequence[str], to: str = "probabilities") -> DataFrame:
    """Add each row's probabilities of the classes, batch by batch; all columns stay, one named ``to`` is replaced."""
    network, params = model.network, model.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_memory()
        for batch in batches:
            last = batch.num_columns - 1
            own = np.zeros((0, network.classes))
            if batch.num_rows:
                values = batch.column(last).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = network.probabilities(params, values)
            offsets = pa.array(np.arange(batch.num_rows + 1) * network.classes, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))], [*kept, to])

    kept = [c for c in df.columns if c != to]
    # Columns by number on the way in: a name may hold a dot.
    rows = df.select(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(kept)], matrix(features).alias("features"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(to, T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def mean_loss(df: DataFrame, network: Network, params: dict[str, np.ndarray], features: Sequence[str], label: str, loss: Loss) -> float:
    """The mean loss of a labelled table, without dropout and class weights; infinite without rows."""
    plain = Loss(None, loss.smoothing, loss.gamma, loss.alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_memory()
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = _lost(network, params, x, batch.column(1).to_numpy(), plain)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([own])], ["n", "lost"])

    rows = df.filter(F.col(label).isNotNull()).select(matrix(features).alias("x"), F.col(label).cast("int").alias("y"))
    found = rows.mapInArrow(run, "n long, lost double").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).first()
    return found.lost / found.n if found.n else float("inf")


def _lost(network: Network, params: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, loss: Loss) -> float:
    return sum(float(loss(network.logits(Scope(params), x[rows]), y[rows]).value) for rows in scored_parts(len(x)))


# --- parameters as tables -------------------------------------------------------


def to_table(spark: SparkSession, params: dict[str, np.ndarray], version: int = 0) -> DataFrame:
    """(version, layer, part, pos, w): every parameter, moving statistics too."""
    parts = [pd.DataFrame({"version": version, "layer": layer_of(k), "part": k.rpartition("/")[2], "pos": np.arange(v.size), "w": v.ravel()}) for k, v in params.items()]
    return spark.createDataFrame(pd.concat(parts), "version int, layer string, part string, pos int, w double")


def from_table(table: DataFrame, network: Network, version: int = 0) -> dict[str, np.ndarray]:
    """The parameters of a version; the network gives their shapes. A layer that it hasn't, or that the table hasn't, is an error."""
    rows = table.filter(F.col("version") == version).select("layer", "part", "pos", "w").toPandas()
    out = network.start()
    found = {f"{layer}/{part}": own.sort_values("pos")["w"].to_numpy() for (layer, part), own in rows.groupby(["layer", "part"])}
    if {k: v.size for k, v in found.items()} != {k: v.size for k, v in out.items()}:
        raise ValueError("the table holds the parameters of another network")
    return {k: found[k].reshape(v.shape) for k, v in out.items()}


# --- the two training recipes ---------------------------------------------------


def by_class(df: DataFrame, label: str, classes: int, weights: DataFrame, name: str, default: float) -> list[float]:
    """A per-class column as a list by class; ``default`` for classes without rows."""
    found = {int(r[label]): float(r[name]) for r in weights.filter(F.col(label).isNotNull()).collect()}
    return [found.get(k, default) for k in range(classes)]


def focal_loss_of(df: DataFrame, label: str, classes: int, gamma: float = 2.0, low: float = 0.5, high: float = 5.0) -> Loss:
    """Focal loss with alpha from the training rows' class counts."""
    domain = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    alpha = balancing.focal_alpha(df.select(F.col(label).cast("int").alias(label)), label, domain, low, high)
    return Loss(gamma=gamma, alpha=by_class(df, label, classes, alpha, "alpha", high))


def weighted_loss_of(df: DataFrame, label: str, classes: int) -> Loss:
    """Cross-entropy with balanced class weights; classes without rows have a weight of 1."""
    return Loss(weights=by_class(df, label, classes, balancing.class_weights(df.filter(F.col(label).isNotNull()), label), "weight", 1.0))


def transfer(
    base: Trained, dealt: Dealt, classes: int, loss: Loss | None = None, frozen_epochs: int = FROZEN_EPOCHS, epochs: int = ALL_EPOCHS, seed: int = 0, tasks: int | None = None,
    validation: tuple[DataFrame, Sequence[str], str] | None = None, momentum: float = 0.99, rates: tuple[float, float] = (FROZEN_RATE, ALL_RATE),
    keep: Callable[[int, dict[str, np.ndarray]], None] | None = None,
) -> tuple[Trained, Trained]:
    """(after the first phase, after the second): ``base`` with a new head for other classes.

    First the head alone learns; every other parameter and moving statistic keeps
    its bits. Then all layers learn at a lower rate. Each phase has an optimiser of
    its own, and with ``validation`` stops early (6 passes, rate halved after 3).
    """
    loss = loss or Loss()
    n = base.network
    network, params = with_new_head(base.params, Network(n.name, n.inputs, classes, n.options), seed)
    watch = lambda rate: Watch(6, 3, rate) if validation else None
    first = train(dealt, network, params, loss, frozen_epochs, rates[0], seed=seed, tasks=tasks, frozen=lambda layer: layer != TRANSFER_HEAD, watch=watch(rates[0]), validation=validation, momentum=momentum, keep=keep)
    later = (lambda epoch, p: keep(frozen_epochs + epoch, p)) if keep else None
    second = train(dealt, network, first.params, loss, epochs, rates[1], seed=seed + 1, tasks=tasks, watch=watch(rates[1]), validation=validation, momentum=momentum, keep=later)
    return first, second
