"""From prepared rows to a trained network and its report: the base training, and transfer to other classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import balancing, encoding, evaluation, learning
from netloom.operators.classifiers import Loss, Network
from netloom.operators.federated import Watch
from netloom.operators.learning import Trained
from netloom.plans import training
from netloom.sources.sinks import stored


@dataclass(frozen=True)
class Recipe:
    """How a network is trained.

    focal: focal loss with alpha by class counts, else cross-entropy with balanced
    class weights. oversample: fill up the training part's smaller classes first.
    """

    network: str
    options: dict = field(default_factory=dict)
    focal: bool = True
    oversample: bool = False
    rate: float = 5e-4
    clip: float | None = 1.0
    epochs: int = 100
    patience: int = 12
    rate_patience: int = 4
    micro: int = learning.MICRO
    batch: int = learning.BATCH
    momentum: float = 0.99


#: Fixed values of the two pipelines: the separable network with focal loss, the recurrent one with oversampling and class weights.
RECIPES = {
    "se_dwnet": Recipe("se_dwnet"),
    "resnet_mlp": Recipe("resnet_mlp"),
    "bilstm": Recipe("bilstm", focal=False, oversample=True, rate=1e-3, clip=None, patience=15, rate_patience=5),
}


@dataclass
class Result:
    """The model, what was fitted for its inputs, its classes (value, code), and the scored test part (truth, said)."""

    model: Trained
    fitted: training.Fitted
    classes: DataFrame
    scored: DataFrame

    def report(self) -> DataFrame:
        """(label, precision, recall, f1, support) on the test part."""
        return evaluation.classification_report(self.scored, "truth", "said", self.classes.select(F.col("value").alias("class")))


def base_training(flows: DataFrame, target: str, columns: Sequence[str], recipe: Recipe, seed: int = 0, k: int = 25, **prepare: object) -> Result:
    """Prepare, split 60/20/20, train on the first part, watch the second, score the third. See ``training.prepare``."""
    rows, fitted = training.prepare(flows, target, columns, k=k, seed=seed, **prepare)
    rows = stored(rows, "prepared")
    model, scored = _fit(rows, fitted.features, fitted.classes, target, recipe, seed)
    return Result(model, fitted, fitted.classes, scored)


def _fit(rows: DataFrame, features: Sequence[str], classes: DataFrame, target: str, recipe: Recipe, seed: int) -> tuple[Trained, DataFrame]:
    n = classes.count()
    train = rows.filter("part = 'train'").select("class_code", *features)
    if recipe.oversample:
        keyed = train.withColumn("__key", F.xxhash64(*train.columns))
        train = stored(balancing.smote(keyed, features, "class_code", "__key", seed).select("class_code", *features), "oversampled")
    loss = learning.focal_loss_of(train, "class_code", n) if recipe.focal else learning.weighted_loss_of(train, "class_code", n)
    dealt = learning.deal(train, features, "class_code", recipe.micro, recipe.batch, seed)
    network = Network(recipe.network, len(features), n, recipe.options)
    watch = Watch(recipe.patience, recipe.rate_patience, recipe.rate)
    validation = rows.filter("part = 'val'"), features, "class_code"
    model = learning.train(dealt, network, network.start(seed), loss, recipe.epochs, recipe.rate, recipe.clip, seed, watch=watch, validation=validation, momentum=recipe.momentum)
    return model, _scored(rows, model, features, classes, target)


def _scored(rows: DataFrame, model: Trained, features: Sequence[str], classes: DataFrame, target: str) -> DataFrame:
    """(truth, said, confidence) of the test part."""
    test = learning.predict(rows.filter("part = 'test'").select(target, *features), model, features)
    said = encoding.decode(evaluation.with_prediction_confidence(test, "probabilities"), "predicted", classes, "said")
    return stored(said.select(F.col(target).cast("string").alias("truth"), "said", "confidence"), "scored")


def transfer_training(
    base: Result, flows: DataFrame, target: str, columns: Sequence[str], recipe: Recipe, seed: int = 0, frozen_epochs: int = learning.FROZEN_EPOCHS, epochs: int = learning.ALL_EPOCHS,
    rates: tuple[float, float] = (learning.FROZEN_RATE, learning.ALL_RATE),
) -> Result:
    """Other flows with other classes: the base's fitted inputs and layers, a new head, two phases; see ``learning.transfer``.

    Inputs that the base doesn't know count as missing or unknown; classes are
    those of the new training part.
    """
    from netloom.operators import splitting

    split = stored(splitting.train_val_test(flows, target, [c for c in columns if c in flows.columns], seed=seed), "split")
    classes = stored(encoding.fit_classes(split.filter("part = 'train'"), target), "classes")
    rows = training.transform(split, base.fitted, target, keep=["part"]).drop("class_code")
    features = base.fitted.features
    rows = encoding.apply_codes(rows, target, classes, "class_code", F.lit(None)).select("part", target, "class_code", *features)
    rows = stored(rows, "prepared")
    dealt = learning.deal(rows.filter("part = 'train'"), features, "class_code", recipe.micro, recipe.batch, seed)
    validation = rows.filter("part = 'val'"), features, "class_code"
    _, model = learning.transfer(base.model, dealt, classes.count(), Loss(), frozen_epochs, epochs, seed, validation=validation, momentum=recipe.momentum, rates=rates)
    return Result(model, base.fitted, classes, _scored(rows, model, features, classes, target))
