"""Multi-class networks over feature columns: separable convolutions, recurrent layers, gated dense layers.

A network is a function of a ``Scope`` and a batch; it names its layers, and the
scope makes their parameters on first use. ``BUILDERS`` chooses one by name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from netloom.operators import slopes
from netloom.operators.slopes import Var

#: Fixed values of the layers: the moving average's momentum, the least variance of both normalisations.
MOMENTUM, LEAST_VARIANCE = 0.99, 1e-3
#: The layer that says the classes, and the one that takes its place when other classes are learned.
HEAD, TRANSFER_HEAD = "head", "transfer_head"
#: Rows that are scored at once: a pass keeps what every layer gives for all its rows.
SCORED = 256


class Scope:
    """The parameters of a network by name ("layer/part"), and what one pass over a batch needs and leaves.

    train: batch statistics and dropout (by ``rngs``, one for each micro-batch; micro-batches
    have as many rows each and lie one below the other). frozen: layers whose
    parameters stay; their normalisations use the moving statistics, as in scoring.
    """

    def __init__(self, params: dict[str, np.ndarray], seed: int = 0, train: bool = False, rngs: Sequence[np.random.Generator] = (), frozen: Callable[[str], bool] = lambda layer: False):
        self.params, self.seed, self.train, self.rngs, self.frozen = params, seed, train, rngs, frozen
        self.used: dict[str, Var] = {}
        self.batch: dict[str, np.ndarray] = {}

    def value(self, name: str, shape: Sequence[int], start: Callable[[np.random.Generator, tuple[int, ...]], np.ndarray]) -> np.ndarray:
        if name not in self.params:
            self.params[name] = start(np.random.default_rng([self.seed, zlib.crc32(name.encode())]), tuple(shape))
        return self.params[name]

    def param(self, name: str, shape: Sequence[int], start: Callable) -> Var:
        if name not in self.used:
            self.used[name] = Var(self.value(name, shape, start))
        return self.used[name]

    def trains(self, layer: str) -> bool:
        return self.train and not self.frozen(layer)


def zeros(_: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    return np.zeros(shape)


def ones(_: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    return np.ones(shape)


def he_normal(rng: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    """A normal distribution cut at two deviations, for as many inputs as all axes but the last have."""
    draws = rng.standard_normal((8, *shape))
    inside = np.abs(draws) <= 2
    first = np.take_along_axis(draws, inside.argmax(0)[None], 0)[0]
    return np.clip(first, -2, 2) / 0.87962566103423978 * np.sqrt(2 / max(1, np.prod(shape[:-1])))


def glorot_uniform(rng: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    edge = np.sqrt(6 / (np.prod(shape[:-1]) + shape[-1]))
    return rng.uniform(-edge, edge, shape)


def orthogonal(rng: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    q, r = np.linalg.qr(rng.standard_normal((max(shape), min(shape))))
    q = q * np.sign(np.diag(r))
    return q if shape[0] >= shape[1] else q.T


def dense(s: Scope, layer: str, x: Var, units: int, start: Callable = glorot_uniform, bias: bool = True) -> Var:
    y = x @ s.param(f"{layer}/kernel", (x.shape[-1], units), start)
    return y + s.param(f"{layer}/bias", (units,), zeros) if bias else y


def _taps(x: Var, width: int, stride: int) -> list[Var]:
    """The inputs at each place of a window over the second axis, padded so that length / stride outputs (rounded up) result."""
    n = x.shape[1]
    outputs = -(-n // stride)
    missing = max(0, (outputs - 1) * stride + width - n)
    x = slopes.pad(x, missing // 2, missing - missing // 2)
    return [x[:, k : k + (outputs - 1) * stride + 1 : stride] for k in range(width)]


def convolution(s: Scope, layer: str, x: Var, filters: int, width: int, stride: int = 1) -> Var:
    kernel = s.param(f"{layer}/kernel", (width, x.shape[-1], filters), he_normal)
    parts = [tap @ kernel[k] for k, tap in enumerate(_taps(x, width, stride))]
    return sum(parts[1:], parts[0]) + s.param(f"{layer}/bias", (filters,), zeros)


def separable(s: Scope, layer: str, x: Var, filters: int, width: int, stride: int = 1) -> Var:
    """A convolution of each channel by itself, then a mixture of the channels at each place."""
    deep = s.param(f"{layer}/depthwise", (width, x.shape[-1]), lambda rng, shape: he_normal(rng, (*shape, 1))[..., 0])
    parts = [tap * deep[k] for k, tap in enumerate(_taps(x, width, stride))]
    return dense(s, layer, sum(parts[1:], parts[0]), filters, he_normal)


def normalise(s: Scope, layer: str, x: Var) -> Var:
    """Batch normalisation over all axes but the last; in training each micro-batch by itself, whose statistics are left for the moving ones."""
    n, shape = x.shape[-1], x.shape
    moving = s.value(f"{layer}/mean", (n,), zeros), s.value(f"{layer}/variance", (n,), ones)
    if s.trains(layer):
        x = slopes.reshape(x, (len(s.rngs), -1, *shape[1:]))
        axes = tuple(range(1, x.value.ndim - 1))
        middle = slopes.mean(x, axes)
        off = x - middle
        spread = slopes.mean(off * off, axes)
        s.batch[f"{layer}/mean"], s.batch[f"{layer}/variance"] = (v.value.reshape(-1, n).sum(0) for v in (middle, spread))
    else:
        off, spread = x - moving[0], slopes.of(moving[1])
    y = slopes.reshape(off * slopes.power(spread + LEAST_VARIANCE, -0.5), shape)
    return y * s.param(f"{layer}/gamma", (n,), ones) + s.param(f"{layer}/beta", (n,), zeros)


def normalise_rows(s: Scope, layer: str, x: Var) -> Var:
    """Layer normalisation over the last axis."""
    off = x - slopes.mean(x, (x.value.ndim - 1,))
    y = off * slopes.power(slopes.mean(off * off, (x.value.ndim - 1,)) + LEAST_VARIANCE, -0.5)
    return y * s.param(f"{layer}/gamma", x.shape[-1:], ones) + s.param(f"{layer}/beta", x.shape[-1:], zeros)


def dropout(s: Scope, x: Var, rate: float) -> Var:
    if not s.train or not rate:
        return x
    drawn = np.concatenate([rng.random((x.shape[0] // len(s.rngs), *x.shape[1:])) for rng in s.rngs])
    return x * ((drawn >= rate) / (1 - rate))


def squeeze_excite(s: Scope, layer: str, x: Var, reduction: int = 16) -> Var:
    """Each channel times a gate that follows from all channels' means."""
    gate = slopes.relu(dense(s, f"{layer}/down", slopes.mean(x, (1,)), max(4, x.shape[-1] // reduction), he_normal, bias=False))
    return x * slopes.sigmoid(dense(s, f"{layer}/up", gate, x.shape[-1], he_normal, bias=False))


def lstm(s: Scope, layer: str, x: Var, units: int, backwards: bool = False) -> Var:
    """The state after each step, in the order of the steps; gates in the order input, forget, candidate, output."""
    unit_forget = lambda rng, shape: np.repeat([0.0, 1.0, 0.0, 0.0], units)  # noqa: E731, ARG005
    drive = dense(s, layer, x, 4 * units, bias=False) + s.param(f"{layer}/bias", (4 * units,), unit_forget)
    return slopes.recurrent(drive, s.param(f"{layer}/recurrent", (units, 4 * units), orthogonal), backwards)


def both_ways(s: Scope, layer: str, x: Var, units: int, sequence: bool) -> Var:
    """A forward and a backward LSTM side by side: at each step, or the last state of either."""
    ahead, back = lstm(s, f"{layer}/ahead", x, units), lstm(s, f"{layer}/back", x, units, backwards=True)
    return slopes.join([ahead, back], 2) if sequence else slopes.join([ahead[:, -1], back[:, 0]], 1)


def attention(s: Scope, layer: str, x: Var, heads: int, size: int, rate: float = 0.0) -> Var:
    """Multi-head self-attention over the second axis; output as wide as the input."""
    rows, n, width = x.shape
    split = lambda part: slopes.transpose(slopes.reshape(dense(s, f"{layer}/{part}", x, heads * size), (rows, n, heads, size)), (0, 2, 1, 3))
    q, k, v = split("query"), split("key"), split("value")
    weights = dropout(s, slopes.softmax((q * size**-0.5) @ slopes.transpose(k, (0, 1, 3, 2))), rate)
    mixed = slopes.reshape(slopes.transpose(weights @ v, (0, 2, 1, 3)), (rows, n, heads * size))
    return dense(s, f"{layer}/out", mixed, width)


# --- networks -----------------------------------------------------------------


def se_dwnet(s: Scope, x: Var, stem: int = 64, stages: Sequence[tuple[int, int]] = ((64, 1), (128, 2), (256, 2)), rate: float = 0.5) -> Var:
    """Columns as one signal: a convolution, residual stages (filters, stride) of separable ones with gated channels, means over the signal."""
    x = slopes.reshape(x, (*x.shape, 1))
    x = slopes.relu(normalise(s, "stem/norm", convolution(s, "stem/conv", x, stem, 3)))
    for k, (filters, stride) in enumerate(stages):
        stage, past = f"stage{k}", x
        if stride > 1 or filters != x.shape[-1]:
            past = normalise(s, f"{stage}/past_norm", convolution(s, f"{stage}/past", x, filters, 1, stride))
        x = slopes.relu(normalise(s, f"{stage}/norm1", separable(s, f"{stage}/conv1", x, filters, 3, stride)))
        x = normalise(s, f"{stage}/norm2", separable(s, f"{stage}/conv2", x, filters, 3))
        x = slopes.relu(squeeze_excite(s, f"{stage}/gate", x) + past)
    means = slopes.mean(x, (1,))
    return dropout(s, slopes.reshape(means, (x.shape[0], x.shape[-1])), rate)


def resnet_mlp(s: Scope, x: Var, width: int = 256, rate: float = 0.3, heads: int = 0, key_size: int = 8, attention_rate: float = 0.0) -> Var:
    """Dense layers with one gated residual part; with ``heads``, columns attend to one another first.

    What attention gives is normalised over the columns: a column is one number,
    and normalised by itself would always be 0.
    """
    if heads:
        tokens = slopes.reshape(x, (*x.shape, 1))
        x = normalise_rows(s, "columns/norm", slopes.reshape(tokens + attention(s, "columns", tokens, heads, key_size, attention_rate), x.shape))
    layer = lambda name, x: normalise(s, f"{name}/norm", dense(s, name, x, width, he_normal))
    x = past = dropout(s, slopes.relu(layer("dense0", x)), rate)
    x = layer("dense2", dropout(s, slopes.relu(layer("dense1", x)), rate))
    gate = slopes.relu(dense(s, "gate0", x, width, he_normal))
    return slopes.relu(x * slopes.sigmoid(dense(s, "gate1", gate, width, he_normal)) + past)


def bilstm(s: Scope, x: Var, units: Sequence[int] = (128, 64, 32), rates: Sequence[float] = (0.3, 0.3, 0.2), width: int = 64, steps: int = 1) -> Var:
    """Stacked bidirectional LSTMs over ``steps`` equal parts of the columns (one step: all columns at once), each normalised."""
    x = slopes.reshape(x, (x.shape[0], steps, x.shape[1] // steps))
    for k, (n, rate) in enumerate(zip(units, rates, strict=True)):
        x = dropout(s, normalise(s, f"lstm{k}/norm", both_ways(s, f"lstm{k}", x, n, k < len(units) - 1)), rate)
    return dropout(s, slopes.relu(dense(s, "dense", x, width)), rates[-1])


BUILDERS: dict[str, Callable[..., Var]] = {"se_dwnet": se_dwnet, "resnet_mlp": resnet_mlp, "bilstm": bilstm}


@dataclass(frozen=True)
class Network:
    """A builder by name with its options, the number of columns and of classes, and the name of the last layer."""

    name: str
    inputs: int
    classes: int
    options: dict = field(default_factory=dict)
    head: str = HEAD

    def __post_init__(self) -> None:
        if self.name not in BUILDERS:
            raise ValueError(f"no network {self.name!r}; there are {', '.join(BUILDERS)}")

    def logits(self, s: Scope, x: np.ndarray) -> Var:
        return dense(s, self.head, BUILDERS[self.name](s, Var(x), **self.options), self.classes)

    def start(self, seed: int = 0) -> dict[str, np.ndarray]:
        """Seeded parameters; those of a layer don't depend on the others."""
        params: dict[str, np.ndarray] = {}
        self.logits(Scope(params, seed), np.zeros((1, self.inputs)))
        return params

    def probabilities(self, params: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        """A part of the rows at a time, so that memory doesn't grow with them."""
        parts = [slopes.softmax(self.logits(Scope(params), np.nan_to_num(x[rows]))).value for rows in scored_parts(len(x))]
        return np.concatenate(parts) if parts else np.zeros((0, self.classes))


def scored_parts(n: int) -> list[slice]:
    return [slice(i, i + SCORED) for i in range(0, n, SCORED)]


def moving(name: str) -> bool:
    """Whether a parameter is a statistic that no slope changes."""
    return name.endswith(("/mean", "/variance"))


def layer_of(name: str) -> str:
    return name.rpartition("/")[0]


@dataclass(frozen=True)
class Loss:
    """Cross-entropy of the softmax, summed over rows: by class weights, with smoothed labels, or focal (gamma, alpha by class)."""

    weights: Sequence[float] | None = None
    smoothing: float = 0.0
    gamma: float | None = None
    alpha: Sequence[float] | None = None

    def __call__(self, z: Var, y: np.ndarray) -> Var:
        n = z.shape[1]
        truth = np.eye(n)[y] * (1 - self.smoothing) + self.smoothing / n
        q = slopes.softmax(z)
        each = slopes.log(q) * -truth
        if self.gamma is not None:
            each = each * slopes.power(q * -1.0 + 1.0, self.gamma) * (np.ones(n) if self.alpha is None else np.asarray(self.alpha, float))
        if self.weights is not None:
            each = each * np.asarray(self.weights, float)[y][:, None]
        return slopes.total(each)


@dataclass
class Sums:
    """What a batch adds to a step: rows, loss, slopes of the parameters, and statistics of normalised layers times rows."""

    rows: int
    loss: float
    slopes: dict[str, np.ndarray]
    batch: dict[str, np.ndarray]


def batch_sums(network: Network, params: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, loss: Loss, seed: Sequence[int], frozen: Callable[[str], bool] = lambda layer: False) -> Sums:
    """One batch's part of a step; batch statistics are this batch's own."""
    return group_sums(network, params, x, y, loss, [seed], frozen)


def group_sums(network: Network, params: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, loss: Loss, seeds: Sequence[Sequence[int]], frozen: Callable[[str], bool] = lambda layer: False) -> Sums:
    """The parts of a step of several batches, a seed each, of as many rows each: what ``batch_sums`` gives for each, added up."""
    s = Scope(params, train=True, rngs=[np.random.default_rng(list(seed)) for seed in seeds], frozen=frozen)
    result = loss(network.logits(s, np.nan_to_num(x)), y)
    slopes.hand_back(result)
    own = {k: v.slope for k, v in s.used.items() if v.slope is not None and not frozen(layer_of(k))}
    return Sums(len(y), float(result.value), own, {k: v * (len(y) // len(seeds)) for k, v in s.batch.items()})


class Adam:
    """Adam over named parameters; each slope is cut to a norm of at most ``clip``. Only what has a slope moves."""

    def __init__(self, rate: float, clip: float | None = None):
        self.rate, self.clip, self.step = rate, clip, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def update(self, params: dict[str, np.ndarray], own: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, g in own.items():
            if self.clip and (norm := float(np.linalg.norm(g))) > self.clip:
                g = g * (self.clip / norm)
            m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * g
            v = self.v[name] = 0.999 * self.v.get(name, 0.0) + 0.001 * g * g
            params[name] = params[name] - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)


def apply(params: dict[str, np.ndarray], sums: Sums, adam: Adam, momentum: float = MOMENTUM) -> dict[str, np.ndarray]:
    """The parameters after a step; moving statistics take a part of the step's own."""
    out = dict(params)
    adam.update(out, {k: g / sums.rows for k, g in sums.slopes.items()})
    for name, x in sums.batch.items():
        out[name] = momentum * out[name] + (1 - momentum) * x / sums.rows
    return out


def with_new_head(base: dict[str, np.ndarray], network: Network, seed: int = 0) -> tuple[Network, dict[str, np.ndarray]]:
    """``network`` (for other classes) with its last layer named TRANSFER_HEAD and new, and all other layers of ``base``."""
    other = Network(network.name, network.inputs, network.classes, network.options, TRANSFER_HEAD)
    fresh = other.start(seed)
    return other, {k: (v if layer_of(k) == TRANSFER_HEAD else base[k].copy()) for k, v in fresh.items()}
