"""Arrays that remember how they were made, so that the slope of a sum of losses reaches every parameter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Var:
    """A value and, for each value it was made from, how a slope is handed back to that one."""

    __slots__ = ("value", "parents", "slope")

    def __init__(self, value: np.ndarray, *parents: tuple[Var, Callable[[np.ndarray], np.ndarray]]):
        self.value, self.parents, self.slope = np.asarray(value, float), parents, None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other: Var | float) -> Var:
        other = of(other)
        return Var(self.value + other.value, (self, lambda g: _fit(g, self.shape)), (other, lambda g: _fit(g, other.shape)))

    def __mul__(self, other: Var | float) -> Var:
        other = of(other)
        return Var(self.value * other.value, (self, lambda g: _fit(g * other.value, self.shape)), (other, lambda g: _fit(g * self.value, other.shape)))

    def __sub__(self, other: Var | float) -> Var:
        return self + of(other) * -1.0

    def __matmul__(self, other: Var) -> Var:
        a, b = self.value, other.value

        def to_other(g: np.ndarray) -> np.ndarray:
            if b.ndim == 2:
                return a.reshape(-1, a.shape[-1]).T @ g.reshape(-1, g.shape[-1])
            return np.swapaxes(a, -1, -2) @ g

        return Var(_product(a, b), (self, lambda g: _product(g, np.swapaxes(b, -1, -2))), (other, to_other))

    def __getitem__(self, part: tuple) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros(self.shape)
            out[part] = g
            return out

        return Var(self.value[part], (self, back))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; one matrix for all of a is one product, not one for each row."""
    return (a.reshape(-1, a.shape[-1]) @ b).reshape(*a.shape[:-1], -1) if b.ndim == 2 and a.ndim > 2 and a.size else a @ b


def of(x: Var | float | np.ndarray) -> Var:
    return x if isinstance(x, Var) else Var(np.asarray(x, float))


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a slope over the axes along which its value was repeated."""
    g = g.sum(tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    axes = tuple(k for k, n in enumerate(shape) if n == 1 and g.shape[k] != 1)
    return g.sum(axes, keepdims=True) if axes else g


def relu(x: Var) -> Var:
    return Var(np.maximum(x.value, 0), (x, lambda g: g * (x.value > 0)))


def _gate(x: np.ndarray) -> np.ndarray:
    y = np.clip(x, -500, 500)
    for f in (np.negative, np.exp):
        f(y, out=y)
    y += 1
    return np.divide(1, y, out=y)


def sigmoid(x: Var) -> Var:
    y = _gate(x.value)
    return Var(y, (x, lambda g: g * y * (1 - y)))


def tanh(x: Var) -> Var:
    y = np.tanh(x.value)
    return Var(y, (x, lambda g: g * (1 - y * y)))


def log(x: Var, least: float = 1e-7) -> Var:
    """The logarithm of values of at least ``least``; smaller ones count as that, without a slope."""
    held = np.maximum(x.value, least)
    return Var(np.log(held), (x, lambda g: g * (x.value >= least) / held))


def power(x: Var, n: float) -> Var:
    """x to a constant power; a base of 0 has no slope below the power 1."""
    def back(g: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return g * n * np.where((x.value == 0) & (n < 1), 0.0, x.value ** (n - 1))

    return Var(x.value**n, (x, back))


def mean(x: Var, axes: tuple[int, ...]) -> Var:
    """The mean along axes, which stay with a length of 1."""
    n = int(np.prod([x.shape[a] for a in axes]))
    return Var(x.value.mean(axes, keepdims=True), (x, lambda g: np.broadcast_to(g / n, x.shape)))


def total(x: Var) -> Var:
    return Var(x.value.sum(), (x, lambda g: np.broadcast_to(g, x.shape)))


def softmax(x: Var) -> Var:
    """Along the last axis."""
    e = np.exp(x.value - x.value.max(-1, keepdims=True))
    y = e / e.sum(-1, keepdims=True)
    return Var(y, (x, lambda g: y * (g - (g * y).sum(-1, keepdims=True))))


def reshape(x: Var, shape: Sequence[int]) -> Var:
    return Var(x.value.reshape(shape), (x, lambda g: g.reshape(x.shape)))


def transpose(x: Var, axes: Sequence[int]) -> Var:
    return Var(x.value.transpose(axes), (x, lambda g: g.transpose(np.argsort(axes))))


def join(parts: Sequence[Var], axis: int) -> Var:
    cuts = np.cumsum([0, *(p.shape[axis] for p in parts)])

    def back(k: int) -> Callable[[np.ndarray], np.ndarray]:
        return lambda g: g[(slice(None),) * (axis % g.ndim) + (slice(cuts[k], cuts[k + 1]),)]

    return Var(np.concatenate([p.value for p in parts], axis), *((p, back(k)) for k, p in enumerate(parts)))


def pad(x: Var, before: int, after: int) -> Var:
    """Zeros before and behind the second axis."""
    n = x.shape[1]
    return Var(np.pad(x.value, ((0, 0), (before, after), *((0, 0),) * (x.value.ndim - 2))), (x, lambda g: g[:, before : before + n]))


def recurrent(drive: Var, again: Var, backwards: bool = False) -> Var:
    """The states of an LSTM after each step (rows, steps, units), in the order of the steps, in one piece.

    drive: what the inputs give to the gates (rows, steps, 4 units), in the order input,
    forget, candidate, output; again: what the last state gives to them, as a matrix.
    """
    n, steps, rows = again.shape[0], drive.shape[1], drive.shape[0]
    # Columns lie one below the other, so that each gate is one piece.
    given, left = np.ascontiguousarray(drive.value.transpose(1, 2, 0)), np.ascontiguousarray(again.value.T)
    i, f, g, o = (slice(k * n, (k + 1) * n) for k in range(4))
    gates, (cells, bent, states) = [np.zeros(0)] * steps, np.empty((3, steps, n, rows))
    way = [*range(steps)][:: -1 if backwards else 1]
    h = c = np.zeros((n, rows))
    for t in way:
        z = left @ h
        z += given[t]
        # tanh(x) = 2 / (1 + exp(-2 x)) - 1
        z[g] *= 2
        y = gates[t] = _gate(z)
        y[g] *= 2
        y[g] -= 1
        c = cells[t] = y[f] * c + y[i] * y[g]
        bent[t] = 2 * _gate(2 * c) - 1
        h = np.multiply(y[o], bent[t], out=states[t])
    done: list[np.ndarray] = []

    def back(slope: np.ndarray) -> np.ndarray:
        """Slopes of what drives the gates (steps, 4 units, rows)."""
        if not done:
            slope, out = np.ascontiguousarray(slope.transpose(1, 2, 0)), np.empty((steps, 4 * n, rows))
            h = c = 0.0
            for k in reversed(range(steps)):
                t = way[k]
                y, own = gates[t], out[t]
                h = slope[t] + h
                c = c + h * y[o] * (1 - bent[t] * bent[t])
                own[i] = c * y[g]
                own[f] = c * cells[way[k - 1]] if k else 0.0
                own[g] = c * y[i] * (1 - y[g] * y[g])
                own[o] = h * bent[t]
                for part in (slice(0, 2 * n), o):
                    own[part] *= y[part] * (1 - y[part])
                h, c = again.value @ own, c * y[f]
            done.append(out)
        return done[0]

    def to_again(slope: np.ndarray) -> np.ndarray:
        out = back(slope)
        return sum((states[a] @ out[b].T for a, b in zip(way, way[1:], strict=False)), np.zeros(again.shape))

    return Var(states.transpose(2, 0, 1), (drive, lambda slope: np.ascontiguousarray(back(slope).transpose(2, 0, 1))), (again, to_again))


def hand_back(result: Var) -> None:
    """Give every value that ``result`` (a number) depends on its slope."""
    order: list[Var] = []
    seen: set[int] = set()
    stack = [(result, False)]
    while stack:
        v, ready = stack.pop()
        if ready:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(p, False) for p, _ in v.parents]
    result.slope = np.ones(result.shape)
    for v in reversed(order):
        for p, back in v.parents:
            g = back(v.slope)
            p.slope = g if p.slope is None else p.slope + g
