"""A small reverse-mode differentiator over numpy arrays, enough for the networks of the detectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The gradient summed over what broadcasting repeated."""
    grad = grad.sum(axis=tuple(range(grad.ndim - len(shape))))
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and grad.shape[i] != 1)
    return grad.sum(axis=wide, keepdims=True) if wide else grad


class Var:
    """An array with what made it; ``back`` gives gradients for its parents."""

    __array_priority__ = 100

    def __init__(self, value, parents: tuple["Var", ...] = (), back: Callable | None = None):
        self.value, self.parents, self.back, self.grad = np.asarray(value, float), parents, back, None

    def __add__(self, other):
        o = as_var(other)
        return Var(self.value + o.value, (self, o), lambda g: (_fit(g, self.value.shape), _fit(g, o.value.shape)))

    def __mul__(self, other):
        o = as_var(other)
        return Var(self.value * o.value, (self, o), lambda g: (_fit(g * o.value, self.value.shape), _fit(g * self.value, o.value.shape)))

    def __sub__(self, other):
        return self + as_var(other) * -1.0

    def __matmul__(self, other):
        o = as_var(other)
        return Var(
            self.value @ o.value,
            (self, o),
            lambda g: (_fit(g @ np.swapaxes(o.value, -1, -2), self.value.shape), _fit(np.swapaxes(self.value, -1, -2) @ g, o.value.shape)),
        )

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return (out,)

        return Var(self.value[at], (self,), back)

    def reshape(self, *shape):
        return Var(self.value.reshape(shape), (self,), lambda g: (g.reshape(self.value.shape),))

    def swap(self, a: int, b: int):
        return Var(np.swapaxes(self.value, a, b), (self,), lambda g: (np.swapaxes(g, a, b),))

    def sum(self):
        return Var(self.value.sum(), (self,), lambda g: (np.full(self.value.shape, g),))

    def _apply(self, value: np.ndarray, slope: np.ndarray):
        return Var(value, (self,), lambda g: (g * slope,))

    def relu(self):
        return self._apply(np.maximum(self.value, 0), (self.value > 0).astype(float))

    def tanh(self):
        t = np.tanh(self.value)
        return self._apply(t, 1 - t * t)

    def sigmoid(self):
        s = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return self._apply(s, s * (1 - s))

    def softmax(self):
        e = np.exp(self.value - self.value.max(-1, keepdims=True))
        s = e / e.sum(-1, keepdims=True)
        return Var(s, (self,), lambda g: (s * (g - (g * s).sum(-1, keepdims=True)),))

    def normed(self):
        """Zero mean and unit variance over the last axis."""
        sd = np.sqrt(self.value.var(-1, keepdims=True) + 1e-5)
        y = (self.value - self.value.mean(-1, keepdims=True)) / sd
        return Var(y, (self,), lambda g: ((g - g.mean(-1, keepdims=True) - y * (g * y).mean(-1, keepdims=True)) / sd,))

    def backward(self) -> None:
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                for p, g in zip(v.parents, v.back(v.grad)):
                    p.grad = g if p.grad is None else p.grad + g


def as_var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def stack(items: list[Var], axis: int) -> Var:
    return Var(np.stack([v.value for v in items], axis), tuple(items), lambda g: tuple(np.take(g, i, axis) for i in range(len(items))))


class Adam:
    """Adam over a dictionary of arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 1e-3):
        self.params, self.rate, self.step = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)
