"""Generic detectors in numpy: what they are, not how Spark fits them (see ``fitting``).

A detector has ``fit(x)`` for arrays and ``score(x)`` (higher: more unusual). Each can also be fitted on a
DataFrame of any size, with the same result: a forest from the rows that its trees draw, a network from sums of gradients,
a support vector machine from its bounded sample. The fitted detector, of bounded size, goes to the tasks that score
with their function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.autodiff import Adam, Var, as_var, stack
from .windows import sliding, unslid

FEATURES = ["load", "temp", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
EULER = 0.5772156649015329
#: Where a forest's sample is a share of the rows, a tree draws so many at most.
MOST_TREE_ROWS = 65_536


def _path_length(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of an unsuccessful search in a tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random cuts; short paths are unusual."""

    def __init__(self, trees: int = 200, sample: int | float | str = 256, seed: int = 0):
        self.trees, self.sample, self.seed = trees, sample, seed

    def rows_a_tree(self, n: int) -> int:
        """How many of ``n`` rows each tree draws; a share of them is at most MOST_TREE_ROWS."""
        m = min(int(self.sample * n), MOST_TREE_ROWS) if isinstance(self.sample, float) else 256 if self.sample == "auto" else self.sample
        return max(2, min(m, n))

    def fit(self, x: np.ndarray) -> "IsolationForest":
        rng, m = np.random.default_rng(self.seed), self.rows_a_tree(len(x))
        return self.grown(m, [self.tree(x[rng.choice(len(x), min(m, len(x)), False)], m, t) for t in range(self.trees)])

    def grown(self, m: int, forest: list[tuple[np.ndarray, ...]]) -> "IsolationForest":
        """Takes trees that were grown from ``m`` rows each."""
        self.norm, self.forest = float(_path_length(m)), forest
        return self

    def tree(self, x: np.ndarray, m: int, number: int) -> tuple[np.ndarray, ...]:
        """The tree of this number from the rows that it drew, in their order."""
        return self._grow(x, int(np.ceil(np.log2(m))), np.random.default_rng([self.seed, number]))

    def _grow(self, x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        col, cut, left, right, size = [], [], [], [], []
        todo = [(np.arange(len(x)), 0, -1, False)]
        while todo:
            at, depth, parent, is_right = todo.pop()
            me = len(col)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            lo, hi = (x[at].min(0), x[at].max(0)) if len(at) > 1 else (x[0], x[0])
            open_ = np.nonzero(hi > lo)[0]
            c = int(rng.choice(open_)) if depth < limit and len(open_) else -1
            col.append(c)
            size.append(len(at))
            cut.append(rng.uniform(lo[c], hi[c]) if c >= 0 else 0.0)
            left.append(-1)
            right.append(-1)
            if c >= 0:
                go = x[at, c] < cut[-1]
                todo += [(at[go], depth + 1, me, False), (at[~go], depth + 1, me, True)]
        return tuple(map(np.asarray, (col, cut, left, right, size)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for col, cut, left, right, size in self.forest:
            node, depth = np.zeros(len(x), int), np.zeros(len(x))
            while (inner := col[node] >= 0).any():
                i = np.nonzero(inner)[0]
                k = node[i]
                node[i] = np.where(x[i, col[k]] < cut[k], left[k], right[k])
                depth[i] += 1
            total += depth + _path_length(size[node])
        return 2.0 ** (-total / len(self.forest) / self.norm)


class OneClassSVM:
    """A radial-kernel one-class machine; the dual is solved by moving weight between the pair of
    points that violate optimality most."""

    def __init__(self, nu: float = 0.05, gamma: float | str = "scale", most: int = 5000, rounds: int = 20_000, seed: int = 0):
        self.nu, self.gamma, self.most, self.rounds, self.seed = nu, gamma, most, rounds, seed

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.g * np.maximum(d, 0))

    def fit(self, x: np.ndarray) -> "OneClassSVM":
        if len(x) > self.most:
            x = x[np.random.default_rng(self.seed).choice(len(x), self.most, False)]
        self.g = 1 / (x.shape[1] * max(x.var(), 1e-12)) if self.gamma == "scale" else float(self.gamma)
        n, top = len(x), 1 / (self.nu * len(x))
        a = np.zeros(n)
        a[: int(self.nu * n)] = top
        if a.sum() < 1:
            a[int(self.nu * n)] = 1 - a.sum()
        k = self._kernel(x, x)
        grad = k @ a
        for _ in range(self.rounds):
            up, down = np.where(a < top - 1e-12, grad, np.inf), np.where(a > 1e-12, grad, -np.inf)
            i, j = int(np.argmin(up)), int(np.argmax(down))
            if grad[j] - grad[i] < 1e-4 * grad.max():
                break
            step = min((grad[j] - grad[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - a[i], a[j])
            a[i] += step
            a[j] -= step
            grad += step * (k[i] - k[j])
        free = (a > 1e-9) & (a < top - 1e-9)
        self.rho = float(np.median(grad[free]) if free.any() else grad[a > 1e-9].max())
        self.x, self.a = x[a > 1e-9], a[a > 1e-9]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rho - self._kernel(x[i : i + 4096], self.x) @ self.a for i in range(0, len(x), 4096)]) if len(x) else np.empty(0)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to evenly spread ones (the finaliser of splitmix64)."""
    x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Network:
    """A network trained by passes over all examples: each pass sums losses and gradients, wherever the examples
    are, and Adam takes one step. A tenth of the examples, by their keys, is held out; the weights of the best loss on
    them are kept, and training stops after ``patience`` passes without a better one. With ten examples or
    fewer, all are trained and held out."""

    def __init__(self, passes: int = 40, rate: float = 0.03, patience: int = 15, seed: int = 0):
        self.passes, self.rate, self.patience, self.seed = passes, rate, patience, seed

    def build(self, shape: tuple[int, ...], rng: np.random.Generator) -> dict[str, np.ndarray]:
        """First weights for examples of this shape."""
        raise NotImplementedError

    def loss(self, p: dict[str, Var], x: np.ndarray, keys: np.ndarray | None = None, number: int = 0) -> tuple[Var, float]:
        """(sum of losses, sum of weights) of examples; ``keys`` and the pass number for what is random in training."""
        raise NotImplementedError

    def sums(self, params: dict[str, np.ndarray], x: np.ndarray, keys: np.ndarray, number: int, hold: bool) -> np.ndarray:
        """[loss and weight in training, the same held out, gradients]: sums over examples, which add up over parts."""
        out = np.zeros(4 + sum(v.size for v in params.values()))
        held = mixed_bits(keys) % np.uint64(10) == 0 if hold else np.ones(len(x), bool)
        for at in range(0, len(x), 512):
            some = slice(at, at + 512)
            train = x[some] if not hold else x[some][~held[some]]
            if len(train):
                p = {k: Var(v) for k, v in params.items()}
                loss, weight = self.loss(p, train, keys[some] if not hold else keys[some][~held[some]], number)
                loss.backward()
                out[:2] += float(loss.value), weight
                out[4:] += np.concatenate([(np.zeros(v.value.shape) if v.grad is None else v.grad).ravel() for v in p.values()])
            if held[some].any():
                loss, weight = self.loss({k: Var(v) for k, v in params.items()}, x[some][held[some]])
                out[2:4] += float(loss.value), weight
        return out

    def trained(self, shape: tuple[int, ...], total: Callable[[dict, int], np.ndarray]) -> "Network":
        """Trains by ``total``, which gives ``sums`` over all examples for weights and a pass number."""
        params = self.build(shape, np.random.default_rng(self.seed))
        adam, best, worse = Adam(params, self.rate), (np.inf, params), 0
        for number in range(self.passes):
            got = total(params, number)
            now = got[2] / max(got[3], 1e-12)
            if now < best[0]:
                best, worse = (now, {k: v.copy() for k, v in params.items()}), 0
            elif (worse := worse + 1) >= self.patience:
                break
            grads, at = {}, 4
            for k, v in params.items():
                grads[k] = got[at : at + v.size].reshape(v.shape) / max(got[1], 1e-12)
                at += v.size
            adam.update(grads)
        self.params = best[1]
        return self

    def fit(self, x: np.ndarray, keys: np.ndarray | None = None) -> "Network":
        keys = np.arange(len(x)) if keys is None else keys
        return self.trained(x.shape[1:], lambda params, number: self.sums(params, x, keys, number, len(x) > 10))


class Autoencoder(Network):
    """A dense autoencoder whose loss looks at the first feature only."""

    def __init__(self, hidden: tuple[int, ...] = (32, 16, 32), **how):
        super().__init__(**how)
        self.hidden = hidden

    def build(self, shape, rng):
        sizes = [shape[0], *self.hidden, shape[0]]
        out = {}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            out |= {f"{i}w": rng.normal(0, np.sqrt(2 / a), (a, b)), f"{i}b": np.zeros(b)}
        return out

    def _first(self, p: dict[str, Var], x: np.ndarray) -> Var:
        out = as_var(x)
        for i in range(len(self.hidden) + 1):
            out = out @ p[f"{i}w"] + p[f"{i}b"]
            out = out.relu() if i < len(self.hidden) else out
        return out[:, 0]

    def loss(self, p, x, keys=None, number=0):
        d = self._first(p, x) - x[:, 0]
        return (d * d).sum(), float(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.abs(self._first({k: Var(v) for k, v in self.params.items()}, x).value - x[:, 0]) if len(x) else np.empty(0)


class WindowModel(Network):
    """A network over windows (n, length, features); the first feature is the load."""

    def predict(self, p: dict, x: np.ndarray) -> Var:
        """The load of each row of each window."""
        raise NotImplementedError

    def loss(self, p, x, keys=None, number=0):
        d = self.predict(p, x) - x[:, :, 0]
        return (d * d).sum(), float(x.shape[0] * x.shape[1])

    def residuals(self, x: np.ndarray) -> np.ndarray:
        """Load minus prediction, (n, length)."""
        p = {k: Var(v) for k, v in self.params.items()}
        return np.concatenate([x[i : i + 512, :, 0] - self.predict(p, x[i : i + 512]).value for i in range(0, len(x), 512)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.abs(self.residuals(x))


class RecurrentAutoencoder(WindowModel):
    """An LSTM reads the window, another writes it back from the last state."""

    def __init__(self, hidden: int = 32, **how):
        super().__init__(**how)
        self.hidden = hidden

    def build(self, shape, rng):
        h, features = self.hidden, shape[1]
        w = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        return {"ex": w(features, 4 * h), "eh": w(h, 4 * h), "eb": np.zeros(4 * h), "dx": w(h, 4 * h), "dh": w(h, 4 * h), "db": np.zeros(4 * h), "ow": w(h, 1), "ob": np.zeros(1)}

    def _cell(self, z: Var, c: Var | None) -> tuple[Var, Var]:
        h = self.hidden
        i, f, o, g = z[:, :h].sigmoid(), (z[:, h : 2 * h] + 1.0).sigmoid(), z[:, 2 * h : 3 * h].sigmoid(), z[:, 3 * h :].tanh()
        c = i * g if c is None else f * c + i * g
        return o * c.tanh(), c

    def predict(self, p, x):
        h = c = None
        for t in range(x.shape[1]):
            z = Var(x[:, t]) @ p["ex"] + p["eb"]
            h, c = self._cell(z if h is None else z + h @ p["eh"], c)
        given, h, c, out = h @ p["dx"] + p["db"], None, None, []
        for _ in range(x.shape[1]):
            h, c = self._cell(given if h is None else given + h @ p["dh"], c)
            out.append((h @ p["ow"] + p["ob"])[:, 0])
        return stack(out, 1)


class MaskedPatches(WindowModel):
    """A patch transformer that reconstructs the load from the other features: windows are cut into
    overlapping patches (tokens), attention runs over them, and each token writes its patch's load;
    overlaps are averaged and a linear map of each row's features is added. ``hide`` is the share of patches
    whose load is hidden in training (1: all, so predictions never depend on the load); all are
    hidden when scoring."""

    def __init__(self, width: int = 32, heads: int = 4, layers: int = 2, patch: int = 16, stride: int = 8, hide: float = 1.0, **how):
        super().__init__(**how)
        self.width, self.heads, self.layers, self.patch, self.stride, self.hide = width, heads, layers, patch, stride, hide

    def _places(self, length: int) -> np.ndarray:
        """The rows of each patch."""
        starts = np.arange(0, max(length - self.patch, 0) + 1, self.stride)
        return starts[:, None] + np.arange(min(self.patch, length))[None]

    def build(self, shape, rng):
        length, features = shape
        at = self._places(length)
        d, n = self.width, at.shape[1]
        w = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        p = {"in": w(n * features, d), "pos": rng.normal(0, 0.02, (len(at), d)), "out": w(d, n) * 0.1, "skip": np.zeros((features - 1, 1)), "bias": np.zeros(1)}
        for i in range(self.layers):
            p |= {f"{i}{k}": w(d, d) for k in "qkvo"} | {f"{i}up": w(d, 2 * d), f"{i}down": w(2 * d, d) * 0.5}
        return p

    def _forward(self, p: dict, x: np.ndarray, hidden: np.ndarray) -> Var:
        n, length, features = x.shape
        at = self._places(length)
        x = x.copy()
        tok = x[:, at]  # (n, tokens, patch, features)
        tok[..., 0] = np.where(hidden[:, :, None], 0.0, tok[..., 0])
        h = self._attended(p, Var(tok.reshape(n, len(at), -1)) @ p["in"] + p["pos"])
        return self._laid(h @ p["out"], at, length) + (Var(x[:, :, 1:]) @ p["skip"]).reshape(n, length) + p["bias"]

    def _attended(self, p: dict, h: Var) -> Var:
        """The encoder over tokens (n, tokens, width)."""
        n, tokens, _ = h.value.shape
        k = self.width // self.heads
        split = lambda v: v.reshape(n, tokens, self.heads, k).swap(1, 2)
        for i in range(self.layers):
            z = h.normed()
            q, key, v = (split(z @ p[f"{i}{c}"]) for c in "qkv")
            mixed = ((q @ key.swap(-1, -2)) * (1 / np.sqrt(k))).softmax() @ v
            h = h + mixed.swap(1, 2).reshape(n, tokens, self.width) @ p[f"{i}o"]
            h = h + (h.normed() @ p[f"{i}up"]).relu() @ p[f"{i}down"]
        return h.normed()

    def _laid(self, patches: Var, at: np.ndarray, length: int) -> Var:
        """Patches (n, patches, rows) back as rows, overlaps averaged."""
        spread = np.zeros((at.size, length))
        spread[np.arange(at.size), at.ravel()] = 1
        return patches.reshape(patches.value.shape[0], -1) @ (spread / np.maximum(spread.sum(0), 1))

    def predict(self, p, x):
        return self._forward(p, x, np.ones((len(x), len(self._places(x.shape[1]))), bool))

    def target_residuals(self, x: np.ndarray) -> np.ndarray:
        """The residual of each window's last row with only the patches that hold it hidden, so the
        prediction may use the load before it (a diagnostic: earlier faults then leak into it)."""
        p, at = {k: Var(v) for k, v in self.params.items()}, self._places(x.shape[1])
        hidden = np.repeat((at == x.shape[1] - 1).any(axis=1)[None], len(x), axis=0)
        return x[:, -1, 0] - self._forward(p, x, hidden).value[:, -1]

    def open_residuals(self, x: np.ndarray) -> np.ndarray:
        """The residual of each window's last row with no patch hidden (a diagnostic: the model may copy the
        load, faults included)."""
        p = {k: Var(v) for k, v in self.params.items()}
        return x[:, -1, 0] - self._forward(p, x, np.zeros((len(x), len(self._places(x.shape[1]))), bool)).value[:, -1]

    def loss(self, p, x, keys=None, number=0):
        if keys is None or self.hide >= 1:
            return super().loss(p, x)
        at = self._places(x.shape[1])
        # a patch of a window is hidden by their hash, so it doesn't matter which task has the window
        draw = mixed_bits(mixed_bits(keys)[:, None] ^ mixed_bits(np.arange(len(at)) + (number << 20))[None])
        hidden = draw / 2.0**64 < self.hide
        rows = np.zeros((len(x), x.shape[1]))
        for t, place in enumerate(at):
            rows[:, place] = np.maximum(rows[:, place], hidden[:, t, None])
        d = (self._forward(p, x, hidden) - x[:, :, 0]) * rows
        return (d * d).sum(), float(rows.sum())


class ChannelPatches(MaskedPatches):
    """The same with a token for each patch of each channel (feature): one linear map embeds the patches of all
    channels, places and channels have vectors of their own, and attention runs over all tokens of a window, so a hidden load
    patch is inferred from the other channels'. A linear map of the patches of all channels at its place is added to each load patch.
    ``mix=False``: attention stays within a channel, channels are not told apart, and only the load's own patch is added,
    so nothing of one channel reaches another (an ablation). The full size: width 128, 4 heads, 3 layers, windows of
    168 rows with six channels, which makes 20 x 6 tokens."""

    def __init__(self, width: int = 32, heads: int = 4, layers: int = 2, patch: int = 16, stride: int = 8, hide: float = 0.4, mix: bool = True, **how):
        super().__init__(width, heads, layers, patch, stride, hide, **how)
        self.mix = mix

    def build(self, shape, rng):
        length, channels = shape
        p = super().build((length, 1), rng)  # the encoder, the places and the map of one channel's patch
        rows = p["in"].shape[0]
        p["skip"] = np.zeros(((channels if self.mix else 1) * rows, rows))
        if self.mix:
            p["channel"] = rng.normal(0, 0.02, (channels, 1, self.width))
        return p

    def _patches(self, x: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """(n, channels, patches, rows), hidden patches of the load 0."""
        tok = x[:, self._places(x.shape[1])].transpose(0, 3, 1, 2).copy()
        tok[:, 0] = np.where(hidden[:, :, None], 0.0, tok[:, 0])
        return tok

    def _encoded(self, p: dict, tok: np.ndarray) -> Var:
        n, channels, patches, rows = tok.shape
        if not self.mix:
            h = Var(tok.reshape(n * channels, patches, rows)) @ p["in"] + p["pos"]
            return self._attended(p, h).reshape(n, channels, patches, self.width)
        h = Var(tok) @ p["in"] + p["pos"] + p["channel"]
        return self._attended(p, h.reshape(n, channels * patches, self.width)).reshape(n, channels, patches, self.width)

    def encoding(self, x: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """What the encoder makes of each patch of each channel, (n, channels, patches, width)."""
        return self._encoded({k: Var(v) for k, v in self.params.items()}, self._patches(x, hidden)).value

    def _forward(self, p, x, hidden):
        tok = self._patches(x, hidden)
        # unmixed channels don't reach the load's, so only its own is encoded
        load = self._encoded(p, tok if self.mix else tok[:, :1])[:, 0]
        beside = (tok if self.mix else tok[:, :1]).transpose(0, 2, 1, 3)
        skip = Var(beside.reshape(*beside.shape[:2], -1)) @ p["skip"]
        return self._laid(load @ p["out"] + skip, self._places(x.shape[1]), x.shape[1]) + p["bias"]


def windows_of(df: DataFrame, cols: list[str], length: int, stride: int) -> DataFrame:
    """(entity, start, values): values holds the window's rows, feature by feature."""
    return sliding(df.withColumn("__f", F.array(*[F.col(c).cast("double") for c in cols])), "__f", length, stride)


def _cube(values: pd.Series) -> np.ndarray:
    return np.array([np.array([np.asarray(r, float) for r in v]) for v in values])


def score_windows(windows: DataFrame, model: WindowModel, how: str = "max", signed: bool = False) -> DataFrame:
    """(entity, idx, x): scores (or signed residuals) of windows, brought back to rows by maximum or mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _cube(pdf["values"])
                out = model.residuals(x) if signed else model.score(x)
                yield pd.DataFrame({"entity": pdf["entity"], "start": pdf["start"], "values": list(out)})

    return unslid(windows.mapInPandas(run, "entity string, start long, values array<double>"), how=how)


def point_residuals(windows: DataFrame, model: WindowModel, last: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(entity, idx, x): the residual of the last row of each window (stride 1), so a row is judged with
    what came before it only; the first rows of a series take the first residual. ``last``: another
    function that gives the last rows' residuals."""
    last = last or (lambda x: model.residuals(x)[:, -1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _cube(pdf["values"])
                yield pd.DataFrame({"entity": pdf["entity"], "idx": pdf["start"] + x.shape[1] - 1, "x": last(x), "first": pdf["start"] == 0})

    out = windows.mapInPandas(run, "entity string, idx long, x double, first boolean")
    fill = out.where("first").select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("idx") - 1)).alias("idx"), "x")
    return out.select("entity", "idx", "x").unionByName(fill)


def score(df: DataFrame, detector, cols: list[str] = FEATURES, out: str = "s") -> DataFrame:
    """Adds the detector's score; rows with a missing feature get null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            ok, s = ~np.isnan(x).any(axis=1), np.full(len(pdf), np.nan)
            s[ok] = detector.score(x[ok])
            yield pdf.assign(**{out: pd.Series(s, index=pdf.index).where(ok)})

    return df.mapInPandas(run, f"{schema}, `{out}` double").withColumn(out, F.when(~F.isnan(out), F.col(out)))


# The configurations that are searched on validation events.
GRIDS: dict[str, list[Callable]] = {
    "isolation forest": [lambda n=n, m=m: IsolationForest(n, m) for n in (100, 200, 400) for m in ("auto", 256, 0.5)],
    "one-class svm": [lambda n=n, g=g: OneClassSVM(n, g) for n in (0.02, 0.05, 0.1) for g in ("scale", 0.2)],
    "autoencoder": [lambda h=h: Autoencoder(h) for h in ((32, 16, 32), (64, 32, 64))],
    "recurrent autoencoder": [lambda h=h: RecurrentAutoencoder(h) for h in (32, 64)],
}
