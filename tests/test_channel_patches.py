"""The masked model with a token for each patch of each channel."""

import numpy as np
import pytest

from meterloom.functions.autodiff import Var
from meterloom.operators import models as M


def made(mix, n=3, length=12, channels=3, **how):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, length, channels))
    m = M.ChannelPatches(8, 2, 2, patch=4, stride=2, mix=mix, **how)
    m.params = m.build((length, channels), rng)
    m.params["skip"] = rng.normal(0, 0.1, m.params["skip"].shape)
    return m, x


def test_alone_no_channel_moves_another():
    for mix in (False, True):
        m, x = made(mix)
        none = np.zeros((3, 5), bool)
        before = m.encoding(x, none)
        for c in range(3):
            y = x.copy()
            y[:, :, c] += np.random.default_rng(c).normal(size=y.shape[:2])
            moved = np.abs(m.encoding(y, none) - before).max(axis=(0, 2, 3)) > 1e-9
            assert moved.tolist() == [mix or k == c for k in range(3)]
            # the same of what is predicted for the load, from other channels than itself
            if c:
                assert (np.abs(m._forward(_vars(m), y, none).value - m._forward(_vars(m), x, none).value).max() > 1e-9) == mix


def _vars(m):
    return {k: Var(v) for k, v in m.params.items()}


def test_hidden_load_does_not_move_the_prediction():
    for mix in (False, True):
        m, x = made(mix)
        y = x.copy()
        y[:, :, 0] += 5
        assert np.allclose(m.predict(_vars(m), x).value, m.predict(_vars(m), y).value)
        # only the patches that hold the last row are hidden: rows of those alone may change freely
        y = x.copy()
        y[:, -2:, 0] += 5
        hidden = np.array([[t == 4 for t in range(5)]] * 3)
        assert np.allclose(m._forward(_vars(m), x, hidden).value, m._forward(_vars(m), y, hidden).value)


@pytest.mark.parametrize("mix", [False, True])
def test_gradients_equal_differences(mix):
    m, x = made(mix)
    keys = np.arange(3)
    got = m.sums(m.params, x, keys, 0, False)[4:]
    at = 0
    for name, v in m.params.items():
        for i in (0, v.size // 2, v.size - 1):
            up, down = ({**m.params, name: v + s * 1e-5 * (np.arange(v.size) == i).reshape(v.shape)} for s in (1, -1))
            slope = (m.sums(up, x, keys, 0, False)[0] - m.sums(down, x, keys, 0, False)[0]) / 2e-5
            assert got[at + i] == pytest.approx(slope, rel=1e-4, abs=1e-6), name
        at += v.size


def test_full_size_has_tokens_of_20_patches_and_6_channels():
    m = M.ChannelPatches(128, 4, 3)
    p = m.params = m.build((168, 6), np.random.default_rng(0))
    x = np.random.default_rng(1).normal(size=(2, 168, 6))
    assert m.encoding(x, np.ones((2, 20), bool)).shape == (2, 6, 20, 128)
    assert m.residuals(x).shape == (2, 168)
    assert p["0up"].shape == (128, 256) and p["skip"].shape == (96, 16) and p["channel"].shape == (6, 1, 128) and "2o" in p


def test_mixed_channels_learn_what_depends_on_another():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 12, 2))
    x[:, :, 0] = 2 * x[:, :, 1]
    losses = [float(np.mean(M.ChannelPatches(8, 2, 1, patch=4, stride=4, hide=1.0, mix=mix, passes=60, patience=60).fit(x).residuals(x) ** 2)) for mix in (True, False)]
    assert losses[0] < 0.5 and losses[1] > 3
