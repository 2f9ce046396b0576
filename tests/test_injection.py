"""Fault injection against a plain sampler on the same hashes, and its edges."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.operators import inject as I


def u(seed, entity, k, what):
    return int(hashlib.md5(f"{seed}|{entity}|{k}|{what}".encode()).hexdigest()[:12], 16) / 2**48


def plain(entity, load, hour, scale, scale_hour, wanted, seed, additive=False, least_share=None, own=False):
    """(draws, events with increments). ``own``: the median follows the accepted events."""
    load, draws, events = load.astype(float).copy(), [], []
    on = (scale_hour >= 8) & (scale_hour < 18)
    sigma, med = scale.std(), np.median(scale)
    night = max(scale[on].mean() - scale[~on].mean(), 0)
    least = 0.5 if least_share is None else least_share * med
    for k in range(1000):
        if len(events) == wanted:
            break
        kind = I.KINDS[int(u(seed, entity, k, "type") * 3)]
        sev = int(u(seed, entity, k, "severity") * 3) + 1
        lo, hi = I.LENGTH[kind]
        n = int(lo + u(seed, entity, k, "length") * (hi - lo)) * (1 if kind == "spike" else 24)
        lo, hi = I.STRENGTH[kind][sev]
        strength = lo + u(seed, entity, k, "strength") * (hi - lo)
        room = len(load) - n - 1
        start = int(np.floor(u(seed, entity, k, "start") * room))
        level = np.median(load) if own else med
        if room <= 0 or any(start < e and s < start + n for s, e, _, _, _ in events):
            draws.append((k, kind, sev, I.NO_ROOM if room <= 0 else I.CLASH))
            continue
        if kind == "spike":
            rise = np.hanning(2 * n)[:n]
            add = strength * sigma * (np.ones(1) if n == 1 else rise / rise.max())
        elif kind == "drift":
            add = np.linspace(0, strength / 24 * n, n) * level
        else:
            at = slice(start, start + n)
            more = np.full(n, strength * night) if additive else np.maximum(level * strength - load[at], 0)
            off = ~((hour[at] >= 8) & (hour[at] < 18))
            add = pd.Series(np.where(off, more, 0.0)).rolling(3, center=True, min_periods=1).mean().to_numpy()
        weak = not add.max() >= least
        draws.append((k, kind, sev, I.WEAK if weak else ""))
        if not weak:
            load[start : start + n] += add
            events.append((start, start + n, kind, sev, add))
    return draws, events


def panel(n=24 * 80, entities="abc"):
    ts = pd.date_range("2016-01-01", periods=n, freq="h")
    rng = np.random.default_rng(7)
    busy = 20 * ((ts.hour >= 8) & (ts.hour < 18))
    return pd.concat([pd.DataFrame({"entity": e, "idx": range(n), "ts": ts, "x": 3 * k + 10 + busy + rng.normal(size=n), "span": np.where(np.arange(n) < n // 2, "train", "test")}) for k, e in enumerate(entities)])


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("how", [{}, {"additive": True}, {"least_share": 0.9}, {"ref": None}, {"ref": None, "least_share": 0.5}])
def test_sampler_equals_a_plain_one(spark, how):
    pdf = panel()
    events, delta, draws = (x.toPandas() for x in I.inject(frame(spark, pdf).repartition(5), n_events=5, seed=11, **how))
    for e, own in pdf.groupby("entity"):
        test = own[own.span == "test"]
        base = test if "ref" in how else own[own.span == "train"]
        want, got = plain(e, test.x.to_numpy(), test.ts.dt.hour.to_numpy(), base.x.to_numpy(), base.ts.dt.hour.to_numpy(), 5, 11, how.get("additive", False), how.get("least_share"), "ref" in how)
        d = draws[draws.entity == e].sort_values("draw")
        assert list(zip(d.draw, d.type, d.severity, d.reason)) == want and (d.accepted == (d.reason == "")).all()
        ev = events[events.entity == e].sort_values("event_id")
        assert ev.event_id.tolist() == list(range(len(got)))
        assert list(zip(ev.start, ev.end, ev.type, ev.severity)) == [g[:4] for g in got]
        assert np.allclose(ev.true_kwh, [np.maximum(g[4], 0).sum() for g in got])
        mine = delta[delta.entity == e].set_index("idx").delta
        assert len(mine) == sum(len(g[4]) for g in got) and np.allclose(mine.sort_index(), np.concatenate([g[4] for g in sorted(got, key=lambda g: g[0])]))


def test_edges(spark):
    """Spans without room, nulls, no reference rows, an empty panel: defined, and no crash."""
    pdf = panel(n=60, entities="s")  # 30 test rows: only spikes and nothing of days fit
    events, _, draws = (x.toPandas() for x in I.inject(frame(spark, pdf), n_events=2))
    assert set(events.type) == {"spike"} and set(draws.reason) >= {""} and set(draws[draws.type != "spike"].reason) <= {I.NO_ROOM}
    p = frame(spark, panel(entities="a"))
    none = p.withColumn("x", F.when(F.col("span") == "train", F.col("x")))
    events = I.inject(none, n_events=3)[0].toPandas()
    assert set(events.type) <= {"spike", "drift"} and len(events) == 3  # nothing can be lifted to a level
    assert I.inject(p.where("span = 'test'"), n_events=1)[0].count() == 0  # no scales
    assert all(x.count() == 0 for x in I.inject(p.limit(0)))
    assert I.inject(p.where("span = 'train'"))[2].count() == 0


def test_no_python_and_one_shuffle(spark):
    events, _, _ = I.inject(frame(spark, panel(n=48)))
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
