"""The closed form of the scorer against the loop it stands for, and its parameters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import scorer as S
from tideline.operators.prefix import clocked, dense_numbers, running
from tideline.params import ScorerParams
from tideline.streaming.scorer import StreamScorer

PARAMS = ScorerParams(
    rows=2, buckets=48, alpha=0.8, beta=0.3, min_count=1.0, hashes=((5, 7), (11, 23)), total_hashes=((7, 3), (13, 5)),
    planes=tuple(tuple((math.sin(1 + 3 * r + b), math.cos(2 + r - b)) for b in range(6)) for r in range(2)),
)


def records(n=900, seed=3):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0] * 6 + [1, 4])
        late = t - 3 if rng.random() < 0.05 else t
        x, y = rng.choice([0.0, rng.uniform(-0.9, 5)]), rng.choice([0.0, rng.expovariate(0.1)])
        out.append((i, late, x, y, rng.choice([0, 1, 2, 7, rng.randint(1, 60)]), rng.randint(1, 5), int(rng.random() < 0.3)))
    return out


def simulate(rows, p):
    decayed, total, out = {}, {}, []
    bounds = {}
    now, k = None, 0
    for _, t, x, y, c, d, ignore in rows:
        if now is None or t > now:
            now, k = t, k + 1
            decayed = {cell: v * p.alpha for cell, v in decayed.items()}
        v = []
        for name, z in (("x", x), ("y", y)):
            if z == 0:
                v.append(None)
                continue
            log = math.log10(1 + z)
            lo, hi = bounds.get(name, (log, log))
            lo, hi = bounds[name] = (min(lo, log), max(hi, log))
            v.append(0.0 if hi == lo else round((log - lo) / (hi - lo), 12))

        def surprise(cur, tot):
            mean = max(tot / k, p.beta)
            q = max(0.0, cur - mean) ** 2
            return q / mean + q / (mean * max(1, k - 1))

        def met(current, totals):
            for cell in current:
                decayed[cell] = decayed.get(cell, 0) + 1
            for cell in totals:
                total[cell] = total.get(cell, 0) + 1
            cur = min(decayed[cell] for cell in current)
            return cur, surprise(cur, min(total[cell] for cell in totals))

        scores = {}
        for name, z in zip("xy", v):
            scores[name] = 0.0 if z is None else met(*[[(name, math.floor(z * (p.buckets - 1)) % p.buckets)]] * 2)[1]
        for name, code in (("c", c), ("d", d)):
            cells = [[(name, side, r, (code * a + b) % p.buckets) for r, (a, b) in enumerate(h)] for side, h in enumerate((p.hashes, p.total_hashes))]
            cur, s = met(*cells)
            scores[name] = 0.0 if code == 0 or cur <= p.min_count else s
        cells = []
        for r, (a, b) in enumerate(p.hashes):
            bits = sum(1 << j for j in range(p.bits) if sum((z or 0.0) * w for z, w in zip(v, p.planes[r][j])) >= 0)
            cells.append(("record", r, (bits + (c * a + b) % p.buckets + (d * (a + 2) + b) % p.buckets) % p.buckets))
        s = met(cells, cells)[1]
        scores["record"] = 0.0 if ignore else s
        out.append(scores)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, t long, x double, y double, c long, d long, ignore int")


def test_equals_the_loop(spark):
    rows = records()
    found = {r["seq"]: r for r in S.score(frame(spark, rows).repartition(7), ["x", "y"], ["c", "d"], PARAMS).collect()}
    assert len(found) == len(rows)
    for i, want in enumerate(simulate(rows, PARAMS)):
        total = sum(want.values())
        assert found[i]["score"] == pytest.approx(math.log1p(total), abs=1e-9)
        for name, s in want.items():
            assert found[i][f"{name}_score"] == pytest.approx(math.log1p(s), abs=1e-9)
            assert found[i][f"{name}_share"] == pytest.approx(s / total if total else 0, abs=1e-9)


def test_stream_equals_batch(spark, tmp_path):
    rows = frame(spark, records(300)).drop("x", "y", "ignore")
    params = ScorerParams(hashes=((5, 7), (11, 23)), buckets=48)
    scorer = StreamScorer(spark, ["c", "d"], params, str(tmp_path), record=True)
    for i, (a, b) in enumerate(((0, 90), (90, 91), (91, 300))):
        scorer.score_batch(rows.where((F.col("seq") >= a) & (F.col("seq") < b)), i)
    scorer.score_batch(rows.where((F.col("seq") >= 91) & (F.col("seq") < 300)), 2)  # a batch tried again
    got = {r["seq"]: r["score"] for r in scorer.scores().collect()}
    want = {r["seq"]: r["score"] for r in S.score(rows, [], ["c", "d"], params).collect()}
    assert got == pytest.approx(want)


def test_nothing(spark):
    assert S.score(frame(spark, []), ["x"], ["c"], PARAMS).count() == 0


@pytest.mark.parametrize("bad", [{"rows": 0}, {"buckets": 1}, {"alpha": 1.0}, {"alpha": 0.0}, {"beta": -1}, {"normaliser": "x"}, {"time_mode": "x"}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        ScorerParams(**bad)


def test_needs_a_feature(spark):
    with pytest.raises(ValueError):
        S.score(frame(spark, []), [], [], PARAMS)


def test_running_over_chunks(spark, monkeypatch):
    import tideline.operators.prefix as P

    monkeypatch.setattr(P, "CHUNK", 7)
    rows = [(i, (i * 37) % 11 if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, v long")
    got = sorted(running(df, "seq", {"lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "s": ("sum", F.col("v"))}).collect())
    for i, r in enumerate(got):
        seen = [v for _, v in rows[: i + 1] if v is not None]
        assert (r["lo"], r["hi"], r["s"]) == (min(seen, default=None), max(seen, default=None), sum(seen))
    steps = clocked(df.withColumn("t", F.col("seq") % 13)).orderBy("seq").collect()
    assert [r["k"] for r in steps] == [min(i, 12) + 1 for i in range(100)]
    numbered = dense_numbers(df.withColumn("g", F.col("seq") % 3), ["g", "seq"], "n").orderBy("g", "seq").collect()
    assert [r["n"] for r in numbered] == list(range(100))
