import numpy as np
import pytest

from loomgraph.operators import boosting


def plain(bins, y, w, start, rounds, leaves, rate, least, l2, width):
    """The same trees on one table, each split found anew from its rows; no subtraction."""
    score, out = np.full(len(y), start), []
    for _ in range(rounds):
        g, h = boosting.gradients(score, y, w)
        groups = [np.arange(len(y))]

        def best(own):
            G, H = g[own].sum() / boosting.UNIT, h[own].sum() / boosting.UNIT
            top = (0.0, None)
            for f in range(bins.shape[1]):
                for b in range(width - 1):
                    left = own[bins[own, f] <= b]
                    if least <= left.size <= own.size - least:
                        gl, hl = g[left].sum() / boosting.UNIT, h[left].sum() / boosting.UNIT
                        if hl > 1e-3 and H - hl > 1e-3:
                            gain = round(gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2), 9)
                            if gain > max(top[0], 1e-9):
                                top = (gain, (f, b))
            return top

        splits = [best(groups[0])]
        while len(groups) < leaves and max(s[0] for s in splits) > 0:
            k = max(range(len(groups)), key=lambda i: splits[i][0])
            own, (f, b) = groups.pop(k), splits.pop(k)[1]
            for part in (own[bins[own, f] <= b], own[bins[own, f] > b]):
                groups.append(part)
                splits.append(best(part))
        for own in groups:
            score[own] = score[own] - rate * g[own].sum() / (h[own].sum() + l2 * boosting.UNIT)
        out.append(score.copy())
    return out


def table(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, n).astype(float), rng.normal(size=n).round(1), rng.random(n)], axis=1)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = ((x[:, 0] > 2) ^ (np.nan_to_num(x[:, 1]) > 0.3) ^ (rng.random(n) < 0.1)).astype(float)
    return x, y, rng.random(n) + 0.5


def frame(spark, x, y, w, parts):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, w double").repartition(parts)


def test_trees_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    x, y, w = table()
    df = frame(spark, x, y, w, 5)
    model = boosting.fit(df, ["a", "b", "c"], weight="w", rounds=5, leaves=6, least_rows=8, most_bins=12)
    bins = model.bins(x)
    assert len(model.trees) == 5 and all((t.feature < 0).sum() - (t.value[t.feature < 0] == 0).sum() <= 6 for t in model.trees)
    want = plain(bins, y, w, model.start, 5, 6, 0.1, 8, 0.0, int(bins.max()) + 1)
    got = {r.id: r.s for r in boosting.score(model, df, [0, 1, 3, 5, 9], "s").collect()}
    for i in range(len(y)):
        assert got[i] == pytest.approx([model.start, want[0][i], want[2][i], want[4][i], want[4][i]], abs=1e-9)
    other = boosting.fit(df.repartition(2), ["a", "b", "c"], weight="w", rounds=5, leaves=6, least_rows=8, most_bins=12)
    assert all((getattr(s, n) == getattr(t, n)).all() for s, t in zip(model.trees, other.trees, strict=True) for n in ("feature", "cut", "left", "right", "value"))


def test_it_learns_and_refuses(spark):
    x, y, w = table(600, 5)
    model = boosting.fit(frame(spark, x, y, w, 3), ["a", "b", "c"], rounds=12, leaves=7)
    other = table(600, 6)
    assert ((model.staged_scores(other[0], [12])[:, 0] > 0) == (other[1] > 0)).mean() > 0.8
    with pytest.raises(ValueError, match="both classes"):
        boosting.fit(frame(spark, x, y * 0, w, 2), ["a"])
    with pytest.raises(ValueError, match="may not predict"):
        boosting.fit(frame(spark, x, y, w, 2), ["a", "y"])


def test_equal_rows_are_one_row(spark, monkeypatch):
    """Forty copies of each row: the table that passes go over has a row for each kind of row, and the trees are those of the copies told apart."""
    x, y, w = table(60, 4)
    x, y, w = np.repeat(x.round(1), 40, axis=0), np.repeat(y, 40), np.repeat(w.round(1), 40)
    written, write = [], boosting.staged
    monkeypatch.setattr(boosting, "staged", lambda t, name: written.append((s := write(t, name)).count()) or s)
    model = boosting.fit(frame(spark, x, y, w, 5), ["a", "b", "c"], weight="w", rounds=3, leaves=5, least_rows=80, most_bins=12)
    assert max(written) <= 60
    bins = model.bins(x)
    want = plain(bins, y, w, model.start, 3, 5, 0.1, 80, 0.0, int(bins.max()) + 1)
    assert model.staged_scores(x, [1, 2, 3]) == pytest.approx(np.stack(want, axis=1), abs=1e-9)
