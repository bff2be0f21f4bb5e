"""The minimum covariance determinant against a plain numpy version, masking by copies, and odd tables."""

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import outliers as o


def plain_distances(x):
    """Distances of one group: three starts, concentration on half the rows until the determinant stays, the least, reweighted."""
    unit, bins = x / o.UNIT, lambda d2: np.minimum(np.floor(np.sqrt(d2) * o.BIN), o.FARTHEST * o.BIN)
    n, eye = len(x), np.eye(o.DIMENSIONS) * o.FLOOR**2
    square = lambda m, s: np.einsum("ij,jk,ik->i", unit - m, np.linalg.inv(s), unit - m)
    cov = lambda v: np.cov(v.T, bias=True)
    med = np.median(unit, axis=0)
    by = np.sqrt((np.median(abs(unit - med), axis=0) * o.MAD) ** 2 + o.FLOOR**2)
    z = (unit - med) / by
    z1, z2 = np.rint(np.tanh(z) * o.UNIT) / o.UNIT, np.rint(z / np.sqrt((z * z).sum(1, keepdims=True) + 1e-12) * o.DIMENSIONS**0.5 * o.UNIT) / o.UNIT
    best = None
    for s in (np.diag(by**2), (cov(z1) + eye) * np.outer(by, by), (cov(z2) + eye) * np.outer(by, by)):
        m, det = med, np.inf
        while True:
            b = bins(square(m, s))
            order = np.sort(b)
            core = unit[b <= order[(n + o.DIMENSIONS + 1) // 2 - 1]]
            m2, s2 = core.mean(0), cov(core) + eye
            d2 = np.linalg.slogdet(s2)[1]
            if not d2 < det - o.GAIN:
                break
            m, s, det = m2, s2, d2
        if best is None or det < best[0]:
            best = (det, m, s)
    d2 = square(best[1], best[2])
    scale = lambda d2: max(1.0, ((np.sort(bins(d2))[n // 2] + 0.5) / o.BIN) ** 2 / o.chi2_bound(0.5))
    near = unit[(bins(d2) / o.BIN) ** 2 <= scale(d2) * o.chi2_bound(o.REWEIGHT)]
    d2 = square(near.mean(0), cov(near) + eye)
    return np.sqrt(d2 / scale(d2))


def test_distances_equal_numpy(spark):
    r = np.random.default_rng(6)
    a = r.multivariate_normal(np.zeros(5), np.diag([1, 2, 0.5, 1, 3]) + 0.4, 301) * o.UNIT
    a[:90] = np.array([20, 0, -20, 0, 40]) * o.UNIT
    x = {"a": np.rint(a).astype(int), "b": np.rint(r.normal(2, 0.05, (200, 5)) * o.UNIT).astype(int)}
    rows = [(g, i, *map(int, v)) for g in x for i, v in enumerate(x[g])]
    df = spark.createDataFrame(rows, "grp string, i int, " + ", ".join(f"x{i} long" for i in range(5))).repartition(3)
    got = o.robust_distances(df).collect()
    for g in x:
        mine = np.array([v["distance"] for v in sorted((v for v in got if v["grp"] == g), key=lambda v: v["i"])])
        assert np.allclose(mine, plain_distances(x[g]), rtol=1e-6)
    assert min(v["distance"] for v in got if v["grp"] == "a" and v["i"] < 90) > 4


def test_copies_of_junk_do_not_mask_themselves(spark):
    r = np.random.default_rng(1)
    plain = [(i, " ".join(f"w{k}" for k in r.integers(0, 5000, 80)), "en", "s") for i in range(240)]
    junk = " ".join(f"w{k}###" for k in r.integers(0, 5000, 80))
    rows = plain + [(1000 + i, junk, "en", "s") for i in range(150)]
    out = {v["doc_id"]: v["kept"] for v in o.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[i] for i in out if i >= 1000) and all(out[i] for i in out if i < 1000)


def test_quantiles():
    assert abs(o.chi2_bound(0.5) - 4.35146) < 1e-4 and abs(o.chi2_bound(0.025) - 12.8325) < 1e-3 and 12 < o.CUTOFF < 13


def test_null_groups_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "", "en", None), (1, "a b", None, "s")], "doc_id long, text string, lang string, source string")
    df = df.withColumns({c: F.lit(1) for c in ("grp", "rows", "x0", "n", "start", "distance")})
    assert sorted(str(v["doc_id"]) for v in o.judge(df).where("not kept and base_failed").collect()) == ["1", "1", "None"]
