"""Effect estimates. Every estimator reduces the data by one or two aggregations to sums of
fixed size, and solves small systems on the driver; no rows are collected.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

Z = 1.96
CALIPERS = (0.5, 0.25, 0.2, 0.1, 0.05)  # fixed values: what is tried


def naive_effect(df: DataFrame, outcome: str, exposure: str) -> DataFrame:
    t, c = F.avg(F.when(F.col(exposure) == 1, F.col(outcome))), F.avg(F.when(F.col(exposure) == 0, F.col(outcome)))
    return df.agg(F.count_if(F.col(exposure) == 1).alias("n_treated"), F.count_if(F.col(exposure) == 0).alias("n_control"), t.alias("mean_treated"), c.alias("mean_control"), (t - c).alias("effect"))


def interval(estimate: float, se: float) -> dict:
    return {"estimate": estimate, "se": se, "low": estimate - Z * se, "high": estimate + Z * se, "p": math.erfc(abs(estimate / se) / math.sqrt(2)) if se else float("nan")}


def _moments(df: DataFrame, x: list[Column], y: Column, w: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'WX, X'Wy, y'Wy and n in one aggregation."""
    k = len(x)
    sums = [F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * x[i] * y).alias(f"b{i}") for i in range(k)] + [F.sum(w * y * y).alias("yy"), F.count("*").alias("n")]
    r = df.agg(*sums).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = r[f"a{i}_{j}"]
    return a, np.array([r[f"b{i}"] for i in range(k)]), r["yy"], r["n"]


def least_squares(df: DataFrame, outcome: str, terms: dict[str, Column], weight: Column | None = None, cluster: str | None = None) -> dict:
    """Coefficients and standard errors of outcome on an intercept and terms; CR1 by cluster, else of the model."""
    names, x = ["intercept", *terms], [F.lit(1.0), *[c.cast("double") for c in terms.values()]]
    w, y = (F.lit(1.0) if weight is None else weight), F.col(outcome).cast("double")
    a, b, yy, n = _moments(df, x, y, w)
    inverse = np.linalg.pinv(a)
    beta, k = inverse @ b, len(names)
    rss = yy - 2 * beta @ b + beta @ a @ beta
    cov = inverse * rss / max(n - k, 1)
    robust = None
    if cluster is not None:
        u = y - reduce(lambda s, t: s + t, [xi * float(bi) for xi, bi in zip(x, beta)])
        scores = df.groupBy(cluster).agg(*[F.sum(w * xi * u).alias(f"s{i}") for i, xi in enumerate(x)])
        meat = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        m, g = np.zeros((k, k)), meat["g"]
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = meat[f"m{i}_{j}"]
        if g > 1 and n > k:
            robust = np.sqrt(np.maximum(np.diag(inverse @ m @ inverse) * (g / (g - 1)) * ((n - 1) / (n - k)), 0))
    model_se = np.sqrt(np.maximum(np.diag(cov), 0))
    se = model_se if robust is None else np.where(np.isfinite(robust) & (robust > 1e-8), robust, model_se)
    return {"n": n, "coef": dict(zip(names, beta)), "se": dict(zip(names, se)), "model_se": dict(zip(names, model_se))}


def logistic(df: DataFrame, exposure: str, covariates: list[str], steps: int = 30) -> np.ndarray:
    """Unpenalised maximum likelihood by Newton's method; one aggregation of fixed size a step. An error if it doesn't converge, as where a covariate parts the arms."""
    df = settle(df.select(exposure, *covariates), "cases")
    scale = df.agg(*[F.avg(c).alias(f"m_{c}") for c in covariates], *[F.stddev_samp(c).alias(f"s_{c}") for c in covariates]).first()
    mean, sd = np.array([scale[f"m_{c}"] for c in covariates]), np.array([scale[f"s_{c}"] or 1.0 for c in covariates])
    x = [F.lit(1.0), *[(F.col(c) - float(m)) / float(s) for c, m, s in zip(covariates, mean, sd)]]
    beta = np.zeros(len(x))
    for _ in range(steps):
        eta = reduce(lambda s, t: s + t, [xi * float(b) for xi, b in zip(x, beta)])
        p = 1 / (1 + F.exp(-eta))
        a, g, _, _ = _moments(df.withColumn("_p", p), x, (F.col(exposure) - F.col("_p")) / F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12)), F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12)))
        step = np.linalg.pinv(a) @ g
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    else:
        if np.abs(step).max() > 1e-6:
            raise ValueError("the logistic fit doesn't converge")
    slope = beta[1:] / sd
    return np.append(beta[0] - (slope * mean).sum(), slope)


def with_propensity(df: DataFrame, exposure: str, covariates: list[str], name: str = "propensity") -> DataFrame:
    b = logistic(df, exposure, covariates)
    eta = reduce(lambda s, t: s + t, [F.col(c) * float(v) for c, v in zip(covariates, b[1:])], F.lit(float(b[0])))
    return df.withColumn(name, 1 / (1 + F.exp(-eta)))


def overlap(df: DataFrame, exposure: str, score: str = "propensity", most: float = 5.0) -> DataFrame:
    """support_low, support_high, outside (treated), ratio of treated to control above .8, ok."""
    t, c, s = F.col(exposure) == 1, F.col(exposure) == 0, F.col(score)
    low = F.greatest(F.min(F.when(t, s)), F.min(F.when(c, s)))
    high = F.least(F.max(F.when(t, s)), F.max(F.when(c, s)))
    b = df.agg(low.alias("support_low"), high.alias("support_high"), F.count_if(t & (s > 0.8)).alias("nt"), F.count_if(c & (s > 0.8)).alias("nc"))
    both = df.crossJoin(F.broadcast(b))  # one row
    out = both.groupBy("support_low", "support_high", "nt", "nc").agg(F.count_if(t & ~s.between(F.col("support_low"), F.col("support_high"))).alias("outside"))
    ratio = F.when(F.col("nt") == 0, 0.0).when(F.col("nc") == 0, float("inf")).otherwise(F.col("nt").cast("double") / F.nullif(F.col("nc"), F.lit(0)))
    return out.select("support_low", "support_high", "outside", ratio.alias("ratio"), (ratio < most).alias("ok"))


def trimmed(df: DataFrame, exposure: str, score: str = "propensity") -> DataFrame:
    o = overlap(df, exposure, score).select("support_low", "support_high")
    return df.crossJoin(F.broadcast(o)).where(F.col(score).between(F.col("support_low"), F.col("support_high"))).drop("support_low", "support_high")  # one row


def standardised_differences(df: DataFrame, exposure: str, covariates: list[str], weight: Column | None = None, sd_from: DataFrame | None = None) -> DataFrame:
    """covariate, smd: difference of (weighted) means over the treated's standard deviation before matching."""
    w = F.lit(1.0) if weight is None else weight
    mean = lambda v, arm: F.sum(F.when(F.col(exposure) == arm, w * F.col(v))) / F.sum(F.when((F.col(exposure) == arm) & F.col(v).isNotNull(), w))
    diff = df.agg(*[(mean(v, 1) - mean(v, 0)).alias(v) for v in covariates])
    sd = (sd_from or df).where(F.col(exposure) == 1).agg(*[F.stddev_samp(v).alias(f"sd_{v}") for v in covariates])
    both = diff.crossJoin(sd)  # a row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(v).alias("covariate"), (F.col(v) / F.nullif(F.col(f"sd_{v}"), F.lit(0.0))).alias("smd")) for v in covariates])).alias("x")).select("x.covariate", "x.smd")


FEW = 10_000  # values that are sorted on the driver at the end of a search for a rank
CELLS = 1024


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of type 7 (linear between ranks) of a column's non-null values.

    The place of each rank is narrowed down by counts in CELLS cells of a range, a row a cell, until a cell has FEW values at most
    or one value only; no task has all values, and the driver gets cells and at most FEW values a rank.
    """
    x = F.col(column).cast("double")
    values = settle(df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x)), "values")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None for _ in shares]
    found: dict[int, float] = {}

    def rank(k: int) -> float:
        if k not in found:
            found[k] = _ranked(values, k, n, low, high)
        return found[k]

    out = []
    for p in shares:
        at = (n - 1) * p
        a, b = math.floor(at), math.ceil(at)
        out.append(rank(a) + (rank(b) - rank(a)) * (at - a) if b > a else rank(a))
    return out


def _ranked(values: DataFrame, k: int, n: int, low: float, high: float) -> float:
    """The k-th smallest (from 0) of n values x within low and high."""
    inside = values
    while n > FEW and high > low:
        width = (high - low) / CELLS
        if width == 0 or low + width == low:
            break  # neighbouring numbers
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(CELLS - 1)).cast("int")
        rows = sorted(inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: r["c"])
        for r in rows:
            if k < r["n"]:
                n, low, high = r["n"], r["lo"], r["hi"]
                break
            k -= r["n"]
        inside = values.where(F.col("x").between(low, high))
    if high == low:
        return low
    if n > FEW:  # many equal values of few kinds
        rows = sorted(inside.groupBy("x").agg(F.count("*").alias("n")).collect(), key=lambda r: r["x"])
        for r in rows:
            if k < r["n"]:
                return r["x"]
            k -= r["n"]
    return sorted(r["x"] for r in inside.collect())[k]


def iptw(df: DataFrame, outcome: str, exposure: str, covariates: list[str]) -> dict:
    """Effect on the treated by inverse propensity weights, winsorised at the exact .01 and .99 quantiles."""
    scored = with_propensity(df, exposure, covariates)
    w = F.when(F.col(exposure) == 1, 1.0).otherwise(F.col("propensity") / F.greatest(1 - F.col("propensity"), F.lit(1e-6)))
    scored = scored.withColumn("_w", w)
    q = quantiles(scored, "_w", [0.01, 0.99])
    fit = least_squares(scored, outcome, {exposure: F.col(exposure)}, F.least(F.greatest(F.col("_w"), F.lit(q[0])), F.lit(q[1])))
    return interval(fit["coef"][exposure], fit["se"][exposure]) | {"n": fit["n"]}


def did(df: DataFrame, outcome: str, covariates: list[str] = (), cluster: str = "operator") -> dict | None:
    """Difference in differences with CR1 errors; None if the frame is no panel."""
    arms = df.agg(F.countDistinct("adopter").alias("a"), F.countDistinct("post").alias("p")).first() if {"adopter", "post"} <= set(df.columns) else None
    if arms is None or arms["a"] < 2 or arms["p"] < 2:
        return None
    terms = {"adopter": F.col("adopter"), "post": F.col("post"), "both": F.col("adopter") * F.col("post"), **{c: F.col(c) for c in covariates}}
    fit = least_squares(df, outcome, terms, cluster=cluster)
    return interval(fit["coef"]["both"], fit["se"]["both"]) | {"n": fit["n"]}


def matched_with_replacement(df: DataFrame, exposure: str, key: str, score: str = "propensity", caliper: float = 0.2, mahalanobis: list[str] | None = None) -> DataFrame:
    """treated, control, gap: each treated row's nearest control within the caliper (in standard deviations of the score).

    Near is by the score, or with ``mahalanobis`` by Mahalanobis distance of those covariates among the controls within the
    caliper. Ties go to the smaller key.
    """
    rows = settle(df.select(key, exposure, score, *(mahalanobis or [])), "rows")
    width, ranges = _spread(rows, score, caliper)
    return _nearest(rows, exposure, key, score, width, ranges) if mahalanobis is None else _nearest_within(rows, exposure, key, score, width, whitened(rows, mahalanobis))


def matched_without_replacement(df: DataFrame, exposure: str, key: str, score: str = "propensity", caliper: float = 0.2, mahalanobis: list[str] | None = None) -> DataFrame:
    """The same, each control once. Rounds: every treated row names its nearest free control, every control takes its
    nearest namer (smaller gap, then smaller key, wins); those matched leave. Unlike one sequential pass this needs
    no order over all rows, and each round at least the closest pair is matched. While more than MANY times EACH rows are left a round is
    a join of Spark's; all rounds of the last ones are one group's, with the same pairs.
    """
    taken, rest = None, settle(df.select(key, exposure, score, *(mahalanobis or [])), "rows")
    width, ranges = _spread(rest, score, caliper)
    white = whitened(rest, mahalanobis) if mahalanobis else None
    left = rest.count()
    while left > MANY * EACH:
        near = _nearest(rest, exposure, key, score, width, ranges) if white is None else _nearest_within(rest, exposure, key, score, width, white)
        new = near.groupBy("control").agg(F.min(F.struct("gap", "treated")).alias("m")).select(F.col("m.treated").alias("treated"), "control", F.col("m.gap").alias("gap"))
        new = settle(new, "pairs")
        if new.isEmpty():
            return taken if taken is not None else new
        taken = new if taken is None else taken.unionByName(new)
        gone = new.select(F.explode(F.array("treated", "control")).alias(key))
        rest = settle(rest.join(gone, key, "left_anti"), "rows")
        left = rest.count()
    last = _rounds_of_few(rest, exposure, key, score, width, white)
    return last if taken is None else taken.unionByName(last)


NEAREST = 64  # controls that a treated row of few keeps by distance until they are taken
LEAF = 128  # places of a box that a search by distance looks into or leaves out


class _Tie(Exception):
    """Places that aren't the same are equally far, so that keys decide."""


def _rounds_of_few(df: DataFrame, exposure: str, key: str, score: str, width: float, white: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """All further rounds of matched_without_replacement for MANY times EACH rows at most: in one group, as a round is little work then."""
    kind = df.schema[key].dataType.simpleString()
    at = [] if white is None else _whitened_columns(white)
    names = [f"x{j}" for j in range(len(at))]
    rows = df.select(F.col(key).alias("k"), (F.col(exposure) == 0).alias("c"), F.col(score).cast("double").alias("s"), *[x.alias(n) for x, n in zip(at, names)])

    def run(frame):
        import pandas as pd

        a, b = frame[~frame.c].sort_values("k"), frame[frame.c].sort_values("k")
        if white is None:
            t, c, gap = _rounds_by_score(a.s.to_numpy(), b.s.to_numpy(), width)
        else:
            t, c, gap = _rounds_by_distance(a.s.to_numpy(), a[names].to_numpy(), b.s.to_numpy(), b[names].to_numpy(), max(width, 1e-12))
        return pd.DataFrame({"treated": a.k.to_numpy()[t], "control": b.k.to_numpy()[c], "gap": gap})

    return rows.groupBy().applyInPandas(run, f"treated {kind}, control {kind}, gap double")


def _winners(t: np.ndarray, c: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Of treated rows t that name controls c, which are taken: each control's by the smallest gap, then the smallest place."""
    order = np.lexsort((t, gap, c))
    return order[np.append(True, np.diff(c[order]) != 0)] if len(order) else order


def _places(columns: list[np.ndarray], alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without a NaN in order of their place (each row's own unless alike rows share one), where each place's begin, and how many they are."""
    rows = np.flatnonzero(~np.isnan(np.column_stack(columns)).any(axis=1))
    if not alike:
        return rows, np.arange(len(rows)), np.ones(len(rows), np.int64)
    rows = rows[np.lexsort((rows, *[x[rows] for x in columns]))]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([x[rows[1:]] != x[rows[:-1]] for x in columns], axis=0)
    start = np.flatnonzero(new)
    return rows, start, np.diff(np.append(start, len(rows)))


def _rounds(treated: list[np.ndarray], controls: list[np.ndarray], namer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of treated and of the controls they get, and gaps. Either arm's columns stand in the order of its keys.

    Rows of one place name and are named alike, so places go through the rounds, as many rounds at once as leave each named control's
    place and each winner's a row. Where keys decide between places, rows go through one by one. namer(treated's columns,
    controls', alike) gives a function of the open treated places and of what control places are free: each one's control and gap.
    """
    for alike in (True, False):
        (tr, t0, tn), (cr, c0, cn) = _places(treated, alike), _places(controls, alike)
        if alike and len(tn) == len(tr) and len(cn) == len(cr):
            continue
        try:
            return _rounds_of_places((tr, t0, tn), (cr, c0, cn), namer([x[tr[t0]] for x in treated], [x[cr[c0]] for x in controls], alike), alike)
        except _Tie:
            continue
    raise AssertionError("rows one by one have no ties")


def _rounds_of_places(t: tuple, c: tuple, near, alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (tr, t0, tn), (cr, c0, cn) = (tuple(x.copy() for x in arm) for arm in (t, c))
    open_, free, out = np.arange(len(tn)), np.ones(len(cn), bool), []
    while len(open_) and free.any():
        at, gap = near(open_, free)
        found = np.isfinite(gap)  # the others find no control any more, as those that are free get fewer
        open_, at, gap = open_[found], at[found], gap[found]
        if not len(open_):
            break
        won = _winners(open_, at, gap)
        if alike:
            best = np.full(len(cn), np.nan)
            best[at[won]] = gap[won]
            if np.count_nonzero(best[at] == gap) > len(won):
                raise _Tie
        w, v = open_[won], at[won]
        m = int(min(tn[w].min(), cn[v].min()))
        some = np.arange(m)
        out.append((tr[(t0[w, None] + some).ravel()], cr[(c0[v, None] + some).ravel()], np.repeat(gap[won], m)))
        t0[w], c0[v], tn[w], cn[v] = t0[w] + m, c0[v] + m, tn[w] - m, cn[v] - m
        free[v] = cn[v] > 0
        open_ = open_[tn[open_] > 0]
    return tuple(np.concatenate([np.zeros(0, kind), *[o[i] for o in out]]) for i, kind in enumerate((np.int64, np.int64, np.float64)))


def _rounds_by_score(ts: np.ndarray, cs: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_rounds by the nearest score within a width."""

    def namer(treated, controls, alike):
        (ts,), (cs,) = treated, controls
        order = np.lexsort((np.arange(len(cs)), cs))

        def near(open_, free):
            nonlocal order
            order = order[free[order]]
            s, t = cs[order], ts[open_]
            above = np.searchsorted(s, t, "left")  # of equal scores the smallest key stands first
            below = np.searchsorted(s, s[np.maximum(above - 1, 0)], "left")
            low = np.where(above > 0, np.abs(t - s[below]), np.inf)
            high = np.where(above < len(s), np.abs(t - s[np.minimum(above, len(s) - 1)]), np.inf)
            if alike and np.any((low == high) & (low <= width)):
                raise _Tie
            lower, upper = order[below], order[np.minimum(above, len(s) - 1)]
            gap = np.minimum(low, high)
            return np.where((low < high) | ((low == high) & (lower < upper)), lower, upper), np.where(gap <= width, gap, np.inf)

        return near

    return _rounds([ts], [cs], namer)


def _rounds_by_distance(ts: np.ndarray, tx: np.ndarray, cs: np.ndarray, cx: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_rounds by distance in x among the controls within a width of the score. A treated place keeps its NEAREST controls and looks again once all are taken."""

    def namer(treated, controls, alike):
        kept, far = np.zeros((len(treated[0]), NEAREST), np.int32), np.full((len(treated[0]), NEAREST), np.inf)
        at, look = np.zeros(len(treated[0]), np.int64), np.ones(len(treated[0]), bool)
        search = _Search(treated, controls, width, alike)

        def near(open_, free):
            some = open_
            while len(some):
                again = some[look[some]]
                if len(again):
                    search(again, free, kept, far)
                    at[again], look[again] = 0, False
                here = np.minimum(at[some], NEAREST - 1)  # on to the first that is free
                some = some[np.isfinite(far[some, here]) & ~free[kept[some, here]]]
                at[some] += 1
                look[some[at[some] >= NEAREST]] = True
            return kept[open_, at[open_]].astype(np.int64), far[open_, at[open_]]

        return near

    return _rounds([ts, *tx.T], [cs, *cx.T], namer)


class _Search:
    """The nearest free controls of treated places, by distance and then by number, among those within a width of the score.

    Both arms lie in boxes of LEAF places: treated places of one box look together, nearest box of controls first, until the next box
    is farther than what they have.
    """

    def __init__(self, treated: list[np.ndarray], controls: list[np.ndarray], width: float, alike: bool):
        (self.ts, *tx), (self.cs, *cx), self.width, self.alike = treated, controls, width, alike
        self.tx, self.cx = np.ascontiguousarray(tx), np.ascontiguousarray(cx)
        self.box = np.zeros(len(self.ts), np.int64)
        for k, rows in enumerate(_boxes(self.tx, np.arange(len(self.ts)))):
            self.box[rows] = k
        self.built = None

    def __call__(self, again: np.ndarray, free: np.ndarray, kept: np.ndarray, far: np.ndarray) -> None:
        n = np.count_nonzero(free)
        if self.built is None or 2 * n < self.built:  # boxes of those that are still free
            self.boxes, self.built = _boxes(self.cx, np.flatnonzero(free)), n
            self.low, self.high = (np.array([[f(x[rows]) for rows in self.boxes] for x in (*self.cx, self.cs)]) for f in (np.min, np.max))
        again = again[np.argsort(self.box[again], kind="stable")]
        for rows in np.split(again, np.flatnonzero(np.diff(self.box[again])) + 1):
            kept[rows], far[rows] = self.nearest(rows, free, kept.shape[1])

    def nearest(self, rows: np.ndarray, free: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        x, s = self.tx[:, rows], self.ts[rows]
        apart = np.maximum(np.maximum(self.low[:-1] - x.max(axis=1)[:, None], x.min(axis=1)[:, None] - self.high[:-1]), 0.0)
        least = np.sqrt((apart**2).sum(axis=0)) * (1 - 1e-9)  # no place of a box is nearer, however numbers were rounded
        in_reach = (self.low[-1] <= s.max() + self.width * (1 + 1e-9) + 1e-15) & (self.high[-1] >= s.min() - self.width * (1 + 1e-9) - 1e-15)
        boxes = np.flatnonzero(in_reach)
        boxes = boxes[np.argsort(least[boxes], kind="stable")]
        own, d, k, step = np.zeros(0, np.int64), np.zeros((len(rows), 0)), 0, 4
        while k < len(boxes) and not (d.shape[1] > most and least[boxes[k]] > d[:, most].max()):
            new = np.concatenate([self.boxes[b] for b in boxes[k : k + step]])
            new = new[free[new]]
            k, step = k + step, min(2 * step, 64)
            if len(new):
                gap = reduce(lambda a, b: a + b, [(x[j][:, None] - self.cx[j][new][None]) ** 2 for j in range(len(x))])
                gap = np.sqrt(gap)
                gap[~(np.abs(s[:, None] - self.cs[new][None]) <= self.width)] = np.inf
                own, d = self.first(own, d, new, gap, most + 1)
        n = min(most, d.shape[1])
        if self.alike and np.any((d[:, 1:] == d[:, :-1]) & np.isfinite(d[:, 1:])):
            raise _Tie
        found, gaps = np.zeros((len(rows), most), np.int32), np.full((len(rows), most), np.inf)
        found[:, :n], gaps[:, :n] = own[:, :n] if n else 0, d[:, :n]
        return found, gaps

    @staticmethod
    def first(own: np.ndarray, d: np.ndarray, new: np.ndarray, gap: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` of both, by distance and then by number, in that order."""
        new = np.broadcast_to(new, gap.shape)
        own, d = (np.concatenate([own, new], axis=1), np.concatenate([d, gap], axis=1)) if d.shape[1] else (new, gap)
        if d.shape[1] > most:
            edge = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
            n = max(most, int(((d <= edge) & np.isfinite(d)).sum(axis=1).max()))
            if n < d.shape[1]:  # all that are as near as the last one, too
                part = np.argpartition(d, n - 1, axis=1)[:, :n]
                own, d = np.take_along_axis(own, part, 1), np.take_along_axis(d, part, 1)
        order = np.lexsort((own, d), axis=1)[:, :most]
        return np.take_along_axis(own, order, 1), np.take_along_axis(d, order, 1)


def _boxes(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows (columns of x) parted at the median of what is widest, until LEAF at most are together."""
    todo, out = [rows], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            if len(rows):
                out.append(rows)
            continue
        wide = x[np.argmax([np.ptp(c[rows]) for c in x])][rows]
        half = np.argpartition(wide, len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return out


EACH = 50_000  # rows of a range of scores
MANY = 40  # times EACH rows: so many go through their rounds in one group


def _spread(rows: DataFrame, score: str, caliper: float) -> tuple[float, int]:
    """The caliper's width in units of the score, and how many ranges of scores to look in."""
    sd, n = rows.agg(F.stddev_samp(score), F.count("*")).first()
    return caliper * (sd or 1.0), max(1, -(-n // EACH))


def _nearest(df: DataFrame, exposure: str, key: str, score: str, width: float, ranges: int) -> DataFrame:
    """Each treated row's nearest control by score, if within a width.

    Rows are parted by score into ranges of like size. In a range the last control before each treated row and the first one after
    it are carried along; at a range's edges they come from the nearest range with a control, a row a range.
    """
    bounds: list[float] = []
    if ranges > 1:
        found = df.agg(F.percentile_approx(score, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10_000)).first()[0]
        bounds = sorted({float(x) for x in found or []})
    inner = F.array(*[F.lit(x) for x in bounds]).cast("array<double>")
    rows = df.select(F.col(key).alias("_k"), (F.col(exposure) == 0).alias("_c"), F.col(score).cast("double").alias("_s")).withColumn("_r", F.size(F.filter(inner, lambda x: x < F.col("_s"))))
    place = F.struct(F.col("_s").alias("s"), F.col("_k").alias("k"))
    own = F.when(F.col("_c"), place)
    # of equal scores controls stand before treated rows, the smallest key last; going down likewise
    up = Window.partitionBy("_r").orderBy(F.col("_s"), F.desc("_c"), F.desc("_k"))
    down = Window.partitionBy("_r").orderBy(F.desc("_s"), F.desc("_c"), F.desc("_k"))
    t = rows.withColumn("_lo", F.last(own, True).over(up)).withColumn("_hi", F.last(own, True).over(down)).where("not _c")
    if bounds:
        ends = rows.where("_c").groupBy("_r").agg(F.min(place).alias("first"), F.max("_s").alias("_top"))
        top = rows.where("_c").join(ends.select("_r", "_top"), "_r").where(F.col("_s") == F.col("_top")).groupBy("_r").agg(F.struct(F.max("_s").alias("s"), F.min("_k").alias("k")).alias("last"))
        every = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_r")).join(ends.select("_r", "first"), "_r", "left").join(top, "_r", "left")
        before, after = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
        edges = every.select("_r", F.last("last", True).over(before).alias("_below"), F.first("first", True).over(after).alias("_above"))
        t = t.join(F.broadcast(edges), "_r").withColumn("_lo", F.coalesce("_lo", "_below")).withColumn("_hi", F.coalesce("_hi", "_above"))  # a row a range
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_s") - F.col(c)["s"]).alias("gap"), F.col(c)["k"].alias("control")))
    near = F.array_min(F.filter(F.array(gap("_lo"), gap("_hi")), lambda x: x.isNotNull()))
    return t.select(F.col("_k").alias("treated"), near.alias("m")).where(F.col("m.gap") <= width).select("treated", "m.control", "m.gap")


def whitened(df: DataFrame, covariates: list[str]) -> tuple[list[str], np.ndarray]:
    """Covariates and what turns them into coordinates in which Mahalanobis distance is plain distance (pooled covariance)."""
    k = len(covariates)
    r = df.agg(*[F.covar_samp(covariates[i], covariates[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]).first()
    c = np.array([[r[f"c{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    values, vectors = np.linalg.eigh(c)
    return covariates, vectors / np.sqrt(np.where(values > 1e-12, values, np.inf))


def _whitened_columns(white: tuple[list[str], np.ndarray]) -> list[Column]:
    names, w = white
    return [reduce(lambda a, b: a + b, [F.col(c).cast("double") * float(w[i, j]) for i, c in enumerate(names)]) for j in range(w.shape[1])]


def _whitened_place(white: tuple[list[str], np.ndarray]) -> Column:
    return F.array(*_whitened_columns(white))


SIDE = 2048  # rows of either arm that meet in one group


def _nearest_within(df: DataFrame, exposure: str, key: str, score: str, width: float, white: tuple[list[str], np.ndarray]) -> DataFrame:
    """Each treated row's nearest control in whitened covariates, among those within a width of its score.

    Scores are cut into buckets one width wide; a treated row meets the controls of its own bucket and the two beside it, in chunks
    of SIDE rows of either arm, so that no group grows with a bucket.
    """
    width = max(width, 1e-12)
    rows = df.select(F.col(key).alias("k"), (F.col(exposure) == 0).alias("c"), F.col(score).cast("double").alias("s"), _whitened_place(white).alias("x")).withColumn("b", F.floor(F.col("s") / width))
    size = rows.groupBy("b").agg(F.count_if("c").alias("nc"), F.count_if(~F.col("c")).alias("nt"))
    chunks = size.select("b", F.ceil(F.col("nc") / SIDE).cast("int").alias("pc"), F.ceil(F.col("nt") / SIDE).cast("int").alias("pt"))
    spread = lambda n: F.pmod(F.xxhash64("k"), F.greatest(n, F.lit(1))).cast("int")
    own = rows.join(chunks, "b")
    theirs = chunks.select(F.col("b").alias("tb"), "pc", "pt")
    # a group: bucket of the treated rows, their chunk, bucket of the controls, their chunk
    t = own.where("not c").select("k", "s", "x", F.lit(False).alias("c"), F.col("b").alias("tb"), spread(F.col("pt")).alias("tp"), F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("cb"))
    t = t.join(chunks.select(F.col("b").alias("cb"), F.col("pc").alias("n")).where("n > 0"), "cb").withColumn("cp", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    c = own.where("c").select("k", "s", "x", F.lit(True).alias("c"), F.col("b").alias("cb"), spread(F.col("pc")).alias("cp"), F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("tb"))
    c = c.join(theirs.select("tb", F.col("pt").alias("n")).where("n > 0"), "tb").withColumn("tp", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    kind = df.schema[key].dataType.simpleString()

    def run(frame):
        import pandas as pd

        a, b = frame[~frame.c], frame[frame.c].sort_values("k")
        out = pd.DataFrame({"treated": a.k.iloc[:0], "control": a.k.iloc[:0], "gap": np.zeros(0)})
        if not len(a) or not len(b):
            return out
        xa, xb = np.stack(a.x.to_numpy()), np.stack(b.x.to_numpy())
        far = np.sqrt(((xa[:, None, :] - xb[None, :, :]) ** 2).sum(axis=2)) if len(a) * len(b) * xa.shape[1] < 1 << 24 else np.concatenate([np.sqrt(((xa[i : i + 64, None, :] - xb[None]) ** 2).sum(axis=2)) for i in range(0, len(a), 64)])
        far[np.abs(a.s.to_numpy()[:, None] - b.s.to_numpy()[None, :]) > width] = np.inf
        best = far.argmin(axis=1)
        gap = far[np.arange(len(a)), best]
        ok = np.isfinite(gap)
        return pd.DataFrame({"treated": a.k.to_numpy()[ok], "control": b.k.to_numpy()[best[ok]], "gap": gap[ok]})

    found = t.unionByName(c).groupBy("tb", "tp", "cb", "cp").applyInPandas(run, f"treated {kind}, control {kind}, gap double")
    return found.groupBy("treated").agg(F.min(F.struct("gap", "control")).alias("m")).select("treated", "m.control", "m.gap")


def psm(df: DataFrame, outcome: str, exposure: str, covariates: list[str], key: str, calipers: tuple[float, ...] = CALIPERS) -> dict:
    """Matched effect: of nearest matches by score, and by Mahalanobis distance within the caliper, each at several calipers, the one with
    the smallest worst standardised difference; with replacement if controls are scarce. Errors are CR1 by matched pair, else of the model.
    """
    scored = settle(trimmed(with_propensity(df.select(key, outcome, exposure, *covariates), exposure, covariates), exposure), "scored")
    n = scored.agg(F.count_if(F.col(exposure) == 1).alias("t"), F.count_if(F.col(exposure) == 0).alias("c")).first()
    again = n["t"] > 0.8 * n["c"]
    best, match = None, matched_with_replacement if again else matched_without_replacement

    def tried(by: tuple) -> dict:
        near, caliper = by
        pairs = settle(match(scored, exposure, key, caliper=caliper, mahalanobis=near), "pairs")
        m, worst = balance(scored, pairs, exposure, key, covariates)
        return {"worst": worst, "caliper": caliper, "mahalanobis": near is not None, "pairs": pairs, "matched": m}

    with ThreadPoolExecutor(max(1, len(calipers))) as pool:  # side by side, as rounds in one group leave other cores idle
        for found in pool.map(tried, [(near, caliper) for near in (None, covariates) for caliper in calipers]):
            if found["worst"] is not None and (best is None or found["worst"] < best["worst"]):
                best = found
    if best is None:
        raise ValueError("no caliper gave a match")
    m, pairs = settle(best.pop("matched"), "matched"), best.pop("pairs")
    group = pairs.select(F.col("treated").alias(key), F.col("control").alias("_pair")).unionByName(pairs.select(F.col("control").alias(key), F.col("control").alias("_pair")).distinct())
    fit = least_squares(m.join(group, key), outcome, {exposure: F.col(exposure)}, F.col("_m"), cluster="_pair")
    counts = m.agg(F.count("*").alias("n"), F.count_if(F.col(exposure) == 1).alias("t")).first()
    return interval(fit["coef"][exposure], fit["se"][exposure]) | best | {"replacement": again, "n": counts["n"], "n_treated": counts["t"], "n_unmatched": n["t"] - counts["t"], "covariates": list(covariates)}


def balance(scored: DataFrame, pairs: DataFrame, exposure: str, key: str, covariates: list[str]) -> tuple[DataFrame, float | None]:
    """The matched rows with their weight ``_m`` (a control's: how many it stands for), and the worst standardised difference, the score's included."""
    w = pairs.select(F.col("treated").alias(key), F.lit(1.0).alias("_m")).unionByName(pairs.groupBy(F.col("control").alias(key)).agg(F.count("*").cast("double").alias("_m")))
    m = scored.join(w, key)
    return m, standardised_differences(m, exposure, [*covariates, "propensity"], F.col("_m"), scored).agg(F.max(F.abs("smd"))).first()[0]


def roi(low: float, high: float, cases: float, rate: float, cost: float) -> dict:
    """Return from an interval of hours' effect: saved = -effect."""
    saved = sorted((-low, -high))
    net = [s * cases * rate - cost for s in saved]
    return {"saved": saved, "net": net, "ratio": [(n + cost) / cost for n in net] if cost else None, "break_even": cost / (cases * rate) if cases * rate else None, "crosses_zero": net[0] < 0 < net[1]}


def roi_columns(low: Column, high: Column, cases: float, rate: float, cost: float) -> dict[str, Column]:
    """roi() of intervals that are columns: saved_low, saved_high, net_low, net_high, ratio_low, ratio_high, crosses_zero."""
    saved = F.least(-low, -high), F.greatest(-low, -high)
    net = [s * cases * rate - cost for s in saved]
    ratio = [(n + cost) / F.nullif(F.lit(float(cost)), F.lit(0.0)) for n in net]
    return {"saved_low": saved[0], "saved_high": saved[1], "net_low": net[0], "net_high": net[1], "ratio_low": ratio[0], "ratio_high": ratio[1], "crosses_zero": (net[0] < 0) & (net[1] > 0)}


def sign_flags(naive: Column, adjusted: Column, low: Column, high: Column, truth: Column) -> dict[str, Column]:
    """signs_differ and recovered of effects that are columns."""
    return {"signs_differ": F.signum(naive) * F.signum(adjusted) < 0, "recovered": truth.between(low, high)}


def history_events(history: DataFrame) -> DataFrame:
    """A simulated history as ledger events, numbered in each case: intake, assistance where there was some, acknowledgement, disposition. Times are hours after the case's own day."""
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("case_id") * 3600)
    at = lambda hours: F.timestamp_seconds(F.unix_timestamp(start) + (hours * 3600).cast("bigint"))
    event = lambda k, kind, hours, human, why, gate: F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(kind).alias("event_type"), at(hours).alias("occurred_at"), F.lit("human" if human else "machine").alias("actor_kind"), F.lit(why).alias("rationale"), F.lit(gate).cast("string").alias("gate_id"))
    all_ = F.array(
        event(1, "case.created", F.lit(0.0), True, "", None), F.when(F.col("assisted") == 1, event(2, "assistance.requested", F.lit(1.0), True, "", None)),
        event(3, "gate.answered", F.least("hours_to_resolution", F.lit(96.0)) / 2, True, "acknowledged in writing", "ACK"), event(4, "disposition.recorded", F.col("hours_to_resolution"), True, "decided on the record", "RESOLVE_STANDARD"),
    )
    e = history.select(F.col("case_id").cast("string").alias("case_id"), F.concat(F.lit("op"), "operator").alias("actor"), F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("e"), (F.col("case_id") * 4).alias("base"))
    return e.select((F.col("base") + F.col("e.k")).alias("seq"), F.concat("case_id", F.lit("-"), F.col("e.k")).alias("event_id"), "case_id", "actor", "e.actor_kind", "e.event_type", "e.occurred_at", "e.rationale", "e.gate_id")


def zscore(df: DataFrame, column: str, name: str) -> DataFrame:
    s = df.agg(F.avg(column).alias("_a"), F.stddev_samp(column).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, (F.col(column) - F.col("_a")) / F.nullif("_s", F.lit(0.0))).drop("_a", "_s")  # one row


# The simulated history's coefficients.
ASSIST = {"intercept": -3.1, "complexity": 0.42, "expedited": 0.9, "backlog": 0.020, "tenure": -0.28, "adopter_post": 1.6}
HOURS = {"intercept": 130.0, "complexity": 26.0, "backlog": 0.85, "tenure": -9.0, "expedited": -58.0}


def simulated_history(spark, n: int = 900, seed: int = 42, effect: float = -9.0, operators: int = 24) -> DataFrame:
    """Cases with a known effect of ``assisted`` on hours; generated by column functions, so at any size."""
    u = lambda k: F.rand(seed + k)
    g = lambda k: F.randn(seed + k)
    df = spark.range(n).select(
        F.col("id").alias("case_id"), (F.lit(5.0) + 1.8 * g(1)).alias("complexity"), (u(2) < 0.2).cast("int").alias("expedited"),
        (30 + 12 * g(3)).alias("backlog"), F.pmod(F.xxhash64("id"), F.lit(operators)).cast("int").alias("operator"), (F.col("id") / n > 0.5).cast("int").alias("post"),
        u(4).alias("_u"), g(5).alias("_e"),
    )
    df = df.withColumn("complexity", F.least(F.lit(10.0), F.greatest(F.lit(1.0), "complexity"))).withColumn("tenure", 1 + (F.col("operator") % 9).cast("double")).withColumn("adopter", (F.col("operator") % 2 == 0).cast("int"))
    eta = ASSIST["intercept"] + ASSIST["complexity"] * F.col("complexity") + ASSIST["expedited"] * F.col("expedited") + ASSIST["backlog"] * F.col("backlog") + ASSIST["tenure"] * F.col("tenure") + ASSIST["adopter_post"] * F.col("post") * F.col("adopter")
    df = df.withColumn("assisted", (F.col("_u") < 1 / (1 + F.exp(-eta))).cast("int"))
    own = (F.pmod(F.xxhash64("operator"), F.lit(1000)) / 1000.0 - 0.5) * 24
    hours = HOURS["intercept"] + HOURS["complexity"] * F.col("complexity") + HOURS["backlog"] * F.col("backlog") + HOURS["tenure"] * F.col("tenure") + HOURS["expedited"] * F.col("expedited") + own + effect * F.col("assisted") + 34 * F.col("_e")
    return df.withColumn("hours_to_resolution", F.greatest(F.lit(2.0), hours)).drop("_u", "_e")


# The coefficients of cases drawn from a cohort.
COHORT_ASSIST = {"intercept": -3.2, "complexity": 0.20, "expedited": 0.45, "backlog": 0.010, "tenure": -0.14, "sdoh": 0.16, "adopter_post": 0.9}
COHORT_HOURS = {"intercept": 130.0, "complexity": 25.0, "backlog": 0.85, "tenure": -9.0, "expedited": -55.0, "sdoh": 14.0}


def simulated_from_cohort(cohort: DataFrame, n: int = 900, seed: int = 42, effect: float = -9.0, operators: int = 24) -> DataFrame:
    """Cases of members drawn with replacement, with a known effect; members are joined on a number drawn for each case.

    cohort: member_id, conditions, encounters, sdoh_flags, urgent_condition.
    """
    from .ledger import numbered

    c = cohort.withColumn("load", F.log1p("conditions") + 0.6 * F.log1p("encounters"))
    c = zscore(c, "load", "z").withColumn("complexity", F.least(F.lit(10.0), F.greatest(F.lit(1.0), 5 + 1.8 * F.coalesce("z", F.lit(0.0)))))
    members = numbered(c.withColumn("_h", F.pmod(F.xxhash64("member_id"), F.lit(1 << 40))), "_h", 1 << 34).select("_n", "member_id", "complexity", F.col("urgent_condition").alias("expedited"), (F.col("sdoh_flags") > 0).cast("int").alias("sdoh"))
    many = members.count()
    if not many:
        raise ValueError("the cohort is empty")
    u, g = (lambda k: F.rand(seed + k)), (lambda k: F.randn(seed + k))
    case = cohort.sparkSession.range(n).select(
        F.col("id").alias("case_id"), (F.floor(u(1) * many) + 1).cast("bigint").alias("_n"), (30 + 12 * g(3)).alias("backlog"), F.pmod(F.xxhash64("id"), F.lit(operators)).cast("int").alias("operator"),
        (F.col("id") / n > 0.5).cast("int").alias("post"), u(4).alias("_u"), g(5).alias("_e"),
    )
    df = case.join(members, "_n").withColumn("tenure", 1 + (F.col("operator") % 9).cast("double")).withColumn("adopter", (F.col("operator") % 2 == 0).cast("int"))
    a, h = COHORT_ASSIST, COHORT_HOURS
    eta = a["intercept"] + reduce(lambda s, t: s + t, [a[k] * F.col(k) for k in ("complexity", "expedited", "backlog", "tenure", "sdoh")]) + a["adopter_post"] * F.col("post") * F.col("adopter")
    df = df.withColumn("assisted", (F.col("_u") < 1 / (1 + F.exp(-eta))).cast("int"))
    own = (F.pmod(F.xxhash64("operator"), F.lit(1000)) / 1000.0 - 0.5) * 24
    hours = h["intercept"] + reduce(lambda s, t: s + t, [h[k] * F.col(k) for k in ("complexity", "backlog", "tenure", "expedited", "sdoh")]) + own + effect * F.col("assisted") + 34 * F.col("_e")
    df = df.withColumn("hours_to_resolution", F.greatest(F.lit(2.0), hours)).withColumn("on_time", (F.col("hours_to_resolution") <= F.when(F.col("expedited") == 1, 72).otherwise(720)).cast("int"))
    return df.drop("_u", "_e", "_n")

