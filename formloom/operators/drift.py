"""Correspondence without landmarks: coherent point drift (Myronenko and Song, 2010), a specimen a fit on thinned points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.tables import written
from formloom.operators.affine import XYZ
from formloom.operators.nearest import nearest_vertex
from formloom.operators.thin import subsample
from formloom.operators.warp import per_specimen

#: Vectors of the kernel that carry a deformation, the least share of the first one's weight that they have, and points of a fit.
RANK, LEAST_WEIGHT, MOST = 200, 1e-8, 1 << 16
#: Atlas points that one task moves at a time, and pairs of points that are compared at a time.
BLOCK, PAIRS = 1 << 16, 1 << 22
#: Points that are compared together, and the share of a point's noise that points too far to be compared add up to at most.
LEAF, FAR = 64, 1e-12
#: What is left of the kernel where columns of it stand for all, and points up to which a kernel that needs many columns is held whole.
LEFT, WHOLE = 1e-15, 8192
#: Pairs that a fit compares in plain rounds before it takes longer steps.
PLAIN = 1 << 28
#: Points from which on a fit starts where one of about COARSE evenly taken points settles.
MANY, COARSE = 8192, 4096


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, k, None] - b[None, :, k]) ** 2 for k in range(3))


def _leaves(p: np.ndarray) -> np.ndarray:
    """An order of points in which each LEAF in succession lie together: halved along the widest side again and again."""
    open_, out = [np.arange(len(p))], []
    while open_:
        own = open_.pop()
        at = -(-len(own) // LEAF) // 2 * LEAF
        if not at:
            out.append(own)
            continue
        cut = np.argpartition(p[own, np.ptp(p[own], axis=0).argmax()], at)
        open_ += [own[cut[at:]], own[cut[:at]]]
    return np.concatenate(out)


def _boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(p), LEAF)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)


def _bending(y: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """The kernel's greatest eigenvalues, ascending, and their vectors.

    A smooth kernel is a product of a few of its columns to the last digit (Cholesky's, the greatest rest first), so it
    is never held whole; but where it takes many columns, it is, of up to WHOLE points.
    """
    n = len(y)
    rows, rest, k = np.empty((min(n, 512), n)), np.ones(n), 0
    while k < n and rest[j := int(rest.argmax())] > LEFT:
        if k >= n // 4 and n <= WHOLE:
            weight, vectors = np.linalg.eigh(np.exp(_squares(y, y) / (-2 * beta * beta)))
            kept = np.flatnonzero(weight > LEAST_WEIGHT * weight[-1])[-RANK:]
            return weight[kept], vectors[:, kept]
        if k == len(rows):
            rows = np.concatenate([rows, np.empty((min(k, n - k), n))])
        rows[k] = (np.exp(((y - y[j]) ** 2).sum(1) / (-2 * beta * beta)) - rows[:k, j] @ rows[:k]) / math.sqrt(rest[j])
        rest -= rows[k] ** 2
        rest[j] = 0
        k += 1
    weight, turn = np.linalg.eigh(rows[:k] @ rows[:k].T)
    kept = np.flatnonzero(weight > LEAST_WEIGHT * weight[-1])[-RANK:]
    return weight[kept], rows[:k].T @ (turn[:, kept] / np.sqrt(weight[kept]))


def _posterior(x: np.ndarray, t: np.ndarray, variance: float, outliers: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weight of each t, weight of each x, sums of x by weight for each t, log likelihood) of a mixture around t, a leaf of x at a time.

    A leaf is compared with leaves of t within reach; what those beyond it would add to a point is below FAR of its noise.
    """
    n, m = len(x), len(t)
    noise = (2 * math.pi * variance) ** 1.5 * outliers * m / ((1 - outliers) * n)
    scale = math.log((1 - outliers) / m) - 1.5 * math.log(2 * math.pi * variance)
    reach = 2 * variance * (math.log(m) - math.log(max(noise, np.finfo(float).tiny)) - math.log(FAR))
    (low, high), (t_low, t_high) = _boxes(x), _boxes(t)
    by_t, by_x, likelihood = np.zeros((m, 4)), np.zeros(n), 0.0
    for leaf, i in enumerate(range(0, n, LEAF)):
        apart = np.maximum(np.maximum(t_low - high[leaf], low[leaf] - t_high), 0)
        near = (np.flatnonzero((apart**2).sum(1) <= reach)[:, None] * LEAF + np.arange(LEAF)).ravel()
        near = near[near < m]
        own, centre = x[i : i + LEAF], (low[leaf] + high[leaf]) / 2
        a, b = own - centre, t[near] - centre
        aa, bb = (a**2).sum(1), (b**2).sum(1)
        if max(aa.max(), bb.max(initial=0)) > 1e6 * variance:  # products would lose the digits that tell
            p = _squares(a, b) / (-2 * variance)
        else:
            p = np.column_stack([a / variance, aa / (-2 * variance), np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), bb / (-2 * variance)]).T
        np.exp(p, out=p)
        weight = p.sum(1)
        total = weight + noise
        # far from everything, and no noise: such a point has no part in the fit
        total[total == 0] = np.finfo(float).tiny
        by_x[i : i + LEAF] = weight / total
        by_t[near] += p.T @ (np.column_stack([np.ones(len(own)), own]) / total[:, None])
        likelihood += float(np.log(total).sum()) + len(own) * scale
    return by_t[:, 0], by_x, by_t[:, 1:], likelihood


def _jump(a: tuple, b: tuple, c: tuple, weight: np.ndarray, most: float) -> tuple[np.ndarray, float, float] | None:
    """(bend, variance, length): where rounds from a to b to c lead when carried on (SQUAREM, Varadhan and Roland, 2008), most steps at most.

    The variance no more than halves from b, unless c's has anyhow: the fit shall narrow as slowly as rounds would.
    """
    (r, s), (dr, ds) = ((q[0] - p[0], math.log(q[1] / p[1])) for p, q in ((a, b), (b, c)))
    v, dv = dr - r, ds - s
    size = lambda bend, v: math.sqrt(float((bend**2 / weight[:, None]).sum()) + v * v)
    length = min(most, size(r, s) / max(size(v, dv), np.finfo(float).tiny))
    limit = max(math.log(2), abs(ds))
    while length > 1:
        by = (2 * length - 1) * s + length * length * dv
        if abs(by) <= limit:
            return a[0] + 2 * length * r + length * length * v, b[1] * math.exp(by), length
        length *= 0.8
    return None


def fit(fixed: np.ndarray, moving: np.ndarray, alpha: float = 2.0, beta: float = 2.0, rounds: int | None = None, tolerance: float = 1e-3, outliers: float = 0.1) -> tuple[np.ndarray, np.ndarray, tuple, list[float]]:
    """(control points, their weights, scales, costs): the smooth deformation that draws moving points onto fixed ones.

    Both are brought to mean 0 and size 1 first; scales undoes that. costs are the negative log likelihood and the price
    of bending, round by round; they never rise. Rounds end when the cost falls by no more than tolerance, however many
    that takes (more points take more rounds), or after `rounds` if that is given. After PLAIN pairs every third round is
    one of a longer step, taken back where the cost would rise; a fit settles only by a plain round. Of MANY points, a few
    are fitted first, to start from there; all have their part in the rounds that costs tell of.
    """
    if not 0 < outliers < 1:
        raise ValueError(f"outliers is {outliers}; it must lie between 0 and 1")
    middle = fixed.mean(0), moving.mean(0)
    size = [float(np.sqrt(((p - c) ** 2).sum() / len(p))) or 1.0 for p, c in zip((fixed, moving), middle, strict=True)]
    x, y = (fixed - middle[0]) / size[0], (moving - middle[1]) / size[1]
    order = _leaves(y)
    x, y = x[_leaves(x)], y[order]
    how = alpha, beta, rounds, tolerance, outliers
    start = None
    if min(len(x), len(y)) > MANY:
        few, control = (p[:: -(-len(p) // COARSE)] for p in (x, y))
        weight, vectors, bend, variance, _ = _settled(few, control, None, *how)
        # as wide as the few lie apart, since between them it isn't known how well all fit
        apart = np.concatenate([np.partition(_squares(control[i : i + LEAF], control), 1)[:, 1] for i in range(0, len(control), LEAF)])
        start = _field(y, control, vectors @ (bend / weight[:, None]), beta), max(variance, float(apart.mean()))
    weight, vectors, bend, _, costs = _settled(x, y, start, *how)
    control, weights = np.empty_like(y), np.empty_like(y)
    control[order], weights[order] = y, vectors @ (bend / weight[:, None])
    return control, weights, (*middle, *size), costs


def _settled(x: np.ndarray, y: np.ndarray, start: tuple | None, alpha: float, beta: float, rounds: int | None, tolerance: float, outliers: float) -> tuple:
    """(kernel's weights, vectors, their shares, variance, costs) where rounds end; start: (shifts of y, variance), nothing bent if None."""
    weight, vectors = _bending(y, beta)
    variance = float((len(y) * (x**2).sum() + len(x) * (y**2).sum() - 2 * x.sum(0) @ y.sum(0)) / (3 * len(x) * len(y)))
    state = (np.zeros((len(weight), 3)), variance) if start is None else (vectors.T @ start[0], min(variance, start[1]))
    path, back, longest, compared = [], None, 4.0, 0
    costs: list[float] = []
    while (rounds is None or len(costs) < rounds) and state[1] > 1e-12:
        bend, variance = state
        by_t, by_x, sums, likelihood = _posterior(x, y + vectors @ bend, variance, outliers)
        cost = alpha / 2 * float((bend**2 / weight[:, None]).sum()) - likelihood
        compared += len(x) * len(y)
        if back is not None and not cost <= costs[-1]:
            state, path, back, longest = back, [], None, max(2.0, length / 2)
            continue
        costs.append(cost)
        if back is None and len(costs) > 1 and costs[-2] - costs[-1] <= tolerance:
            break
        if back is not None and length == longest:
            longest *= 2
        to = np.linalg.solve(vectors.T @ (by_t[:, None] * vectors) + np.diag(alpha * variance / weight), vectors.T @ (sums - by_t[:, None] * y))
        t = y + vectors @ to
        after = to, float((by_x @ (x**2).sum(1) - 2 * (sums * t).sum() + by_t @ (t**2).sum(1)) / (3 * by_x.sum()))
        path, back = [*path[-1:], state], None
        state = after
        if compared > PLAIN and len(path) > 1 and after[1] > 1e-12 and (far := _jump(*path, after, weight, longest)) and far[1] > 1e-12:
            state, length, path, back = far[:2], far[2], [], after
    return weight, vectors, *(state if back is None else back), costs


def _field(at: np.ndarray, control: np.ndarray, weights: np.ndarray, beta: float) -> np.ndarray:
    """Shifts of points, a part at a time."""
    out, step = np.empty((len(at), 3)), max(1, PAIRS // len(control))
    by = np.column_stack([control, np.ones(len(control)), (control**2).sum(1) / -2]).T / (beta * beta)
    for i in range(0, len(at), step):
        own = at[i : i + step]
        p = np.column_stack([own, (own**2).sum(1) / -2, np.ones(len(own))]) @ by
        out[i : i + step] = np.exp(p, out=p) @ weights
    return out


def move(points: np.ndarray, control: np.ndarray, weights: np.ndarray, scales: tuple, beta: float) -> np.ndarray:
    """Points under a fit's deformation, a part at a time."""
    own = (points - scales[1]) / scales[3]
    return (own + _field(own, control, weights, beta)) * scales[2] + scales[0]


_SCALES = [f"{n}{c}" for n in ("to_", "at_") for c in XYZ] + ["to_size", "size"]


def _tasks(df: DataFrame) -> int:
    """Four for each specimen, so that few share one; by sizes in bytes Spark would put all fits, which are long, into one task."""
    return max(1, 4 * df.select("specimen_id").distinct().count())


def deformations(points: DataFrame, atlas: DataFrame, percent: float = 4.0, beta: float = 2.0, **how: float) -> DataFrame:
    """(specimen_id, k, control points, weights, scales, rounds, cost): the atlas's deformation onto each specimen.

    Both are thinned by percent of their diagonals first. More than MOST points after that are an error: a fit is one task, and
    its time grows with their square, so thin more. Specimens without points have no deformation.
    """
    one = F.lit("atlas").alias("specimen_id")
    base = subsample(atlas.select(one, "point_id", *XYZ), percent).select("point_id", *XYZ)
    thinned = subsample(points.select("specimen_id", "point_id", *XYZ), percent)
    made = ["k int", *[f"{n}{c} double" for n in ("c", "w") for c in XYZ], *[f"{c} double" for c in _SCALES], "rounds int", "cost double"]
    columns = [c.split()[0] for c in made]

    def fitted(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame(columns=["specimen_id", *columns])
        if max(len(own), len(other)) > MOST:
            raise ValueError(f"{max(len(own), len(other))} points are too many for a fit, {MOST} may be; thin by more than {percent} percent")
        fixed, moving = (df.sort_values("point_id")[list(XYZ)].to_numpy(float) for df in (own, other))
        control, weights, scales, costs = fit(fixed, moving, beta=beta, **how)
        held = np.hstack([np.arange(len(control))[:, None], control, weights, np.tile(np.hstack(scales), (len(control), 1))])
        out = pd.DataFrame(held, columns=columns[:-2]).assign(rounds=len(costs), cost=costs[-1] if costs else 0.0)
        return out.astype({"k": int}).assign(specimen_id=own.specimen_id.iloc[0])[["specimen_id", *columns]]

    goal = per_specimen(base, points)
    tasks = _tasks(points)
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(tasks, "specimen_id") for df in (thinned, goal))
    schema = ", ".join([f"specimen_id {points.schema['specimen_id'].dataType.simpleString()}", *made])
    return written(left.groupBy("specimen_id").cogroup(right.groupBy("specimen_id")).applyInPandas(fitted, schema), "drift")


def drifted(points: DataFrame, atlas: DataFrame, percent: float = 4.0, beta: float = 2.0, **how: float) -> DataFrame:
    """(specimen_id, point_id, x, y, z): all atlas points after the drift onto each specimen, a block of them a task."""
    found = deformations(points, atlas, percent, beta, **how)
    blocks = 1 + atlas.count() // BLOCK
    asked = per_specimen(atlas.select("point_id", *XYZ), found).withColumn("block", F.pmod(F.xxhash64("point_id"), F.lit(blocks)))
    told = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))

    def moved(own: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(by):
            return own.iloc[:0].drop(columns="block")
        by = by.sort_values("k")
        s = by[_SCALES].iloc[0].to_numpy(float)
        xyz = move(own[list(XYZ)].to_numpy(float), by[["cx", "cy", "cz"]].to_numpy(float), by[["wx", "wy", "wz"]].to_numpy(float), (s[:3], s[3:6], s[6], s[7]), beta)
        return own.assign(x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2]).drop(columns="block")

    tasks = _tasks(found) * blocks
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(tasks, "specimen_id", "block") for df in (asked, told))
    schema = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in left.columns if c != "block")
    return left.groupBy("specimen_id", "block").cogroup(right.groupBy("specimen_id", "block")).applyInPandas(moved, schema)


def drift_correspondence(points: DataFrame, atlas: DataFrame, percent: float = 4.0, beta: float = 2.0, **how: float) -> DataFrame:
    """(specimen_id, point_id, vertex_id, ...) as `nearest_vertex` has it: the specimen's vertex that each atlas point drifts to."""
    at = written(drifted(points, atlas, percent, beta, **how), "drift-points")
    return nearest_vertex(at, points)
