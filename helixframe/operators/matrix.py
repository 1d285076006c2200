"""Matrices in coordinate form (i, j, v), and non-negative factorisation over them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import forget, written


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def density(m: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """rows, cols, nonzero, density; sizes default to the distinct indexes."""
    found = m.agg(F.count_distinct("i").alias("r"), F.count_distinct("j").alias("c"), F.count_if(F.col("v") != 0).alias("nonzero"))
    r = F.col("r") if rows is None else F.lit(rows).cast("long")
    c = F.col("c") if cols is None else F.lit(cols).cast("long")
    return found.select(r.alias("rows"), c.alias("cols"), "nonzero", F.try_divide("nonzero", r * c).alias("density"))


def norm(m: DataFrame) -> DataFrame:
    """Frobenius norm."""
    return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def _draw(index: str, k: int, seed: int) -> Column:
    """Positive starting weights from a hash of index and pattern, alike in every run and layout."""
    unit = lambda p: (F.pmod(F.xxhash64(F.col(index), F.lit(p), F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    # absolute values of normal numbers, by Box and Muller
    return F.array(*[F.abs(F.sqrt(-2 * F.log(unit(2 * p))) * F.cos(2 * 3.141592653589793 * unit(2 * p + 1))) + F.lit(1e-6) for p in range(k)])


def _gram(t: DataFrame, k: int, runs: list[int]) -> tuple[dict[int, list[list[float]]], dict[int, float]]:
    """For each run the k by k products of a factor's columns, and the factor's product with its numerators: bounded by patterns and runs."""
    w, top = F.col("w"), F.col("top")
    sums = [F.sum(w[r * k + a] * w[r * k + b]).alias(f"g{r}_{a}_{b}") for r in runs for a in range(k) for b in range(a, k)]
    dots = [F.sum(sum((w[r * k + p] * top[r * k + p] for p in range(k)), F.lit(0.0))).alias(f"dot{r}") for r in runs] if "top" in t.columns else []
    got = t.agg(*sums, *dots).first().asDict()
    return {r: [[got[f"g{r}_{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)] for r in runs}, {r: got.get(f"dot{r}") or 0.0 for r in runs}


def _update(v: DataFrame, own: DataFrame, other: DataFrame, gram: dict[int, list[list[float]]], index: str, across: str, k: int, every: int) -> DataFrame:
    """One multiplicative step for a factor, with the other held, in the runs that gram names; the others' weights stay. top: the step's numerators."""
    at = [r * k + p for r in gram for p in range(k)]  # of every = runs * k weights
    met = v.join(other.select(F.col(across), F.col("w").alias("o")), across)
    top = met.groupBy(index).agg(*[F.sum(F.col("v") * F.col("o")[p]).alias(f"t{p}") for p in at])
    joined = own.select(index, "w").join(top, index, "left")
    tops = {p: F.coalesce(f"t{p}", F.lit(0.0)) for p in at}
    below = {r * k + p: sum((F.col("w")[r * k + q] * F.lit(g[q][p]) for q in range(k)), F.lit(1e-12)) for r, g in gram.items() for p in range(k)}
    weights = [F.col("w")[p] * tops[p] / below[p] if p in tops else F.col("w")[p] for p in range(every)]
    return joined.select(index, F.array(*weights).alias("w"), F.array(*[tops.get(p, F.lit(0.0)) for p in range(every)]).alias("top"))


def replicated(m: DataFrame, k: int = 5, runs: int = 1, rounds: int = 20, tolerance: float = 0.001, seed: int = 1, seconds: float | None = None) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """W (i, w), H (j, w) and each run's squared errors after its rounds, by multiplicative updates (Lee and Seung 2001) from several starts at once.

    All runs go on together: a factor is a table with an array of runs * k weights, run after run, so a round reads the
    matrix twice whatever the number of runs. A run stops once a round betters its error by no more than the tolerance, after so many rounds, or
    with all others at the end of the round in which so many seconds have passed (no limit by default); its weights stay from then on. Only k by k products
    and errors reach the driver. The error comes from what a round has at hand: the numerators of W's step are the matrix times H.
    An empty matrix gives empty factors and errors of 0; of the same place given twice both values count as entries.
    """
    begun, every = time.monotonic(), runs * k
    v = written(m.filter("v <> 0").select("i", "j", F.col("v").cast("double").alias("v")), "matrix")
    starts = lambda index, more: F.concat(*[_draw(index, k, seed + 100 * r + more) for r in range(runs)]).alias("w")
    w = written(v.select("i").distinct().select("i", starts("i", 0)), "factor")
    h = written(v.select("j").distinct().select("j", starts("j", 1)), "factor")
    square = v.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    errors: list[list[float]] = [[] for _ in range(runs)]
    active = list(range(runs))
    gw, _ = _gram(w, k, active)
    for _ in range(rounds):
        before = h, w
        h = written(_update(v, h, w, {r: gw[r] for r in active}, "j", "i", k, every), "factor")
        gh, _ = _gram(h, k, active)
        w = written(_update(v, w, h, gh, "i", "j", k, every), "factor")
        forget(*before)
        gw, dot = _gram(w, k, active)
        for r in active:
            errors[r].append(square - 2 * dot[r] + sum(gw[r][a][b] * gh[r][a][b] for a in range(k) for b in range(k)))
        active = [r for r in active if len(errors[r]) < 2 or errors[r][-2] - errors[r][-1] > tolerance * max(errors[r][-2], 1e-12)]
        if not active or seconds is not None and time.monotonic() - begun >= seconds:
            break
    return w.select("i", "w"), h.select("j", "w"), errors


def factorise(m: DataFrame, k: int = 5, rounds: int = 20, tolerance: float = 0.001, seed: int = 1, seconds: float | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """W (i, w), H (j, w) and the squared error after each round, from one start."""
    w, h, errors = replicated(m, k, 1, rounds, tolerance, seed, seconds)
    return w, h, errors[0]


def best_run(w: DataFrame, h: DataFrame, errors: list[list[float]], k: int) -> tuple[DataFrame, DataFrame, int]:
    """The factors of the run that ended with the smallest error (of equals the first), and its number."""
    r = min(range(len(errors)), key=lambda x: (errors[x][-1], x))
    own = F.slice("w", r * k + 1, k).alias("w")
    return w.select("i", own), h.select("j", own), r


def run_table(w: DataFrame, index: str, k: int) -> DataFrame:
    """run, index, pattern, weight of all runs."""
    long = w.select(index, F.posexplode("w").alias("_p", "weight"))
    return long.select(F.floor(F.col("_p") / k).cast("int").alias("run"), index, (F.col("_p") % k).cast("int").alias("pattern"), "weight")


def pattern_weights(factor: DataFrame, index: str, names: DataFrame | None = None) -> DataFrame:
    """pattern, index, weight above 0 with the rank of each within its pattern, and each index's best pattern."""
    long = factor.select(index, F.posexplode("w").alias("pattern", "weight")).filter("weight > 0")
    down = Window.partitionBy("pattern").orderBy(F.desc("weight"), index)
    best = long.groupBy(index).agg(F.max(F.struct("weight", (-F.col("pattern")).alias("p")))["p"].alias("p"))
    out = long.withColumn("rank", F.row_number().over(down)).join(best, index).withColumn("best", -F.col("p")).drop("p")
    return out if names is None else out.join(names, index)
