"""Mixing sources to target weights by iterative proportional fitting (operator 3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: Cells (combinations of marginal values) that are fitted on the driver at most; more are fitted as a table.
CELLS = 200_000


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of key and seed: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _shares(targets: dict, name: str) -> dict:
    """The stated share of each value; values are text or None."""
    out = {None if v is None else str(v): float(x) for v, x in targets[name].items()}
    if any(not 0 <= x < float("inf") for x in out.values()):
        raise ValueError(f"{name}: a target share is negative or no number")
    return out


def _filled(goal: np.ndarray, supply: np.ndarray, budget: float) -> np.ndarray:
    """min(supply, m * goal) with the m that makes the sum `budget`; all that has a goal where that is too little."""
    full = np.zeros(len(goal), bool)
    while True:
        left = goal[~full].sum()
        m = max(0.0, budget - supply[full].sum()) / left if left > 0 else 0.0
        more = ~full & (goal > 0) & (m * goal > supply)
        if not more.any():
            return np.where(full, supply, m * goal)
        full |= more


def _capped(w: np.ndarray, tokens: np.ndarray, codes: list, goals: list, budget: float, rounds: int) -> np.ndarray:
    """Tokens of each cell in the sample: min(tokens, w * a factor of each marginal value), raked to the goals.

    A value that has fewer tokens than its part of the budget gives all it has and the others share the rest.
    """
    at = w.copy()
    plans = [(code, _filled(goal, np.bincount(code, weights=np.where(w > 0, tokens, 0.0), minlength=len(goal)), budget)) for code, goal in zip(codes, goals)]
    for _ in range(rounds):
        for code, goal in plans:
            n = len(goal)
            full = np.zeros(len(at), bool)
            while True:
                given = np.bincount(code, weights=np.where(full, tokens, 0.0), minlength=n)
                left = np.bincount(code, weights=np.where(full, 0.0, at), minlength=n)
                factor = np.divide(np.maximum(goal - given, 0), left, out=np.zeros(n), where=left > 0)
                more = ~full & (at * factor[code] > tokens * (1 + 1e-12))
                if not more.any():
                    break
                full |= more
            at = np.where(full, np.maximum(tokens, at * factor[code]), at * factor[code])
    return np.minimum(at, tokens)


def _fit_rows(cells: DataFrame, dims: list[str], power: float, rounds: int, targets: dict, budget: float | None):
    rows = cells.collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    w, total = tokens.copy(), tokens.sum()
    codes, goals = [], []
    for d in dims:
        values = sorted({r[d] for r in rows}, key=lambda x: (x is not None, x))
        place = {v: k for k, v in enumerate(values)}
        code = np.array([place[r[d]] for r in rows], int) if rows else np.zeros(0, int)
        share = np.bincount(code, weights=tokens, minlength=len(values)) / total if total else np.zeros(len(values))
        if d in targets:
            stated = _shares(targets, d)
            goal = np.array([stated.get(v, 0.0) for v in values]) * (share > 0)
        else:
            goal = np.where(share > 0, share, 0) ** power * (share > 0)
        codes.append(code)
        goals.append(goal / goal.sum() * total if goal.sum() > 0 else goal)
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            have = np.bincount(code, weights=w, minlength=len(goal))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
    ratio = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)
    if budget is None:
        top = ratio.max() if len(ratio) else 1.0
        chance = ratio / top if top > 0 else np.zeros_like(ratio)
    else:
        chance = np.divide(_capped(w, tokens, codes, goals, budget * total, rounds), tokens, out=np.zeros_like(w), where=tokens > 0)
    return [(*[r[d] for d in dims], float(x), float(c)) for r, x, c in zip(rows, ratio, chance)]


def _fit_table(cells: DataFrame, dims: list[str], power: float, rounds: int, targets: dict, budget: float | None) -> DataFrame:
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d in dims:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("n"))
        if d in targets:
            stated = cells.sparkSession.createDataFrame(list(_shares(targets, d).items()), "s string, g double")
            share = have.join(stated, F.col(d).eqNullSafe(F.col("s")), "left").select(d, F.when(F.col("n") > 0, F.coalesce("g", F.lit(0.0))).otherwise(0.0).alias("g"))
        else:
            share = have.select(d, F.pow(F.col("n") / F.lit(float(total or 1)), F.lit(power)).alias("g"))
        whole = share.agg(F.sum("g")).first()[0] or 1.0
        goals[d] = stored(share.select(F.col(d).alias("v"), (F.col("g") / whole * total).alias("g")), "goals")
    for _ in range(rounds):
        for d in dims:
            have = now.groupBy(F.col(d).alias("v2")).agg(F.sum("w").alias("have"))
            factor = goals[d].join(have, F.col("v").eqNullSafe(F.col("v2"))).select("v", F.coalesce(F.try_divide("g", "have"), F.lit(0.0)).alias("f"))
            now = now.join(factor, now[d].eqNullSafe(factor["v"])).select(*dims, "tokens", (F.col("w") * F.col("f")).alias("w"))
        now = stored(now, "raking")
    ratio = now.withColumn("weight", F.coalesce(F.try_divide(F.col("w"), F.col("tokens").cast("double")), F.lit(0.0)))
    if budget is None:
        top = ratio.agg(F.max("weight")).first()[0] or 1.0
        return ratio.select(*dims, "weight", (F.col("weight") / top).alias("probability"))
    return _capped_table(ratio, dims, goals, budget * total, rounds)


def _capped_table(ratio: DataFrame, dims: list[str], goals: dict, budget: float, rounds: int) -> DataFrame:
    """_capped() over tables: each look for full cells or values is an aggregation."""
    plans = {}
    for d in dims:
        supply = ratio.groupBy(F.col(d).alias("v2")).agg(F.sum(F.when(F.col("w") > 0, F.col("tokens")).otherwise(0)).cast("double").alias("supply"))
        values = stored(goals[d].join(supply, F.col("v").eqNullSafe(F.col("v2"))).select("v", "g", "supply", F.lit(False).alias("full")), "values")
        while True:
            r = values.agg(F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("g"))).alias("left"), F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0.0)).alias("given")).first()
            m = max(0.0, budget - (r["given"] or 0.0)) / r["left"] if r["left"] else 0.0
            more = ~F.col("full") & (F.col("g") > 0) & (F.col("g") * m > F.col("supply"))
            if not values.where(more).count():
                break
            values = stored(values.withColumn("full", F.col("full") | more), "values")
        plans[d] = stored(values.select("v", F.when(F.col("full"), F.col("supply")).otherwise(F.col("g") * m).alias("g")), "values")
    now = ratio.withColumn("at", F.col("w"))
    for _ in range(rounds):
        for d in dims:
            now = stored(now.select(*dims, "tokens", "weight", "at", F.lit(False).alias("full")), "capping")
            while True:
                sums = now.groupBy(F.col(d).alias("v2")).agg(F.sum(F.when(F.col("full"), F.col("tokens")).otherwise(0)).alias("given"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("at"))).alias("left"))
                f = F.coalesce(F.try_divide(F.greatest(F.col("g") - F.col("given"), F.lit(0.0)), F.col("left")), F.lit(0.0)).alias("f")
                factor = plans[d].join(sums, F.col("v").eqNullSafe(F.col("v2"))).select("v", f)
                tried = now.join(factor, now[d].eqNullSafe(factor["v"])).drop("v")
                tried = stored(tried.withColumn("more", ~F.col("full") & (F.col("at") * F.col("f") > F.col("tokens") * F.lit(1 + 1e-12))), "capping")
                if not tried.where("more").count():
                    break
                now = tried.withColumn("full", F.col("full") | F.col("more")).drop("f", "more")
            scaled = F.col("at") * F.col("f")
            now = tried.withColumn("at", F.when(F.col("full"), F.greatest(F.col("tokens").cast("double"), scaled)).otherwise(scaled)).drop("f", "more")
    return now.select(*dims, "weight", F.coalesce(F.try_divide(F.least("at", F.col("tokens").cast("double")), F.col("tokens").cast("double")), F.lit(0.0)).alias("probability"))


def calibrated(docs: DataFrame, dims: dict[str, Column], tokens: Column, power: float = 0.9, rounds: int = 10, seed: int = 3, id_col: str = "doc_id", cells_on_driver: int = CELLS, targets: dict[str, dict] | None = None, budget: float | None = None) -> DataFrame:
    """docs (as struct `row`) with the marginal values, tokens, weight, probability and kept.

    targets: shares by marginal and value ({"lang": {"en": 0.5, "fr": 0.5}}); values left out get none. For a
    marginal without them: its own token shares to the power `power` (below 1 they favour the small). Both are
    made to sum to one over the values that have tokens. Token weights of the cells are raked to them in
    `rounds` rounds. The weight is a cell's raked tokens over its own.
    budget: the part of all tokens (0 to 1) that the sample shall have. Probabilities are min(1, scaled weight),
    and what a full cell cannot give is raked onto the others; a value with too few tokens gives all it has. So
    a rare cell takes nothing from the others. Without a budget the probability is the weight over the largest:
    the expected tokens are in the target proportions exactly, but one rare cell shrinks the whole sample.
    A document stays if the md5 of its id and the seed is below the probability.

    A null marginal value is a value of its own; cells without tokens get weight 0, but documents without
    tokens are always kept, as they weigh nothing; null ids draw one common number; repeated rows draw alike;
    an empty table gives no rows; other columns pass in `row`.
    """
    if budget is not None and not 0 <= budget <= 1:
        raise ValueError("budget: a part of all tokens, from 0 to 1")
    if unknown := set(targets or {}) - set(dims):
        raise ValueError(f"targets of no marginal: {sorted(unknown)}")
    spark = prepare(docs.sparkSession)
    names = [f"d{k}" for k in range(len(dims))]
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), *[c.cast("string").alias(n) for n, c in zip(names, dims.values())], F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))
    cells = stored(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    kind = ", ".join([f"{n} string" for n in names] + ["weight double", "probability double"])
    stated = {n: targets[d] for n, d in zip(names, dims) if d in (targets or {})}
    if cells.count() <= cells_on_driver:
        fitted = F.broadcast(spark.createDataFrame(_fit_rows(cells, names, power, rounds, stated, budget), kind))
    else:
        fitted = _fit_table(cells, names, power, rounds, stated, budget)
    fitted = fitted.select(*[F.col(n).alias("f" + n) for n in names], "weight", "probability")
    same = [F.col(n).eqNullSafe(F.col("f" + n)) for n in names]
    out = rows.join(fitted, same).withColumn("kept", (F.col("tokens") == 0) | (uniform(F.col("id"), seed) < F.col("probability")))
    return out.select("row", *[F.col(n).alias(d) for n, d in zip(names, dims)], "tokens", "weight", "probability", "kept")
