"""Problem 9: sources mixed to target shares of the total size, by balanced (cube) sampling.

Every document gets whole copies and a fractional inclusion probability for one more. The cube method's flight phase
moves the fractions through the null space of the balancing constraints (tokens and documents) until at most as many
stay fractional as there are constraints; further levels gather these, and a landing of the last few decides them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_collect, cut, require, tasks

#: Documents of a block in the flight phase.
BLOCK_ITEMS = 5000
#: Bound of the table of targets.
MOST_SOURCES = 10_000


def flight(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Move inclusion probabilities through the null space of x (one column per item) until no move is left.

    At every step a window of one item more than constraints has a direction that keeps all balances; one of the two ends
    along it, chosen so that the expectation stays, makes at least one probability 0 or 1.
    """
    p, r = p.astype(float).copy(), np.random.default_rng(seed)
    k = x.shape[0]
    eps = 1e-9
    window: list[int] = []
    waiting = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    while True:
        while len(window) < k + 1 and (i := next(waiting, None)) is not None:
            window.append(i)
        if not window:
            break
        a = x[:, window]
        _, s, vt = np.linalg.svd(a, full_matrices=True)
        rank = int((s > 1e-9 * max(1.0, s[0] if len(s) else 1.0)).sum())
        if rank >= len(window):
            break
        u = vt[-1]
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > eps, (1 - q) / u, np.where(u < -eps, -q / u, np.inf)))
            down = np.min(np.where(u > eps, q / u, np.where(u < -eps, (q - 1) / u, np.inf)))
        if not np.isfinite(up) or not np.isfinite(down) or up + down <= eps:
            break
        q = q + (up if r.random() < down / (up + down) else -down) * u
        q[q < eps * 10] = 0.0
        q[q > 1 - eps * 10] = 1.0
        p[window] = q
        window = [i for i in window if 0 < p[i] < 1]
    return p


#: Documents of all sizes in the last block of a source that stay open for the landing.
HELD = 64


def landing(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Decide the few fractions that are left: each is drawn with its probability, then single documents and pairs change sides as long
    as that brings the balances (rows of x) nearer to their expectation.

    The draw makes the decision random, and an exchange is as likely one way as the other, so no document is preferred.
    """
    p, r = p.copy(), np.random.default_rng(seed)
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    q, y = p[left], x[:, left]
    taken = r.random(len(left)) < q
    off = y @ (taken - q)
    weight = 1.0 / np.maximum(np.abs(y).max(1), 1e-12)
    while True:
        change = y * np.where(taken, -1.0, 1.0)  # what a change of sides adds, by document
        one = off[:, None] + change
        two = off[:, None, None] + change[:, :, None] + change[:, None, :]
        two[:, np.arange(len(left)), np.arange(len(left))] = one
        cost = np.tensordot(weight, np.abs(two), 1)
        i, j = np.unravel_index(int(cost.argmin()), cost.shape)
        if cost[i, j] >= weight @ np.abs(off) - 1e-12:
            break
        for k in {int(i), int(j)}:
            taken[k] = not taken[k]
        off = two[:, i, j]
    p[left] = taken
    return p


def plan(totals: dict[str, float], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Repeats per source (fractional) so that shares meet the targets at the largest size the caps allow."""
    share = sum(t for t, _ in targets.values()) or 1.0
    reach = [totals.get(s, 0) * m / (t / share) for s, (t, m) in targets.items() if t > 0]
    size = min(reach, default=0.0)
    return {s: (size * (t / share) / totals[s] if totals.get(s) else 0.0) for s, (t, _) in targets.items()}


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """key, source, tokens and repeats (0 to max_repeats) for every document of a source with a target.

    The total is the largest at which every source meets its share within its cap, so a source that is short at its cap sets
    the size. Documents without a source, or of a source without a target, are not used; a source with a target but
    without tokens would allow no mix of the given shares at all, so every repeat count is 0 then. Targets are a small fixed table,
    checked against MOST_SOURCES, and are scaled to a sum of 1. Repeated keys are separate documents.
    """
    require(sizes, key, "source", "tokens")
    require(targets, "source", "target_share", "max_repeats")
    rows = bounded_collect(targets, MOST_SOURCES, "the table of targets")
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows if r.source is not None}
    sums = sizes.filter(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    totals = {r.source: float(r.t or 0) for r in sums}
    repeats = plan(totals, wanted)
    spark = sizes.sparkSession
    table = [(s, repeats[s], wanted[s][1]) for s in wanted]
    rates = F.broadcast(spark.createDataFrame(table, "source string, rate double, cap int"))  # at most MOST_SOURCES rows
    items = sizes.select(F.col(f"`{key}`").alias("item"), "source", F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens")).join(rates, "source")
    items = items.withColumn("rate", F.least("rate", F.col("cap").cast("double"))).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int"))
    items = items.select("item", "source", "tokens", "whole", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")).alias("p"))
    kind = dict(sizes.dtypes)[key]
    schema = f"item {kind}, source string, tokens int, whole int, p double, last boolean"
    sure = items.filter("p < 1e-9").withColumn("p", F.lit(0.0))
    open_ = cut(items.filter("p >= 1e-9"))
    done: list[DataFrame] = []
    while True:
        # each block leaves at most as many open documents as there are balances; levels go on until a source is one block
        counts = open_.groupBy("source").agg(F.ceil(F.count("*") / BLOCK_ITEMS).cast("int").alias("blocks"))
        placed = open_.join(F.broadcast(counts), "source")
        placed = placed.select("*", F.pmod(F.xxhash64("item", "tokens"), F.col("blocks")).cast("int").alias("block"), (F.col("blocks") == 1).alias("last"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # the largest first: what is left in the end is small
            pdf = pdf.sort_values(["tokens", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
            p, size = pdf["p"].to_numpy(float), pdf["tokens"].to_numpy(float)
            x = np.stack([size / max(size.max(), 1.0), np.ones(len(p))])
            fly = np.ones(len(p), bool)
            if pdf["last"].iloc[0]:
                fly[np.unique(np.linspace(0, len(p) - 1, HELD).astype(int))] = False
            p[fly] = flight(p[fly], x[:, fly], seed + len(p))
            pdf["p"] = landing(p, x, seed) if pdf["last"].iloc[0] else p
            return pdf[["item", "source", "tokens", "whole", "p", "last"]]

        flown = cut(placed.drop("blocks").repartition(tasks(spark), "source", "block").groupBy("source", "block").applyInPandas(run, schema))
        done.append(flown.filter("last OR p <= 0 OR p >= 1").drop("last"))
        open_ = flown.filter("NOT last AND p > 0 AND p < 1").drop("last")
        if open_.isEmpty():
            break
    out = reduce(DataFrame.unionByName, [sure, *done])
    return out.select(F.col("item").alias(key), "source", "tokens", (F.col("whole") + F.round("p").cast("int")).alias("repeats"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens, documents used and the most repeats of one."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint") * F.col("repeats")).alias("tokens"), F.count_if(F.col("repeats") > 0).alias("documents"), F.max("repeats").alias("most_repeats"))
    total = used.agg(F.sum("tokens").alias("total"))
    return targets.select("source", "target_share", "max_repeats").join(used, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
    )
