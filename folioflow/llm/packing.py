"""Problem 8: items of varying size put into containers of fixed capacity, by minimum bin slack.

Per container a subset-sum dynamic program over the sizes still available finds the fullest feasible combination,
which is removed. Items are spread over blocks by hash, and each block packs for itself; what its last
containers leave open is packed once more among the remainders of many blocks.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tokens import pieces_of
from folioflow.session import cut, require, tasks

#: Items of a block; the slack of a full block's containers is close to nothing, so larger blocks gain little.
BLOCK_ITEMS = 4000


def fullest(available: dict[int, int], capacity: int, first: int) -> list[int]:
    """Sizes (with repetition) of the fullest combination within the capacity that holds one item of size `first`.

    The reachable sums are a bitset in one integer. Sizes join from the largest down, each as often as it is available,
    in doubling steps; the path back is read from the bitsets kept on the way. It stops as soon as the capacity itself
    can be reached.
    """
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted(available, reverse=True):
        n = available[size] - (size == first)
        if size > room or n <= 0 or size == 0:
            continue
        n, k = min(n, room // size), 1
        while n > 0:
            take = min(k, n)
            new = (reach | (reach << (take * size))) & mask
            if new != reach:
                steps.append((reach, size, take))
                reach = new
            n -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = [first]
    for before, size, take in reversed(steps):
        if not before >> total & 1:
            out += [size] * take
            total -= size * take
    return out


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Container numbers for the items, in their order. Every container starts with the largest item left; items without
    size go to the first container. An item over the capacity is an error: cut it before."""
    if any(s > capacity or s < 0 for s in sizes):
        raise ValueError("an item is larger than the container")
    waiting: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        waiting[s].append(i)
    available = {s: len(v) for s, v in waiting.items()}
    bins, no = [0] * len(sizes), 0
    while any(available):
        chosen = fullest(available, capacity, max(available))
        for s in chosen:
            bins[waiting[s].pop()] = no
            available[s] -= 1
            if not available[s]:
                del available[s]
        no += 1
    for i in waiting.get(0, []):
        bins[i] = 0
    return bins


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """key, part, tokens and pack for items with their tokens; items over the capacity are cut into full parts first.

    Two rounds: blocks of about BLOCK_ITEMS items, spread by a hash of key, part and copy so that no source or group of copies
    fills one, pack for themselves; containers filled below 99.5 percent give their items back to one more round over fewer,
    larger-ranged blocks. The same items give the same packs in any layout and after any retry. Empty items (no tokens) ride in
    the first container of their block. Repeated keys are separate items, numbered as copies. An empty table gives an
    empty result.
    """
    require(sizes, key, "tokens")
    copies = sizes.groupBy(F.col(f"`{key}`").alias("item"), F.coalesce("tokens", F.lit(0)).alias("tokens")).agg(F.count("*").alias("n"))
    numbered = copies.select("item", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select(F.struct("item", "copy", F.col("tokens").alias("size")).alias("it"), "tokens")
    parts = pieces_of(numbered, "it", capacity).select("it.item", "it.copy", "it.size", "part", "tokens")
    full = parts.filter(F.col("tokens") == capacity).select("item", "copy", "size", "part", "tokens", F.concat_ws("-", F.lit("f"), F.xxhash64("item", "size"), "copy", "part").alias("pack"))
    rest = parts.filter(F.col("tokens") < capacity)
    kind = dict(sizes.dtypes)[key]

    def in_blocks(rows: DataFrame, label: str) -> DataFrame:
        n = rows.count()
        blocks = max(1, -(-n // BLOCK_ITEMS))
        spread = rows.withColumn("block", F.pmod(F.xxhash64("item", "copy", "size", "part"), F.lit(blocks)).cast("int"))

        def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["tokens", "item", "copy", "part"], kind="stable")
            no = pack_sizes(pdf["tokens"].tolist(), capacity)
            return pdf[["item", "copy", "size", "part", "tokens"]].assign(pack=[f"{label}-{key_[0]}-{x}" for x in no])

        many = min(blocks, tasks(rows.sparkSession))
        return spread.repartition(many, "block").groupBy("block").applyInPandas(run, f"item {kind}, copy bigint, size int, part int, tokens int, pack string")

    first = cut(in_blocks(rest, "a"))
    filled = first.groupBy("pack").agg(F.sum("tokens").alias("s"))
    good = first.join(filled.filter(F.col("s") >= 0.995 * capacity).select("pack"), "pack").select("item", "copy", "size", "part", "tokens", "pack")
    open_ = first.join(filled.filter(F.col("s") < 0.995 * capacity).select("pack"), "pack").select("item", "copy", "size", "part", "tokens")
    again = in_blocks(cut(open_), "b")
    return full.unionByName(good).unionByName(again).select(F.col("item").alias(key), "part", "tokens", "pack")


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """packs, items, tokens and the share of room lost over all containers."""
    per = packed.groupBy("pack").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("packs"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), (1 - F.sum("t") / (F.count("*") * capacity)).alias("slack"))
