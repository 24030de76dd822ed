"""Entity graph: resolution, relations, adjacency, personalised PageRank, seeds, chunk scores, sweeps, tree walks."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import canonical_name, normalized
from folioflow.session import cut, require, tasks


def canonical(name: Column) -> Column:
    """Canonical form of an entity's name after NFKC; names that leave nothing are empty."""
    return canonical_name(normalized(name))


def resolve_entities(mentions: DataFrame, *scope: str) -> DataFrame:
    """canonical, display (the first spelling by seq), aliases (the other spellings) and mentions, within each scope (such as a user).

    Names are compared after NFKC, in small letters and without punctuation; null names and those that leave nothing are dropped.
    Spellings are folded before they are gathered, so the repetitions of a frequent name cost nothing.
    """
    require(mentions, "name", "seq", *scope)
    spelled = mentions.filter("name IS NOT NULL").groupBy(*scope, "name").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    named = spelled.withColumn("canonical", canonical(F.col("name"))).filter(F.length("canonical") > 0)
    got = named.groupBy(*scope, "canonical").agg(F.min_by("name", F.struct("seq", "name")).alias("display"), F.sort_array(F.collect_list("name")).alias("all"), F.sum("n").alias("mentions"))
    return got.select(*scope, "canonical", "display", F.array_join(F.filter("all", lambda x: x != F.col("display")), "|").alias("aliases"), "mentions")


def ingest_relations(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, canonical, display, aliases, mentions) and relations (subject_id, predicate, object_id, source) of triples.

    triples: subject, predicate, object, seq, source. The id is a hash of the canonical name, so it is the same in every run and
    needs no numbering. Triples with a side that leaves no name are dropped.
    """
    require(triples, "subject", "predicate", "object", "seq", "source")
    sides = triples.select(F.col("subject").alias("name"), "seq").union(triples.select("object", "seq"))
    ents = resolve_entities(sides).select(F.xxhash64("canonical").alias("id"), "*")
    key = lambda c: F.xxhash64(canonical(F.col(c)))
    named = triples.withColumns({"__s": canonical(F.col("subject")), "__o": canonical(F.col("object"))}).filter((F.length("__s") > 0) & (F.length("__o") > 0))
    return ents, named.select(F.xxhash64("__s").alias("subject_id"), "predicate", F.xxhash64("__o").alias("object_id"), "source")


def _canonical_text(text: str) -> str:
    t = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", text).lower())
    return re.sub(r"\s+", " ", t).strip()


def seeds(entities: DataFrame, asked: str, most: int = 20) -> DataFrame:
    """node and weight (1) of the entities a query names: the whole query and its words of three letters or more are looked up as
    canonical names, as aliases, and as parts of names, of which each finds `most` at most, in order of id.

    A query without such words names nothing. entities: id, canonical, display, aliases (between bars).
    """
    words = [w for w in map(_canonical_text, asked.split()) if len(w) >= 3]
    found = None
    for word in dict.fromkeys([_canonical_text(asked), *words]) if words else ():
        whole = entities.filter((F.col("canonical") == word) | F.array_contains(F.split("aliases", r"\|"), word)).select("id")
        part = entities.filter(F.col("canonical").contains(word) | F.lower("display").contains(word)).select("id").orderBy("id").limit(most)
        found = whole.union(part) if found is None else found.union(whole).union(part)
    if found is None:
        return entities.select(F.col("id").alias("node"), F.lit(1.0).alias("weight")).limit(0)
    return found.distinct().select(F.col("id").alias("node"), F.lit(1.0).alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected distinct neighbours without self-loops; edges with a null end are left out."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst")
    return both.distinct()


#: Graphs of at most so many directed edges are ranked in one task, larger ones by joins.
LOCAL_EDGES = 1_000_000


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, *, restart: float = 0.15, iterations: int = 25, tolerance: float = 1e-6, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node and score. seeds: node, weight; teleport is weight over the sum of all positive weights, also of nodes that are not in the graph.

    It stops when the summed change falls below tolerance. No positive seed in the graph gives no rows. Graphs up to
    local_edges run in one task; beyond, the edges, which carry 1 / degree, are laid out by source once, each iteration is one join
    and one aggregation on that layout, and every fifth state is written as a table, where the change is looked at.
    """
    adj = adjacency(edges)
    degree = adj.groupBy("src").agg(F.count("*").alias("deg"))
    steps = cut(adj.join(degree, "src").select("src", "dst", (1.0 / F.col("deg")).alias("p")))
    weights = seeds.filter("weight > 0").groupBy("node").agg(F.sum("weight").alias("w"))
    if steps.count() <= local_edges:
        return _ranked_at_once(steps, weights, restart, iterations, tolerance)
    total = weights.agg(F.sum("w")).first()[0]
    nodes = steps.select(F.col("src").alias("node")).distinct()
    if not total:
        return nodes.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    state = cut(nodes.join(weights, "node", "left").select("node", F.coalesce(F.col("w") / total, F.lit(0.0)).alias("t")).withColumn("score", F.col("t")))
    if state.filter("t > 0").isEmpty():
        return state.filter(F.lit(False)).select("node", "score")
    held = steps.repartition(tasks(steps.sparkSession), "src").persist(StorageLevel.DISK_ONLY)
    for i in range(iterations):
        flow = state.join(held, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("p")).alias("flow"))
        state = state.join(flow, F.col("node") == F.col("dst"), "left").select("node", "t", F.col("score").alias("old"), (restart * F.col("t") + (1 - restart) * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if i % 5 == 4 or i == iterations - 1:
            state = cut(state)
            if state.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < tolerance:
                break
        state = state.drop("old")
    held.unpersist()
    return state.select("node", "score")


def _ranked_at_once(steps: DataFrame, weights: DataFrame, restart: float, iterations: int, tolerance: float) -> DataFrame:
    """The same for a graph of a checked size, as array arithmetic in one task."""
    kind = dict(steps.dtypes)["src"]

    def rank(rows: pd.DataFrame) -> pd.DataFrame:  # at most LOCAL_EDGES edges and the seeds
        edge = rows["p"].notna().to_numpy()
        number, names = pd.factorize(rows["src"])
        at = dict(zip(names, range(len(names)), strict=True))
        src, dst = number[edge], rows["dst"][edge].map(at).to_numpy()
        p = rows["p"][edge].to_numpy()
        w = rows["w"][~edge].to_numpy(float)
        inside = np.zeros(len(names), bool)
        inside[src] = True
        t = np.bincount(number[~edge], w, len(names)) / w.sum() if len(w) else np.zeros(len(names))
        t = np.where(inside, t, 0.0)
        if not t.any():
            return pd.DataFrame({"node": names[:0], "score": t[:0]})
        score = t
        for _ in range(iterations):
            new = restart * t + (1 - restart) * np.bincount(dst, score[src] * p, len(names))
            change, score = np.abs(new - score).sum(), new
            if change < tolerance:
                break
        return pd.DataFrame({"node": names[inside], "score": score[inside]})

    none = F.lit(None)
    rows = steps.select("src", "dst", "p", none.cast("double").alias("w")).union(weights.select("node", none.cast(kind), none.cast("double"), F.col("w").cast("double")))
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(rank, f"node {kind}, score double")


def touching(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that a relation names as subject or object, as a union of two equi-joins in place of an or-join."""
    ids = relations.select(F.col("subject_id").alias("id")).union(relations.select("object_id")).distinct()
    return entities.join(ids, "id", "left_semi")


def registry(entities: DataFrame, relations: DataFrame, most: int = 50) -> DataFrame:
    """The entities that relations name, those of the greatest ids first, `most` at most."""
    return touching(entities, relations).orderBy(F.desc("id")).limit(most)


def without_source(entities: DataFrame, relations: DataFrame, gone: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Entities and relations after sources were deleted: their relations go, then the entities that no relation names any more."""
    kept = relations.join(gone.select(source).distinct(), source, "left_anti")
    return touching(entities, kept), kept


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    ids = relations.select(F.col("subject_id").alias("id")).union(relations.select("object_id")).distinct()
    return entities.join(ids, "id", "left_anti")


def source_scores(relations: DataFrame, scores: DataFrame, source: str) -> DataFrame:
    """Per source the sum of its relations' subject and object scores; missing scores are 0."""
    s = scores.select(F.col("node").alias("subject_id"), F.col("score").alias("a"))
    o = scores.select(F.col("node").alias("object_id"), F.col("score").alias("b"))
    j = relations.join(s, "subject_id", "left").join(o, "object_id", "left")
    return j.groupBy(source).agg(F.sum(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("graph"))


def walk_up(chunks: DataFrame) -> DataFrame:
    """vec_rowid with its parent and grandparent; missing parents give nulls."""
    up = chunks.select(F.col("vec_rowid").alias("parent_vec_rowid"), F.col("parent_vec_rowid").alias("grand_vec_rowid"), F.col("level").alias("parent_level"))
    return chunks.select("vec_rowid", "level", "parent_vec_rowid").join(up, "parent_vec_rowid", "left")
