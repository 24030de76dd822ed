"""Queries over vectors, the entity graph and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import dedup as X
from folioflow.operators import graph as G
from folioflow.operators import vectors as V
from folioflow.plans.registry import query
from folioflow.session import bounded_collect, cut, table
from folioflow.streaming import monitors as M

Spark = SparkSession


def _query_vector(s: Spark, d: str) -> list[float]:
    e = table(s, d, "embeddings")
    return list(bounded_collect(e.filter(F.col("vec_id") == e.agg(F.min("vec_id")).first()[0]).select("embedding"), 1, "the query vector")[0][0])


_Q = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))), 6)"


@query("knn_topk", f"SELECT vec_id, {_COS} AS sim FROM embeddings, {_Q} ORDER BY sim DESC, vec_id LIMIT 10")
def knn_topk(s: Spark, d: str) -> DataFrame:
    return V.top_k(table(s, d, "embeddings"), _query_vector(s, d), 10)


@query("knn_filtered", f"SELECT vec_id, {_COS} AS sim FROM embeddings, {_Q} WHERE label = 1 ORDER BY sim DESC, vec_id LIMIT 10")
def knn_filtered(s: Spark, d: str) -> DataFrame:
    return V.top_k(table(s, d, "embeddings").filter("label = 1"), _query_vector(s, d), 10)


@query("knn_threshold", f"SELECT * FROM (SELECT vec_id, {_COS} AS sim FROM embeddings, {_Q} ORDER BY sim DESC, vec_id LIMIT 20) x WHERE sim >= 0.2")
def knn_threshold(s: Spark, d: str) -> DataFrame:
    return V.top_k(table(s, d, "embeddings"), _query_vector(s, d), 20).filter("sim >= 0.2")


@query("knn_dot", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS sim FROM embeddings, {_Q} ORDER BY sim DESC, vec_id LIMIT 10")
def knn_dot(s: Spark, d: str) -> DataFrame:
    return V.top_k(table(s, d, "embeddings"), _query_vector(s, d), 10, metric="dot")


@query("knn_l2", f"SELECT vec_id, round(1 - list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) / 2, 6) AS sim FROM embeddings, {_Q} ORDER BY sim DESC, vec_id LIMIT 10")
def knn_l2(s: Spark, d: str) -> DataFrame:
    return V.top_k(table(s, d, "embeddings"), _query_vector(s, d), 10, metric="l2")


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(s: Spark, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


_NEAR = """SELECT query, neighbour, sim FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) x QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) <= 3"""


@query("knn_join", _NEAR)
def knn_join(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(e.filter("vec_id % 100 = 0"), e, 3)


@query("novelty_bands", f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN sim < 0.65 THEN 'novel' WHEN sim > 0.85 THEN 'derivative' ELSE 'judge' END AS band FROM ({_NEAR}) y QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) = 1) z GROUP BY band")
def novelty_bands(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(e.filter("vec_id % 100 = 0"), e, 1).select(V.novelty_band(F.col("sim")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("idea_clusters")
def idea_clusters(s: Spark, d: str) -> DataFrame:
    return X.idea_clusters(table(s, d, "embeddings"), 0.3, "label", "vec_id")


# --- graph: suppliers and parts of the line items as entities, one relation per line, the order as its source

_TRIPLES = "(SELECT s_name AS subject, p_name || ' ' || p_brand AS object, l_orderkey AS source FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"
_CANON = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s_-]', '', 'g'), '\\s+', ' ', 'g'))"
_REL = f"(SELECT {_CANON.format('subject')} AS s, {_CANON.format('object')} AS o, source FROM {_TRIPLES} t)"
_SEEK = "red widget Supplier#000000007"


def _triples(s: Spark, d: str) -> DataFrame:
    """Names are joined to the line items from two small tables; the line's number gives the order of mention."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    sup = table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("subject"))
    part = table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("object"))
    j = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("subject", F.lit("supplies").alias("predicate"), "object", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("source"))


def _graph(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations, written once: several steps of a search read them."""
    ents, rels = G.ingest_relations(_triples(s, d))
    return cut(ents), cut(rels)


@query("relation_ingest", f"SELECT (SELECT count(*) FROM (SELECT s FROM {_REL} a UNION SELECT o FROM {_REL} b) u) AS entities, (SELECT count(*) FROM {_REL} c) AS relations")
def relation_ingest(s: Spark, d: str) -> DataFrame:
    ents, rels = G.ingest_relations(_triples(s, d))
    return ents.agg(F.count("*").alias("entities")).crossJoin(rels.agg(F.count("*").alias("relations")))  # one row each


@query("graph_adjacency", f"SELECT node, count(DISTINCT other) AS degree FROM (SELECT s AS node, o AS other FROM {_REL} a UNION SELECT o, s FROM {_REL} b) x WHERE node <> other GROUP BY node")
def graph_adjacency(s: Spark, d: str) -> DataFrame:
    ents, rels = _graph(s, d)
    degree = G.adjacency(rels.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))).groupBy("src").agg(F.count("*").alias("degree"))
    return degree.join(ents.select(F.col("id").alias("src"), F.col("canonical").alias("node")), "src").select("node", "degree")


_NAMES = f"(SELECT DISTINCT unnest([s, o]) AS node FROM {_REL} r)"
_SEEDS = f"(SELECT node FROM {_NAMES} n WHERE contains(node, 'red') OR contains(node, 'widget') OR contains(node, 'supplier000000007') OR contains(node, 'red widget supplier000000007'))"


@query("graph_seeds", f"SELECT node FROM {_SEEDS} q")
def graph_seeds(s: Spark, d: str) -> DataFrame:
    """All names that hold a word of the query; the look-up's cut at 20 a word is lifted, as ids follow no order of names."""
    ents, _ = _graph(s, d)
    return G.seeds(ents, _SEEK, 1 << 30).join(ents, F.col("node") == F.col("id")).select(F.col("canonical").alias("node"))


_PPR = f"""WITH RECURSIVE rel AS MATERIALIZED (SELECT DISTINCT s, o FROM {_REL} a), adj AS MATERIALIZED (SELECT s AS src, o AS dst FROM rel UNION SELECT o, s FROM rel), deg AS MATERIALIZED (SELECT src, count(*) AS k FROM adj GROUP BY src), seed AS MATERIALIZED (SELECT node, 1.0::DOUBLE / count(*) OVER () AS t FROM {_SEEDS} q), start AS MATERIALIZED (SELECT d.src AS node, k, coalesce(t, 0) AS t FROM deg d LEFT JOIN seed ON seed.node = d.src),
r AS (SELECT 0 AS i, node, t AS score FROM start
UNION ALL SELECT * FROM (SELECT any_value(r.i) + 1, a.dst, 0.15 * any_value(z.t) + 0.85 * sum(r.score / g.k) FROM r JOIN adj a ON a.src = r.node JOIN start g ON g.node = r.node JOIN start z ON z.node = a.dst WHERE r.i < 25 GROUP BY a.dst) z)
SELECT node, round(score, 10) AS score FROM r WHERE i = 25"""


def _ranked(ents: DataFrame, rels: DataFrame) -> DataFrame:
    edges = rels.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    return G.personalised_pagerank(edges, G.seeds(ents, _SEEK, 1 << 30))


@query("graph_ppr", _PPR)
def graph_ppr(s: Spark, d: str) -> DataFrame:
    ents, rels = _graph(s, d)
    return _ranked(ents, rels).join(ents.select(F.col("id").alias("node"), "canonical"), "node").select(F.col("canonical").alias("node"), F.round("score", 10).alias("score"))


@query("chunk_graph_score", f"WITH g AS ({_PPR}) SELECT source AS chunk, round(sum(coalesce(a.score, 0) + coalesce(b.score, 0)), 10) AS graph FROM {_REL} r LEFT JOIN g a ON a.node = r.s LEFT JOIN g b ON b.node = r.o GROUP BY 1")
def chunk_graph_score(s: Spark, d: str) -> DataFrame:
    ents, rels = _graph(s, d)
    scores = _ranked(ents, rels).withColumn("score", F.round("score", 10))
    return G.source_scores(rels, scores, "source").select(F.col("source").alias("chunk"), F.round("graph", 10).alias("graph"))


@query("hybrid_rank", f"WITH g AS ({_PPR}), hits AS (SELECT vec_id, {_COS} AS sim FROM embeddings, {_Q} ORDER BY sim DESC, vec_id LIMIT 100), c AS (SELECT source, round(sum(coalesce(a.score, 0) + coalesce(b.score, 0)), 10) AS graph FROM {_REL} r JOIN hits ON vec_id = source LEFT JOIN g a ON a.node = r.s LEFT JOIN g b ON b.node = r.o GROUP BY 1), h AS (SELECT vec_id, sim, o_orderstatus AS status, coalesce(graph, 0) AS graph FROM hits JOIN orders ON o_orderkey = vec_id LEFT JOIN c ON c.source = vec_id) SELECT vec_id, status, sim, graph, round(0.7 * sim + CASE WHEN max(graph) OVER () > 0 THEN 0.3 * graph / max(graph) OVER () ELSE 0 END, 6) AS final FROM h ORDER BY final DESC, vec_id LIMIT 20")
def hybrid_rank(s: Spark, d: str) -> DataFrame:
    """The flagship search: nearest chunks joined with their rows (orders), ranked with the graph scores of their relations."""
    hits = cut(V.with_metadata(V.top_k(table(s, d, "embeddings"), _query_vector(s, d), V.overfetch(20)), table(s, d, "orders").select(F.col("o_orderkey").alias("vec_id"), F.col("o_orderstatus").alias("status")), "vec_id"))
    ents, rels = _graph(s, d)
    scores = _ranked(ents, rels).withColumn("score", F.round("score", 10))
    near = rels.join(F.broadcast(hits.select(F.col("vec_id").alias("source"))), "source")  # at most 100 hits
    graph = G.source_scores(near, scores, "source").select(F.col("source").alias("vec_id"), F.round("graph", 10).alias("graph"))
    return V.blended(hits, graph, 0.7, 0.3, 20, "vec_id").select("vec_id", "status", "sim", "graph", "final")


@query("entity_resolution", f"SELECT canonical, first_value(name) OVER (PARTITION BY canonical ORDER BY seq, name) AS display, sum(n) OVER (PARTITION BY canonical)::BIGINT AS mentions FROM (SELECT name, min(seq) AS seq, count(*) AS n, {_CANON.format('nfkc')} AS canonical FROM (SELECT name, seq, replace(replace(name, chr(160), ' '), chr(8230), '...') AS nfkc FROM (SELECT unnest([author, author_en]) AS name, epoch_us(created_at) AS seq FROM books) a WHERE name IS NOT NULL) b GROUP BY name, nfkc) c WHERE canonical <> '' QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY seq, name) = 1")
def entity_resolution(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "books").select(F.explode(F.array("author", "author_en")).alias("name"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("seq")).filter("name IS NOT NULL")
    return G.resolve_entities(b).select("canonical", "display", "mentions")


@query("entity_registry", "SELECT DISTINCT c_custkey AS id, c_name AS name FROM customer, (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 49) r WHERE c_custkey = a OR c_custkey = b ORDER BY id DESC LIMIT 50")
def entity_registry(s: Spark, d: str) -> DataFrame:
    rel = table(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id"))
    return G.registry(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), rel)


@query("graph_orphan_sweep", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def graph_orphan_sweep(s: Spark, d: str) -> DataFrame:
    rel = table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("object_id"))
    return G.orphans(table(s, d, "part").select(F.col("p_partkey").alias("id")), rel)


@query("graph_cascade_delete", f"WITH k AS (SELECT * FROM {_REL} r WHERE source NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) SELECT count(DISTINCT node) AS entities, (SELECT count(*) FROM k) AS relations FROM (SELECT unnest([s, o]) AS node FROM k) x")
def graph_cascade_delete(s: Spark, d: str) -> DataFrame:
    ents, rels = _graph(s, d)
    gone = table(s, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("source"))
    kept, left = G.without_source(ents, rels, gone)
    return kept.agg(F.count("*").alias("entities")).crossJoin(left.agg(F.count("*").alias("relations")))  # one row each


@query("propositions", "SELECT concept_id, part, text FROM (SELECT c_nationkey AS concept_id, c_custkey AS part, left(c_name || ' buys in ' || c_mktsegment || '.', 400) AS text FROM customer) x WHERE length(text) >= 10 QUALIFY row_number() OVER (PARTITION BY concept_id, lower(text) ORDER BY part) = 1")
def propositions(s: Spark, d: str) -> DataFrame:
    rel = table(s, d, "customer").select(F.col("c_nationkey").alias("concept_id"), F.col("c_custkey").alias("part"), F.col("c_name").alias("subject"), F.lit("buys_in").alias("predicate"), F.col("c_mktsegment").alias("object"))
    return X.propositions(rel)


# --- events

@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_counts(s: Spark, d: str) -> DataFrame:
    return M.tumbling_counts(table(s, d, "events"))


@query("sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, k")
def sessions(s: Spark, d: str) -> DataFrame:
    return M.sessions(table(s, d, "events"))


@query("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_window(s: Spark, d: str) -> DataFrame:
    return M.rate_in_window(table(s, d, "events"), "event_type").select("event_id", "recent")


@query("drift_monitor", "SELECT event_id, user_id, round((long - short) / long, 6) AS drop FROM (SELECT *, row_number() OVER w AS n, avg(value) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS long, avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS short FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE n >= 20 AND long > 0 AND (long - short) / long >= 0.15")
def drift_monitor(s: Spark, d: str) -> DataFrame:
    return M.drift(table(s, d, "events"), "user_id").select("event_id", "user_id", F.round("drop", 6).alias("drop"))


@query("drift_alerts")
def drift_alerts(s: Spark, d: str) -> DataFrame:
    return M.drift_alerts(table(s, d, "events"), "user_id", "1 hour").select("event_id", "user_id", F.round("drop", 6).alias("drop"))


@query("circuit_rates", "SELECT event_id, round(rate, 6) AS rate, round(p95, 6) AS p95, CASE WHEN rate < 0.8 THEN 'halve' WHEN rate >= 0.95 THEN 'raise' ELSE 'hold' END AS step FROM (SELECT event_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) OVER w AS rate, quantile_cont(value, 0.95) OVER w AS p95 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) x")
def circuit_rates(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ok", F.col("event_type") != "error")
    return M.success_window(e, "user_id").select("event_id", F.round("rate", 6).alias("rate"), F.round("p95", 6).alias("p95"), "step")


@query("controller_limits")
def controller_limits(s: Spark, d: str) -> DataFrame:
    return M.controller_limits(table(s, d, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", slow=100.0)


@query("breaker_states")
def breaker_states(s: Spark, d: str) -> DataFrame:
    return M.breaker_states(table(s, d, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", rate=0.4)


@query("resume_by_ids", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def resume_by_ids(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events")
    return M.not_yet_done(e, e.filter("event_type = 'click'"), "event_id").select("event_id")


@query("tier_cascade", "SELECT user_id, CASE WHEN g IS NOT NULL THEN g ELSE b END AS tier FROM (SELECT user_id, min(event_id) FILTER (value >= 60) AS g, arg_min(event_id, (-value, event_id)) AS b FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id) x")
def tier_cascade(s: Spark, d: str) -> DataFrame:
    tries = table(s, d, "events").filter("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", F.col("event_id").alias("tier"), F.col("value").alias("quality"))
    return M.first_good_tier(tries, "user_id", 60).select("user_id", "tier")


@query("uniqueness_scores", f"SELECT label, count(*) AS ideas, count(*) FILTER (sim < 0.3) AS novel, CASE WHEN count(*) >= 3 THEN CAST(floor(100 * count(*) FILTER (sim < 0.3) / count(*) + 0.5) AS INT) END AS score FROM (SELECT * FROM ({_NEAR}) y QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) = 1) z JOIN embeddings ON vec_id = query GROUP BY label")
def uniqueness_scores(s: Spark, d: str) -> DataFrame:
    from folioflow.operators import seams

    e = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    near = V.nearest(e.filter("vec_id % 100 = 0"), e, 1).select(F.col("query").alias("vec_id"), V.novelty_band(F.col("sim"), 0.3, 0.85).alias("band"))
    return seams.uniqueness(near.join(e.select("vec_id", "label"), "vec_id"), "label")


@query("semantic_dedup")
def semantic_dedup(s: Spark, d: str) -> DataFrame:
    """The stated query set against all other vectors: which of its rows resemble none before them."""
    from folioflow.operators import seams

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("created_at"))
    return seams.new_concepts(e.filter("id % 100 = 0"), e.filter("id % 100 <> 0"), 0.45).select("id")


@query("vector_scroll", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) ORDER BY vec_id LIMIT 256 OFFSET 20")
def vector_scroll(s: Spark, d: str) -> DataFrame:
    return table(s, d, "embeddings").filter(F.col("label").isin(1, 2)).select("vec_id", "label").orderBy("vec_id").offset(20).limit(256)


@query("hits_with_rows", f"SELECT vec_id, sim, o_orderstatus AS status, o_totalprice AS price FROM (SELECT vec_id, {_COS} AS sim FROM embeddings, {_Q} ORDER BY sim DESC, vec_id LIMIT 50) h JOIN orders ON o_orderkey = vec_id")
def hits_with_rows(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("vec_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return V.with_metadata(V.top_k(table(s, d, "embeddings"), _query_vector(s, d), 50), rows, "vec_id").select("vec_id", "sim", "status", "price")


@query("event_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(s: Spark, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@query("job_transitions", "SELECT event_id FROM (SELECT event_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS s FROM events) x) y WHERE b IS NOT NULL AND b <> s AND NOT (b || '>' || s IN ('queued>running', 'queued>cancelled', 'running>done', 'running>failed', 'running>cancelled'))")
def job_transitions(s: Spark, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    e = table(s, d, "events").select("event_id", F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), state.alias("state"))
    return M.invalid_transitions(e).select("event_id")
