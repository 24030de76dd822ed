"""One call for each thing a client asks for: search, search in chunks, export, catalogue, collections, rebuilding the catalogue from files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import catalog, export, graph, replies, seams, vectors
from folioflow.operators.stored import typed_front_matter
from folioflow.session import cut, require

ALPHA, BETA = 0.7, 0.3


def search(concepts: DataFrame, query: str, embedder: seams.Embedder, *, user: str, collection: str | None = None, limit: int = 10) -> DataFrame:
    """The concepts nearest to a query with their similarity, best first. concepts: id, user_id, collection_name, vector and any columns."""
    require(concepts, "id", "user_id", "collection_name", "vector")
    mine = concepts.filter(F.col("user_id") == user)
    mine = mine if collection is None else mine.filter(F.col("collection_name") == collection)
    hits = vectors.top_k(mine, embedder([query])[0].tolist(), limit, key="id", vector="vector", most=100)
    return vectors.with_metadata(hits, mine.drop("vector"), "id")


def search_chunks(chunks: DataFrame, entities: DataFrame, relations: DataFrame, query: str, embedder: seams.Embedder, *, user: str, limit: int = 10, level: int | None = None, least: float | None = None, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:  # noqa: E501
    """The chunks that answer a query: the nearest ones, ranked again with the graph rank of what their relations name.

    Five times as many as asked for are fetched, 100 at most; level and least similarity are looked at after that, so fewer may come back. Without
    a weight for the graph, or where the query names no entity, the order is that of the similarities. chunks: id, user_id, level, vector
    and any columns; relations: subject_id, object_id, source (a chunk's id).
    """
    require(chunks, "id", "user_id", "level", "vector")
    mine = chunks.filter(F.col("user_id") == user)
    hits = vectors.top_k(mine, embedder([query])[0].tolist(), vectors.overfetch(limit), key="id", vector="vector")
    found = vectors.with_metadata(hits, mine.drop("vector"), "id")
    found = found if level is None else found.filter(F.col("level") == level)
    found = cut(found if least is None else found.filter(F.col("sim") >= least))
    if beta == 0:
        scores = None
    else:
        edges = relations.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
        scores = graph.personalised_pagerank(edges, graph.seeds(entities, query))
    near = relations.join(F.broadcast(found.select(F.col("id").alias("source"))), "source")  # at most 100 hits
    per = near.groupBy("source").agg(F.lit(0.0).alias("graph")) if scores is None else graph.source_scores(near, scores, "source")
    return vectors.blended(found, per.withColumnRenamed("source", "id"), alpha if beta else 1.0, beta, limit, "id")


def export_dataset(concepts: DataFrame, path: str, *, user: str, collection: str, form: str = "jsonl") -> tuple[int, int]:
    """Accepted concepts of a collection written in order of creation; the number of lines and of payloads that do not parse.

    form: jsonl (one object a concept), sharegpt (template conversations) or chatml (the same as text). concepts: as
    replies.accepted_concepts() takes them.
    """
    good, bad = replies.accepted_concepts(concepts, user, collection)
    if form == "jsonl":
        rows = good.select("id", "collection_name", "created_at", F.to_json("delta").alias("delta"))
        lines = rows.select("created_at", "id", F.to_json(F.struct(F.col("id").alias("conceptId"), F.col("collection_name").alias("collectionName"), F.col("created_at").alias("createdAt"), "delta")).alias("value"))
    else:
        field = lambda n: F.expr(f"try_variant_get(delta, '$.{n}', 'string')").alias(n)
        atoms = good.select("id", "created_at", *[field(n) for n in ("domain", "essence", "proof", "cipher", "applicability")])
        talks = export.template_dialogues(atoms.drop("created_at"), 3).join(atoms.select(F.col("id").alias("concept_id"), "created_at"), "concept_id")
        turn = lambda who, what, a, b: F.struct(F.lit(who).alias(a), F.col(what).alias(b))
        if form == "sharegpt":
            value = F.to_json(F.struct(F.array(turn("system", "system", "from", "value"), turn("human", "question", "from", "value"), turn("gpt", "answer", "from", "value")).alias("conversations")))
        elif form == "chatml":
            value = F.to_json(F.struct(export.chatml(F.array(turn("system", "system", "role", "content"), turn("user", "question", "role", "content"), turn("assistant", "answer", "role", "content"))).alias("text")))
        else:
            raise ValueError(f"no such form: {form}")
        lines = talks.select("created_at", F.concat_ws("#", "concept_id", "depth").alias("id"), value.alias("value"))
    written = cut(lines)
    written.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id").select("value").write.mode("error").text(path)
    return written.count(), bad.count()


def catalogue_page(books: DataFrame, **wanted) -> tuple[DataFrame, int]:  # noqa: ANN003
    """A page of the catalogue (operators.catalog.query_catalog) and how many books meet the query in all."""
    page = {k: wanted.pop(k) for k in ("order", "limit", "offset", "most") if k in wanted}
    return catalog.query_catalog(books, **page, **wanted), catalog.matching(books, **wanted).count()


def next_page(books: DataFrame, statuses: list[str], after: str, limit: int) -> tuple[DataFrame, str | None]:
    """A page of ids behind `after`, and the id to go on from, or none when the page is not full."""
    page = catalog.keyset_page(books, statuses, after, limit)
    last = page.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    return page, last["last"] if last["n"] == limit else None


def collections(concepts: DataFrame, user: str) -> DataFrame:
    """collection_name and concepts of a user's collections."""
    return concepts.filter(F.col("user_id") == user).groupBy("collection_name").agg(F.count("*").alias("concepts"))


def catalogue_from_files(spark: SparkSession, path: str) -> DataFrame:
    """path and the fields of the front matter of every markdown file below a folder; files without one are left out, the last path of an id counts."""
    fields = ("id", "sha256", "title", "author", "year", "isbn", "publisher", "domain", "status", "tags")

    def read(text: str | None) -> dict | None:
        meta = typed_front_matter(text)
        year = meta.get("year")
        return {f: ",".join(v) if isinstance(v := meta.get(f), list) else None if v is None else str(v) for f in fields} | {"year": year if isinstance(year, int) else None} if meta.get("id") else None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(f, pa.int32() if f == "year" else pa.string()) for f in fields])
        for b in batches:
            yield pa.array([read(t) for t in b.to_pylist()], kind)

    ddl = "struct<" + ",".join(f"{f}:{'int' if f == 'year' else 'string'}" for f in fields) + ">"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), "value")
    rows = files.select("path", F.arrow_udf(run, ddl)("value").alias("m")).filter("m IS NOT NULL").select("path", "m.*")
    return catalog.latest(rows, "id", "path")
