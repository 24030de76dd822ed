"""Catalogue operators: queries, pages, look-ups, groupings, gates, upserts. All are single plans for Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import require


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return default if value is None else max(low, min(high, int(value)))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, F.trim(c))


ORDERS = {
    "default": [F.desc_nulls_last, "quality_score", F.desc, "updated_at"],
    "quality": [F.desc_nulls_last, "quality_score", F.asc, "title"],
    "title": [F.asc, "title"],
    "words": [F.desc_nulls_last, "word_count"],
    "evaluated": [F.desc_nulls_last, "evaluated_at"],
}


def matching(books: DataFrame, *, user: str | None = None, title: str | None = None, least_quality: float | None = None, most_quality: float | None = None, hide_fiction: bool = False, statuses: list[str] | None = None, domain: str | None = None) -> DataFrame:  # noqa: E501
    """The rows a catalogue query asks for. hide_fiction keeps rows whose flag is null; all words of title must stand in it."""
    cond = F.lit(True)
    if user is not None:
        cond &= F.col("user_id") == user
    for word in (title or "").lower().split():
        cond &= F.lower("title").contains(word)
    if least_quality is not None:
        cond &= F.col("quality_score") >= least_quality
    if most_quality is not None:
        cond &= F.col("quality_score") <= most_quality
    if hide_fiction:
        cond &= ~F.coalesce("is_fiction_or_water", F.lit(False))
    if statuses is not None:
        if not statuses:
            raise ValueError("an empty list of statuses selects nothing")
        cond &= F.col("status").isin(*statuses)
    if domain is not None:
        cond &= F.col("domain") == domain
    return books.filter(cond)


def query_catalog(books: DataFrame, *, order: str = "default", limit: int | None = None, offset: int = 0, most: int = 500, **wanted) -> DataFrame:  # noqa: ANN003
    """One page of matching(); ties end with the id, the limit is 100 where none is given and held to 1..most."""
    require(books, "id", "title")
    spec = ORDERS[order]
    keys = [f(c) for f, c in zip(spec[::2], spec[1::2], strict=True)]
    return matching(books, **wanted).orderBy(*keys, "id").offset(max(0, offset)).limit(clamp(limit, 100, 1, most))


def _begins(words: Column, start: str) -> Column:
    return F.exists(words, lambda x: x.startswith(start))


def full_text(books: DataFrame, fields: list[str], asked: str) -> DataFrame:
    """Rows whose fields together hold all asked words; a word that ends in * stands for every word it begins."""
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", *fields)), r"[^\p{L}\p{N}]+"))
    cond = F.lit(True)
    for w in asked.lower().split():
        cond &= _begins(words, w[:-1]) if w.endswith("*") else F.array_contains(words, w)
    return books.filter(cond)


def keyset_page(books: DataFrame, statuses: list[str], after: str, limit: int) -> DataFrame:
    return books.filter(F.col("status").isin(*statuses) & (F.col("id") > after)).orderBy("id").limit(limit)


def by_ids(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of the given ids with their position in the list; ids without a row are dropped."""
    wanted = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{key} {dict(df.dtypes)[key]}, position int")
    return df.join(wanted, key)


def label_of(label: Column, unknown: str) -> Column:
    """A label without blanks around it; blank and null ones are `unknown`."""
    return F.coalesce(blank_to_null(label), F.lit(unknown))


def group_by_label(books: DataFrame, label: Column, unknown: str) -> DataFrame:
    """label, the number of books and the smallest id. A label may hold any share of all books, so the ids are rows of members()."""
    return books.groupBy(label_of(label, unknown).alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def members(books: DataFrame, label: Column, unknown: str) -> DataFrame:
    """label and id, one row per book: the lists behind group_by_label, without collecting any."""
    return books.select(label_of(label, unknown).alias("label"), "id")


def localized(books: DataFrame, field: str, first: str = "ru") -> Column:
    other = "en" if first == "ru" else "ru"
    return F.coalesce(*[blank_to_null(F.col(c)) for c in (f"{field}_{first}", f"{field}_{other}", field)])


def tag_members(books: DataFrame) -> DataFrame:
    """tag and id, each once; blank tags are left out."""
    return books.select(F.explode(F.array_distinct(F.transform("tags", lambda x: F.trim(x)))).alias("tag"), "id").filter(F.length("tag") > 0)


def group_by_tag(books: DataFrame, per_book_once: bool = True) -> DataFrame:
    """tag and n; a tag twice in one book counts once, or twice where per_book_once is false."""
    rows = tag_members(books) if per_book_once else books.select(F.explode(F.transform("tags", lambda x: F.trim(x))).alias("tag")).filter(F.length("tag") > 0)
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest order; the choice is an aggregation, so hot keys combine before the shuffle.

    A row without an order counts before all that have one; of rows alike in order any one is kept.
    """
    rest = [c for c in df.columns if c != key]
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows without a new version and all new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def gate(books: DataFrame, ids: DataFrame, least_quality: float) -> DataFrame:
    """The first reason that speaks against each requested id, or null; reasons in order."""
    j = ids.join(books.withColumn("__there", F.lit(True)), "id", "left")
    reason = (
        F.when(F.col("__there").isNull(), "not_found")
        .when(F.col("is_fiction_or_water"), "fiction_or_water")
        .when(F.col("evaluated_at").isNull(), "unevaluated")
        .when(F.coalesce("quality_score", F.lit(0)) < least_quality, "low_quality")
    )
    return j.select("id", reason.alias("reason"))


def row_number_pick(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
