"""Pools of candidate records: works, their standard records, and duplicates.

A pool is a DataFrame with a row per candidate. ``book_id`` names the pool and ``pos`` is
the candidate's place in it: order is data here, every choice ends in ``pos`` and none in
the order rows happen to arrive. Keys are worked out first (some need Python, after which Spark
forgets how rows were dealt), then ``reduced`` deals the rows by ``book_id`` once, for all its
windows. A book's pool is bounded by what its sources may answer, so this deals evenly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as X

SCHEMA = (
    "book_id long, pos long, source string, title string, authors array<string>, author_ids array<string>, "
    "series string, series_number string, series_id string, language string, isbn string, description string, "
    "publisher string, date string, cover string, genres array<struct<genre:string,seen:string>>"
)
#: Fixed value: the fields that tell two records of a work apart, the last one first.
PAYLOAD = (
    "title", "authors", "series", "series_number", "description", "publisher", "date", "isbn", "language", "cover",
)


def stated(name: str) -> Column:
    """A payload field as text, empty where nothing is stated."""
    value = F.array_join(F.col(name), "; ") if name == "authors" else F.col(name).cast("string")
    return F.coalesce(value, F.lit(""))


def completeness(fields=PAYLOAD) -> Column:
    """How many payload fields are stated."""
    return reduce(lambda n, name: n + F.when(stated(name) != "", 1).otherwise(0), fields, F.lit(0))


def first_in_group(df: DataFrame, by: list[str], key: Column, order: list[Column]) -> DataFrame:
    """One row for each ``key`` within ``by``, the first by ``order``; a null key never groups."""
    window = Window.partitionBy(*by, "__key", "__alone").orderBy(*order)
    alone = F.when(key.isNull(), F.col("pos"))
    return (
        df.withColumns({"__key": key, "__alone": alone})
        .withColumn("__n", F.row_number().over(window))
        .filter("__n = 1")
        .drop("__key", "__alone", "__n")
    )


def source_ranks(by: str = "book_id") -> Column:
    """A source's rank in its pool: the order in which sources first appear."""
    return F.min("pos").over(Window.partitionBy(by, "source"))


def standard_record_order(fields=PAYLOAD) -> list[Column]:
    """The earliest date (undated last), the source that appears first, the most payload
    fields, the fields themselves from the last to the first, then the place in the pool."""
    return [
        F.nullif(F.col("date"), F.lit("")).asc_nulls_last(),
        F.col("__source_rank").asc(),
        completeness(fields).desc(),
        *(stated(name).asc() for name in reversed(fields)),
        F.col("pos").asc(),
    ]


def work_keys(pool: DataFrame) -> DataFrame:
    """The pool with ``group`` (title head and author letters; null if either is missing) and
    ``__own``, the record's own placement (series and position, both or none)."""
    # Each step in a projection of its own: what a later one reads twice is a column by then.
    told = pool.withColumns(
        {
            "__title": X.parted(F.col("title"))["head"],
            "__names": X.name_keys(F.coalesce("authors", F.array().cast("array<string>"))),
            "__number": X.said(F.col("series_number")),
        }
    )
    spelled = told.withColumns(
        {"__head": X.comparison_key(F.col("__title")), "__letters": X.letters(F.col("__names")), "__series": X.comparison_key(F.col("series"))}
    )
    placed = (F.col("__series") != "") & F.col("__number").isNotNull()
    known = (F.col("__head") != "") & F.col("__letters").isNotNull()
    return spelled.withColumns(
        {
            "group": F.when(known, F.concat_ws("\x1f", "__head", "__letters")),
            "__own": F.when(placed, F.concat_ws("\x1f", "__series", "__number")),
        }
    ).drop("__title", "__names", "__number", "__head", "__letters", "__series")


def placed_groups(keyed: DataFrame) -> DataFrame:
    """The pool of ``work_keys`` with ``placement``: its own, or the group's if that has one."""
    placed = F.collect_set("__own").over(Window.partitionBy("book_id", "group"))
    return (
        keyed.withColumn("__placed", placed)
        .withColumn("placement", F.coalesce("__own", F.when(F.size("__placed") == 1, F.get("__placed", 0))))
        .drop("__own", "__placed")
    )


def work_groups(pool: DataFrame) -> DataFrame:
    """The pool with ``group`` (title head and author letters; null if either is missing) and
    ``placement`` (series and position, both or none; a sole one in the group is everyone's)."""
    return placed_groups(work_keys(pool))


def _standard(grouped: DataFrame) -> DataFrame:
    key = F.when(F.col("group").isNotNull(), F.struct("group", F.coalesce("placement", F.lit("")).alias("placement")))
    work = F.coalesce(F.to_json(key), F.concat(F.lit("#"), F.col("pos").cast("string")))
    first = F.min("pos").over(Window.partitionBy("book_id", "__work"))
    chosen = grouped.withColumn("__source_rank", source_ranks()).withColumn("__work", work).withColumn("__first", first)
    window = Window.partitionBy("book_id", "__work").orderBy(*standard_record_order())
    return (
        chosen.withColumn("__n", F.row_number().over(window))
        .filter("__n = 1")
        .withColumn("pos", F.col("__first"))
        .drop("__work", "__first", "__n", "__source_rank", "group", "placement")
    )


def standard_records(pool: DataFrame) -> DataFrame:
    """One candidate for each work, at the place where its work first appears."""
    return _standard(placed_groups(work_keys(pool).repartition("book_id")))


def identity() -> Column:
    """What identifies a record: its ISBN-13, else title, first author and year; or null."""
    return _identified(X.comparison_key(F.col("title")), X.name_key(F.get("authors", 0)))


def _identified(title: Column, author: Column) -> Column:
    isbn = X.isbn13(F.col("isbn"))
    key = F.concat_ws("\x1f", F.lit("key"), title, author, F.coalesce(X.year(F.col("date")), F.lit("")))
    return F.when(isbn.isNotNull(), F.concat(F.lit("isbn\x1f"), isbn)).when((title != "") & (author != ""), key)


def identified(pool: DataFrame) -> DataFrame:
    """The pool with ``__identity``."""
    keyed = pool.withColumns({"__title": X.comparison_key(F.col("title")), "__author": X.name_key(F.get("authors", 0))})
    return keyed.withColumn("__identity", _identified(F.col("__title"), F.col("__author"))).drop("__title", "__author")


def _first_of_each(keyed: DataFrame) -> DataFrame:
    return first_in_group(keyed, ["book_id"], F.col("__identity"), [F.col("pos").asc()]).drop("__identity")


def dedupe(pool: DataFrame) -> DataFrame:
    """One candidate for each record, the first in the pool."""
    return _first_of_each(identified(pool))


def reduced(pool: DataFrame) -> DataFrame:
    """``dedupe(standard_records(pool))`` with one exchange: a record's identity is its own,
    whichever of its work it stands for, so all keys come before the rows are dealt."""
    return _first_of_each(_standard(placed_groups(work_keys(identified(pool)).repartition("book_id"))))


def concat_pools(pool: DataFrame | None, new: DataFrame) -> DataFrame:
    """The pool followed by new candidates, places re-based behind those there are."""
    if pool is None:
        return new
    ends = pool.groupBy("book_id").agg((F.max("pos") + 1).alias("__end"))
    moved = (
        new.join(ends.hint("merge"), "book_id", "left")
        .withColumn("pos", F.col("pos") + F.coalesce("__end", F.lit(0)))
        .drop("__end")
    )
    return pool.unionByName(moved, allowMissingColumns=True)
