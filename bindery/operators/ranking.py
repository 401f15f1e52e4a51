"""Scores, ranks, bands and offers of pools against the books they were gathered for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import similarity as S
from bindery.functions import text as X

#: Fixed value: how many candidates a source may offer.
PER_SOURCE = 5


@dataclass(frozen=True)
class Bands:
    """Bars of the bands; a pool of one has its own, which may not be the lower one."""

    strong: float = 0.89
    singleton: float = 0.95
    medium: float = 0.80
    gap: float = 0.08

    def __post_init__(self) -> None:
        if self.singleton < self.strong:
            raise ValueError(f"singleton bar {self.singleton} is below the strong bar {self.strong}")


def score(pool: DataFrame, books: DataFrame) -> DataFrame:
    """Candidates with score, title_similarity, author_similarity, author_agrees and agrees.

    ``books`` is (book_id, title, authors, language, date); candidates in another language
    than the book's, as far as both state one, leave the pool.
    """
    file = books.select("book_id", *(F.col(c).alias(f"file_{c}") for c in ("title", "authors", "language", "date")))
    met = pool.join(file.hint("merge"), "book_id").filter(X.same_language(F.col("file_language"), F.col("language")))
    # Each step in a projection of its own: what a later one reads twice is a column by then.
    sides = met.withColumns({"__file": X.parted(F.col("file_title")), "__record": X.parted(F.col("title"))})
    chosen = sides.withColumn("__titles", S.compared_titles(F.col("__file"), F.col("__record")))
    keyed = chosen.withColumns(
        {
            "__left": X.comparison_key(F.col("__titles.file")),
            "__right": X.comparison_key(F.col("__titles.record")),
            "__wanted": X.name_keys("file_authors"),
            "__found": X.name_keys("authors"),
            "__number": X.position(X.bracket(F.col("file_title"), 2)),
        }
    ).withColumns({"__ratio": S.ratio("__left", "__right"), "__best": S.best_ratios("__wanted", "__found")})
    title = F.when((F.col("__left") == "") | (F.col("__right") == ""), F.lit(1.0)).otherwise(S.penalty(F.col("__ratio")))
    mean = F.aggregate(
        F.transform("__best", lambda r: 1.0 - S.penalty(r)), F.lit(0.0), lambda a, b: a + b, lambda a: a / F.size("__best")
    )
    author = F.when(F.size("__best") > 0, mean)
    series = F.when(
        F.col("__number").isNotNull() & (F.coalesce("series_number", F.lit("")) != ""),
        F.col("__number") != F.col("series_number"),
    )
    own, other = X.year(F.col("file_date")), X.year(F.col("date"))
    years = F.when(own.isNotNull() & other.isNotNull(), own != other)
    compared = keyed.withColumns({"__title": title, "__author": author, "__series": series, "__years": years})
    agrees = F.coalesce(F.col("__author") >= S.AUTHOR_AGREES, F.lit(False))
    return compared.withColumns(
        {
            "score": S.weighted_score(F.col("__title"), F.col("__author"), F.col("__series"), F.col("__years")),
            "title_similarity": F.round(1.0 - F.col("__title"), 4),
            "author_similarity": F.round("__author", 4),
            "author_agrees": agrees,
            "agrees": agrees & (F.round(1.0 - F.col("__title"), 4) > 0),
        }
    ).drop(*(c for c in compared.columns if c.startswith(("__", "file_"))))


def rank(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scored candidates with ``rk`` (best first, ties by place) and, for the best, the gap
    to the next (four places; null in a pool of one) and the pool's size."""
    own = Window.partitionBy(*(by or ["book_id"]))
    order = own.orderBy(F.col("score").desc(), "pos")
    return scored.withColumns(
        {
            "rk": F.row_number().over(order),
            "gap": F.round(F.col("score") - F.lead("score").over(order), 4),
            "pool_size": F.count("*").over(own),
        }
    )


def band(bands: Bands = Bands()) -> Column:
    """The band of a leader (rk = 1) from score, gap, pool_size and author_agrees."""
    strong = F.when(F.col("pool_size") == 1, F.col("score") >= bands.singleton).otherwise(
        (F.col("score") >= bands.strong) & (F.coalesce("gap", F.lit(0.0)) >= bands.gap)
    )
    return (
        F.when(strong & F.col("author_agrees"), "strong")
        .when(F.col("author_agrees") & (F.col("score") >= bands.medium), "medium")
        .when(F.col("score") > 0, "low")
        .otherwise("none")
    )


def leaders(ranked: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The best candidate of each pool with its band."""
    return ranked.filter("rk = 1").withColumn("band", band(bands))


def offer(ranked: DataFrame, most: int = PER_SOURCE, by: str = "book_id") -> DataFrame:
    """The ranked pool with at most ``most`` candidates of each source, in rank order."""
    own = Window.partitionBy(by, "source").orderBy("rk")
    return ranked.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= most).drop("__n")


def nearest_agreeing(ranked: DataFrame, by: str = "book_id") -> DataFrame:
    """The best-ranked candidate that agrees on title and author, of each pool that has one."""
    agreeing = ranked.filter("agrees")
    first = Window.partitionBy(by).orderBy("rk")
    return agreeing.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
