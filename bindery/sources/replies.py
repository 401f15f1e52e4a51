"""Recorded replies of two catalogues, read as candidates; natively, by declared schemas.

Catalogue A answers with editions of works, catalogue B with volumes. A reply table is
(book_id, reply); the result is pool rows with ``pos`` in the order of the reply.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import text as X

EDITIONS = (
    "data struct<editions:array<struct<title:string,isbn_13:string,isbn_10:string,reading_format_id:int,"
    "publisher:struct<name:string>,release_date:string,image:struct<url:string>,"
    "language:struct<language:string,code2:string,code3:string>,"
    "book:struct<id:bigint,title:string,description:string,release_date:string,image:struct<url:string>,"
    "cached_tags:struct<Genre:array<struct<tag:string>>>,"
    "contributions:array<struct<contribution:string,author:struct<id:bigint,name:string>>>,"
    "book_series:array<struct<featured:boolean,position:double,series:struct<id:bigint,name:string>>>>>>>"
)
VOLUMES = (
    "totalItems int, items array<struct<id:string,volumeInfo:struct<title:string,authors:array<string>,"
    "publisher:string,publishedDate:string,description:string,"
    "industryIdentifiers:array<struct<type:string,identifier:string>>,categories:array<string>,"
    "imageLinks:struct<smallThumbnail:string,thumbnail:string>,language:string>>>"
)
AUDIO = 2
GENRES = "array<struct<genre:string,seen:string>>"


def packed_genres(values: Column) -> Column:
    """Parts of packed genres with where each was first seen, in order, once each."""
    parts = F.flatten(
        F.transform(
            F.coalesce(values, F.array().cast("array<string>")),
            lambda v: F.transform(X.genre_parts(v), lambda p: F.struct(p.alias("genre"), v.alias("seen"))),
        )
    )
    names = F.transform(parts, lambda p: p["genre"])
    return F.filter(parts, lambda p, i: F.array_position(names, p["genre"]) == i + 1).cast(GENRES)


def catalogue_a(replies: DataFrame, source: str = "catalogue_a", asked: str | None = None) -> DataFrame:
    """Editions as candidates: the work's title before the edition's, the edition's date and
    cover before the work's, authors among the contributions only, no audio editions.

    ``asked`` names a column with the ISBN that was asked for, which stands in for none.
    """
    told = replies.withColumn("__r", F.from_json("reply", EDITIONS))
    rows = told.select("book_id", *([asked] if asked else []), F.posexplode("__r.data.editions").alias("pos", "e")).filter(
        ~F.col("e.reading_format_id").eqNullSafe(F.lit(AUDIO))
    )
    people = F.filter(
        F.coalesce("e.book.contributions", F.expr("array()").cast("array<struct<contribution:string,author:struct<id:bigint,name:string>>>")),
        lambda c: (c["contribution"] == "Author") & X.said(c["author"]["name"]).isNotNull(),
    )
    named = F.filter("e.book.book_series", lambda s: X.said(s["series"]["name"]).isNotNull())
    series = F.coalesce(F.get(F.filter(named, lambda s: F.coalesce(s["featured"], F.lit(False))), 0), F.get(named, 0))
    isbn = F.coalesce(X.said(F.col("e.isbn_13")), X.said(F.col("e.isbn_10")), F.col(asked) if asked else F.lit(None))
    return rows.withColumns({"__people": people, "__series": series}).select(
        "book_id",
        F.col("pos").cast("long").alias("pos"),
        F.lit(source).alias("source"),
        F.coalesce(X.said(F.col("e.book.title")), X.said(F.col("e.title"))).alias("title"),
        F.transform("__people", lambda c: F.trim(c["author"]["name"])).alias("authors"),
        F.transform("__people", lambda c: c["author"]["id"].cast("string")).alias("author_ids"),
        X.said(F.col("__series.series.name")).alias("series"),
        F.regexp_replace(F.col("__series.position").cast("string"), r"\.0$", "").alias("series_number"),
        F.col("__series.series.id").cast("string").alias("series_id"),
        F.coalesce(X.said(F.col("e.language.code2")), X.said(F.col("e.language.code3"))).alias("language"),
        isbn.alias("isbn"),
        X.said(F.col("e.book.description")).alias("description"),
        X.said(F.col("e.publisher.name")).alias("publisher"),
        F.coalesce(X.said(F.col("e.release_date")), X.said(F.col("e.book.release_date"))).alias("date"),
        F.coalesce(X.said(F.col("e.image.url")), X.said(F.col("e.book.image.url"))).alias("cover"),
        packed_genres(F.transform("e.book.cached_tags.Genre", lambda g: g["tag"])).alias("genres"),
    )


def has_editions(reply: Column) -> Column:
    """Whether a reply of catalogue A is an answer: it lists editions, if none."""
    return F.from_json(reply, "data struct<editions:array<string>>")["data"]["editions"].isNotNull()


def catalogue_b(replies: DataFrame, source: str = "catalogue_b", isbn: str | None = None) -> DataFrame:
    """Volumes as candidates; this catalogue states no series. With ``isbn``, a column that
    holds the number asked for, only volumes that really carry it."""
    told = replies.withColumn("__r", F.from_json("reply", VOLUMES))
    rows = told.select("book_id", *([isbn] if isbn else []), F.posexplode("__r.items").alias("pos", "v"))
    numbers = F.transform(
        F.coalesce("v.volumeInfo.industryIdentifiers", F.expr("array()").cast("array<struct<type:string,identifier:string>>")),
        lambda i: F.upper(F.regexp_replace(i["identifier"], r"[-\s]", "")),
    )
    rows = rows.withColumn("__numbers", F.array_sort(numbers))
    if isbn:
        rows = rows.filter(F.array_contains("__numbers", F.upper(F.regexp_replace(F.col(isbn), r"[-\s]", ""))))
    of_length = lambda n: F.get(F.filter("__numbers", lambda x: F.length(x) == n), 0)
    info = "v.volumeInfo"
    none = F.lit(None).cast("string")
    return rows.select(
        "book_id",
        F.col("pos").cast("long").alias("pos"),
        F.lit(source).alias("source"),
        X.said(F.col(f"{info}.title")).alias("title"),
        F.filter(
            F.transform(F.coalesce(f"{info}.authors", F.array().cast("array<string>")), X.said), lambda a: a.isNotNull()
        ).alias("authors"),
        F.array().cast("array<string>").alias("author_ids"),
        none.alias("series"), none.alias("series_number"), none.alias("series_id"),
        X.said(F.col(f"{info}.language")).alias("language"),
        F.coalesce(of_length(13), of_length(10)).alias("isbn"),
        X.said(F.col(f"{info}.description")).alias("description"),
        X.said(F.col(f"{info}.publisher")).alias("publisher"),
        X.said(F.col(f"{info}.publishedDate")).alias("date"),
        F.coalesce(X.said(F.col(f"{info}.imageLinks.thumbnail")), X.said(F.col(f"{info}.imageLinks.smallThumbnail"))).alias("cover"),
        packed_genres(F.col(f"{info}.categories")).alias("genres"),
    )


#: What a refusal says that blames the key, and the reasons of failures.
KEY_WORDS = ("api key", "keyinvalid", "key expired", "keyexpired", "not authorized")
REJECTED_KEY = "rejected the key"
UNREADABLE = "unreadable reply"
NETWORK = {
    "timeout": ("temporary", "timeout"),
    "refused": ("temporary", "connection refused"),
    "reset": ("temporary", "connection reset"),
    "dns": ("temporary", "DNS failure"),
    "certificate": ("held", "TLS certificate failure"),
    "unreadable": ("held", UNREADABLE),
}


def failure(status: Column, message: Column | None = None, by: str = "message") -> Column:
    """struct(kind, reason) of an HTTP status, null for success: what passes by itself is
    temporary, the rest is held until someone acts.

    ``by`` tells how a refusal of the key shows: ``message`` (catalogue B: its words, with a
    400 or 403), ``status`` (catalogue A: any 401 or 403) or ``model`` (as ``status``, and a
    402 is a spent balance, which passes).
    """
    told = F.lower(F.coalesce(message, F.lit(""))) if message is not None else F.lit("")
    if by == "message":
        key = status.isin(400, 403) & told.rlike("|".join(map(re.escape, KEY_WORDS)))
    else:
        key = status.isin(401, 403)
    number = F.concat(F.lit(", HTTP "), status.cast("string"))
    struct = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))
    first = F.when(status.between(200, 299), F.lit(None))
    if by == "model":
        first = first.when(status == 402, struct("temporary", F.concat(F.lit("out of balance"), number)))
    return (
        first.when(key, struct("held", F.lit(REJECTED_KEY)))
        .when(status == 429, struct("temporary", F.concat(F.lit("rate limiting"), number)))
        .when((status == 408) | (status >= 500), struct("temporary", F.concat(F.lit("HTTP "), status.cast("string"))))
        .when(status.between(400, 499), struct("held", F.concat(F.lit("configuration problem"), number)))
        .otherwise(struct("held", F.concat(F.lit("HTTP "), status.cast("string"))))
    )


def network_failure(error: Column) -> Column:
    """struct(kind, reason) of an exchange that gave no status, by what went wrong (a key of
    ``NETWORK``); anything else is a reply that could not be read."""
    known = F.create_map(*(F.lit(x) for k, (kind, _) in NETWORK.items() for x in (k, kind)))
    reasons = F.create_map(*(F.lit(x) for k, (_, reason) in NETWORK.items() for x in (k, reason)))
    kind, reason = F.coalesce(known[error], F.lit("held")), F.coalesce(reasons[error], F.lit(UNREADABLE))
    return F.when(error.isNotNull(), F.struct(kind.alias("kind"), reason.alias("reason")))


CHAT = "choices array<struct<finish_reason:string,message:struct<content:string>>>"


def _content(reply: Column) -> Column:
    """The answer of a model's reply as JSON, null if it was cut short or is none."""
    first = F.get(F.from_json(reply, CHAT)["choices"], 0)
    return F.try_parse_json(F.when(first["finish_reason"] != "length", first["message"]["content"]))


def chosen(reply: Column, offered: Column) -> Column:
    """struct(pick, confidence, reason) of a chooser's reply, null if it breaks the contract:
    ``pick`` null or a whole number from 1 to ``offered``, ``confidence`` a number from 0 to 1."""
    answer = _content(reply)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.variant_get(answer, path, "variant")), r"^\w+", 0)
    pick = F.try_variant_get(answer, "$.pick", "int")
    confidence = F.try_variant_get(answer, "$.confidence", "double")
    number = ("BIGINT", "DECIMAL", "DOUBLE", "INT", "FLOAT")
    whole = F.coalesce(kind("$.pick").isin("BIGINT", "INT") & pick.between(1, offered), F.lit(False))
    none = F.coalesce(kind("$.pick") == "VOID", F.lit(False))
    sure = F.coalesce(kind("$.confidence").isin(*number) & confidence.between(0, 1), F.lit(False))
    reason = X.short_reason(F.try_variant_get(answer, "$.reason", "string"))
    return F.when((whole | none) & sure, F.struct(pick.alias("pick"), confidence.alias("confidence"), reason.alias("reason")))


def accepted(choice: Column, bar: float) -> Column:
    """Whether a choice is applied: it picks one and is as sure as a strong match."""
    return F.coalesce(choice["pick"].isNotNull() & (choice["confidence"] >= bar), F.lit(False))


def mapped_genre(reply: Column) -> Column:
    """The genre a model's reply names; null for none."""
    return X.said(F.try_variant_get(_content(reply), "$.genre", "string"))


def described(fields: list[str] | dict[str, Column]) -> Column:
    """``name=value`` of what a row states, for a prompt: of columns, or of named values."""
    told = fields if isinstance(fields, dict) else {f: F.col(f) for f in fields}
    said = lambda c: c.cast("string")
    return F.concat_ws("; ", *(F.when(F.coalesce(said(c), F.lit("")) != "", F.concat(F.lit(f"{n}="), said(c))) for n, c in told.items()))


def numbered(lines: Column) -> Column:
    """Descriptions as numbered lines from 1."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
