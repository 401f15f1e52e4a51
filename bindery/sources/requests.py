"""Requests to catalogues as rows, and their answers from a table.

What a live transport would send is a column, so that answers can be joined by it: a recorded
table (request, status, body, error) plays a catalogue, and a fetcher that fills such a table
for the distinct requests it is given is a live one. Equal requests are asked once.

A request is a JSON object of named values, which a catalogue's dialect makes of a book; how
they are put into an address or a body is the service's. Dialects are registered by the names
of their catalogues.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import text as X
from bindery.sources import replies
from bindery.storage import materialize

RECORDED = "request string, status int, body string, error string"
#: Fixed value: volumes of one answer.
MOST = 40


def _term(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit('"'), F.lit(" ")))


def _first_author(authors: Column) -> Column:
    return F.get(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), 0)


def _bare(isbn: Column) -> Column:
    return F.regexp_replace(isbn, r"[-\s]", "")


def _language(language: Column) -> Column:
    """The primary tag that a question is restricted to; null for none."""
    told = X.primary_language(language)
    return F.when(told != "", told)


def isbn_request(isbn: Column) -> Column:
    return F.concat(F.lit("isbn:"), _bare(isbn))


def title_request(title: Column, authors: Column) -> Column:
    """Any of a book's search titles and its first author, as one question; null without a
    title. The author is left out where there is none."""
    titles = F.transform(X.search_titles(title), lambda t: F.concat(F.lit('intitle:"'), _term(t), F.lit('"')))
    author = _first_author(authors)
    by = F.when(author.isNotNull(), F.concat(F.lit(' inauthor:"'), _term(author), F.lit('"')))
    return F.when(titles.isNotNull(), F.concat(F.array_join(titles, " OR "), F.coalesce(by, F.lit(""))))


def _json(**values: Column) -> Column:
    """The values as a JSON object, less those that are null."""
    return F.to_json(F.struct(*(v.alias(n) for n, v in values.items())))


def search_by_isbn(books: DataFrame) -> Column:
    """Catalogue B: a search for the number."""
    return _json(q=isbn_request(F.col("isbn")))


def search_by_title(books: DataFrame) -> Column:
    """Catalogue B: a search for titles and author, in the book's language."""
    q = title_request(F.col("title"), F.col("authors"))
    return F.when(q.isNotNull(), _json(q=q, langRestrict=_language(F.col("language")), maxResults=F.lit(MOST)))


def editions_by_isbn(books: DataFrame) -> Column:
    """Catalogue A: the edition of a number, in either form."""
    return _json(form=F.lit("isbn"), isbn=_bare(F.col("isbn")))


def editions_by_title(books: DataFrame) -> Column:
    """Catalogue A: editions of works whose title is one of the book's, as they are written, in
    its language: by the three-letter code for a tag of that length, else by the two-letter one.
    Authors are compared afterwards, not asked for."""
    titles = F.filter(F.transform(X.search_titles(F.col("title")), F.trim), lambda t: t != "")
    language = _language(F.col("language"))
    form = F.when(language.isNull(), "title").when(F.length(language) == 3, "title_code3").otherwise("title_code2")
    return F.when(F.size(titles) > 0, _json(form=form, titles=titles, language=language))


@dataclass(frozen=True)
class Dialect:
    """How a catalogue is asked and read: its requests from books (book_id, title, authors, isbn,
    language, date), candidates from (book_id, reply, isbn) and its name, with whether an ISBN
    was asked for; ``refusal`` as in ``replies.failure``; which successful replies are answers."""

    by_isbn: Callable[[DataFrame], Column]
    by_title: Callable[[DataFrame], Column]
    read: Callable[[DataFrame, str, bool], DataFrame]
    refusal: str = "message"
    answers: Callable[[Column], Column] = lambda reply: reply.isNotNull()


def _read_a(rows: DataFrame, name: str, by_isbn: bool) -> DataFrame:
    return replies.catalogue_a(rows, name, "isbn" if by_isbn else None)


def _read_b(rows: DataFrame, name: str, by_isbn: bool) -> DataFrame:
    return replies.catalogue_b(rows, name, "isbn" if by_isbn else None)


#: The known catalogues. Others are added under names of their own.
DIALECTS: dict[str, Dialect] = {
    "catalogue_a": Dialect(editions_by_isbn, editions_by_title, _read_a, "status", replies.has_editions),
    "catalogue_b": Dialect(search_by_isbn, search_by_title, _read_b),
}


def answers(
    asked: DataFrame,
    transport: DataFrame | Callable[[DataFrame], DataFrame],
    by: str = "message",
    answers: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(book_id, request) -> also ``reply`` (null on failure) and ``failed`` (kind, reason; null
    on success). A request that the transport has no row for, or whose reply is no answer, could
    not be read."""
    wanted = asked.filter(F.col("request").isNotNull())
    recorded = transport if isinstance(transport, DataFrame) else transport(wanted.select("request").distinct())
    met = wanted.join(recorded.select("request", "status", "body", "error"), "request", "left")
    lost = F.coalesce("error", F.when(F.col("status").isNull(), F.lit("unreadable")))
    if answers is not None:
        lost = F.coalesce(lost, F.when(F.col("status").between(200, 299) & ~F.coalesce(answers(F.col("body")), F.lit(False)), F.lit("unreadable")))
    failed = F.coalesce(replies.network_failure(lost), replies.failure(F.col("status"), F.col("body"), by))
    return met.withColumn("failed", failed).select(
        "book_id", "request", F.when(F.col("failed").isNull(), F.col("body")).alias("reply"), "failed"
    )


def errors(answered: DataFrame, source: str) -> DataFrame:
    """(book_id, source, reason) of the books that a source could not be asked about."""
    return answered.filter(F.col("failed").isNotNull()).select("book_id", F.lit(source).alias("source"), F.col("failed.reason").alias("reason"))


def capped(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """At most ``most`` candidates of a book: the places an answer has."""
    return candidates.filter(F.col("pos") < most)


def lookups(transports: dict[str, DataFrame | Callable[[DataFrame], DataFrame]]):
    """(by_isbn, by_title) over catalogues in their order of trust: functions of books that give
    (sources, errors) as the walks take them. Nothing is asked before a walk asks it."""
    if unknown := set(transports) - set(DIALECTS):
        raise ValueError(f"no such catalogues: {sorted(unknown)}")

    def source(name: str, by_isbn: bool):
        dialect, transport = DIALECTS[name], transports[name]

        def ask(books: DataFrame) -> tuple[DataFrame, DataFrame]:
            request = (dialect.by_isbn if by_isbn else dialect.by_title)(books)
            asked = books.select("book_id", "isbn", request.alias("request"))
            told = materialize(answers(asked.select("book_id", "request"), transport, dialect.refusal, dialect.answers), "answers")
            rows = told.filter("reply is not null").join(asked.select("book_id", "isbn"), "book_id")
            return capped(dialect.read(rows, name, by_isbn)), errors(told, name)

        return ask

    def by_isbn(books: DataFrame):
        return [(name, source(name, True)) for name in transports], None

    def by_title(books: DataFrame):
        return [(name, source(name, False)) for name in transports], None

    return by_isbn, by_title
