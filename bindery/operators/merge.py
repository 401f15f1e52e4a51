"""Merging an accepted record into a book, field by field, with an audit of what changes.

The input has the book's fields as ``file_<name>`` and the record's as ``found_<name>``;
``file_unverified`` says that the book carries the mark of an earlier pass. The result adds
a struct ``edits`` (null: leave alone) and ``changes``, what differs from the book, in the
order fields are written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import text as X

FIELDS = ("title", "authors", "series", "series_number", "description", "publisher", "date", "isbn", "language")
#: Fixed value: what each field does unless told otherwise.
RULES = {
    "title": "overwrite", "authors": "overwrite", "series": "overwrite", "series_number": "overwrite",
    "description": "fill", "publisher": "fill", "date": "fill", "isbn": "fill", "language": "fill",
}
TAG = "bindery:unverified"
#: Fixed value: the order in which changes are made and told.
WRITTEN = (
    "title", "authors", "description", "publisher", "date", "language", "isbn", "series", "series_number",
    "tag", "genres", "cover",
)


def _empty(value: Column, name: str) -> Column:
    if name == "authors":
        return F.size(F.coalesce(value, F.array().cast("array<string>"))) == 0
    return F.coalesce(value.cast("string"), F.lit("")) == ""


def by_rule(rule: str, name: str, current: Column, found: Column) -> Column:
    """The value a rule writes, or null: overwrite what the record states, fill only what
    the book lacks, skip; a silent record writes nothing."""
    if rule == "skip":
        return F.lit(None).cast("array<string>" if name == "authors" else "string")
    allowed = ~_empty(found, name)
    if rule == "fill":
        allowed = allowed & _empty(current, name)
    return F.when(allowed, found)


def edits(rows: DataFrame, rules: Mapping[str, str] | None = None, isbn_identifies: Column | bool = False) -> DataFrame:
    """The rows with ``edits`` for books that a record matched."""
    chosen = RULES | dict(rules or {})
    file, found = (lambda n: F.col(f"file_{n}")), (lambda n: F.col(f"found_{n}"))
    marked = F.coalesce(file("unverified"), F.lit(False))
    blurb = F.when(marked, X.unmarked(file("description"))).otherwise(file("description"))
    wanted = {n: by_rule(chosen[n], n, blurb if n == "description" else file(n), found(n)) for n in FIELDS}
    same_title = X.comparison_key(file("title")) == X.comparison_key(found("title"))
    wanted["title"] = F.when(~same_title, wanted["title"])
    identified = isbn_identifies if isinstance(isbn_identifies, Column) else F.lit(isbn_identifies)
    wanted["isbn"] = F.when(identified, wanted["isbn"])
    # A mark comes off with the match: the blurb without its note, or no blurb at all.
    untouched = marked & wanted["description"].isNull()
    first = rows.withColumns({f"__{n}": c for n, c in wanted.items()} | {"__untouched": untouched, "__blurb": blurb})
    resulting = F.coalesce("__series", file("series"))
    number_fits = X.same_series(resulting, found("series"))
    replaced = F.col("__series").isNotNull() & ~X.same_series(F.col("__series"), file("series"))
    struct = F.struct(
        *(F.col(f"__{n}").alias(n) for n in FIELDS if n not in ("description", "series_number")),
        F.when(F.col("__untouched"), F.col("__blurb")).otherwise(F.col("__description")).alias("description"),
        F.when(number_fits, F.col("__series_number")).alias("series_number"),
        (F.col("__series_number").isNull() & ~_empty(file("series_number"), "series_number") & replaced).alias("drop_series_number"),
        (F.col("__untouched") & F.col("__blurb").isNull()).alias("drop_description"),
        F.col("__untouched").alias("note_removed"),
        F.lit(False).alias("unverified"),
    )
    return first.withColumn("edits", struct).drop(*(c for c in first.columns if c.startswith("__")))


def mark(rows: DataFrame) -> DataFrame:
    """The rows with ``edits`` for books that nothing matched: the note and the tag only."""
    null = lambda n: F.lit(None).cast("array<string>" if n == "authors" else "string").alias(n)
    struct = F.struct(
        *(null(n) for n in FIELDS if n not in ("description", "series_number")),
        X.noted(F.col("file_description")).alias("description"),
        null("series_number"),
        F.lit(False).alias("drop_series_number"),
        F.lit(False).alias("drop_description"),
        F.lit(False).alias("note_removed"),
        F.lit(True).alias("unverified"),
    )
    return rows.withColumn("edits", struct)


def genres_to_add(own: Column, wanted: Column) -> Column:
    """Genres that the book does not carry in any case, each once, in order."""
    taken = F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda g: X.casefold(F.trim(g)))
    clean = F.filter(F.transform(F.coalesce(wanted, F.array().cast("array<string>")), lambda g: F.trim(g)), lambda g: g != "")
    fresh = F.filter(clean, lambda g: ~F.array_contains(taken, X.casefold(g)))
    folded = F.transform(fresh, X.casefold)
    return F.filter(fresh, lambda g, i: F.array_position(folded, X.casefold(g)) == i + 1)


def changes(rows: DataFrame, source: Column | None = None) -> DataFrame:
    """The rows with ``changes``: array of (field, value, source) of what an edit moves, in
    the order of writing. Tag, genres and a removed note are the engine's own; the rest is
    the source's. ``genres`` and ``cover_added`` are used where the rows have them."""
    file, edit = (lambda n: F.col(f"file_{n}")), (lambda n: F.col(f"edits.{n}"))
    by = source if source is not None else F.lit(None).cast("string")
    engine = F.lit("engine")

    def moved(name: str) -> tuple[Column, Column, Column]:
        if name == "tag":
            has = F.coalesce(file("unverified"), F.lit(False))
            put = F.when(edit("unverified") & ~has, F.lit("added")).when(~edit("unverified") & has, F.lit("removed"))
            return put.isNotNull(), put, engine
        if name == "genres":
            if "genres" not in rows.columns:
                return F.lit(False), F.lit(""), engine
            return F.size("genres") > 0, F.array_join("genres", ", "), engine
        if name == "cover":
            given = F.col("cover_added") if "cover_added" in rows.columns else F.lit(False)
            return given, F.lit("added"), by
        if name == "authors":
            value = F.array_join(edit(name), ", ")
            return edit(name).isNotNull() & ~edit(name).eqNullSafe(file(name)), value, by
        if name == "isbn":
            return edit(name).isNotNull() & ~X.isbn_of(edit(name)).eqNullSafe(X.isbn_of(file(name))), edit(name), by
        told = edit(name).isNotNull() & ~X.said(edit(name)).eqNullSafe(X.said(file(name)))
        if name == "series_number":
            return told | edit("drop_series_number"), F.coalesce(edit(name), F.lit("")), by
        if name == "description":
            gone = edit("drop_description")
            credit = F.when(edit("note_removed") | edit("unverified"), engine).otherwise(by)
            return told | gone, F.coalesce(edit(name), F.lit("")), credit
        return told, edit(name), by

    listed = []
    for name in WRITTEN:
        when, value, credit = moved(name)
        listed.append(F.when(when, F.struct(F.lit(name).alias("field"), value.alias("value"), credit.alias("source"))))
    return rows.withColumn("changes", F.filter(F.array(*listed), lambda c: c.isNotNull()))


def wants_cover(add_cover: bool = True) -> Column:
    """Whether a cover is to be added: allowed, offered, and the book has none."""
    return F.lit(add_cover) & (F.coalesce("found_cover", F.lit("")) != "") & ~F.coalesce("file_has_cover", F.lit(False))


def audit_line(
    path: Column, outcome: Column, source: Column, score: Column, how: Column | None = None, problem: Column | None = None
) -> Column:
    """One line for a book: what became of it and every change, in order; nothing of a source or
    score that is null. ``how`` is a struct of what led there (reason, sought, tried, near,
    said): a wait has its reason; a book that nothing matched, what was sought and where, and
    what came near; a book that the model was asked about, what it said."""
    told = F.transform("changes", lambda c: F.concat(c["field"], F.lit("="), X.short_reason(c["value"])))
    number = lambda c, form="%.4f": F.format_string(form, c)
    parts = [path, outcome, F.concat(F.lit("source="), source), F.when(score.isNotNull(), F.concat(F.lit("score="), number(score)))]
    if how is not None:
        near, said, open_ = how["near"], how["said"], outcome == "unverified"
        pick = F.coalesce(F.concat(F.lit("candidate "), said["pick"].cast("string")), F.lit("none of them"))
        parts += [
            F.concat(F.lit("reason="), how["reason"]),
            F.when(open_, F.concat(F.lit("sought="), how["sought"])),
            F.when(open_ & (F.size(how["tried"]) > 0), F.concat(F.lit("tried="), F.array_join(how["tried"], ", "))),
            F.when(open_ & near.isNotNull(), F.concat(F.lit("near="), near["title"], F.lit(" of "), near["source"], F.lit(", "), number(near["score"]))),
            F.when(
                said.isNotNull(),
                F.concat(F.lit("model="), pick, F.lit(", "), number(said["confidence"], "%.2f"), F.coalesce(F.concat(F.lit(": "), said["reason"]), F.lit(""))),
            ),
        ]
    if problem is not None:
        parts.append(F.when(problem.isNotNull(), F.concat(F.lit("problem="), X.short_reason(problem))))
    parts.append(F.when(F.size("changes") == 0, F.lit("no change")).otherwise(F.array_join(told, "; ")))
    return F.concat_ws(" | ", *parts)
