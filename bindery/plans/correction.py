"""The whole pass over a folder's books: read, look up, decide, merge, rewrite, deliver.

Everything is a table with a row per book. A book's route is one of ``match`` (a record is
written into it), ``unverified`` (marked), ``waiting`` (a source or the model could not be
asked; it stays as it is until the next UTC day), ``untouched`` (nothing to look up by) and
``unread``. Tables that several steps read are written between them; steps that have no books
are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import text as X
from bindery.operators import delivery, merge, state, walk
from bindery.operators import pool as P
from bindery.operators import ranking as R
from bindery.options import Options
from bindery.sources import epub, files, replies
from bindery.storage import many, materialize

#: Fields of a candidate that a decision carries.
FOUND = [c.split(" ")[0] for c in P.SCHEMA.replace("genre:string,seen", "").split(", ")][2:]

Lookup = Callable[[DataFrame], tuple[list[tuple[str, walk.Source]], DataFrame | None]]
Model = Callable[[DataFrame], DataFrame]
#: How many of so many calls may be made now; they are spent by asking.
Take = Callable[[int], int]
#: Why a book that the model was not asked about waits.
SPENT, UNASKED = "the day's calls are spent", "the model could not be asked"


@dataclass
class Catalogues:
    """How books are looked up: by ISBN and by title, each giving (sources in order of trust,
    errors) for (book_id, title, authors, isbn, language, date); and a model that answers
    (id, prompt) with (id, reply), null where it could not be asked. Covers are a table (url,
    body), or a function that gives one for the urls (url) that are wanted."""

    by_isbn: Lookup
    by_title: Lookup
    choose: Model | None = None
    map_genre: Model | None = None
    covers: DataFrame | Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Memory:
    """What earlier passes learned: name spellings, genre mappings; and what is allowed."""

    names: DataFrame
    genres: DataFrame
    allowed: DataFrame
    overrides: DataFrame | None = None


def _found(rows: DataFrame, prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in FOUND)).alias("found")


def _told(rows: DataFrame, route: str, kind) -> DataFrame:
    """Decisions without a record."""
    return rows.select(
        "book_id", F.lit(route).alias("route"), F.lit(None).cast(kind).alias("found"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("by_isbn")
    )


def _reasons(trail: DataFrame) -> DataFrame:
    """(book_id, reason) of the books that some source could not be asked about."""
    one = F.concat("source", F.lit(" could not be asked: "), "reason")
    return trail.filter("reason is not null").groupBy("book_id").agg(F.array_join(F.sort_array(F.collect_set(one)), "; ").alias("reason"))


def decide(books: DataFrame, by: Catalogues, options: Options, take: Take | None = None) -> DataFrame:
    """(book_id, route, found, score, by_isbn, outcome) of readable books; ``outcome`` says how it came
    to that: the reason of a wait, the title sought, the sources tried, the nearest record that
    was passed over, and what the model said.

    Each source is asked about the books that are still open when its turn comes, and the model
    about as many as ``take`` grants, in the order of the books' paths.
    """
    take = state.in_all(options.daily_calls) if take is None else take
    found_isbn, first = walk.isbn_walk(books, *by.by_isbn(books))
    outcomes = many(found_isbn, "isbn-walk")
    kind = outcomes.select(_found(outcomes, "found.")).schema["found"].dataType
    parts = [
        outcomes.filter("outcome = 'match'").select(
            "book_id", F.lit("match").alias("route"), _found(outcomes, "found."), F.lit(1.0).alias("score"), F.lit(True).alias("by_isbn")
        ),
        _told(outcomes.filter("outcome = 'held'"), "waiting", kind),
    ]
    trails = [first] if first is not None else []
    rest = books.join(outcomes.filter("outcome in ('match', 'held')"), "book_id", "left_anti")
    rest = many(rest.withColumn("__titles", X.search_titles(F.col("title"))), "title-books")
    asked_before = outcomes.filter("outcome = 'missed'").select("book_id")
    nameless = rest.filter("__titles is null")
    parts.append(_told(nameless.join(asked_before, "book_id", "left_semi"), "unverified", kind))
    parts.append(_told(nameless.join(asked_before, "book_id", "left_anti"), "untouched", kind))
    titled = rest.filter("__titles is not null").withColumn("__sought", F.get("__titles", 0)).drop("__titles")
    notes = [titled.select("book_id", F.col("__sought").alias("sought"))]
    reasons = None
    if not titled.isEmpty():
        titled = titled.drop("__sought")
        gathered, second = walk.title_walk(titled, *by.by_title(titled), options.bands)
        trails += [second] if second is not None else []
        pools = many(gathered, "title-walk")
        leaders = walk.routed(pools, options.full_scan)
        parts.append(
            leaders.filter("route = 'write'").select("book_id", F.lit("match").alias("route"), _found(leaders), "score", F.lit(False).alias("by_isbn"))
        )
        poolless = titled.join(pools.select("book_id").distinct(), "book_id", "left_anti").select("book_id")
        broken = second.filter("reason is not null").select("book_id").distinct() if second is not None else titled.select("book_id").limit(0)
        parts.append(_told(leaders.filter("route = 'hold'").select("book_id").unionByName(poolless.join(broken, "book_id", "left_semi")), "waiting", kind))
        near = R.nearest_agreeing(pools)
        notes.append(near.select("book_id", F.struct("title", "source", "score").alias("near")))
        extra = outcomes.filter("outcome = 'contradicted'").select("book_id", "found.*")
        offers = walk.with_contradicted(R.offer(pools.drop("exited", "held")), extra.select("book_id", *FOUND))
        medium = leaders.filter("route = 'ask'").select("book_id")
        if options.full_scan:
            open_ = leaders.filter("route = 'unverified'").select("book_id").unionByName(poolless.join(broken, "book_id", "left_anti"))
            medium = medium.unionByName(open_.join(extra, "book_id", "left_semi"))
        if by.choose is not None:
            ask = many(offers.join(medium, "book_id", "left_semi"), "offers")
            if not ask.isEmpty():
                picked, refused, said = _choose(ask, titled, by.choose, options, take)
                parts.append(picked.select("book_id", F.lit("match").alias("route"), _found(picked), "score", F.lit(False).alias("by_isbn")))
                parts.append(_told(refused, "waiting", kind))
                notes.append(said)
                reasons = refused
    decided = many(reduce(DataFrame.unionByName, parts), "decided")
    decided = decided.unionByName(_told(books.join(decided, "book_id", "left_anti"), "unverified", kind))
    return _explained(decided, trails, notes, reasons, options)


def _explained(decided: DataFrame, trails: list[DataFrame], notes: list[DataFrame], reasons: DataFrame | None, options: Options) -> DataFrame:
    """The decisions with ``outcome``."""
    empty = "book_id long, source string, reason string"
    trail = reduce(DataFrame.unionByName, trails) if trails else decided.sparkSession.createDataFrame([], empty)
    place = F.array_position(F.array(*map(F.lit, options.sources)), F.col("source"))
    tried = trail.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("n"), "source"))), lambda t: t["source"]).alias("tried"))
    why = _reasons(trail)
    if reasons is not None:
        why = why.unionByName(reasons).groupBy("book_id").agg(F.array_join(F.collect_list("reason"), "; ").alias("reason"))
    for more in (tried, why, *notes):
        decided = decided.join(more.hint("merge"), "book_id", "left")
    kinds = {"near": "struct<title:string,source:string,score:double>", "said": "struct<pick:int,confidence:double,reason:string>"}
    for name, kind in kinds.items():
        if name not in decided.columns:
            decided = decided.withColumn(name, F.lit(None).cast(kind))
    waits = F.when(F.col("route") == "waiting", F.col("reason"))
    passed = F.when(F.col("route") == "unverified", F.col("near"))
    outcome = F.struct(waits.alias("reason"), "sought", "tried", passed.alias("near"), "said")
    return decided.withColumn("outcome", outcome).drop("reason", "sought", "tried", "near", "said")


def shown() -> Column:
    """What a prompt says of a candidate; never where it comes from, which is not to be judged."""
    return replies.described(
        {
            "title": F.col("title"), "author": F.array_join("authors", ", "), "series": F.col("series"), "position": F.col("series_number"),
            "year": X.year(F.col("date")), "publisher": F.col("publisher"), "isbn": F.col("isbn"), "language": F.col("language"),
        }
    )


def _choose(offers: DataFrame, books: DataFrame, model: Model, options: Options, take: Take) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates picked, with ``score`` the model's confidence; books it could not be asked
    about, with the reason; what it said of each book)."""
    numbered = offers.withColumn("line", shown()).withColumn("__n", F.row_number().over(Window.partitionBy("book_id").orderBy("rk")))
    listed = numbered.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("__n", "line"))).alias("lines"), F.count("*").cast("int").alias("n"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    prompt = F.concat(F.lit("file="), name, F.lit("; title="), F.col("title"), F.lit("\n"), replies.numbered(F.transform("lines", lambda x: x["line"])))
    calls = many(listed.join(books.select("book_id", "title", "path"), "book_id").select("book_id", "path", "n", prompt.alias("prompt")), "calls")
    given = take(calls.count())
    # As few rows as a day has calls.
    granted = calls.orderBy("path", "book_id").limit(given)
    answered = calls.select("book_id", "n").withColumn("reply", F.lit(None).cast("string")).limit(0)
    if given:
        asked = materialize(granted, "granted")
        told = model(asked.select(F.col("book_id").alias("id"), "prompt")).select(F.col("id").alias("book_id"), "reply")
        answered = materialize(asked.select("book_id", "n").join(told, "book_id", "left"), "choices")
    choice = answered.withColumn("choice", replies.chosen(F.col("reply"), F.col("n")))
    sure = choice.filter(replies.accepted(F.col("choice"), options.strong_score)).select(
        "book_id", F.col("choice.pick").alias("__n"), F.col("choice.confidence").alias("__sure")
    )
    picked = numbered.join(sure, ["book_id", "__n"]).withColumn("score", F.col("__sure"))
    lost = answered.filter("reply is null").select("book_id", F.lit(UNASKED).alias("reason"))
    spent = calls.join(answered, "book_id", "left_anti").select("book_id", F.lit(SPENT).alias("reason"))
    return picked, lost.unionByName(spent), choice.filter("choice is not null").select("book_id", F.col("choice").alias("said"))


def spelled(decided: DataFrame, memory: Memory) -> tuple[DataFrame, DataFrame]:
    """The decisions, which have ``path``, with the known spellings of authors and series in their records, and the
    rows of the name table that they tell, with ``path`` and ``pos``: the books in the order of
    their paths, a book's authors before its series."""
    authors = decided.select("book_id", "path", F.posexplode("found.authors").alias("place", "name"), "found").select(
        "book_id", "path", "place", F.lit("author").alias("kind"), F.col("found.source").alias("source"), "name",
        F.get("found.author_ids", F.col("place")).alias("identity"),
    )
    series = decided.filter("found.series is not null").select(
        "book_id", "path", F.lit(2**31 - 1).alias("place"), F.lit("series").alias("kind"), F.col("found.source").alias("source"),
        F.col("found.series").alias("name"), F.col("found.series_id").alias("identity"),
    )
    names = authors.unionByName(series).withColumn("pos", F.struct("path", "place"))
    resolved = many(state.resolve_names(names, memory.names, memory.overrides), "names")
    told = resolved.groupBy("book_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "author", F.struct("place", "spelling")))), lambda x: x["spelling"]).alias("__authors"),
        F.max(F.when(F.col("kind") == "series", F.col("spelling"))).alias("__series"),
    )
    met = decided.join(told.hint("merge"), "book_id", "left")
    any_author = F.size("__authors") > 0
    found = (
        F.col("found")
        .withField("authors", F.when(any_author, F.col("__authors")).otherwise(F.col("found.authors")))
        .withField("series", F.when(any_author, F.coalesce("__series", "found.series")).otherwise(F.col("found.series")))
    )
    return met.withColumn("found", F.when(F.col("found").isNotNull(), found)).drop("__authors", "__series"), state.name_rows(resolved.drop("book_id", "place"))


def genres(decided: DataFrame, memory: Memory, model: Model | None, options: Options, take: Take | None = None) -> tuple[DataFrame, DataFrame]:
    """(book_id, wanted): allowed genres of each record in order; and the new mappings, with the
    ``path`` of each book that states them. Each source's genre is asked about once, and none in
    a dry run; one that the day has no call for, or that gets no answer, is left as unknown as
    it was."""
    take = state.in_all(options.daily_calls) if take is None else take
    stated = decided.select("book_id", "path", F.col("found.source").alias("source"), F.posexplode("found.genres").alias("place", "g")).select(
        "book_id", "path", "source", "place", F.col("g.genre").alias("genre"), F.col("g.seen").alias("seen")
    )
    first = F.struct("path", "place")
    once = stated.groupBy("source", "genre").agg(F.min_by("seen", first).alias("seen"), F.min(first).alias("first"))
    known = materialize(state.map_genres(once, memory.genres, memory.allowed), "genre-map")
    targets = known.filter("state = 'mapped'").select("source", "genre", "target")
    new = stated.limit(0).select("path", "source", "genre", F.lit("").alias("mapped"), "seen")
    misses = known.filter("state in ('miss', 'gone')")
    given = take(misses.count()) if model is not None and not options.dry_run else 0
    if given:
        # The allowed list is a setting: as short as its author made it.
        listed = memory.allowed.agg(F.array_join(F.array_sort(F.collect_set("genre")), ", ")).first()[0]
        asked = materialize(misses.orderBy("first", "source", "genre").limit(given).withColumn("id", F.xxhash64("source", "genre")), "genre-calls")
        calls = asked.select("id", F.concat("genre", F.lit(f"\n{listed}")).alias("prompt"))
        answered = asked.join(model(calls), "id").filter("reply is not null")
        own = memory.allowed.select(X.casefold(F.trim(F.col("genre"))).alias("__key"), F.col("genre").alias("target")).dropDuplicates(["__key"])
        keyed = answered.drop("target").withColumn("__key", X.casefold(replies.mapped_genre(F.col("reply"))))
        mapped = materialize(keyed.join(own, "__key", "left").select("source", "genre", "target", "seen"), "genre-answers")
        targets = targets.unionByName(mapped.filter("target is not null").select("source", "genre", "target"))
        told = mapped.select("source", "genre", F.coalesce("target", F.lit("")).alias("mapped"), "seen")
        new = stated.select("path", "source", "genre").distinct().join(told, ["source", "genre"]).select("path", "source", "genre", "mapped", "seen")
    listed = stated.join(targets, ["source", "genre"]).groupBy("book_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("wanted")
    )
    return listed, new


def plan(books: DataFrame, decided: DataFrame, wanted: DataFrame, options: Options, covers=None) -> DataFrame:
    """Books with ``edits``, ``genres``, ``cover`` and ``changes``: what would be written. A dry
    run fetches no cover, and tells of the one that is wanted."""
    rows = books.join(decided, "book_id").join(wanted.hint("merge"), "book_id", "left")
    file = [F.col(n).alias(f"file_{n}") for n in (*merge.FIELDS, "unverified", "has_cover")]
    found = [F.col(f"found.{n}").alias(f"found_{n}") for n in (*merge.FIELDS, "cover", "source")]
    keep = ["book_id", "path", "route", "score", "by_isbn", "subjects", "wanted"]
    rows = rows.select(*keep, *file, *found)
    matched = merge.edits(rows.filter("route = 'match'"), options.rules, F.col("by_isbn"))
    marked = merge.mark(rows.filter("route = 'unverified'"))
    both = matched.unionByName(marked.withColumn("edits", F.col("edits").cast(matched.schema["edits"].dataType)))
    both = both.withColumn("genres", merge.genres_to_add(F.col("subjects"), F.col("wanted")))
    if options.dry_run:
        return merge.changes(both.withColumns({"cover": F.lit(None).cast("binary"), "cover_added": merge.wants_cover(options.add_cover and covers is not None)}), F.col("found_source"))
    if callable(covers):
        covers = covers(both.filter(merge.wants_cover(options.add_cover)).select(F.col("found_cover").alias("url")).distinct())
    image = covers.select(F.col("url").alias("found_cover"), "body") if covers is not None else None
    if image is not None:
        both = both.join(image, "found_cover", "left")
    body = F.col("body") if image is not None else F.lit(None).cast("binary")
    both = both.withColumn("cover", F.when(merge.wants_cover(options.add_cover), body))
    both = both.withColumn("cover_added", F.col("cover").isNotNull())
    return merge.changes(both, F.col("found_source"))


def correct(
    listed: DataFrame, by: Catalogues, memory: Memory, options: Options = Options(), take: Take | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, name, content) -> the corrected files; and what their books teach, a row each with
    ``path``: rows of the name table, and genre mappings.

    A corrected file has route, score, source, title (the record's), ``key`` (the book's, in the
    match table), ``changes``, ``outcome``, ``line``, ``kept`` (whether it was rewritten, so its
    original is to be backed up), ``problem`` and its new content; with ``dry_run`` the content
    is as it was. ``take`` grants the calls of a model, of both kinds.
    """
    take = state.in_all(options.daily_calls) if take is None else take
    read = many(
        epub.read_books(listed.filter(delivery.is_book(F.col("path")))).withColumn("book_id", F.xxhash64("path")), "books"
    )
    books = read.filter("error is null")
    decided = many(decide(books.drop("error"), by, options, take), "decisions")
    decided, taught = spelled(decided.join(books.select("book_id", "path"), "book_id"), memory)
    decided = many(decided, "spelled")
    wanted, mapped = genres(decided.filter("found is not null"), memory, by.map_genre, options, take)
    planned = many(plan(books, decided.drop("path"), wanted, options, by.covers), "planned")
    moved = planned.filter(F.size("changes") > 0)
    key = state.book_key(F.col("file_isbn"), F.col("file_title"), F.col("file_authors")).alias("key")
    told = planned.select("path", "score", F.col("found_source").alias("source"), F.col("found_title").alias("title"), key, "changes")
    routes = read.join(decided.select("book_id", "route", "outcome"), "book_id", "left").select(
        "path", F.coalesce("route", F.lit("unread")).alias("route"), "outcome", F.col("error").alias("problem")
    )
    rows = listed.join(routes.hint("merge"), "path", "left").join(told.hint("merge"), "path", "left")
    rows = rows.withColumn("changes", F.coalesce("changes", F.array().cast(planned.schema["changes"].dataType)))
    rows = rows.withColumn("line", merge.audit_line(F.col("name"), F.coalesce("route", F.lit("no book")), F.col("source"), F.col("score"), F.col("outcome"), F.col("problem")))
    if not options.dry_run:
        new = epub.rewritten(moved.join(listed.select("path", "content"), "path"))
        written = new.select("path", F.col("content").alias("__new"), F.col("error").alias("__error"))
        rows = rows.join(written.hint("merge"), "path", "left")
        rows = rows.withColumn("kept", F.col("__new").isNotNull() & F.col("__error").isNull())
        rows = rows.withColumn("original", F.when(F.col("kept"), F.col("content")))
        rows = rows.withColumn("content", F.when(F.col("kept"), F.col("__new")).otherwise(F.col("content"))).drop("__new", "__error")
    else:
        rows = rows.withColumns({"kept": F.lit(False), "original": F.lit(None).cast("binary")})
    return rows, taught, mapped


def backed_up(corrected: DataFrame, backups: str, kept: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The corrected files that are not waiting, and (path, name) of the originals that are now
    in ``backups``. Originals of ``before`` (path) are there already. A book whose original
    could not be kept is delivered as it came, with that as its problem."""
    ready = materialize(corrected.filter("route is null or route <> 'waiting'"), "ready")
    originals = ready.filter("kept").select("path", "name", F.col("original").alias("content"))
    if before is not None:
        originals = originals.join(before.select("path"), "path", "left_anti")
    none = originals.select("path", "name").limit(0)
    if originals.isEmpty():
        return ready, none
    spare = materialize(delivery.free_names(originals, kept, order=["path"]).select("path", F.col("free").alias("name"), "content"), "spare")
    aside = materialize(files.place(spare.select("name", "content"), backups), "backed-up").join(spare.select("path", "name"), "name")
    lost = aside.filter("error is not null").select("path", F.concat(F.lit("the original could not be backed up: "), "error").alias("__lost"))
    ready = ready.join(lost, "path", "left")
    undone = F.col("__lost").isNotNull()
    ready = ready.withColumns(
        {
            "content": F.when(undone, F.col("original")).otherwise(F.col("content")),
            "kept": F.col("kept") & ~undone,
            "line": F.when(undone, F.concat("line", F.lit(" | nothing written: "), "__lost")).otherwise(F.col("line")),
            "problem": F.coalesce("__lost", "problem"),
        }
    ).drop("__lost")
    return materialize(ready, "ready-kept"), aside.filter("error is null").select("path", "name")


def addressed(ready: DataFrame, present: DataFrame, kept: DataFrame) -> DataFrame:
    """(path, name, route, content, folder): where each file goes. ``present`` is a listing of
    the output folder and ``kept`` (name) what backups has; ``folder`` is ``output``, or
    ``backups`` for duplicates; one whose original is there already goes nowhere."""
    going = materialize(delivery.routes(ready.select("path", "name", "content", "kept"), present, files.digests), "going")
    out = delivery.free_names(going.filter("route <> 'duplicate'"), present.select("name").distinct(), order=["path"])
    back = delivery.free_names(going.filter("route = 'duplicate' and not kept"), kept, order=["path"])
    done = going.filter("route = 'duplicate' and kept").select("path", "name", "route", "content", F.lit(None).cast("string").alias("folder"))
    to = lambda rows, folder: rows.select("path", F.col("free").alias("name"), "route", "content", F.lit(folder).alias("folder"))
    return materialize(to(out, "output").unionByName(to(back, "backups")).unionByName(done), "outgoing")


def put(going: DataFrame, output: str, backups: str) -> DataFrame:
    """Put files where they go, then take them out of where they came from; (path, name, route,
    error, stuck) of each: ``error`` where it did not arrive, ``stuck`` where it could not be
    removed."""
    placed = going.filter("folder is null").select("path", "name", "route", F.lit(None).cast("string").alias("error"))
    for folder, root in (("output", output), ("backups", backups)):
        own = going.filter(F.col("folder") == folder)
        told = own.select("path", "name", "route").join(files.place(own, root), "name")
        placed = placed.unionByName(told.select("path", "name", "route", "error"))
    done = materialize(placed, "delivered")
    gone = materialize(files.delete(done.filter("error is null")), "removed")
    return done.join(gone.withColumnRenamed("error", "stuck"), "path", "left")


def deliver(spark: SparkSession, corrected: DataFrame, output: str, backups: str, present: DataFrame, kept: DataFrame) -> DataFrame:
    """Back originals up, put corrected files into ``output`` and duplicates into ``backups``,
    then take them out of where they came from; (path, name, route, error, stuck) of each that
    is not waiting. ``present`` and ``kept`` are a listing and (name) of what the folders have."""
    ready, aside = backed_up(corrected, backups, kept)
    return put(addressed(ready, present, kept.select("name").unionByName(aside.select("name"))), output, backups)
