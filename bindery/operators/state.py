"""Durable tables: name spellings, matches, genre mappings; and how they are written.

A table is a log of commits below one folder. A commit names the folders of Parquet files that
make up the table from then on: a base, and deltas that are merged into it as it is read. It is
a small file with the next number, created only if that is not there: readers see one commit or
the next, and of two writers one has to read the other's commit and try again. The upserts are
functions of DataFrames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery import storage
from bindery.functions import text as X

NAMES = "kind string, source string, key string, standard string, seen string"
MATCHES = "book_key string, source string, confidence double, matched_at string, matched_as string"
GENRES = "source string, genre string, mapped string, seen string"


#: Deltas that are read beside a base before they are written into a new one.
MOST_DELTAS = 8
#: Commits that stay, for readers that have begun with them.
KEPT_COMMITS = 3
#: Days whose leases stay.
KEPT_DAYS = 2


class StateTable:
    """One table below ``root``. ``merged`` makes the table of the base's and the deltas' rows,
    with ``seq``, the place of the commit they came with; without it they are all its rows.
    ``batch`` numbers rise: what has no higher number than the last one was written before."""

    def __init__(self, spark: SparkSession, root: str, schema: str, merged: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.schema, self.merged = spark, root.rstrip("/"), schema, merged

    def _log(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.root}/log") if n.endswith(".json")]

    def _commit(self, number: int) -> dict:
        return json.loads(storage.read_text(self.spark, f"{self.root}/log/{number:010d}.json"))

    def _current(self) -> tuple[int, dict]:
        log = self._log()
        return (log[-1], self._commit(log[-1])) if log else (-1, {"base": None, "deltas": [], "batch": -1})

    def _rows(self, told: dict) -> DataFrame:
        folders = [f for f in (told["base"], *told["deltas"]) if f]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))
        if self.merged is None or not told["deltas"]:
            return rows
        own = F.regexp_extract("_metadata.file_path", "/(rows-[0-9a-f]+)/[^/]*$", 1)
        seq = F.array_position(F.array(*map(F.lit, folders)), own)
        return self.merged(rows.withColumn("seq", seq)).select(*(c.split(" ")[0] for c in self.schema.split(", ")))

    def read(self) -> DataFrame:
        return self._rows(self._current()[1])

    def _written(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def _put(self, number: int, told: dict) -> bool:
        done = storage.create_text(self.spark, f"{self.root}/log/{number:010d}.json", json.dumps(told))
        if done:
            self._forget()
        return done

    def _forget(self) -> None:
        """Old commits go, and what only they name."""
        log = self._log()
        old, kept = log[:-KEPT_COMMITS], log[-KEPT_COMMITS:]
        if not old:
            return
        of = lambda told: {f for f in (told["base"], *told["deltas"]) if f}
        needed = set().union(*(of(self._commit(n)) for n in kept))
        for n in old:
            for folder in of(self._commit(n)) - needed:
                storage.remove(self.spark, f"{self.root}/{folder}")
            storage.remove(self.spark, f"{self.root}/log/{n:010d}.json")

    def replace(self, rows: DataFrame, batch: int = -1) -> bool:
        """Make the table these rows; False if ``batch`` was written before."""
        folder = None
        while True:
            number, told = self._current()
            if 0 <= batch <= told["batch"]:
                return False
            folder = folder or self._written(rows)
            if self._put(number + 1, {"base": folder, "deltas": [], "batch": max(batch, told["batch"])}):
                return True

    def append(self, rows: DataFrame, batch: int = -1) -> bool:
        """Add rows to those there are; False if ``batch`` was written before."""
        folder = None
        while True:
            number, told = self._current()
            if 0 <= batch <= told["batch"]:
                return False
            folder = folder or self._written(rows)
            if self._put(number + 1, told | {"deltas": [*told["deltas"], folder], "batch": max(batch, told["batch"])}):
                break
        if len(told["deltas"]) + 1 >= MOST_DELTAS:
            self.update(lambda rows: rows)
        return True

    def update(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Make the table what ``change`` makes of it, anew if another writer came first."""
        while True:
            number, told = self._current()
            folder = self._written(change(self._rows(told)))
            if self._put(number + 1, {"base": folder, "deltas": [], "batch": told["batch"]}):
                return
            storage.remove(self.spark, f"{self.root}/{folder}")

    def reset(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))


class DailyCalls:
    """How many calls each UTC day has left, whoever makes them.

    Calls are taken before they are made, by a lease: a file below ``root`` and the day, with
    the next number and all that is spent with it, created only if that is not there. Those who
    ask at once take turns, a restart reads the last lease, and a call that fails was spent.
    """

    def __init__(self, spark: SparkSession, root: str, daily: int):
        self.spark, self.root, self.daily = spark, root.rstrip("/"), daily

    def _last(self, day: str) -> tuple[int, dict]:
        leases = storage.names(self.spark, f"{self.root}/{day}")
        if not leases:
            return -1, {"spent": 0, "batch": -1}
        return int(leases[-1]), json.loads(storage.read_text(self.spark, f"{self.root}/{day}/{leases[-1]}"))

    def spent(self, day: str) -> int:
        return self._last(day)[1]["spent"]

    def take(self, day: str, wanted: int, batch: int = -1) -> int:
        """How many of the wanted calls may be made; none for a batch, of rising numbers, that
        took some before. Leases of days before yesterday go."""
        while True:
            number, told = self._last(day)
            given = wanted if not self.daily else max(0, min(wanted, self.daily - told["spent"]))
            if 0 <= batch <= told["batch"] or (given == 0 and batch < 0):
                return 0
            lease = {"spent": told["spent"] + given, "calls": given, "batch": max(batch, told["batch"])}
            if storage.create_text(self.spark, f"{self.root}/{day}/{number + 1:010d}", json.dumps(lease)):
                break
        for old in storage.names(self.spark, self.root)[:-KEPT_DAYS]:
            storage.remove(self.spark, f"{self.root}/{old}")
        return given

    def on(self, day: str) -> Callable[[int], int]:
        """A day's calls, as the steps that make them take them."""
        return lambda wanted: self.take(day, wanted)

    def grant(self, calls: DataFrame, day: str, batch: int, *order: str) -> DataFrame:
        """The first calls of a batch that the day still has, by ``order``, which tells them
        apart; the calls of a day are as few as its limit."""
        given = self.take(day, calls.count(), batch)
        return calls.orderBy(*order).limit(given)


def in_all(daily: int) -> Callable[[int], int]:
    """As many calls as ``daily`` in all, for a pass that keeps no count; 0 is no limit."""
    left = [daily]

    def take(wanted: int) -> int:
        given = wanted if not daily else min(wanted, left[0])
        left[0] -= given
        return given

    return take


def resolve_names(names: DataFrame, known: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(kind, source, name, identity) with ``spelling``, ``by_id`` and ``overridden``.

    An override (kind, name, spelling) by the name's key wins, then the standard of the
    source's own id, then that of the key, then the name itself. Names without a key go.
    """
    keyed = names.withColumn("key", X.durable_key(F.col("name"))).filter("key <> ''")
    by_id = known.filter("source <> ''").select("kind", "source", F.col("key").alias("identity"), F.col("standard").alias("__id"))
    by_key = known.filter("source = ''").select("kind", "key", F.col("standard").alias("__key"))
    met = keyed.join(by_id, ["kind", "source", "identity"], "left").join(by_key, ["kind", "key"], "left")
    if overrides is None:
        met = met.withColumn("__over", F.lit(None).cast("string"))
    else:
        own = overrides.select("kind", X.durable_key(F.col("name")).alias("key"), F.col("spelling").alias("__over"))
        met = met.join(own.dropDuplicates(["kind", "key"]), ["kind", "key"], "left")
    return met.withColumns(
        {
            "spelling": F.coalesce("__over", "__id", "__key", "name"),
            "by_id": F.col("__over").isNull() & F.col("__id").isNotNull(),
            "overridden": F.col("__over").isNotNull(),
        }
    ).drop("__over", "__id", "__key")


def name_rows(resolved: DataFrame) -> DataFrame:
    """What resolved names tell the name table: a row by the chosen spelling's key and, unless
    it was resolved by id or overridden, one by the source's id; with ``pos`` and other columns
    as they are."""
    others = [c for c in resolved.columns if c not in ("kind", "source", "key", "name", "identity", "spelling", "by_id", "overridden")]
    told = [F.col("spelling").alias("standard"), F.col("name").alias("seen"), *others]
    by_key = resolved.select("kind", F.lit("").alias("source"), X.durable_key(F.col("spelling")).alias("key"), *told)
    by_id = resolved.filter("identity is not null and not by_id and not overridden").select("kind", "source", F.col("identity").alias("key"), *told)
    return by_key.unionByName(by_id).filter("key <> ''")


def first_names(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each kind, source and key: what came first stays."""
    first = Window.partitionBy("kind", "source", "key").orderBy(order)
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", order)


def learn_names(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """The name table with what was not known. First come, first kept."""
    first = first_names(name_rows(resolved), "pos")
    return known.unionByName(first.join(known, ["kind", "source", "key"], "left_anti").select(known.columns))


def merged_genres(rows: DataFrame) -> DataFrame:
    """Of each source's genre the newest target and the spelling seen first, by ``seq``."""
    return rows.groupBy("source", "genre").agg(F.max_by("mapped", "seq").alias("mapped"), F.min_by("seen", "seq").alias("seen"))


def merged_matches(priority: dict[str, int] | list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of each book's matches the one of higher confidence, then of the better source (an
    unlisted one last), then the one that was there, by ``seq``."""
    listed = {s: n for n, s in enumerate(priority)} if isinstance(priority, list) else priority
    rank: Column = F.lit(len(listed))
    for name, n in listed.items():
        rank = F.when(F.col("source") == name, F.lit(n)).otherwise(rank)
    order = Window.partitionBy("book_key").orderBy(F.col("confidence").desc(), rank, "seq", "matched_at", "matched_as")
    return lambda rows: rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "seq")


def best_matches(known: DataFrame, new: DataFrame, priority: dict[str, int] | list[str]) -> DataFrame:
    """The match table after new matches, the best of each book."""
    rows = known.withColumn("seq", F.lit(0)).unionByName(new.select(known.columns).withColumn("seq", F.lit(1)))
    return merged_matches(priority)(rows)


def book_key(isbn: Column, title: Column, authors: Column) -> Column:
    """What names a book in the match table: its ISBN, else its keys of title and authors."""
    digits = F.regexp_replace(F.coalesce(isbn, F.lit("")), r"[-\s]", "")
    names = F.array_join(F.transform(F.coalesce(authors, F.array().cast("array<string>")), X.durable_key), ";")
    return F.when(digits != "", digits).otherwise(F.concat_ws("|", X.durable_key(title), names))


def save_genres(known: DataFrame, new: DataFrame) -> DataFrame:
    """The genre table after new mappings: the new target, the first spelling seen."""
    old = known.select("source", "genre", F.col("mapped").alias("__mapped"), F.col("seen").alias("__seen"))
    return new.join(old, ["source", "genre"], "full").select(
        "source", "genre", F.coalesce("mapped", "__mapped").alias("mapped"), F.coalesce("__seen", "seen").alias("seen")
    )


def genre_fingerprint(genres: DataFrame, column: str = "genre") -> DataFrame:
    """(fingerprint): the list's folded entries, sorted, a line each."""
    folded = genres.select(X.casefold(F.trim(F.col(column))).alias("g")).filter("g <> ''")
    return folded.agg(F.array_join(F.array_sort(F.collect_list("g")), "\n").alias("fingerprint"))


def sweep_genres(known: DataFrame, stored: str | None, current: str) -> DataFrame:
    """The genre table less the refusals, if the allowed list has changed."""
    return known if stored == current else known.filter("mapped <> ''")


def map_genres(wanted: DataFrame, known: DataFrame, allowed: DataFrame) -> DataFrame:
    """(source, genre) with ``state``: miss (not known), unfit (known not to fit), gone (its
    target left the list) or mapped, and ``target`` in the allowed list's own spelling."""
    listed = allowed.select(X.casefold(F.trim(F.col("genre"))).alias("__key"), F.col("genre").alias("__own")).dropDuplicates(["__key"])
    met = wanted.join(known.select("source", "genre", "mapped"), ["source", "genre"], "left").withColumn(
        "__key", X.casefold(F.trim(F.col("mapped")))
    )
    state = (
        F.when(F.col("mapped").isNull(), "miss").when(F.col("mapped") == "", "unfit").when(F.col("__own").isNull(), "gone").otherwise("mapped")
    )
    return met.join(listed, "__key", "left").withColumn("state", state).withColumn("target", F.col("__own")).drop("__key", "__own", "mapped")


def utc_day(at: Column) -> Column:
    """The UTC day of a moment, whatever the session's time zone."""
    return F.to_date(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()))


def quota(calls: DataFrame, daily: int, when: str = "at", order: list[str] | None = None) -> DataFrame:
    """Calls with ``granted``: the first ``daily`` of each UTC day, failures counting; 0 is
    no limit.

    A day is not ranked as a whole: each hour's first ``daily`` calls are found on their own,
    and only these, of which the day's first must be some, are ranked by day.
    """
    if daily == 0:
        return calls.withColumn("granted", F.lit(True))
    keyed = calls.withColumns({"__day": utc_day(F.col(when)), "__hour": F.floor(F.unix_micros(F.col(when).cast("timestamp")) / 3_600_000_000)})
    by = [when, *(order or [])]
    hourly = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__day", "__hour").orderBy(*by)))
    early = F.col("__n") <= daily
    counts = hourly.groupBy("__day", "__hour").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__day").orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("__day", "__hour", F.coalesce(before, F.lit(0)).alias("__before"))
    met = hourly.join(places, (hourly["__day"].eqNullSafe(places["__day"])) & (hourly["__hour"].eqNullSafe(places["__hour"])), "left")
    granted = early & (F.coalesce("__before", F.lit(0)) + F.col("__n") <= daily)
    return met.select(*(calls[c] for c in calls.columns), granted.alias("granted"))


def ordered_names(known: DataFrame) -> DataFrame:
    """The name table in its stable order."""
    return known.select("kind", "source", "key", "standard", "seen").orderBy("kind", "source", "key")


def ordered_genres(known: DataFrame) -> DataFrame:
    """The genre table in its stable order."""
    return known.select("source", "genre", "mapped", "seen").orderBy("source", "genre")
