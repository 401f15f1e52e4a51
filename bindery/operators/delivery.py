"""Folders: which files are settled, where they go, what is a duplicate, what expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: suffixes of unfinished downloads.
UNFINISHED = ("part", "crdownload", "tmp", "download", "partial")
BOOKS = r"(?i)\.(epub|kepub)$"


def candidates(files: DataFrame, root: str) -> DataFrame:
    """Files that may be looked at: none hidden, none below a hidden folder, no unfinished
    download. ``files`` is (path, length, modificationTime, ...)."""
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root.rstrip('/')}/", "")
    hidden = inner.rlike(r"(^|/)\.")
    unfinished = inner.rlike(rf"(?i)\.({'|'.join(UNFINISHED)})$")
    return files.filter(~hidden & ~unfinished)


def is_book(path: Column) -> Column:
    return path.rlike(BOOKS)


def settled(sightings: DataFrame, checks: int = 2, by: str = "path", at: str = "at", mark: str = "mark") -> DataFrame:
    """Sightings with ``streak``, how many in a row show the same mark, and ``settled``."""
    order = Window.partitionBy(by).orderBy(at)
    changed = F.when(F.col(mark).eqNullSafe(F.lag(mark).over(order)), 0).otherwise(1)
    runs = sightings.withColumn("__changed", changed).withColumn("__run", F.sum("__changed").over(order))
    streak = F.row_number().over(Window.partitionBy(by, "__run").orderBy(at))
    return runs.withColumn("streak", streak).withColumn("settled", F.col("streak") >= checks).drop("__changed", "__run")


#: A name that says which of several it is: stem, number, ending.
NUMBERED = r"^(.*) \(([2-9]|[1-9]\d{1,8})\)(\.[^.]*)?$"


def free_names(wanted: DataFrame, taken: DataFrame, name: str = "name", order: list[str] | None = None) -> DataFrame:
    """Wanted names with ``free``: the name, or ``name (2).ext`` and on, the first that
    neither the folder nor an earlier row has. ``taken`` is (name).

    A numbered name that is wanted itself is kept for the row that wants it. The p-th free
    number of a name is p and as many more as there are used ones before it: the i-th used
    number u has u - i free ones below it, so one running count over both tells them apart.
    """
    row = "__row"
    keyed = wanted.withColumn("__place", F.row_number().over(Window.partitionBy(name).orderBy(*(order or [name]))))
    part = lambda group: F.regexp_extract(name, NUMBERED, group)
    numbered = taken.select(name).unionByName(wanted.select(name)).filter(F.col(name).rlike(NUMBERED)).distinct()
    used = (
        taken.select(F.col(name).alias("__base"), F.lit(1).cast("long").alias("__n"))
        .unionByName(numbered.select(F.concat(part(1), part(3)).alias("__base"), part(2).cast("long").alias("__n")))
        .distinct()
        .join(wanted.select(F.col(name).alias("__base")).distinct(), "__base", "left_semi")
    )
    below = F.col("__n") - F.row_number().over(Window.partitionBy("__base").orderBy("__n"))
    asks = keyed.select(F.col(name).alias("__base"), F.col("__place").cast("long").alias("__at"), F.struct("*").alias(row))
    told = asks.withColumn("__used", F.lit(0)).unionByName(
        used.select("__base", below.alias("__at"), F.lit(None).cast(asks.schema[row].dataType).alias(row), F.lit(1).alias("__used"))
    )
    so_far = Window.partitionBy("__base").orderBy("__at", "__used").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = (F.col("__at") + F.sum("__used").over(so_far)).alias("__number")
    stem, ending = (F.regexp_extract("__base", r"^(.*?)(\.[^.]*)?$", group) for group in (1, 2))
    again = F.concat(stem, F.lit(" ("), F.col("__number").cast("string"), F.lit(")"), ending)
    free = F.when(F.col("__number") == 1, F.col("__base")).otherwise(again)
    found = told.select("__base", row, number).filter(F.col(row).isNotNull())
    return found.select(*(F.col(row)[c].alias(c) for c in wanted.columns), free.alias("free"))


def destinations(files: DataFrame, delivered: DataFrame) -> DataFrame:
    """(name, content) with ``route``: moved (name is free), duplicate (same size and digest)
    or collision. ``delivered`` is (name, content)."""
    there = delivered.select("name", F.length("content").alias("__size"), F.sha2("content", 256).alias("__digest"))
    met = files.join(there, "name", "left")
    same = (F.length("content") == F.col("__size")) & (F.sha2("content", 256) == F.col("__digest"))
    return met.withColumn(
        "route", F.when(F.col("__size").isNull(), "moved").when(same, "duplicate").otherwise("collision")
    ).drop("__size", "__digest")


def routes(files: DataFrame, there: DataFrame, digests: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, name, content) with ``route``, as ``destinations``, against a listing (path, name,
    length): only files of the same name and length are read, by ``digests`` of their paths."""
    known = there.groupBy("name").agg(F.first("path").alias("__there"), F.first("length").alias("__length"))
    met = files.join(known, "name", "left").withColumn("__same", F.length("content") == F.col("__length"))
    read = digests(met.filter("__same").select(F.col("__there").alias("path"))).select(F.col("path").alias("__there"), "digest")
    met = met.join(read, "__there", "left")
    same = F.coalesce(F.col("__same") & (F.sha2("content", 256) == F.col("digest")), F.lit(False))
    route = F.when(F.col("__there").isNull(), "moved").when(same, "duplicate").otherwise("collision")
    return met.withColumn("route", route).drop("__there", "__length", "__same", "digest")


def expired(backups: DataFrame, now: Column, days: int, at: str = "modificationTime") -> DataFrame:
    """Backups older than ``days``; hidden files stay."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return backups.filter((F.col(at) < now - F.expr(f"INTERVAL {int(days)} DAYS")) & ~name.startswith("."))


def not_stuck(sightings: DataFrame, stuck: DataFrame) -> DataFrame:
    """Sightings less the files that were delivered but could not be removed, until they
    change. Both have (path, mark)."""
    return sightings.join(stuck.select("path", "mark"), ["path", "mark"], "left_anti")


def still_stuck(stuck: DataFrame, sightings: DataFrame) -> DataFrame:
    """The stuck files that are there as they were; the others are forgotten."""
    return stuck.join(sightings.select("path", "mark").distinct(), ["path", "mark"], "left_semi")
