"""Watching a folder: passes over what has settled, with the state between them.

A pass lists the ingest folder, counts for how many passes each file has looked the same,
corrects and delivers those that have settled, and remembers what was delivered. State is below
one folder: tables ``seen`` (path, mark, streak), ``stuck`` (delivered but not removable, until
they change), ``waiting`` (left for the next UTC day), ``told`` (announced by a dry run; for a day, if they wait),
``backed`` (originals that are in backups and whose book has not arrived), ``names``,
``genres``, ``matches`` and the allowed list's ``fingerprint``; and the leases of the day's
``calls``. ``poll`` makes passes, ``watch`` handles the folder as a stream, whose own state then
counts and holds.

What a pass decided is written into ``journal``, a row a book with where it goes, before
anything is put there, and learned from the rows of the books that arrived. A journal that a
pass left behind is learned from by the next one, as far as its books are in the output folder
and no more in the ingest folder; learning the same twice changes nothing.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators import delivery, state
from bindery.options import Options
from bindery.plans import correction
from bindery.sources import files
from bindery.storage import materialize, scratch
from bindery.streaming import folder

NAME = "struct<kind:string,source:string,key:string,standard:string,seen:string,pos:struct<path:string,place:int>>"
GENRE = "struct<source:string,genre:string,mapped:string,seen:string>"
MATCH = "struct<book_key:string,source:string,confidence:double,matched_at:string,matched_as:string>"
TABLES = {
    "seen": "path string, mark string, streak long",
    "stuck": "path string, mark string",
    "waiting": "path string, day string",
    "told": "path string, mark string, day string",
    "backed": "path string, mark string, name string",
    "names": state.NAMES,
    "genres": state.GENRES,
    "matches": state.MATCHES,
    "fingerprint": "fingerprint string",
    "journal": f"path string, name string, length long, names array<{NAME}>, genres array<{GENRE}>, match {MATCH}",
}


@dataclass
class Relay:
    spark: SparkSession
    ingest: str
    output: str
    backups: str
    root: str
    catalogues: correction.Catalogues
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        root = self.root.rstrip("/")
        merged = {"names": state.first_names, "genres": state.merged_genres, "matches": state.merged_matches(list(self.options.sources))}
        self.state = {n: state.StateTable(self.spark, f"{root}/{n}", kind, merged.get(n)) for n, kind in TABLES.items()}
        self.calls = state.DailyCalls(self.spark, f"{root}/calls", self.options.daily_calls)
        self.stop = threading.Event()

    def _put(self, name: str, rows: DataFrame) -> None:
        """Replace a small table, if that changes it."""
        rows = materialize(rows, f"state-{name}")
        if not (rows.isEmpty() and self.state[name].read().isEmpty()):
            self.state[name].replace(rows)

    def start(self) -> None:
        """Forget the genres that did not fit, if the allowed list has changed; a dry run
        changes nothing."""
        if self.options.dry_run:
            return
        current = state.genre_fingerprint(self._allowed()).first()["fingerprint"]
        stored = self.state["fingerprint"].read().first()
        if stored is None or stored["fingerprint"] != current:
            self.state["genres"].update(lambda known: state.sweep_genres(known, stored and stored["fingerprint"], current))
            self._put("fingerprint", self.spark.range(1).select(F.lit(current).alias("fingerprint")))

    def _allowed(self) -> DataFrame:
        listed = F.array(*map(F.lit, self.options.genres)).cast("array<string>")
        return self.spark.range(1).select(F.explode(listed).alias("genre"))

    def _overrides(self) -> DataFrame | None:
        if not self.options.authors:
            return None
        rows = (F.struct(F.lit("author").alias("kind"), F.lit(a).alias("name"), F.lit(b).alias("spelling")) for a, b in self.options.authors.items())
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    def settled(self, day: str) -> DataFrame:
        """(path, mark) of the files to be handled in this pass; counts the others."""
        listed = delivery.candidates(files.listing(self.spark, self.ingest), self.ingest)
        present = materialize(listed.select("path", "mark"), "present")
        stuck = materialize(delivery.still_stuck(self.state["stuck"].read(), present), "stuck")
        self._put("stuck", stuck)
        waiting = self.state["waiting"].read().filter(F.col("day") == day)
        fresh = delivery.not_stuck(present, stuck).join(waiting, "path", "left_anti")
        if self.options.dry_run:
            told = self.state["told"].read().filter(F.coalesce(F.col("day") == day, F.lit(True)))
            fresh = fresh.join(told, ["path", "mark"], "left_anti")
        before = self.state["seen"].read().select("path", F.col("mark").alias("was"), F.col("streak").alias("n"))
        streak = F.when(F.col("mark") == F.col("was"), F.col("n")).otherwise(0) + 1
        counted = materialize(fresh.join(before, "path", "left").select("path", "mark", streak.cast("long").alias("streak")), "counted")
        ready = F.col("streak") >= self.options.stable_checks
        self._put("seen", counted.filter(~ready))
        return counted.filter(ready).select("path", "mark")

    def scan_once(self, day: str, now: str) -> list[str]:
        """One pass; the lines that tell of it, by name. ``day`` and ``now`` are in UTC."""
        with scratch(self.spark):
            return self._scan(day, now)

    def _learn(self, rows: DataFrame) -> None:
        """Remember what the journal says of books that arrived."""
        told = materialize(rows, "learned")
        new = {
            "names": state.first_names(told.select(F.inline("names")), "pos"),
            "genres": told.select(F.inline("genres")).groupBy("source", "genre").agg(F.min("mapped").alias("mapped"), F.min("seen").alias("seen")),
            "matches": told.filter("match is not null").select("match.*"),
        }
        for name, more in new.items():
            if not (more := materialize(more, f"new-{name}")).isEmpty():
                self.state[name].append(more)

    def recover(self) -> None:
        """Learn from what an earlier pass delivered and did not come to learn from."""
        journal = self.state["journal"].read()
        if journal.isEmpty():
            return
        there = files.at_top(files.listing(self.spark, self.output), self.output).select("name", "length")
        here = files.listing(self.spark, self.ingest).select("path")
        self._learn(journal.join(there, ["name", "length"], "left_semi").join(here, "path", "left_anti"))
        self.state["journal"].reset()

    def _journal(self, told: DataFrame, names: DataFrame, genres: DataFrame, going: DataFrame, now: str) -> DataFrame:
        """A row for each book that teaches something: a rewritten one its names, genres and
        match; one that needed no change its genres."""
        own = told.filter("route = 'match'").select("path", "kept", "key", "source", "score", "title", (F.size("changes") == 0).alias("same"))
        listed = names.groupBy("path").agg(F.collect_list(F.struct("kind", "source", "key", "standard", "seen", "pos")).alias("names"))
        mapped = genres.groupBy("path").agg(F.collect_list(F.struct("source", "genre", "mapped", "seen")).alias("genres"))
        match = F.struct(
            F.col("key").alias("book_key"), "source", F.col("score").alias("confidence"), F.lit(now).alias("matched_at"), F.col("title").alias("matched_as")
        )
        rows = own.join(listed, "path", "left").join(mapped, "path", "left").join(going.select("path", "name", F.length("content").cast("long").alias("length")), "path")
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        return rows.select(
            "path", "name", "length",
            F.when(F.col("kept"), F.coalesce("names", empty(NAME))).otherwise(empty(NAME)).alias("names"),
            F.when(F.col("kept") | F.col("same"), F.coalesce("genres", empty(GENRE))).otherwise(empty(GENRE)).alias("genres"),
            F.when(F.col("kept"), match).alias("match"),
        ).filter("size(names) > 0 or size(genres) > 0 or match is not null")

    def _expire(self, now: str) -> None:
        """Old backups go, and the folders that they leave empty."""
        if self.options.dry_run:
            return
        old = files.listing(self.spark, self.backups)
        expired = delivery.expired(old, F.lit(now).cast("timestamp"), self.options.backup_days)
        gone = materialize(files.delete(expired.select("path")), "expired")
        if not gone.isEmpty():
            files.remove_empty_folders(self.backups)

    def _scan(self, day: str, now: str) -> list[str]:
        if not self.options.dry_run:
            self._expire(now)
            self.recover()
        return self._handled(materialize(self.settled(day), "settled"), day, now)

    def _handled(self, ready: DataFrame, day: str, now: str) -> list[str]:
        """Correct and deliver settled files (path, mark)."""
        dry = self.options.dry_run
        if ready.isEmpty():
            return []
        listed = materialize(files.read(ready), "listed")
        memory = correction.Memory(
            self.state["names"].read(),
            self.state["genres"].read(),
            self._allowed(),
            self._overrides(),
        )
        corrected, names, genres = correction.correct(listed, self.catalogues, memory, self.options, self.calls.on(day))
        told = materialize(corrected, "corrected")
        put_off = told.filter("route = 'waiting'").select("path", F.lit(day).alias("day"))
        if dry:
            # Each version once; those that wait, once a day. A later real pass is not held by it.
            self._put("told", self.state["told"].read().unionByName(ready.join(put_off, "path", "left")))
            return self._lines(told)
        self._put("waiting", self.state["waiting"].read().filter(F.col("day") == day).unionByName(put_off))
        kept = files.listing(self.spark, self.backups).select("name")
        backed = self.state["backed"].read()
        held, aside = correction.backed_up(told, self.backups, kept, backed.join(ready, ["path", "mark"], "left_semi"))
        aside = materialize(aside.join(ready, "path").select("path", "mark", "name"), "aside")
        if not aside.isEmpty():
            self._put("backed", backed.unionByName(aside))
        present = files.at_top(files.listing(self.spark, self.output), self.output)
        going = correction.addressed(held, present, kept.unionByName(aside.select("name")))
        journal = materialize(self._journal(held, names, genres, going, now), "journal")
        if not journal.isEmpty():
            self.state["journal"].replace(journal)
        done = materialize(correction.put(going, self.output, self.backups), "done")
        arrived = done.filter("error is null").select("path")
        left = done.filter("stuck is not null").join(ready, "path").select("path", "mark")
        if not left.isEmpty():
            self._put("stuck", self.state["stuck"].read().unionByName(left))
        if not journal.isEmpty():
            # Only now, and only of these: what did not arrive is not to be learned from.
            self._learn(journal.join(arrived, "path", "left_semi"))
            self.state["journal"].reset()
        self._put("backed", self.state["backed"].read().join(arrived, "path", "left_anti"))
        lost = done.filter("error is not null").select("path", F.concat(F.lit(" | not delivered: "), "error").alias("lost"))
        whole = told.filter("route = 'waiting'").select("path", "name", "line").unionByName(held.select("path", "name", "line"))
        return self._lines(whole.join(lost, "path", "left").withColumn("line", F.concat("line", F.coalesce("lost", F.lit("")))))

    def _lines(self, told: DataFrame) -> list[str]:
        """The lines by name; they come one partition after the other, not all at once."""
        return [r["line"] for r in told.select("name", "line").orderBy("name").toLocalIterator()]

    def poll(self, passes: int | None = None, clock: Callable[[], float] = time.time, rest: Callable[[float], object] | None = None) -> None:
        """Pass after pass, ``poll_seconds`` apart, until ``stop`` is set; the pass that is
        under way then is finished."""
        self.start()
        rest = rest or self.stop.wait
        while not self.stop.is_set() and (passes is None or passes > 0):
            moment = time.gmtime(clock())
            for line in self.scan_once(time.strftime("%Y-%m-%d", moment), time.strftime("%Y-%m-%dT%H:%M:%SZ", moment)):
                print(line, flush=True)
            passes = None if passes is None else passes - 1
            if passes is None or passes > 0:
                rest(self.options.poll_seconds)

    def batch(self, settled: DataFrame, number: int = 0) -> list[str]:
        """Handle a batch of the stream: the settled files that are candidates and not stuck.
        Those that wait are told again by the stream on the next UTC day."""
        moment = time.gmtime()
        day, now = time.strftime("%Y-%m-%d", moment), time.strftime("%Y-%m-%dT%H:%M:%SZ", moment)
        with scratch(self.spark):
            if not self.options.dry_run:
                self.recover()
            ready = delivery.candidates(settled.select("path", "mark"), self.ingest)
            ready = materialize(delivery.not_stuck(ready, self.state["stuck"].read()), "settled")
            return self._handled(ready, day, now)

    def watch(self, tell: Callable[[str], None] = lambda line: print(line, flush=True)) -> None:
        """Handle the folder as a stream until ``stop`` is set; a restart goes on where it was."""
        self.start()
        self._expire(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        handle = lambda batch, number: [tell(line) for line in self.batch(batch, number)] and None
        query = folder.watch(self.spark, self.ingest, f"{self.root.rstrip('/')}/stream", handle, self.options.stable_checks, self.options.poll_seconds)
        while not self.stop.wait(0.5) and query.isActive:
            continue
        query.stop()
        if (error := query.exception()) is not None:
            raise error

    def reset(self, confirmed: bool) -> None:
        """Forget names, genres and matches; only if that was confirmed."""
        if not confirmed:
            raise ValueError("a reset forgets all spellings, mappings and matches; confirm it")
        for name in ("names", "genres", "matches", "fingerprint"):
            self.state[name].reset()
