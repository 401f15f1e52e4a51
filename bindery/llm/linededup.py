"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends and with A-Z lower-cased; its hash is
two independent 64-bit values (128 bits, so that keys of a whole corpus stay apart).
``LineRuns`` keeps what was seen as sorted runs of (hash, documents, keeper). A new batch is
merge-joined with the runs: its hashes that no run has (the anti-join) are fresh, and only
they name a keeper, the largest document of the batch that holds the line; for known hashes
the batch adds its documents alone. The batch becomes a run of level 0; when a level holds
``fanout`` runs they are merged into one sorted run of the next level, so a hash lies in at
most ``fanout * levels`` runs. A small manifest names the runs that count; while it is replaced
its successor stands beside it, so an interrupted call leaves either the runs as they were or
those with its batch, and a later call or session goes on from them.

``dedup_lines`` deals its documents into batches by falling ids, adds them to the runs, and
drops, from each document, the lines found in at least ``min_docs`` documents unless it is
their keeper: the largest document, or, where earlier calls left their runs, the one that
these kept it in. Only DataFrame functions are used. Hashes, not texts, are shuffled for
counting; a line found in a third of all documents is pre-aggregated before its shuffle. The
texts are shuffled once, by row, and are neither sorted nor held: they stream past a hash
table of the places to drop, and adaptive execution splits a hot partition of them.

Defined cases: null or empty text is one empty line; a null id counts as one document
below every other id; rows with equal ids are one document for counting and each row keeps
its own lines; repeated lines of one document count once; ties are lines of one key, all of
which stay in the keeper; long texts are read whole, one at a time; an empty table gives an
empty result; all columns of the input are carried, whatever their names, and counts are
added only under names that the caller gives.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.text import BLANKS, ascii_lower, lines
from bindery.storage import discard, materialize, read_text, remove, shared_dir, write_text

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 3
#: Stands for a null id: below every other.
NO_ID = -(2**63)
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, keeper) below a shared folder.

    ``keeper`` is null in rows that only add documents to a hash of an earlier run, so over
    all runs each hash has it once.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.root = root or shared_dir(spark, "line-runs")
        self.fanout = fanout
        known = (read_text(spark, self._manifest) or read_text(spark, self._successor)) if root else None
        state = json.loads(known) if known else {"written": 0, "levels": {}}
        self.written: int = state["written"]
        self.levels: dict[int, list[str]] = {int(k): v for k, v in state["levels"].items()}

    @property
    def _manifest(self) -> str:
        return f"{self.root}/manifest.json"

    @property
    def _successor(self) -> str:
        return f"{self.root}/manifest-next.json"

    def _commit(self) -> None:
        """Name the runs that count: at each moment one of both files is whole."""
        told = json.dumps({"written": self.written, "levels": self.levels})
        for path in (self._successor, self._manifest):
            remove(self.spark, path)
            write_text(self.spark, path, told)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(*paths)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.root}/level-{level}/run-{self.written}"
        self.written += 1
        run.sortWithinPartitions(*HASH).write.mode("overwrite").parquet(path)
        self.levels.setdefault(level, []).append(path)

    @property
    def paths(self) -> list[str]:
        return [path for level in sorted(self.levels) for path in self.levels[level]]

    def add(self, batch: DataFrame) -> None:
        """Add (h1, h2, doc_id): a row per hash and document, of documents not added before."""
        counted = batch.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))
        fresh = F.lit(True)
        if self.paths:
            known = self._read(self.paths).filter("keeper IS NOT NULL").select(*HASH, F.lit(True).alias("known"))
            counted, fresh = counted.join(known, HASH, "left"), F.col("known").isNull()
        self._write(counted.select(*HASH, "n_docs", F.when(fresh, F.col("largest")).alias("keeper")), 0)
        merged = self._compact()
        self._commit()
        for path in merged:
            remove(self.spark, path)

    def _compact(self) -> list[str]:
        """Merge levels that are full; the runs that no longer count."""
        level, merged = 0, []
        while len(self.levels.get(level, [])) >= self.fanout:
            paths = self.levels.pop(level)
            level += 1
            self._write(self._merged(paths), level)
            merged += paths
        return merged

    def _merged(self, paths: list[str]) -> DataFrame:
        sums = F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")
        return self._read(paths).groupBy(*HASH).agg(*sums)

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) over all runs, a row for each hash."""
        return self._read(self.paths) if len(self.paths) == 1 else self._merged(self.paths)


def long_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key has ``min_chars`` code points.

    ``row`` is a hash of the text: with the id it names a row, copies of a row sharing it.
    """
    placed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("row"),
        F.posexplode(F.transform(lines(F.col(text)), line_key)).alias("pos", "key"),
    )
    return placed.filter(F.length("key") >= min_chars).select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


def _falling(placed: DataFrame, batches: int) -> list[Column]:
    """Conditions on ``doc_id`` that part the rows into batches of about equal size, the
    largest ids first."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = placed.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"] if shares else []
    edges = list(dict.fromkeys(cuts or []))
    above = [F.col("doc_id") > edge for edge in edges] + [F.lit(True)]
    below = [F.lit(True)] + [F.col("doc_id") <= edge for edge in edges]
    return [a & b for a, b in zip(above, below)]


def dropped_places(
    docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int, batches: int, runs: LineRuns
) -> DataFrame:
    """(doc_id, row, drop): the places of the lines that go, of documents that lose any."""
    placed = materialize(long_lines(docs, doc_id, text, min_chars), "lines")
    for chosen in _falling(placed, batches):
        runs.add(placed.filter(chosen).select("doc_id", *HASH).distinct())
    common = runs.totals().filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper")
    dropped = materialize(
        placed.join(common, HASH)
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("pos")).alias("drop")),
        "dropped-lines",
    )
    discard(placed)
    return dropped


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    runs: LineRuns | None = None,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The input with its texts cut. ``counts`` names two more columns (long), the lines of a
    text before and how many of them went; names of the input are refused. ``runs`` are those
    of earlier calls, whose lines count as seen; without them the call starts afresh."""
    own = docs.columns
    if clash := {c.lower() for c in counts or ()} & {c.lower() for c in own}:
        raise ValueError(f"columns of the input: {sorted(clash)}")
    fresh = runs is None
    runs = runs or LineRuns(docs.sparkSession)
    dropped = dropped_places(docs, doc_id, text, min_chars, min_docs, batches, runs)
    if fresh:
        remove(docs.sparkSession, runs.root)
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("in"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("row"),
    )
    met = keyed.join(dropped.hint("shuffle_hash"), ["doc_id", "row"], "left").select(
        "in", lines(F.col("in")[text]).alias("l"), F.coalesce("drop", F.array().cast("array<int>")).alias("d")
    )
    # The lines between two dropped places, one slice each: linear however many are dropped.
    between = F.transform(
        F.sequence(F.lit(0), F.size("d")),
        lambda j: F.slice(
            F.col("l"),
            F.coalesce(F.get("d", j - 1), F.lit(-1)) + 2,
            F.coalesce(F.get("d", j), F.size("l")) - F.coalesce(F.get("d", j - 1), F.lit(-1)) - 1,
        ),
    )
    cut = F.when(F.size("d") == 0, F.col("in")[text]).otherwise(F.array_join(F.flatten(between), "\n"))
    told = [F.size(c).cast("long").alias(name) for c, name in zip(("l", "d"), counts or ())]
    return met.select(*(cut.alias(c) if c == text else F.col("in")[c].alias(c) for c in own), *told)


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    """Lines of all documents, with those found in five documents or more kept once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return cut.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p
),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
