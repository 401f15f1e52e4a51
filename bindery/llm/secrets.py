"""Secret scanning with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds
the (blob, rule version) pairs that were scanned and their findings; a scan takes only
pairs that the ledger lacks, so copies, and versions that come back, are scanned once.
Findings are joined back to all paths by content address.

Spans come from native regular expressions: splitting at a pattern gives the gaps, its
matches give the hits, and running lengths of both, summed in chunks and then over chunks,
give the places in code points. Each pattern is leftmost and non-overlapping. Cheap patterns
guard the costly ones. No Python runs on rows.

Defined cases: a null text is empty; a null path passes through; equal rows give equal
findings; spans with equal starts are ordered by kind; very long texts are scanned whole, in
time about linear in their hits; an empty table gives an empty result; extra columns are not
carried.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.text import let
from bindery.storage import materialize

#: Hits whose places are summed at once.
CHUNK = 256


@dataclass(frozen=True)
class Secret:
    """A kind: what guards it, its pattern, and the group whose length must reach a bound."""

    kind: str
    guard: str
    pattern: str
    group: int
    at_least: int


#: In the order that breaks ties of equal starts. The first three are the base kinds.
KINDS: tuple[Secret, ...] = (
    Secret(
        "assign",
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Secret("access", r"AKIA[A-Z0-9]{14}", r"AKIA[A-Z0-9]+", 0, 18),
    Secret("hex", r"[0-9a-f]{16}", r"[0-9a-f]+", 0, 16),
    Secret("pem", r"-----BEGIN ", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Secret("forge", r"gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Secret("jwt", r"eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
BASE = 3
SPAN = "struct<start:int,kind:int,end:int>"


def rules_version(rules: tuple[Secret, ...] = KINDS) -> int:
    """A number that changes with any rule, so that what a changed rule set would find is
    never taken from an older scan."""
    return zlib.crc32(repr(rules).encode()) >> 1


BLOB_RULES_VERSION = rules_version()


def _spans(text: Column, order: int, rule: Secret) -> Column:
    """The spans of one kind, in order."""
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    told = hits if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    sizes = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), told.alias("told")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["told"]).alias("told")
        ),
    )
    found = let(sizes, lambda own: let(_walked(own, order, rule.at_least), _placed))
    return F.when(text.rlike(rule.guard), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _walked(sizes: Column, order: int, at_least: int) -> Column:
    """For each chunk of gaps and hits: struct(at, its length; found, its spans from its start)."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
        F.when(
            x["told"] >= at_least,
            F.concat(
                acc["found"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"),
                        F.lit(order).alias("kind"),
                        (acc["at"] + x["gap"] + x["hit"]).alias("end"),
                    )
                ),
            ),
        )
        .otherwise(acc["found"])
        .alias("found"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(CHUNK)),
        lambda first: F.aggregate(F.slice(sizes, first, F.lit(CHUNK)), start, step),
    )


def _placed(chunks: Column) -> Column:
    """The spans of all chunks, moved by what comes before."""
    ends = F.aggregate(
        chunks,
        F.array(F.lit(0)),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])),
    )
    return let(
        ends,
        lambda before: F.flatten(
            F.transform(
                chunks,
                lambda c, k: F.transform(
                    c["found"],
                    lambda s: F.struct(
                        (s["start"] + F.get(before, k)).alias("start"), s["kind"].alias("kind"), (s["end"] + F.get(before, k)).alias("end")
                    ),
                ),
            )
        ),
    )


def blobs_of(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, content) of every version."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("content"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=KINDS, version: int = BLOB_RULES_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs that ``ledger`` lacks at
    this rule version. ``versions`` is (path, blob, content)."""
    unseen = versions.select("blob", "content").dropDuplicates(["blob"])
    if ledger is not None:
        done = ledger.filter(F.col("rule_version") == version).select("blob")
        unseen = versions.select("blob", "content").join(done, "blob", "left_anti").dropDuplicates(["blob"])
    found = F.array_sort(F.concat(*(_spans(F.col("content"), k, rule) for k, rule in enumerate(rules))))
    return unseen.select("blob", F.lit(version).alias("rule_version"), found.alias("spans"))


def findings(paths: DataFrame, ledger: DataFrame, version: int = BLOB_RULES_VERSION) -> DataFrame:
    """(path, blob, spans) of every path; an empty list where nothing was found."""
    found = ledger.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(found, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")
    )


def _written(spans: Column, rules=KINDS) -> Column:
    names = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def op9_secret_scans(spark, sf_dir) -> DataFrame:
    """Spans of secrets in all documents."""
    versions = blobs_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ledger = materialize(scan(versions), "secret-ledger")
    spans = findings(versions.select("path", "blob"), ledger)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        F.col("path").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def secret_ledger_rounds(spark, sf_dir) -> DataFrame:
    """Two rounds over one ledger: all documents, then all documents again with all turns of
    conversations as further versions, of which only unseen texts are scanned. A row for
    each path of the second round: its spans, and whether its text was new to that round."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat(F.lit("conv/"), "conv_id", F.lit("/"), "turn").alias("path"), "text"
    )
    first = materialize(scan(blobs_of(docs, "path")), "secret-ledger")
    versions = blobs_of(docs.unionByName(turns), "path")
    second = materialize(scan(versions, first).withColumn("fresh", F.lit(True)), "secret-ledger")
    ledger = first.withColumn("fresh", F.lit(False)).unionByName(second)
    return (
        versions.select("path", "blob")
        .join(ledger, "blob")
        .select("path", "fresh", F.size("spans").cast("long").alias("n_spans"), _written(F.col("spans")).alias("spans"))
    )


def _oracle(source: str = "documents") -> str:
    parts = []
    for k, rule in enumerate(KINDS):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""
  SELECT rid, {k} AS kind, '{rule.kind}' AS name, at_ AS s, at_ + length(hit) AS e, length(told) >= {rule.at_least} AS ok FROM (
    SELECT rid, hit, told, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
    FROM (
      SELECT rid, unnest(range(len(hits))) AS pos, unnest(hits) AS hit, unnest(tolds) AS told, unnest(gaps[1:len(hits)]) AS gap FROM (
        SELECT rid, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS tolds,
          string_split_regex(t, '{pattern}') AS gaps FROM d
      ) WHERE len(hits) > 0
    ) WINDOW w AS (PARTITION BY rid ORDER BY pos)
  )"""
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
f AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0)::BIGINT AS a, count(*) FILTER (WHERE kind = 1)::BIGINT AS b,
    count(*) FILTER (WHERE kind = 2)::BIGINT AS c,
    string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans,
    string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base
  FROM f WHERE ok GROUP BY rid
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.rid = g.rid
"""


ORACLE = _oracle()

_BOTH = """(SELECT 'doc/' || doc_id AS doc_id, text FROM documents
  UNION ALL SELECT 'conv/' || conv_id || '/' || turn, text FROM conversations) both_tables"""
ROUNDS_ORACLE = f"""
WITH r AS ({_oracle(_BOTH)}),
v AS (
  SELECT 'doc/' || doc_id AS path, FALSE AS fresh FROM documents
  UNION ALL SELECT 'conv/' || conv_id || '/' || turn, NOT EXISTS (SELECT 1 FROM documents x WHERE coalesce(x.text, '') = coalesce(c.text, '')) FROM conversations c
)
SELECT path, fresh, coalesce(len(string_split(nullif(spans, ''), ',')), 0)::BIGINT AS n_spans, spans
FROM r JOIN v ON r.doc_id = v.path
"""
