"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; together they
get a share of all words, none more than ``max_repeats`` times its own words, and what is
above that bound is shared again by weight (water filling, solved in closed form over the
sources sorted by bound per weight).

Schedule: slot ``i`` has the golden-ratio point ``frac(i * 0.618...)`` in 31-bit integer
arithmetic. The point falls into one source's stretch of the cumulative targets; the slot
takes that source's next block, so the rank of a slot among its source's is the number of
the block. A source's documents are shuffled by a seeded digest, laid end to end and cut into
equal blocks of words, going round again where the target exceeds the source. There are as
many slots as blocks make up the words of all targets, and what a source gives is what its
slots take: the sequence has a discrepancy of about a block, at the end and in every prefix,
so the words taken come within a few blocks of the target. Slots past ``max_repeats`` rounds
of a source stay empty. Blocks are of ``block_words`` words, or shorter where the mix would
have fewer than ``LEAST_SLOTS`` of them, so small mixes come as near to their targets.

Scale: a source may hold any share of the rows. Running sums and ranks within a source are
two-level (a bucket's total, then places within the bucket), with about the square root of
the rows in each bucket, so no source meets in one task. The only windows without a
partition run over one row per source. Only DataFrame functions are used.

Defined cases: null or empty text has size 0 and is never taken; null ids are shuffled by
their texts; ties of a digest go by id, then size; repeated rows are rows of their own, which
a window over equal id and text tells apart; very long texts fill many blocks and are taken
in parts by ``mix``; a source without words has target 0; an empty table gives an empty
result; extra columns are not carried by ``mix`` and are, whatever their names, by
``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.text import words
from bindery.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 64
LEAST_SLOTS = 1 << 18
SEED = "mix-1"
#: Points are integers below 2**31; the step is 2**31 over the golden ratio, made odd.
BITS = 31
STEP = 1327217885
#: Cells that map a point to the few sources whose stretch meets it, at least so many bits.
CELL_BITS = 12


def targets(
    sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, ...) -> also sid (0 up, by code point, null last) and target."""
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))))
    bound = (F.col("source_size") * max_repeats).cast("double")
    rows = ranked.withColumns({"weight": weight.cast("double"), "bound": bound})
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "sid")
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    levelled = rows.withColumn("level", level).withColumn("full", F.col("bound") <= F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levelled.withColumn("open", open_level).select(
        *sources.columns,
        "sid",
        F.when(F.col("full"), F.col("bound")).otherwise(F.col("open") * F.col("weight")).alias("target"),
    )


def _digest(doc_id: Column, text: Column, seed: str) -> Column:
    own = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(F.concat_ws("/", F.lit(seed), own).cast("binary"))


def stream_order(sized: DataFrame, buckets: int) -> DataFrame:
    """(sid, digest, doc_id, size) -> also bucket, rn (place in the bucket) and start (words
    of the source before the document)."""
    keyed = sized.withColumn(
        "bucket",
        F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32),
    )
    totals = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "bucket").orderBy("digest", "doc_id", "size")
    return (
        keyed.join(offsets, ["sid", "bucket"])
        .withColumn("rn", F.row_number().over(within))
        .withColumn(
            "start",
            F.col("offset")
            + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("digest", "offset")
    )


def block_size(total: int, most: int = BLOCK_WORDS) -> int:
    """Words of a block in a mix of ``total`` words."""
    return max(1, min(most, total // LEAST_SLOTS))


def schedule(quotas: DataFrame, slots: int, step: int = STEP) -> DataFrame:
    """(sid, quota in words) -> (sid, block, slot): the source of each of ``slots`` slots, and
    the slot's rank among those of its source. Quotas are of a few words to any number."""
    spark = quotas.sparkSession
    total = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("quota").over(Window.orderBy("sid"))
    point = lambda x: F.floor(x / total * float(1 << BITS)).cast("long")
    stretches = (
        quotas.filter("quota > 0")
        .select("sid", point(upto - F.col("quota")).alias("lo"), point(upto).alias("hi"))
        .filter("hi > lo")
    )
    shift = BITS - min(BITS, max(CELL_BITS, quotas.count().bit_length()))
    cells = stretches.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    mask = (1 << BITS) - 1
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id").bitwiseAND(F.lit(mask)) * F.lit(step)).bitwiseAND(F.lit(mask))).alias("u")
    )
    chunk = max(1024, math.isqrt(max(slots, 1)))
    drawn = (
        points.withColumn("cell", F.shiftright("u", shift))
        .join(cells, "cell")
        .filter("u >= lo AND u < hi")
        .select("sid", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    )
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return drawn.join(bases, ["sid", "chunk"]).select("sid", (F.col("base") + rank).alias("block"), "slot")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = SHARE,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
    step: int = STEP,
) -> DataFrame:
    """Per row: doc_id, row (hash of its text), size, source_size, target, and ``turns``, for
    each round of its source that takes any of it a struct of ``words`` taken and the ``slot``
    that takes the first of them; ``taken`` is the sum of words, ``slot`` the first slot."""
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(text).alias("row"),
            _digest(F.col(doc_id), F.col(text), seed).alias("digest"),
            F.col(source).alias("source"),
            F.size(words(F.col(text))).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = materialize(targets(per_source, share, weights, max_repeats), "mix-targets")
    quotas = goal.select("sid", F.floor("target").alias("quota"))
    rows, total = goal.agg(F.sum("n"), F.sum(F.floor("target"))).first()
    block = block_size(total or 0, block_words)
    slots = materialize(schedule(quotas, -(-(total or 0) // block), step), "mix-slots")
    drawn = goal.join(slots.groupBy("sid").agg(F.count("*").alias("blocks")), "sid", "left")
    reach = F.least(F.coalesce("blocks", F.lit(0)) * block, F.col("source_size") * max_repeats)
    known = sized.join(
        drawn.select("source", "sid", "source_size", "target", reach.alias("reach")),
        sized["source"].eqNullSafe(drawn["source"]),
    ).drop("source")
    placed = stream_order(known, max(1, math.isqrt(rows or 0)))
    rounds = F.transform(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)),
        lambda e: F.struct(
            (F.col("start") + e * F.col("source_size")).alias("a"),
            F.least(F.col("start") + e * F.col("source_size") + F.col("size"), F.col("reach")).alias("b"),
        ),
    )
    # A document that gets nothing keeps one row, on a block that no slot has.
    nothing = F.array(F.struct((F.lit(-block) * (1 + F.pmod("start", F.lit(1024)))).alias("a"), F.lit(None).cast("long").alias("b")))
    taken = F.filter(rounds, lambda x: x["b"] > x["a"])
    carried = ["doc_id", "row", "size", "source_size", "target"]
    parts = placed.select("sid", "bucket", "rn", *carried, F.explode(F.when(F.size(taken) > 0, taken).otherwise(nothing)).alias("x"))
    met = parts.withColumn("block", F.floor(F.col("x.a") / block)).join(slots, ["sid", "block"], "left")
    turn = F.when(F.col("x.b").isNotNull(), F.struct("slot", (F.col("x.b") - F.col("x.a")).alias("words")))
    return (
        met.groupBy("sid", "bucket", "rn", *carried)
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(
            *carried,
            "turns",
            F.aggregate("turns", F.lit(0).cast("long"), lambda x, y: x + y["words"]).alias("taken"),
            F.get("turns", 0)["slot"].alias("slot"),
        )
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as whole documents, with the input's columns, in the order of their slots: a
    copy for each turn that takes at least half of a document's words, so each source is
    within half a document of its target for each turn.

    Rows of one id and text are as many as the mix has lists of turns for; equal rows of them
    are counted, not numbered: the lists are dealt to the counts in their order, and a text is
    moved once for all rows that equal it."""
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    wanted = mix(docs, doc_id, text, source).select(
        key(F.col("doc_id")).alias("key"),
        "row",
        F.transform(F.filter("turns", lambda t: 2 * t["words"] >= F.col("size")), lambda t: t["slot"]).alias("slots"),
    )
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("in"), key(F.col(doc_id)).alias("key"), F.xxhash64(text).alias("row")
    ).withColumn("kind", F.xxhash64("in"))
    of = Window.partitionBy("key", "row")
    kinds = own.groupBy("key", "row", "kind").agg(F.count("*").alias("n"))
    first = kinds.select("key", "row", "kind", (F.sum("n").over(of.orderBy("kind")) - F.col("n") + 1).alias("at"))
    lists = wanted.filter(F.size("slots") > 0).withColumn("at", F.row_number().over(of.orderBy("slots")).cast("long"))
    dealt = lists.withColumn("kind", F.lit(None).cast("long")).unionByName(first.withColumn("slots", F.array().cast("array<long>")))
    # The kind that begins last at or before a list's place; kinds come before lists of their place.
    last = of.orderBy("at", F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    copies = dealt.withColumn("kind", F.last("kind", ignorenulls=True).over(last)).select("key", "row", "kind", F.explode("slots").alias("slot"))
    texts = own.groupBy("key", "row", "kind").agg(F.first("in").alias("in"))
    return copies.join(texts, ["key", "row", "kind"]).select("slot", "in").orderBy("slot").select("in.*")


def op4_source_mix(spark, sf_dir) -> DataFrame:
    """Words that the mix takes from each document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "slot"
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{SEED}/' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(sid % 3) + 1] AS weight, (2 * source_size)::DOUBLE AS bound FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, sid, source_size, CASE WHEN bound <= level * weight THEN bound
    ELSE max(CASE WHEN NOT bound <= level * weight THEN level END) OVER () * weight END AS target FROM l
), q AS (
  SELECT sid, floor(target)::BIGINT AS quota, (sum(floor(target)) OVER ())::BIGINT AS total, (sum(floor(target)) OVER (ORDER BY sid))::BIGINT AS upto FROM t
), b AS (
  SELECT greatest(1, least({BLOCK_WORDS}, max(total) // {LEAST_SLOTS}))::BIGINT AS block, max(total) AS total FROM q
), p AS (
  SELECT slot, ((slot & {(1 << BITS) - 1}) * {STEP}) & {(1 << BITS) - 1} AS u
  FROM (SELECT unnest(range((total + block - 1) // block)) AS slot FROM b)
), g AS (
  SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM p JOIN q
    ON quota > 0 AND u >= floor((upto - quota) / total * {1 << BITS}) AND u < floor(upto / total * {1 << BITS})
), n AS (
  SELECT t.*, least(2 * source_size, coalesce(blocks, 0) * block) AS reach, block
  FROM t CROSS JOIN b LEFT JOIN (SELECT sid, count(*) AS blocks FROM g GROUP BY sid) USING (sid)
), o AS (
  SELECT d.doc_id, d.size, n.*,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS a
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
), e AS (
  SELECT *, greatest(0, least(a + size, reach) - a) AS one, greatest(0, least(a + size + source_size, reach) - a - source_size) AS two FROM o
)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, slot
FROM e LEFT JOIN g ON e.sid = g.sid AND one > 0 AND g.k = e.a // block
"""
