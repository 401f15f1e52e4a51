"""The prefix trie of conversations, from sorted turn arrays and their common prefixes.

A turn becomes a token of 20 bytes (16 of the SHA-256 of its role and text, 4 of the text's
length), a conversation the bytes of its tokens, so bytes compare as turns do and no text is
moved. The distinct arrays are sorted globally by ranges; each task sweeps its arrays with a
stack: the common prefix with the array before (LCP) tells which nodes end and which begin, and
a node that ends gives its sums to its parent. Nodes on the path of a task's first array, and
those still open at its end, may go on in the tasks beside it: they are told as parts. The
stitch merges the parts of a node by its id and sweeps them once more, as they are a small trie
themselves, at most two paths a task. Parents' members and the ends are joined by node id.

Long conversations are cut into segments of ``SEGMENT`` turns, each keyed by all that goes
before it; the deepest segments are swept first and give their sums to the node that they
continue. A conversation's turns are never gathered: they are sorted by range too, and leave
the sort in chunks of at most ``SEGMENT`` turns. Equal arrays are one row before the sort. What
one task must see in order, as it goes into one digest, are the ids of a node's ends; they
arrive in blocks of ids, sorted, and are digested as they pass.

Defined cases: rows without a conversation take no part; turns without a number come first;
turns of one number are in the order of their tokens; repeated rows are turns of their own; a
null role or text is empty; equal roles and texts are equal turns, whatever their numbers; an
empty table gives no nodes; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.storage import materialize

#: Bytes of a token, and of them the digest's.
TOKEN = 20
DIGEST = 16
#: Turns of one array.
SEGMENT = 256
#: A conversation takes at most so many turns of another one.
SHARED = 8
#: Conversation ids in a block of a node's ends.
BLOCK = 256
#: Rows that a sweep passes on at once.
ROWS = 20_000

NODE, PART, TOTAL = 0, 1, 2
NODES = (
    "kind int, id binary, parent binary, depth long, low long, n long, bytes long, children long, leaves long, saved long, "
    "g1 long, g2 long, prefix binary"
)
NAMES = [c.split(" ")[0] for c in NODES.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]] for c in NODES.split(", ")]


def token(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.unhex(F.substring(digest, 1, 2 * DIGEST)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def _joined(parts: Column, name: str) -> Column:
    """The bytes of sorted structs' field ``name``, one after the other."""
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x[name]))


def _cut(tokens: Column, first: Column, n: Column) -> Column:
    """``n`` tokens from place ``first`` on."""
    return F.substring(tokens, (first * TOKEN + 1).cast("int"), (n * TOKEN).cast("int"))


def chunks(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, turn, token) -> (conv_id, part, no, n, tokens): the turns of each conversation
    in order, in chunks whose order is that of ``part`` and ``no``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, held, no, rows = None, [], 0, []
        names = ["conv_id", "part", "no", "n", "tokens"]

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)

        for batch in batches:
            for now, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != conv or len(held) == segment:
                    if held:
                        rows.append((conv, part, no, len(held), b"".join(held)))
                        no += 1
                    conv, held = now, []
                held.append(told)
            if len(rows) > ROWS:
                yield table()
                rows.clear()
        if held:
            rows.append((conv, part, no, len(held), b"".join(held)))
        if rows:
            yield table()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "token"]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "token")
    return sorted_.mapInArrow(run, "conv_id long, part int, no long, n long, tokens binary")


def rebuilt(pieces: DataFrame, segment: int, shares: Column, base: Column) -> DataFrame:
    """(conv_id, seg, arr): each conversation's segments, after its first turns, ``shares`` of
    them, have made room for as many of conversation ``base``, as far as that has them."""
    before = Window.partitionBy("conv_id").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    opening = F.struct("at", _cut(F.col("tokens"), F.lit(0), F.lit(SHARED) - F.col("at")).alias("t"))
    heads = placed.filter(F.col("at") < SHARED).groupBy("conv_id").agg(F.sort_array(F.collect_list(opening)).alias("head"))
    heads = heads.select("conv_id", _joined(F.col("head"), "t").alias("head"))
    asked = heads.select("conv_id", base.alias("base"), shares.alias("h"))
    given = asked.join(heads.select(F.col("conv_id").alias("base"), "head"), "base", "left")
    taken = F.coalesce(_cut(F.col("head"), F.lit(0), F.col("h")), F.lit(b""))
    given = given.select("conv_id", "h", taken.alias("taken"))
    met = placed.join(given, "conv_id")
    skip = F.greatest(F.lit(0), F.least(F.col("n"), F.col("h") - F.col("at")))
    own = _cut(F.col("tokens"), skip, F.col("n") - skip)
    start = F.octet_length("taken") / TOKEN + F.col("at") + skip - F.col("h")
    opens = F.col("at") == 0
    told = met.select(
        "conv_id",
        F.when(opens, F.lit(0)).otherwise(start).cast("long").alias("start"),
        F.when(opens, F.concat("taken", own)).otherwise(own).alias("bytes"),
        opens.alias("opens"),
    ).withColumn("size", (F.octet_length("bytes") / TOKEN).cast("long"))
    # A conversation without turns keeps its empty opening.
    told = told.filter("opens or size > 0")
    last = F.floor(F.greatest(F.col("start"), F.col("start") + F.col("size") - 1) / segment)
    parts = told.select("*", F.explode(F.sequence(F.floor(F.col("start") / segment), last)).alias("seg"))
    begins = F.greatest(F.col("start"), F.col("seg") * segment)
    part = F.struct("start", _cut(F.col("bytes"), begins - F.col("start"), (F.col("seg") + 1) * segment - begins).alias("t"))
    whole = parts.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("conv_id", "seg", _joined(F.col("parts"), "t").alias("arr"))


def header(seg: int, g1: int, g2: int) -> bytes:
    """What goes before a segment's tokens in the digests that name its nodes."""
    return f"{seg},{g1},{g2}|".encode()


def keyed(segments: DataFrame) -> DataFrame:
    """Segments with ``g1`` and ``g2``, of all segments before, ``id``, of the node where it
    ends, ``up``, that of the segment before, and whether it is its conversation's last."""
    order = Window.partitionBy("conv_id").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = segments.withColumn("sha", F.sha2("arr", 256))
    gone = lambda k: F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "seg", "sha")).over(before), F.lit(0))
    told = own.select("conv_id", "seg", "arr", gone(1).alias("g1"), gone(2).alias("g2"), F.lead("seg").over(order).isNull().alias("last"))
    head = F.concat(F.col("seg").cast("string"), F.lit(","), F.col("g1").cast("string"), F.lit(","), F.col("g2").cast("string"), F.lit("|"))
    name = F.unhex(F.substring(F.sha2(F.concat(head.cast("binary"), "arr"), 256), 1, 2 * DIGEST))
    told = told.withColumn("id", name)
    return told.withColumn("up", F.lag("id").over(order))


class _Frame:
    """A node that is open: its name, place and sums so far."""

    __slots__ = ("hash", "id", "parent", "depth", "low", "n", "bytes", "children", "leaves", "saved", "group", "prefix", "shared")

    def __init__(self, hash, id, parent, depth, size, group, prefix, shared):
        self.hash, self.id, self.parent, self.depth, self.bytes, self.group, self.prefix, self.shared = hash, id, parent, depth, size, group, prefix, shared
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0

    def add(self, low, n, children, leaves, saved):
        if low is not None and (self.low is None or low < self.low):
            self.low = low
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def row(self, kind, prefix=None):
        return (kind, self.id, self.parent, self.depth, self.low, self.n, self.bytes, self.children, self.leaves, self.saved, *self.group, prefix)

    def closed(self, above: _Frame | None, level: int):
        """The row of a node that has all its sums, which go to the node above."""
        if not self.children:
            self.leaves += 1
        self.saved += (self.n - 1) * self.bytes
        if above is not None:
            above.add(self.low, self.n, 1, self.leaves, self.saved)
        return self.row(TOTAL if level and not self.depth else NODE)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _table(held)
            held = []
    if held:
        yield _table(held)


def common(a: bytes, b: bytes) -> int:
    """Tokens at the beginning of both."""
    most = min(len(a), len(b)) // TOKEN
    if a[: most * TOKEN] == b[: most * TOKEN]:
        return most
    n = 0
    while a[n * TOKEN : (n + 1) * TOKEN] == b[n * TOKEN : (n + 1) * TOKEN]:
        n += 1
    return n


def sweep(arrays: Iterator[tuple], level: int) -> Iterator[tuple]:
    """Rows of nodes and parts from (g1, g2, arr, up, low, n, children, leaves, saved), sorted
    by the first three, which are distinct; the last three come from segments below."""
    stack: list[_Frame] = []
    group, before, opening = None, b"", True

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            yield node.row(PART, node.prefix) if node.shared else node.closed(stack[-1] if stack else None, level)

    for g1, g2, arr, up, low, n, *below in arrays:
        if (g1, g2) != group:
            yield from close(0)
            group, before = (g1, g2), b""
            start = hashlib.sha256(header(level, g1, g2))
            stack.append(_Frame(start, up if level else start.digest()[:DIGEST], None, 0, 0, group, b"", opening))
        kept = common(before, arr)
        yield from close(kept + 1)
        for depth in range(kept + 1, len(arr) // TOKEN + 1):
            above, one = stack[-1], arr[(depth - 1) * TOKEN : depth * TOKEN]
            name = above.hash.copy()
            name.update(one)
            stack.append(_Frame(name, name.digest()[:DIGEST], above.id, depth, int.from_bytes(one[DIGEST:], "big"), group, arr[: depth * TOKEN], opening))
        stack[-1].add(low, n, *below)
        before, opening = arr, False
    for node in stack:
        node.shared = True
    yield from close(0)


def stitch(parts: Iterator[tuple], level: int) -> Iterator[tuple]:
    """Rows of nodes from merged parts (id, parent, depth, low, n, bytes, children, leaves,
    saved, g1, g2, prefix), sorted by the last three: each node after the one above it."""
    stack: list[_Frame] = []
    for id, parent, depth, low, n, size, children, leaves, saved, g1, g2, prefix in parts:
        while stack and (stack[-1].group != (g1, g2) or stack[-1].depth >= depth):
            node = stack.pop()
            yield node.closed(stack[-1] if stack else None, level)
        stack.append(_Frame(None, id, parent, depth, size, (g1, g2), None, False))
        stack[-1].add(low, n, children, leaves, saved)
    while stack:
        node = stack.pop()
        yield node.closed(stack[-1] if stack else None, level)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def level_nodes(arrays: DataFrame, level: int) -> DataFrame:
    """The nodes of one level's segments, and the totals that the level above takes."""
    order = ["g1", "g2", "arr"]
    sorted_ = arrays.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = [*order, "up", "low", "n", "children", "leaves", "saved"]
    swept = materialize(sorted_.select(columns).mapInArrow(lambda b: _batched(sweep(_rows(b), level)), NODES), "trie-sweep")
    sums = [F.min("low").alias("low"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved"))]
    merged = swept.filter(F.col("kind") == PART).groupBy("id", "parent", "depth", "bytes", "g1", "g2", "prefix").agg(*sums)
    # The parts are two paths a task: one task sweeps them all.
    one = merged.select("id", "parent", "depth", "low", "n", "bytes", "children", "leaves", "saved", "g1", "g2", "prefix").coalesce(1)
    stitched = one.sortWithinPartitions("g1", "g2", "prefix").mapInArrow(lambda b: _batched(stitch(_rows(b), level)), NODES)
    whole = swept.filter(F.col("kind") != PART).unionByName(materialize(stitched, "trie-stitch"))
    return whole.drop("g1", "g2", "prefix")


def ends(segments: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes where conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, rows = None, None, []
        for batch in batches:
            for id, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if id != now:
                    if digest is not None:
                        rows.append((now, digest.hexdigest()))
                    now, digest = id, hashlib.sha256(listed.encode())
                else:
                    digest.update(b"," + listed.encode())
            if len(rows) > ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string()))], ["id", "ends_sha256"])
                rows = []
        if digest is not None:
            rows.append((now, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string()))], ["id", "ends_sha256"])

    blocks = segments.filter("last").groupBy("id", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    sorted_ = blocks.agg(listed.alias("ids")).repartition("id").sortWithinPartitions("id", "block")
    return sorted_.select("id", "ids").mapInArrow(run, "id binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    shares: Column | None = None,
    base: Column | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of every node.

    With ``shares`` and ``base``, columns of ``conv_id``, a conversation's first ``shares``
    turns (at most ``SHARED``) are replaced by those of conversation ``base``.
    """
    turns = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), token(F.col(role), F.col(text)).alias("token"))
    turns = materialize(turns.filter("conv_id is not null"), "turns")
    own = F.lit(0) if shares is None else F.least(shares, F.lit(SHARED))
    pieces = materialize(chunks(turns, segment), "turn-chunks")
    segments = materialize(keyed(rebuilt(pieces, segment, own, F.col("conv_id") if base is None else base)), "segments")
    sums = [F.count("*").alias("n"), F.min("conv_id").alias("low")]
    arrays = materialize(segments.groupBy("seg", "g1", "g2", "arr", "id", "up").agg(*sums), "arrays")
    deepest = arrays.agg(F.max("seg")).first()[0]
    below, levels = None, []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        rows = arrays.filter(F.col("seg") == level)
        if below is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            totals = below.filter(F.col("kind") == TOTAL).select("id", "children", "leaves", "saved")
            rows = rows.join(totals, "id", "left").na.fill(0, ["children", "leaves", "saved"])
        below = level_nodes(rows, level)
        levels.append(below.filter(F.col("kind") == NODE).withColumn("depth", F.col("depth") + level * segment))
    if not levels:
        kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return conversations.sparkSession.createDataFrame([], kinds)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    above = nodes.select(F.col("id").alias("parent"), F.col("low").alias("parent_conv_id"))
    met = nodes.join(above, "parent", "left").join(ends(segments), "id", "left")
    return met.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of the one whose id is
    divisible by five."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    shares = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return prefix_trie(conversations, shares, F.col("conv_id") - F.col("conv_id") % 5)


ORACLE = """
WITH t AS (
  SELECT conv_id, list(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS toks,
    list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS sizes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
      lambda d, k: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 9 AS h FROM t
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.toks[1:a.h], []), a.toks[a.h + 1:]) AS toks, list_concat(coalesce(b.sizes[1:a.h], []), a.sizes[a.h + 1:]) AS sizes
  FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5
), m AS (
  SELECT conv_id, d, len(toks) = d AS ends, md5(d || array_to_string(toks[1:d], ',')) AS node,
    CASE WHEN d > 0 THEN md5((d - 1) || array_to_string(toks[1:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(toks) + 1)) AS d FROM r)
), n AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY node
), k AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN (SELECT parent, count(*) AS n FROM n GROUP BY parent) c ON c.parent = n.node
), s AS (
  SELECT m.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * k.size) AS saved_tokens
  FROM k JOIN m ON m.conv_id = k.conv_id AND m.d <= k.depth GROUP BY m.node
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (node) LEFT JOIN k p ON p.node = k.parent
"""
