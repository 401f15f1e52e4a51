"""Hard negatives by bit-sliced integer products.

Vectors become integers (``floor(scale * x)``). A block of rows is cut into bit-planes: plane
``b`` holds bit ``b`` of every component, less the component's least value in the block. The
inner products of the rows with an anchor are summed plane by plane from the most significant
one: after each plane a row's score lies in an interval whose width is what the planes below
can still add, the same for all rows of an anchor. Rows whose interval cannot qualify any more
are dropped before the next plane, so few rows see the low planes, and those that see the last
one have their exact score.

Two searches, each over the grid of row blocks and anchor chunks. The first finds an anchor's
positives, the best ``positives`` rows of its own label; a row is dropped when its upper end is
below the k-th best lower end. The second knows the positives' scores and finds, for each, the
best rows of other labels within ``[floor_percent, 100]`` percent of that score; a row is
dropped when its interval lies outside all windows or below the k-th best of the rows that are
certainly within. Blocks of the grid are equality groups of bounded size; each gives at most k
rows for an anchor or an anchor and positive, which a ranked window merges. Nothing is
broadcast, and a group is computed again alone if an executor is lost.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or
non-finite component, take no part; each row is an anchor or a candidate of its own, also where
ids repeat, but no row meets rows of the anchor's own id; ties go to the smaller id, then to
either row; shorter vectors are as if filled with zeros; an anchor without positives, or a
positive without negatives, gives no rows; a negative score has an empty window; scores outside
a long are cut to its range when they are returned and when rows are ranked; an empty table
gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.topk import _integers, _scores
from bindery.storage import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least so much of the positive's, in hundredths.
FLOOR_PERCENT = 80
#: Rows whose planes are multiplied at once; a block is a multiple.
CHUNK_ROWS = 8192
#: Anchors that are multiplied at once.
CHUNK_ANCHORS = 128
MAX_BLOCK = 65536
MAX_ANCHORS = 4096
#: Where no more of the pairs are left, the rows left are taken out of the planes.
FEW = 0.05

#: (lower ends, upper ends, alive, anchors) -> alive, of a (rows, anchors) matrix.
Drop = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Planes:
    """The bit-planes of a block's rows, most significant first."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.rows, self.dim = values.shape
        self.least = values.min(axis=0) if self.rows else np.zeros(self.dim, np.int64)
        rest = values - self.least
        top = int(rest.max()).bit_length() if rest.size else 0
        self.planes = [] if values.dtype == object else [(b, ((rest >> b) & 1).astype(np.float32)) for b in range(top - 1, -1, -1)]

    def exact(self, anchors: np.ndarray) -> bool:
        """Whether all partial sums are whole in the floating-point numbers that are used."""
        if self.values.dtype == object or anchors.dtype == object:
            return False
        widest = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0))
        span = float(2 ** (self.planes[0][0] + 1)) if self.planes else 1.0
        return widest * (span + float(np.abs(self.least.astype(np.float64)).max(initial=0))) < 2**52

    def survivors(self, anchors: np.ndarray, alive: np.ndarray, drop: Drop) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact scores) of each anchor that ``drop`` leaves of ``alive``."""
        dim = min(self.dim, anchors.shape[1])
        anchors = anchors[:, :dim]
        if not self.exact(anchors):
            found = [np.flatnonzero(alive[:, i]) for i in range(len(anchors))]
            return [(rows, _scores(self.values[rows], a)) for rows, a in zip(found, anchors)]
        told = anchors.astype(np.float64)
        above, below = np.maximum(told, 0).sum(axis=1), np.minimum(told, 0).sum(axis=1)
        narrow = np.float32 if np.abs(told).sum(axis=1).max(initial=0) < 2**24 else np.float64
        turned = np.ascontiguousarray(told.T, dtype=narrow)
        part = np.tile(told @ self.least[:dim].astype(np.float64), (self.rows, 1))
        at = 0
        while at < len(self.planes):
            bit, plane = self.planes[at]
            part += (plane[:, :dim].astype(narrow, copy=False) @ turned) * float(2**bit)
            at, rest = at + 1, 2**bit - 1
            alive = drop(part + below * rest, part + above * rest, alive, np.arange(len(anchors)))
            if alive.mean() < FEW:
                break
        out = []
        for i in range(len(anchors)):
            rows = np.flatnonzero(alive[:, i])
            score = part[rows, i]
            for bit, plane in self.planes[at:]:
                score = score + (plane[rows, :dim].astype(narrow, copy=False) @ turned[:, i]).astype(np.float64) * float(2**bit)
                rest = 2**bit - 1
                kept = drop((score + below[i] * rest)[:, None], (score + above[i] * rest)[:, None], np.ones((len(rows), 1), bool), np.array([i]))[:, 0]
                rows, score = rows[kept], score[kept]
            out.append((rows, score.astype(np.int64)))
        return out


def _kth(low: np.ndarray, counted: np.ndarray, k: int) -> np.ndarray:
    """Of each column the k-th largest of the values that count; minus infinity for fewer."""
    if len(low) < k:
        return np.full(low.shape[1], -np.inf)
    return np.partition(np.where(counted, low, -np.inf), len(low) - k, axis=0)[len(low) - k]


def best_of_label(k: int, known: np.ndarray) -> Drop:
    """Drops what is below the k-th best lower end or the k-th best score that is ``known``."""

    def drop(low, high, alive, anchors):
        return alive & (high >= np.maximum(_kth(low, alive, k), known[anchors]))

    return drop


def within_windows(k: int, floors: np.ndarray, tops: np.ndarray, known: np.ndarray) -> Drop:
    """Drops what can't be among the k best of any of an anchor's windows [floor, top]; the
    arrays are (anchors, windows)."""

    def drop(low, high, alive, anchors):
        left = np.zeros_like(alive)
        for j in range(floors.shape[1]):
            floor, top = floors[anchors, j], tops[anchors, j]
            sure = alive & (low >= floor) & (high <= top)
            bar = np.maximum(np.maximum(_kth(low, sure, k), known[anchors, j]), floor)
            left |= (high >= bar) & (low <= top)
        return alive & left

    return drop


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _table(schema: list[tuple[str, list]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for n, v in schema})


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the first."""
    return np.argsort(-score, kind="stable")[:k]


class _Block:
    """A block's rows in the order of their ids, and a chunk of anchors."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, scale: int):
        ids = _column(rows, "vec_id")
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], _column(rows, "label")[order]
        self.values = _integers(rows.column("embedding"), scale)[order]
        self.anchor_ids, self.anchor_labels, self.anchor_rows = (_column(anchors, n) for n in ("anchor_id", "anchor_label", "anchor"))
        self.anchors = _integers(anchors.column("vector"), scale)

    def parts(self, by_label: bool):
        """(planes, row places, anchor places): with ``by_label`` rows only meet anchors of
        their own label, else all do."""
        for label in np.unique(self.anchor_labels) if by_label else [None]:
            rows = np.flatnonzero(self.labels == label) if by_label else np.arange(len(self.ids))
            asked = np.flatnonzero(self.anchor_labels == label) if by_label else np.arange(len(self.anchor_ids))
            for a in range(0, len(rows), CHUNK_ROWS):
                some = rows[a : a + CHUNK_ROWS]
                planes = Planes(self.values[some])
                for b in range(0, len(asked), CHUNK_ANCHORS):
                    yield planes, some, asked[b : b + CHUNK_ANCHORS]


def positives_of_block(anchors: pa.Table, rows: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best rows of a block for each anchor of a chunk, among those of its label."""
    names = ["anchor", "positive_id", "positive_score"]
    if not (anchors.num_rows and rows.num_rows):
        return _table([(n, []) for n in names])
    block = _Block(anchors, rows, scale)
    best: list[list] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in block.anchor_ids]
    known = np.full(len(best), -np.inf)
    for planes, some, asked in block.parts(True):
        alive = block.ids[some][:, None] != block.anchor_ids[asked][None]
        drop = best_of_label(k, known[asked])
        for i, (found, score) in zip(asked, planes.survivors(block.anchors[asked], alive, drop)):
            ids = np.concatenate([best[i][0], block.ids[some][found]])
            score = np.concatenate([best[i][1], score])
            top = _best(score, k)
            best[i] = [ids[top], score[top]]
            if len(top) == k:
                known[i] = score[top[-1]]
    sizes = [len(b[0]) for b in best]
    return _table(list(zip(names, ([np.repeat(block.anchor_rows, sizes)], [b[0] for b in best], [b[1] for b in best]))))


def negatives_of_block(anchors: pa.Table, rows: pa.Table, k: int, scale: int, percent: int) -> pa.Table:
    """For each positive of each anchor of a chunk the k best rows of a block of other labels
    within the positive's window; ``scores`` of an anchor lists its positives' scores by place."""
    names = ["anchor", "place", "negative_id", "negative_score"]
    if not (anchors.num_rows and rows.num_rows):
        return _table([(n, []) for n in names])
    block = _Block(anchors, rows, scale)
    told = anchors.column("scores").to_pylist()
    width = max(map(len, told))
    # No score is in a window that is not there.
    tops = np.array([t + [-1] * (width - len(t)) for t in told], dtype=object)
    floors = np.array([[-(-percent * s // 100) if s >= 0 else 0 for s in row] for row in tops], dtype=object)
    loose = lambda x: x.astype(np.float64)
    known = np.full(tops.shape, -np.inf)
    best = {(i, j): [np.zeros(0, np.int64), np.zeros(0, np.int64)] for i in range(len(told)) for j in range(len(told[i]))}
    for planes, some, asked in block.parts(False):
        alive = block.labels[some][:, None] != block.anchor_labels[asked][None]
        alive &= block.ids[some][:, None] != block.anchor_ids[asked][None]
        drop = within_windows(k, loose(floors[asked]), loose(tops[asked]), known[asked])
        for i, (found, score) in zip(asked, planes.survivors(block.anchors[asked], alive, drop)):
            for j in range(len(told[i])):
                inside = (score >= int(floors[i, j])) & (score <= int(tops[i, j]))
                ids = np.concatenate([best[i, j][0], block.ids[some][found[inside]]])
                now = np.concatenate([best[i, j][1], score[inside]])
                top = _best(now, k)
                best[i, j] = [ids[top], now[top]]
                if len(top) == k:
                    known[i, j] = now[top[-1]]
    keys = [(i, j, len(b[0])) for (i, j), b in best.items()]
    anchor = np.repeat(block.anchor_rows[[i for i, _, _ in keys]], [n for _, _, n in keys])
    place = np.repeat(np.array([j for _, j, _ in keys], np.int64), [n for _, _, n in keys])
    return _table(list(zip(names, ([anchor], [place], [b[0] for b in best.values()], [b[1] for b in best.values()]))))


def _grid(n: int, m: int) -> tuple[int, int]:
    """Blocks of ``n`` rows and chunks of ``m`` anchors: groups of bounded size, at least a few
    tasks' worth of them."""
    blocks = max(1, -(-n // min(MAX_BLOCK, max(4096, -(-n // 4)))))
    return blocks, max(1, -(-m // min(MAX_ANCHORS, max(64, -(-m * blocks // 24)))))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = FLOOR_PERCENT,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor and each of its positives the best negatives of the positive's window."""
    component = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    label = F.col(label) if isinstance(label, str) else label
    chosen = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("embedding"),
        label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("embedding", component), F.lit(False))
    # Rows are told apart by a number, so that no block grows with the rows of one id.
    rows = materialize(chosen.filter(whole).withColumn("number", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter("asks").select(
        F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("embedding").alias("vector")
    )
    told = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks, chunks = _grid(*told)
    spread = lambda c, to: F.pmod(F.xxhash64(c), F.lit(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    dealt = rows.select("vec_id", "label", "embedding", spread("number", blocks).alias("block")).select("*", every(chunks).alias("chunk"))

    def searched(asked: DataFrame, search, schema: str) -> DataFrame:
        left = asked.withColumn("chunk", spread("anchor", chunks)).select("*", every(blocks).alias("block"))
        return left.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(search, schema)

    def near(one: pa.Table, other: pa.Table) -> pa.Table:
        return positives_of_block(one, other, positives, scale)

    def hard(one: pa.Table, other: pa.Table) -> pa.Table:
        return negatives_of_block(one, other, negatives, scale, percent)

    order = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id")
    found = searched(anchors, near, "anchor long, positive_id long, positive_score long")
    found = found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives)
    listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asked = materialize(anchors.join(listed, "anchor").withColumn("scores", F.transform("positives", lambda p: p["positive_score"])), "positives")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    near_misses = searched(asked.drop("positives"), hard, "anchor long, place long, negative_id long, negative_score long")
    ranked = near_misses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = asked.select("anchor", "anchor_id", F.inline("positives"))
    return ranked.join(pairs.withColumn("place", F.col("place").cast("long")), ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    """Hard negatives for every row whose id is divisible by 100; the labels of ids divisible
    by 7 are moved on by one, of ten."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, label=label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other))::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
