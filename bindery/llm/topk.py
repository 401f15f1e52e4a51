"""Exact top-k inner products over a bit-sliced index.

Vectors become integers (``floor(scale * x)``). A block of rows is indexed by attribute: its
values, less the block's least value, are cut into bit slices, each slice one bitmap over
the rows. A query's scores are then added up for all rows of a block at once with bitmap
arithmetic: every signed digit of a query component contributes the attribute's slices (or
their complements, for a negative digit) at its weight, and carry-save adders reduce them
to the slices of the sum. From its most significant slice downward the k-th largest score
is found by counting bits; rows above it are in, and the boundary rows that tie with it, or,
where wide attributes were quantised to ``slices`` bits, may yet reach it, are resolved by
exact integer inner products, ties to the smaller id.

Distribution: the grid of row blocks and query chunks is a plain equality grouping; a row
is sent once per chunk and a query once per block, each group holds one block and one
chunk of bounded size, and gives at most k rows per query, which a ranked window merges.
At the largest sizes a block is sent, and its index made, once for 8192 queries, each of
which then adds up all of its bitmaps: sending and indexing are a small share of that.
Nothing is broadcast. Groups are re-computed alone if an executor is lost.

Defined cases: vectors that are null, hold null or non-finite components, or have a null
id take no part; all rows of a repeated id count, each as a candidate for the queries of
other ids, and its queries are ranked as one, the best pairs of all; shorter vectors are as if
filled with zeros; an empty vector scores 0; scores outside a long are cut to its range;
a table without queries or candidates gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.storage import materialize

SCALE = 64
K = 20
#: Bits of an attribute that are indexed; wider attributes are quantised to so many.
SLICES = 12
#: Rows whose bitmaps are added at once; a block is a multiple.
CHUNK_ROWS = 16384
MAX_BLOCK = 65536
MAX_QUERIES = 8192
LONG = np.iinfo(np.int64)


def _digits(value: int) -> list[tuple[int, int]]:
    """Non-adjacent signed digits of an integer: (bit, 1 or -1)."""
    found, bit = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            found.append((bit, digit))
            value -= digit
        value >>= 1
        bit += 1
    return found


class BitSlices:
    """The index of a block: bit slices of every attribute, less its least value."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        self.rows, self.dim = values.shape
        self.width = -(-self.rows // 64)
        self.least = [int(values[:, j].min()) if self.rows else 0 for j in range(self.dim)]
        self.shift: list[int] = []
        self.first: list[int] = []  # of an attribute's slices, in bitmaps
        self.count: list[int] = []
        maps: list[np.ndarray] = []
        for j in range(self.dim):
            column = values[:, j] - self.least[j]
            bits = int(column.max()).bit_length() if self.rows else 0
            shift = max(0, bits - slices)
            column = (column >> shift).astype(np.int64)
            self.shift.append(shift)
            self.first.append(len(maps))
            self.count.append(bits - shift)
            for b in range(bits - shift):
                maps.append(self.pack(((column >> b) & 1).astype(np.uint8)))
        plain = np.stack(maps) if maps else np.zeros((0, self.width), np.uint64)
        self.maps = np.concatenate([plain, ~plain])
        self.flip = len(maps)
        self.all = self.pack(np.ones(self.rows, np.uint8))

    def pack(self, bits: np.ndarray) -> np.ndarray:
        full = np.zeros(self.width * 64, np.uint8)
        full[: self.rows] = bits
        return np.packbits(full, bitorder="little").view(np.uint64)

    def rows_of(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=self.rows))

    def add_up(self, query: list[int]) -> tuple[list[np.ndarray], int, int]:
        """(slices of the sum, constant to add, greatest error) of the scores of all rows.

        The score lies between sum + constant and that plus the error.
        """
        levels: dict[int, list[int]] = {}
        constant = below = above = 0
        for j, q in enumerate(query[: self.dim]):
            constant += q * self.least[j]
            lost = (1 << self.shift[j]) - 1
            if q > 0:
                above += q * lost
            else:
                below += -q * lost
            n = self.count[j]
            if not n:
                continue
            for bit, sign in _digits(q):
                base = self.first[j] + (self.flip if sign < 0 else 0)
                at = bit + self.shift[j]
                if sign < 0:
                    constant -= ((1 << n) - 1) << at
                for b in range(n):
                    levels.setdefault(at + b, []).append(base + b)
        sums: list[np.ndarray] = []
        carried = np.zeros((0, self.width), np.uint64)
        level = 0
        while level <= max(levels, default=-1) or len(carried):
            own = self.maps[levels.get(level, [])]
            stack = np.concatenate([own, carried]) if len(carried) else own
            carries = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                x = a ^ b
                carries.append((a & b) | (c & x))
                x ^= c
                stack = np.concatenate([x, stack[3 * m :]]) if len(stack) > 3 * m else x
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            sums.append(stack[0] if len(stack) else np.zeros(self.width, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, self.width), np.uint64)
            level += 1
        return sums, constant - below, below + above

    def select(self, sums: list[np.ndarray], among: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Rows of ``among`` that may be in the top k: those above the k-th largest sum, and
        the boundary rows that are at most ``slack`` below it."""
        count = lambda bitmap: int(np.bitwise_count(bitmap).sum())
        if count(among) <= k:
            return self.rows_of(among)
        inside = np.zeros(self.width, np.uint64)
        edge, need, value = among, k, 0
        for i in range(len(sums) - 1, -1, -1):
            upper = edge & sums[i]
            n = count(upper)
            if n >= need:
                edge, value = upper, value | (1 << i)
            else:
                inside |= upper
                need -= n
                edge = edge & ~sums[i]
        if slack:
            inside, edge = self.at_least(sums, among, value - slack), np.zeros_like(edge)
        return self.rows_of(inside | edge)

    def at_least(self, sums: list[np.ndarray], among: np.ndarray, bound: int) -> np.ndarray:
        if bound <= 0:
            return among
        above, equal = np.zeros(self.width, np.uint64), among
        for i in range(len(sums) - 1, -1, -1):
            if bound >> i & 1:
                equal = equal & sums[i]
            else:
                above |= equal & sums[i]
                equal = equal & ~sums[i]
        return above | equal


def _integers(column, scale: int) -> np.ndarray:
    """The rows of a list column as integers, filled with zeros to one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values, dtype=np.float64)[offsets[0] : offsets[-1]] if n else np.zeros(0)
    sizes = np.diff(offsets)
    dim = int(sizes.max()) if n else 0
    if n and (sizes == dim).all():
        dense = flat.reshape(n, dim)
    else:
        dense = np.zeros((n, dim))
        dense[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes]) if n else []] = flat
    with np.errstate(over="ignore"):
        floors = np.floor(scale * dense)
    if floors.size and np.abs(floors).max() >= 2.0**40:
        # Beyond the precision of a double a component is an integer, scaled as one.
        exact = lambda x, f: scale * int(x) if abs(x) >= 2.0**53 else int(f)
        return np.array([[exact(x, f) for x, f in zip(*row)] for row in zip(dense.tolist(), floors.tolist())], dtype=object)
    return floors.astype(np.int64)


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, as a long."""
    dim = min(rows.shape[1], len(query))
    rows, query = rows[:, :dim], query[:dim]
    most = lambda x: int(abs(x).max()) if x.size else 0
    if most(rows) * most(query) * max(dim, 1) < 2**62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    exact = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), int(LONG.min)), int(LONG.max)) for x in exact], dtype=np.int64)


def search_block(queries: pa.Table, rows: pa.Table, k: int, scale: int, slices: int) -> pa.Table:
    """The k best rows of a block for each query of a chunk."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        ids = np.asarray(rows.column("vec_id"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        values = _integers(rows.column("embedding"), scale)[order]
        wanted = _integers(queries.column("embedding"), scale)
        query_ids = np.asarray(queries.column("query_id"))
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in query_ids]
        for at in range(0, len(ids), CHUNK_ROWS):
            part, names = values[at : at + CHUNK_ROWS], ids[at : at + CHUNK_ROWS]
            index = BitSlices(part, slices)
            for n, query in enumerate(wanted):
                among = index.all
                first, last = np.searchsorted(names, query_ids[n]), np.searchsorted(names, query_ids[n], "right")
                if first < last:
                    own = np.zeros(len(names), np.uint8)
                    own[first:last] = 1
                    among = among & ~index.pack(own)
                sums, _, slack = index.add_up([int(q) for q in query])
                chosen = index.select(sums, among, k, slack)
                score = _scores(part[chosen], query)
                top = _first(score, k)
                best[n].append((names[chosen][top], score[top]))
        for n, parts in enumerate(best):
            names = np.concatenate([p[0] for p in parts])
            score = np.concatenate([p[1] for p in parts])
            top = _first(score, k)
            found.append((np.full(len(top), query_ids[n]), names[top], score[top]))
    columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the first, in that order; ids ascend."""
    return np.argsort(~score, kind="stable")[:k]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: int = SCALE,
    slices: int = SLICES,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest score for
    each id of ``queries``, other than rows with the query's own id."""

    def whole(table: DataFrame) -> DataFrame:
        component = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        chosen = table.select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")
        )
        # Rows of one id are dealt out by their number, so that no block grows with them.
        return chosen.filter(
            F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", component), F.lit(False))
        ).withColumn("number", F.monotonically_increasing_id())

    rows = materialize(whole(vectors), "vectors")
    asked = materialize(whole(queries), "queries").withColumnRenamed("vec_id", "query_id")
    n, m = rows.count(), asked.count()
    block = min(MAX_BLOCK, max(4096, -(-n // 4)))
    blocks = max(1, -(-n // block))
    chunk = min(MAX_QUERIES, max(256, -(-m * blocks // 24)))
    chunks = max(1, -(-m // chunk))
    spread = lambda c, to: F.pmod(F.xxhash64(c, "number"), F.lit(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    left = asked.select("*", spread("query_id", chunks).alias("chunk")).select("*", every(blocks).alias("block"))
    right = rows.select("*", spread("vec_id", blocks).alias("block")).select("*", every(chunks).alias("chunk"))

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        return search_block(one, other, k, scale, slices)

    near = (
        left.groupBy("block", "chunk")
        .cogroup(right.groupBy("block", "chunk"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op2_exact_topk(spark, sf_dir) -> DataFrame:
    """The 20 nearest rows for each row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
