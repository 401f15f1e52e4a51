"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document is its ids and an end id; one longer than a sequence is cut into full pieces,
the first taking what is left over. Full pieces are sequences of their own. The others are
dealt by a hash, salted with their place in the written table of pieces so that repeated
rows part too, into shards of about ``SHARD_ITEMS`` pieces; a shard is one packing problem
of bounded size. Several islands, tasks of their own, hold populations for the same shard:
chromosomes are sets of bins, crossover injects whole well-filled bins of one parent into
the other, removes the bins that then hold a piece twice, and best-fits the displaced
pieces; mutation dissolves the emptiest bins. After each round every island's elite
migrates to the next island of its shard. A shard whose bins equal the lower bound
(tokens over sequence length, rounded up) has a proven optimum and is not searched further. Randomness is
seeded by shard, island and round, so reruns agree.

Recovery: pieces, shards and each round's elites are written tables; a lost executor costs
the tasks it ran. Memory: a task holds one shard.

Defined cases: null and empty texts are the end id alone; null ids are packed and stay
null; repeated rows are packed as rows of their own; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.tokens import encoder
from bindery.storage import materialize

LENGTH = 1024
END_ID = 2
SHARD_ITEMS = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 6
GENERATIONS = 8
WELL_FILLED = 0.35
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, most: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; only the first may be shorter."""
    first = total % most or most
    return [(0, min(first, total))] + [(at, most) for at in range(first, total, most)]


def pieces(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", most: int = LENGTH
) -> DataFrame:
    """A row per piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for name, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1), (END_ID,))):
                told = memoryview(ids).cast("B")
                for number, (start, length) in enumerate(cut(len(ids), most)):
                    rows.append((name, number, start, length, zlib.crc32(told[4 * start : 4 * (start + length)])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    chosen = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    return chosen.mapInArrow(run, PIECES)


#: A packing: for each bin its load and its pieces.
Packing = list[tuple[int, tuple[int, ...]]]


class Bins:
    """Open bins by free space: the fullest bin that still takes a piece, in bit operations."""

    def __init__(self, lengths: list[int], most: int, bins: Packing = ()):
        self.lengths, self.most = lengths, most
        self.loads = [load for load, _ in bins]
        self.items = [items for _, items in bins]
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        for k, load in enumerate(self.loads):
            self._offer(k, most - load)

    def _offer(self, k: int, free: int) -> None:
        if free:
            stack = self.by_free.get(free)
            if stack:
                stack.append(k)
            else:
                self.by_free[free] = [k]
                self.open |= 1 << free

    def place(self, item: int) -> None:
        need = self.lengths[item]
        fitting = self.open >> need
        if not fitting:
            self.items.append((item,))
            self.loads.append(need)
            self._offer(len(self.items) - 1, self.most - need)
            return
        free = need + (fitting & -fitting).bit_length() - 1
        stack = self.by_free[free]
        k = stack.pop()
        if not stack:
            self.open &= ~(1 << free)
        self.items[k] += (item,)
        self.loads[k] += need
        self._offer(k, free - need)

    def best_fit(self, items: list[int]) -> Packing:
        for item in sorted(items, key=self.lengths.__getitem__, reverse=True):
            self.place(item)
        return self.packing()

    def packing(self) -> Packing:
        return list(zip(self.loads, self.items))


def fitness(bins: Packing, most: int) -> tuple[int, float]:
    """Fewer bins first; then bins that are either full or nearly empty."""
    return -len(bins), sum(load * load for load, _ in bins) / (most * most)


def crossover(one: Packing, other: Packing, lengths: list[int], most: int, rng) -> Packing:
    """Inject well-filled bins of ``other`` into ``one``, drop the bins of ``one`` that hold
    an injected piece, and best-fit what those bins held besides."""
    filled = sorted(other, key=lambda b: (-b[0], len(b[1])))
    top = filled[: max(1, int(WELL_FILLED * len(filled)))]
    injected = rng.sample(top, max(1, len(top) // 2))
    taken = {i for _, items in injected for i in items}
    kept, displaced = [], []
    for b in one:
        if taken.isdisjoint(b[1]):
            kept.append(b)
        else:
            displaced += [i for i in b[1] if i not in taken]
    return Bins(lengths, most, injected + kept).best_fit(displaced)


def mutate(bins: Packing, lengths: list[int], most: int, rng) -> Packing:
    """Dissolve the emptiest bins and some at random; best-fit their pieces."""
    ranked = sorted(bins, key=lambda b: b[0])
    n = max(1, len(ranked) // 50)
    loose, rest = ranked[:n], ranked[n:]
    for _ in range(min(n, len(rest))):
        loose.append(rest.pop(rng.randrange(len(rest))))
    return Bins(lengths, most, rest).best_fit([i for _, items in loose for i in items])


def evolve(lengths: list[int], most: int, seed: str, elites: list[Packing], generations: int = GENERATIONS) -> Packing:
    """The best packing an island finds from best-fit seeds and the elites it was sent."""
    bound = -(-sum(lengths) // most)
    rng = random.Random(seed)
    items = list(range(len(lengths)))
    score = lambda bins: fitness(bins, most)
    population = [*elites, Bins(lengths, most).best_fit(items)]
    best = max(population, key=score)
    if len(best) <= bound:
        return best
    while len(population) < POPULATION:
        seeded = Bins(lengths, most)
        order = items[:]
        rng.shuffle(order)
        for item in sorted(order, key=lambda i: -(lengths[i] * rng.uniform(0.8, 1.2))):
            seeded.place(item)
        population.append(seeded.packing())
    for _ in range(generations):
        offspring = []
        for _ in range(POPULATION):
            a, b = rng.sample(population, 2)
            child = crossover(a, b, lengths, most, rng)
            offspring.append(mutate(child, lengths, most, rng) if rng.random() < 0.5 else child)
        population = sorted(population + offspring, key=score, reverse=True)[:POPULATION]
        if len(population[0]) <= bound:
            break
    return population[0]


def _assigned(bins: Packing, n: int) -> list[int]:
    found = [0] * n
    for k, (_, items) in enumerate(bins):
        for i in items:
            found[i] = k
    return found


def _bins_of(assigned: list[int], lengths: list[int]) -> Packing:
    found: dict[int, tuple[int, ...]] = {}
    for i, k in enumerate(assigned):
        found[k] = found.get(k, ()) + (i,)
    return [(sum(lengths[i] for i in items), items) for items in found.values()]


def _shards(rows: DataFrame, n: int) -> DataFrame:
    """(shard, items): a row per shard, its pieces in a fixed order.

    The salt is a row's place in the files of ``rows``, a written table, so a task that is
    run again deals its rows as before."""
    salt = F.monotonically_increasing_id()
    shard = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", salt), F.lit(n)).cast("int")
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    return rows.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def _round(states: DataFrame, most: int, number: int) -> DataFrame:
    """One round on every island: (shard, island, lengths, elites) -> (shard, island, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, island, lengths, elites = (batch.column(c)[k].as_py() for c in range(4))
                best = evolve(lengths, most, f"{shard}/{island}/{number}", [_bins_of(e, lengths) for e in elites])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()),
                        pa.array([island], pa.int32()),
                        pa.array([len(best)], pa.int32()),
                        pa.array([_assigned(best, len(lengths))], pa.list_(pa.int32())),
                    ],
                    ["shard", "island", "bins", "best"],
                )

    return states.mapInArrow(run, "shard int, island int, bins int, best array<int>")


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = LENGTH,
    shard_items: int = SHARD_ITEMS,
    islands: int = ISLANDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return pack_pieces(materialize(pieces(docs, path, doc_id, text, most), "pieces"), most, shard_items, islands, rounds)


def pack_pieces(
    rows: DataFrame, most: int = LENGTH, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, rounds: int = ROUNDS
) -> DataFrame:
    n = max(1, round(rows.count() / shard_items))
    shards = materialize(_shards(rows, n), "shards")
    loose = F.filter("items", lambda x: x["length"] < most)
    problems = shards.select("shard", F.transform(loose, lambda x: x["length"].cast("int")).alias("lengths"))
    # A few islands a task: their rows are small, their work is not.
    spread = lambda df: df.repartition(-(-n * islands // 4), "shard", "island")
    every = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    none = F.array().cast("array<array<int>>")
    states = spread(problems.select("shard", every, "lengths")).select("shard", "island", "lengths", none.alias("elites"))
    best = materialize(_round(states, most, 0), "islands")
    for number in range(1, rounds):
        # An island keeps its own elite and takes that of the island before it.
        sent = best.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), "best")
        met = sent.unionByName(best.select("shard", "island", "best")).groupBy("shard", "island").agg(
            F.sort_array(F.collect_list("best")).alias("elites")
        )
        states = spread(problems.join(met, "shard")).select("shard", "island", "lengths", "elites")
        best = materialize(_round(states, most, number), "islands")
    chosen = best.groupBy("shard").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _laid_out(batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values, most)

    return shards.join(chosen, "shard").select("shard", "items", "best").mapInArrow(
        lay_out, f"{PIECES}, sequence_id long, offset long"
    )


def _laid_out(shard: int, items: pa.StructArray, best: pa.Array, most: int) -> pa.RecordBatch:
    """Pieces of one shard: sequence ids are the shard times 2**32 plus a running number."""
    lengths = np.asarray(items.field("length"))
    sequence = np.zeros(len(lengths), np.int64)
    loose = np.flatnonzero(lengths < most)
    own = np.asarray(best, dtype=np.int64)
    sequence[loose] = own
    full = np.flatnonzero(lengths >= most)
    sequence[full] = (int(own.max()) + 1 if len(own) else 0) + np.arange(len(full))
    order = np.argsort(sequence, kind="stable")
    sizes = lengths[order]
    before = np.cumsum(sizes) - sizes
    first = np.concatenate(([True], sequence[order][1:] != sequence[order][:-1])) if len(order) else np.zeros(0, bool)
    offset = np.zeros(len(lengths), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(order) else before
    columns = [items.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sequence + (shard << 32)), pa.array(offset)], names)


def op3_best_fit_packing(spark, sf_dir) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
