"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit set where more than half of a text's shingle hashes (XXH64, seed
42, of the space-joined four words, repeats included) have it set. Fingerprints that differ
in at most ``DISTANCE`` = 4 bits are linked. Cut into three segments, two linked
fingerprints have one segment that differs in at most one bit (three segments with two
differing bits each would need six). So each fingerprint is indexed, for every segment and
every bit of it, by the segment with that bit a wildcard: 64 keys, and every linked pair
shares one. An equality exchange brings equal keys together and the distance verifies.

Copies collapse first: the index holds one row per distinct fingerprint. A bucket of equal
keys never emits its pairs: a breadth-first walk over bit-packed distances emits a spanning
forest of the bucket's links, at most one row per member. Buckets beyond ``BUCKET`` members
are keyed again, by the wildcard variants of a second cut of the fingerprint, so a bucket's
members agree in about 40 of 64 bits; one that is still larger is held by its task, 8 bytes a
member, and walked in blocks against each other, so no bucket is cut short. Forests of all
buckets make up the links, whose components are found by label propagation with pointer
jumping, cut by written tables; component labels meet documents in a sort-merge join, which
adaptive execution splits for a hot fingerprint.

Defined cases: null, empty and blank texts have fingerprint 0, linked like any other; a
text of fewer than four words has one shingle, the whole sequence; very long texts are
hashed whole, in blocks of shingles; a null id is never a component's id unless the
component has no other; repeated rows share one fingerprint and component; ties cannot
occur, as a component's id is the smallest; an empty table gives an empty result; extra
columns, whatever their names, are carried only by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.storage import discard, materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Bits of the three segments, from the lowest.
SEGMENTS = (21, 21, 22)
#: Members of a bucket that are walked at once.
BUCKET = 4096

_BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TO_SPACE = bytes(0x20 if b in _BLANKS else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    n = len(words)
    if n == 0:
        return 0
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n - SHINGLE + 1)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            columns = [batch.column(0), batch.column(1), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "fp"])

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, row long, fp long")


def _key_bits() -> list[tuple[int, int]]:
    """(mask of a segment without one bit, variant number) for all 64 variants."""
    found, low = [], 0
    for width in SEGMENTS:
        segment = ((1 << width) - 1) << low
        found += [(segment & ~(1 << bit), low + (bit - low)) for bit in range(low, low + width)]
        low += width
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near(a: np.ndarray, b: int | np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def _forest(members: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links between distinct fingerprints.

    Breadth first: each member that is taken up is compared with those not yet reached,
    which leave as soon as they are, so a dense group costs little more than its size.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rest = members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = _near(rest, one)
            if near.any():
                got = rest[near]
                rest = rest[~near]
                left.append(np.full(len(got), one, np.uint64))
                right.append(got)
                queue.extend(got)
    return left, right


def _bucket_links(members: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span a bucket of any size, by blocks of at most ``BUCKET``.

    Blocks are spanned on their own; between two blocks each member of one is linked to one
    near member of the other for every component it may join, again without all pairs.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    blocks = [members[at : at + BUCKET] for at in range(0, len(members), BUCKET)]
    for i, own in enumerate(blocks):
        a, b = _forest(own)
        left += a
        right += b
        for other in blocks[i + 1 :]:
            a, b = _forest(np.concatenate([own, other]))
            left += a
            right += b
    return left, right


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, key, fp) sorted by variant and key -> links of each bucket."""
    carry: list[np.ndarray] = []  # of the last bucket, which may go on in the next batch
    names = ["a", "b"]

    def emit(rows: np.ndarray) -> pa.RecordBatch | None:
        # rows: (variant, key, fp) of whole buckets
        change = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        starts = np.concatenate(([0], change))
        stops = np.concatenate((change, [len(rows)]))
        sizes = stops - starts
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        two = starts[sizes == 2]
        if len(two):
            x, y = rows[two, 2], rows[two + 1, 2]
            near = _near(x, y)
            left.append(x[near])
            right.append(y[near])
        for at in np.flatnonzero(sizes > 2):
            members = np.unique(rows[starts[at] : stops[at], 2])
            a, b = _bucket_links(members) if len(members) > BUCKET else _forest(members)
            left += a
            right += b
        if not left:
            return None
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)).astype(np.int64, copy=False).view(np.uint64) for k in range(3)]
        rows = np.stack(columns, axis=1)
        if carry and (carry[-1][-1, :2] == rows[0, :2]).all() and (rows[-1, :2] == rows[0, :2]).all():
            carry.append(rows)
            continue
        rows = np.concatenate([*carry, rows])
        tail = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
        cut = int(tail[-1]) + 1 if len(tail) else 0
        carry = [rows[cut:]]
        if cut and (out := emit(rows[:cut])) is not None:
            yield out
    if carry and (out := emit(np.concatenate(carry))) is not None:
        yield out


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) that span every group of linked fingerprints; ``distinct`` is (fp), no repeats."""
    variants = F.array(
        *(
            F.struct(F.lit(v).alias("variant"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for mask, v in _key_bits()
        )
    )
    keyed = distinct.select("fp", F.explode(variants).alias("v")).select(
        F.col("v.variant").cast("long").alias("variant"), F.col("v.key").alias("key"), "fp"
    )
    keyed = _split_large(keyed)
    dealt = keyed.repartition("variant", "key").sortWithinPartitions("variant", "key")
    return dealt.mapInArrow(_walk, "a long, b long").distinct()


def _split_large(keyed: DataFrame) -> DataFrame:
    """Buckets beyond ``BUCKET`` members get 64 keys each in place of one: the bucket's key
    together with a wildcard variant of a second cut of the whole fingerprint, three segments
    of every third bit. Links within a bucket differ in at most four bits, so one segment of
    the second cut, too, differs in one bit at most."""
    spread = [sum(1 << b for b in range(k, 64, 3)) for k in range(3)]
    second = [(mask & ~(1 << bit), bit) for k, mask in enumerate(spread) for bit in range(k, 64, 3)]
    sizes = keyed.groupBy("variant", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    large = materialize(sizes.select("variant", "key"), "simhash-large")
    if large.isEmpty():
        return keyed
    again = F.array(
        *(
            F.struct(
                F.lit(v + 1).alias("second"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("rest")
            )
            for mask, v in second
        )
    )
    hot = keyed.join(large, ["variant", "key"], "left_semi").select("variant", "key", "fp", F.explode(again).alias("s"))
    finer = hot.select(
        (F.col("variant") + 64 * F.col("s.second")).alias("variant"),
        F.xxhash64("key", "s.rest").alias("key"),
        "fp",
    )
    return keyed.join(large, ["variant", "key"], "left_anti").unionByName(finer)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label, root) with the smallest label reachable, null only if there is no other,
    and the smallest node that has it, which no other component has; ``nodes`` is (node, label).

    Each round takes the smallest label of a node and its neighbours, and then the label
    that its label's holder has (pointer jumping on the smallest-labelled node), until
    nothing changes. Only nodes with a link take part.
    """
    both = materialize(
        edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("next"))
        ),
        "links",
    )
    linked = both.select("node").distinct()
    # best.at: the node whose label is the smallest known, compared by (no label, label, node)
    best = F.struct(F.col("label").isNull().alias("none"), "label", F.col("node").alias("at")).alias("best")
    state = materialize(nodes.join(linked, "node", "left_semi").select("node", best), "labels")
    while True:
        told = both.join(state.select(F.col("node").alias("next"), "best"), "next").groupBy("node").agg(
            F.min("best").alias("told")
        )
        near = state.join(told, "node", "left").select(
            "node", F.col("best").alias("was"), F.least("best", F.coalesce("told", "best")).alias("best")
        )
        jump = near.select(F.col("node").alias("at"), F.col("best").alias("theirs"))
        moved = materialize(
            near.join(jump, near["best.at"] == jump["at"]).select(
                "node", "was", F.least("best", "theirs").alias("best")
            ),
            "labels",
        )
        done = moved.filter(F.col("was.at") != F.col("best.at")).isEmpty()
        discard(state)
        state = moved.select("node", "best")
        state.written_to = moved.written_to
        if done:
            discard(both)
            return state.select("node", F.col("best.label").alias("label"), F.col("best.at").alias("root"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp, component_id, root) of every row; component ids may repeat where ids
    do or are null, roots don't."""
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    groups = materialize(marked.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("label")), "groups")
    labels = components(groups, links(groups.select(F.col("node").alias("fp"))))
    own = groups.join(labels.withColumnRenamed("label", "reached"), "node", "left").select(
        F.col("node").alias("fp"), F.coalesce("reached", "label").alias("component_id"), F.coalesce("root", "node").alias("root")
    )
    return marked.join(materialize(own, "components"), "fp").select("doc_id", "row", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return grouped(docs, doc_id, text).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One of the input's rows for each component: the first by id, a null id after all, then
    by a hash of the text, and of rows alike in both the first by a hash of all columns."""
    first = grouped(docs, doc_id, text).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("key"), "row")).alias("first")
    )
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("in"),
        F.col(doc_id).isNull().alias("none"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("key"),
        F.xxhash64(text).alias("row"),
    )
    by = ["none", "key", "row"]
    kept = own.join(first.select("first.*").hint("shuffle_hash"), by, "left_semi").groupBy(*by)
    return kept.agg(F.min_by("in", F.xxhash64(F.to_json("in"))).alias("in")).select("in.*")


def op8_simhash(spark, sf_dir) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
