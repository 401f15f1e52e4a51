"""Language-model scores of documents: a hidden Markov model over word classes.

Tokens are the words of a text, A-Z lower-cased, and one end. A word of the training texts that
is among the ``own`` most frequent ones is a class of its own; the others, also those that
training never saw, share classes by their last letters. The probability of a text is that of
its sequence of classes in a hidden Markov model, by the scaled forward recursion over the whole
text, times that of each word in its class, by the corpus's counts, one added: a distribution
over all words, with one unknown word a class.

Training. Words are counted over all training texts (partial counts a task, then one sum a
word). States are trained by Baum-Welch: each task adds up the expected counts of its texts, in
pieces of at most ``hmm.PIECE`` tokens that begin with a distribution of their own, and the sums
are added up over the partitions, in slices; the driver sees only the model, states times
classes, whatever the corpus's size. Texts are coded once, as class numbers in a written table,
which every round and the scoring read. The counts of words without a class of their own are
joined by the word, so the vocabulary is nowhere whole; the own words and the totals of the
shared classes have fixed bounds.

Defined cases: a null or empty text is one end; rows with a null id are training texts and are
scored as any other; each row of a repeated id or text counts; without training texts every
count is 0, and each word has probability 1 in its class; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm import hmm
from bindery.storage import materialize

#: The end of a text; no word holds a line's end.
END = b"\n"
#: Words with a class of their own, at most, and classes that the other words share.
OWN = 16384
SHARED = 2048
#: The other words' classes go by so many bytes at their end.
ENDING = 3
STATES = 8
ROUNDS = 4
#: Distinct words that a task counts before it passes their counts on.
HELD_WORDS = 150_000
#: Slices in which the sums of a round are added up.
SLICES = 256
#: Symbols of training texts that a task gathers before it counts them.
GATHERED = 1 << 18


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased."""
    return (text or b"").lower().split()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each token is in the texts, ends among them."""

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for told in batch.column(0).to_pylist():
                seen.update(tokens(told))
                seen[END] += 1
                if len(seen) > HELD_WORDS:
                    yield table(seen)
                    seen.clear()
        yield table(seen)

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The classes: own words with their counts, the end first, then the shared ones, with the
    tokens and the types of their known words."""

    own: list[bytes]
    counts: np.ndarray
    shared_tokens: np.ndarray
    shared_types: np.ndarray
    tokens: int
    types: int
    #: Words seen less often than this have no class of their own.
    least: int

    @property
    def symbols(self) -> int:
        return len(self.own) + len(self.shared_tokens)

    @property
    def share(self) -> np.ndarray:
        """Each class's share of the corpus, one added."""
        whole = np.concatenate([self.counts, self.shared_tokens]).astype(np.float64) + 1
        return whole / whole.sum()

    def base(self) -> np.ndarray:
        """log10 of the own words' add-one probabilities."""
        return np.log10((self.counts + 1) / (self.tokens + self.types + 1))

    def coder(self) -> dict:
        """Words to classes, for any word."""
        first, shared = len(self.own), len(self.shared_tokens)

        class Coder(dict):
            def __missing__(self, word):
                return first + zlib.crc32(word[-ENDING:]) % shared

        return Coder((w, n) for n, w in enumerate(self.own))


def shared_class(word: Column, shared: int = SHARED) -> Column:
    """The number, from 0, of the shared class of a word without one of its own."""
    length = F.octet_length(word)
    ending = F.substring(word, F.greatest(length - ENDING + 1, F.lit(1)), F.lit(ENDING))
    return (F.crc32(ending) % shared).cast("int")


def vocabulary(words: DataFrame, own: int = OWN, shared: int = SHARED) -> Vocabulary:
    """Classes of counted words. The own words are those of the highest counts, whole counts
    only, so that ties decide nothing."""
    ends = words.filter(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    types, total = words.agg(F.count("*"), F.sum("n")).first()
    least, taken = None, 0
    # At most ``own`` counts can have words of their own.
    for row in words.filter(F.col("word") != F.lit(END)).groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).limit(own).collect():
        taken += row["k"]
        if taken > own:
            break
        least = row["n"]
    least = least if least is not None else 2**62
    rows = words.filter((F.col("n") >= least) & (F.col("word") != F.lit(END))).orderBy(F.col("n").desc(), "word").collect()
    sums = (
        rare(words, least).withColumn("class", shared_class(F.col("word"), shared)).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    )
    told = np.zeros((2, shared), np.int64)
    for r in sums.collect():
        told[:, r["class"]] = r["n"], r["k"]
    return Vocabulary([END, *(bytes(r["word"]) for r in rows)], np.array([ends, *(r["n"] for r in rows)], np.int64), *told, int(total or 0), int(types), least)


def rare(words: DataFrame, least: int) -> DataFrame:
    """The words that have no class of their own."""
    return words.filter((F.col("n") < least) & (F.col("word") != F.lit(END)))


def coded(docs: DataFrame, told: Vocabulary, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, codes, others): the texts as classes,
    with the sum of their own words' add-one logarithms, and their other words, counted."""
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, codes binary, others array<struct<word:binary,tf:long>>"
    kind = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base", pa.float64()), ("codes", pa.binary()), ("others", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))]
    )
    whole = np.uint16 if told.symbols < 2**16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base, own, seen = told.coder(), told.base(), len(told.own), told.counts > 0
        rows, size = [], 0
        for batch in batches:
            for row, name, held, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens(body)
                words.append(END)
                codes = np.fromiter(map(code.__getitem__, words), whole, len(words))
                mine = codes[codes < own]
                others = Counter([words[i] for i in np.flatnonzero(codes >= own).tolist()])
                rows.append((row, name, held, len(words), int(seen[mine].sum()), float(base[mine].sum()), codes.tobytes(), list(others.items())))
                size += len(words)
                if size > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("text")
    )
    return numbered.mapInArrow(run, schema)


def _sequences(column: pa.Array, symbols: int) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16 if symbols < 2**16 else np.uint32) for c in column.to_pylist()]


def expected(texts: DataFrame, model: hmm.Model, symbols: int) -> hmm.Model:
    """The expected counts of all texts (codes), added up over the partitions."""
    flat, states = model.flat(), model.states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = hmm.shaped(flat, states)
        total = np.zeros(len(flat))

        def add(held):
            cut = [hmm.pieces(s) for s in held]
            begins = [n == 0 for pieces in cut for n in range(len(pieces))]
            total[:] += hmm.expect(now, [p for pieces in cut for p in pieces], begins).flat()

        held, size = [], 0
        for batch in batches:
            for one in _sequences(batch.column(0), symbols):
                held.append(one)
                size += len(one)
                if size > GATHERED:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        parts = [p.tobytes() for p in np.array_split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "sums"])

    def join(part: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(s, np.float64) for s in part.column("sums").to_pylist()], axis=0)
        return pa.table({"slice": part.column("slice")[:1].cast(pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    kind = "slice int, sums binary"
    told = texts.select("codes").mapInArrow(run, kind).groupBy("slice").applyInArrow(join, kind).collect()
    whole = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(told, key=lambda r: r["slice"])] or [np.zeros(len(flat))])
    return hmm.shaped(whole, states)


def train(texts: DataFrame, told: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> hmm.Model:
    """Baum-Welch rounds over the coded training texts."""
    model = hmm.first(told.share, states)
    for _ in range(rounds):
        model = hmm.maximise(expected(texts, model, told.symbols), told.share)
    return model


def likelihoods(texts: DataFrame, model: hmm.Model, symbols: int) -> DataFrame:
    """The coded texts' rows with ``classes``, log10 of their classes' probability."""
    flat, states = model.flat(), model.states
    carried = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = hmm.shaped(flat, states)
        for batch in batches:
            sums = hmm.log_likelihoods(now, _sequences(batch.column("codes"), symbols)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sums, pa.float64())], [*carried, "classes"])

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, classes double"
    return texts.select(*carried, "codes").mapInArrow(run, kind)


def score(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    own: int = OWN,
    shared: int = SHARED,
    states: int = STATES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row,
    learning from the rows that are not held out."""
    held = F.coalesce(held_out, F.lit(False))
    words = materialize(count_words(docs.filter(~held), text), "words")
    told = vocabulary(words, own, shared)
    texts = materialize(coded(docs, told, held, doc_id, text), "coded")
    model = train(texts.filter(~F.col("held_out")), told, states, rounds)
    sums = docs.sparkSession.createDataFrame(
        [(k, int(n), int(v)) for k, (n, v) in enumerate(zip(told.shared_tokens, told.shared_types))], "class int, in_class long, types long"
    )
    # One row a shared class.
    others = texts.select("row", F.inline("others")).withColumn("class", shared_class(F.col("word"), shared)).join(F.broadcast(sums), "class")
    met = others.join(rare(words, told.least), "word", "left")
    seen = F.coalesce("n", F.lit(0)) + 1
    per_row = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("more_known"),
        F.sum(F.col("tf") * F.log10(seen / (told.tokens + told.types + 1))).alias("more_base"),
        F.sum(F.col("tf") * F.log10(seen / (F.col("in_class") + F.col("types") + 1))).alias("in_classes"),
    )
    scored = likelihoods(texts, model, told.symbols).join(per_row, "row", "left")
    none = F.lit(0.0)
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(told.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("classes") + F.coalesce("in_classes", none)).alias("score"),
    )


def op13_hmm_scores(spark, sf_dir) -> DataFrame:
    """Scores of all documents; those whose id's CRC-32 leaves 2 by 7 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
