"""Toxicity by compression distance to two zstandard dictionaries.

A text is read as words, lower-cased and without punctuation at their ends; a word becomes
a run of 8-byte codes, hashes of its first 3, 5 and 7 characters and of the whole. Codes
are incompressible, so a match with a dictionary saves as much whatever a word's letters,
and words that merely resemble others save nothing. Training takes a bounded sample of
labelled rows. Each class's windows, less the codes that the class does not hold more often
than the other (by document frequency and likelihood ratio), are the samples from which
zstandard's own trainer makes its dictionary. Every window of ``WINDOW`` words of a text is
compressed with both; the margin of a window is the difference of the compressed lengths.
A margin threshold is calibrated on ordinary training windows, and a logistic model over a
text's margins gives its score. Labels, language, source and id are not inputs of a score.

Scoring is one pass without a shuffle; the model is a few kilobytes. Only the model's
sample meets the driver: one text for each of at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS``
labelled ids, the first by a hash of the id, whatever their length.

Defined cases: null and empty texts are one empty window and get a score; with fewer than
three toxic or ordinary training texts every score is the smoothed share of toxic labels;
where samples are too few for the trainer, they are the dictionary themselves; null labels
and ids are not learned from; an id labelled both ways is toxic; of rows with one labelled id
the least text is learned from; null ids are never held out; repeated rows score alike, and a
score of exactly one half is toxic; very long texts are scored whole, in groups of windows; an
empty table gives an empty result; extra columns, whatever their names, are carried only by
``keep_clean``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOXIC_ROWS = 1000
ORDINARY_ROWS = 3000
WINDOW = 16
STEMS = (3, 5, 7)
CODE = 8
DICTIONARY_BYTES = 4096
#: Bytes of the stretches that the trainer picks: the codes of one word.
STRETCH = 32
#: How much more often, and how surely so, a class holds the codes its dictionary is made of. The
#: toxic ones were chosen by three folds of the training rows alone.
TOXIC_CONTRAST, TOXIC_SIGNIFICANCE = 6.0, 12.0
ORDINARY_CONTRAST, ORDINARY_SIGNIFICANCE = 1.5, 6.0
LEAST_DOCS = 3
RIDGE = 0.3
#: Words that are compressed in one call.
GROUP_WORDS = 100_000
CACHE_WORDS = 60_000
PUNCTUATION = ".,;:!?|*&%$#<>()[]{}\"'-_=+/\\~`"

_cache: dict[str, bytes] = {}


def word_codes(word: str) -> bytes:
    """The codes of one lower-cased word."""
    known = _cache.get(word)
    if known is None:
        bare = word.strip(PUNCTUATION)
        parts = [f"{k}{bare[:k]}" for k in STEMS if len(bare) >= k or k == STEMS[0]]
        known = b"".join(xxhash.xxh64_digest(p.encode("utf-8", "surrogatepass")) for p in [*parts, f"w{bare}"])
        if len(_cache) < CACHE_WORDS:
            _cache[word] = known
    return known


def _forget() -> None:
    """Give back what a task's words took: its worker goes on to other tasks, of other stages too."""
    _cache.clear()
    pa.default_memory_pool().release_unused()


def coded(text: str | None) -> list[bytes]:
    return [word_codes(w) for w in (text or "").lower().split()]


def windows(words: list[bytes]) -> list[bytes]:
    return [b"".join(words[at : at + WINDOW]) or b"\0" for at in range(0, max(1, len(words)), WINDOW)]


def _split(run: bytes) -> list[bytes]:
    return [run[at : at + CODE] for at in range(0, len(run), CODE)]


@dataclass
class Model:
    """Two dictionaries, the window threshold and the weights over a text's features."""

    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: int = 4
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5

    def __post_init__(self) -> None:
        self._pair: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def compressors(self) -> tuple:
        if self._pair is None:
            settings = zstandard.ZstdCompressionParameters.from_level(
                3,
                min_match=6,
                strategy=zstandard.STRATEGY_GREEDY,
                write_content_size=0,
                write_checksum=0,
                write_dict_id=0,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            self._pair = tuple(
                zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                    compression_params=settings,
                )
                for d in (self.ordinary, self.toxic)
            )
        return self._pair

    def margins(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, by window."""
        lengths = []
        for one in self.compressors():
            packed = one.multi_compress_to_buffer(parts)
            lengths.append(np.fromiter((len(packed[k]) for k in range(len(packed))), np.int64, len(packed)))
        return lengths[0] - lengths[1]

    def features(self, margins: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row per text; ``starts`` are the places of its first window."""
        counts = np.diff(np.append(starts, len(margins)))
        reach = (margins >= self.threshold).astype(np.int64)
        hits = np.add.reduceat(reach, starts)
        gained = np.add.reduceat(np.where(reach > 0, margins, 0), starts)
        total = np.add.reduceat(margins, starts)
        return np.column_stack(
            [np.log1p(hits), hits / counts, np.log1p(gained), total / counts, np.maximum.reduceat(margins, starts)]
        )

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        scaled = (features - np.array(self.mean)) / np.array(self.scale)
        line = self.weights[0] + scaled @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(line, -40, 40)))

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """Scores of whole texts, compressed in groups of bounded size."""
        if not self.weights:
            return np.full(sum(1 for _ in texts), self.prior)
        scores: list[np.ndarray] = []
        parts: list[bytes] = []
        starts: list[int] = []

        def flush() -> None:
            if starts:
                scores.append(self.probabilities(self.features(self.margins(parts), np.array(starts))))
            parts.clear()
            starts.clear()

        for text in texts:
            starts.append(len(parts))
            parts.extend(windows(coded(text)))
            if len(parts) * WINDOW >= GROUP_WORDS:
                flush()
        flush()
        return np.concatenate(scores) if scores else np.zeros(0)


def _likelihood_ratio(a: int, n1: int, b: int, n0: int) -> float:
    def log_of(k: int, n: int, q: float) -> float:
        return (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (log_of(a, n1, a / n1) + log_of(b, n0, b / n0) - log_of(a, n1, p) - log_of(b, n0, p))


def _codes_of(words: list[bytes]) -> np.ndarray:
    """The distinct codes of a text, as integers."""
    return np.unique(np.frombuffer(b"".join(words), np.uint64))


def _distinctive(own: list[list[bytes]], other: list[list[bytes]], contrast: float, significance: float) -> set[bytes]:
    """Codes that ``own`` texts hold more often than ``other``."""
    codes, found = np.unique(np.concatenate([_codes_of(words) for words in own]), return_counts=True)
    codes, found = codes[found >= LEAST_DOCS], found[found >= LEAST_DOCS]
    against = np.zeros(len(codes), np.int64)
    for words in other:
        against += np.isin(codes, _codes_of(words), assume_unique=True)
    n1, n0 = len(own), len(other)
    often = np.flatnonzero(found / n1 > contrast * (against + 0.5) / n0)
    sure = [k for k in often if _likelihood_ratio(int(found[k]), n1, int(against[k]), n0) > significance]
    return {codes[k].tobytes() for k in sure}


def _samples(texts: list[list[bytes]], kept: set[bytes]) -> list[bytes]:
    """What ``kept`` codes leave of each window that has any."""
    parts = (words[at : at + WINDOW] for words in texts for at in range(0, len(words), WINDOW))
    left = (b"".join(c for word in part for c in _split(word) if c in kept) for part in parts)
    return [x for x in left if x]


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary that zstandard trains on the samples, or, of too few of them, the distinct
    ones, the most frequent last."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=STRETCH, d=CODE, level=3).as_bytes()
    except zstandard.ZstdError:
        ranked = [x for x, _ in sorted(Counter(samples).items(), key=lambda x: (x[1], x[0]))]
        return b"".join(ranked)[-DICTIONARY_BYTES:]


def _unique(texts: list[str]) -> list[list[bytes]]:
    return [coded(t) for t in dict.fromkeys(texts)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted ridge logistic regression by damped Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    ridge = RIDGE * np.eye(design.shape[1])
    ridge[0, 0] = 1e-6
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (weight * (y - p)) - ridge @ w
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return w.tolist()


def fit(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int) -> Model:
    """A model from sampled texts; the counts are those of all labelled training rows."""
    model = Model(prior=(n_toxic + 0.5) / (n_toxic + n_ordinary + 1))
    own, other = _unique(toxic), _unique(ordinary)
    if len(own) < LEAST_DOCS or len(other) < LEAST_DOCS:
        return model
    toxic_codes = _distinctive(own, other, TOXIC_CONTRAST, TOXIC_SIGNIFICANCE)
    if not toxic_codes:
        return model
    ordinary_codes = _distinctive(other, own, ORDINARY_CONTRAST, ORDINARY_SIGNIFICANCE)
    model.toxic = _dictionary(_samples(own, toxic_codes))
    model.ordinary = _dictionary(_samples(other, ordinary_codes))
    margins, starts, labels = [], [], []
    at = 0
    for label, group in zip((1.0, 0.0), (own, other)):
        for words in group:
            parts = windows(words)
            margins.append(model.margins(parts))
            starts.append(at)
            labels.append(label)
            at += len(parts)
    flat, y = np.concatenate(margins), np.array(labels)
    plain = flat[starts[len(own)] :]
    model.threshold = int(max(1, np.quantile(plain, 0.999)))
    x = model.features(flat, np.array(starts))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = np.where(y == 1, n_toxic / len(own), n_ordinary / len(other))
    model.mean, model.scale = mean.tolist(), scale.tolist()
    model.weights = _logistic((x - mean) / scale, y, share / share.mean())
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from the labelled rows that are not held out; labels is (doc_id, toxic)."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.bool_or(F.col("toxic") == 1).alias("bad"))
    )
    counts = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    first = lambda bad, most: known.filter(F.col("bad") == bad).orderBy(F.xxhash64("id"), "id").limit(most)
    # At most TOXIC_ROWS + ORDINARY_ROWS ids, so the texts stay where they are.
    wanted = F.broadcast(first(True, TOXIC_ROWS).unionByName(first(False, ORDINARY_ROWS)))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(wanted, "id")
    one_each = rows.groupBy("id", "bad").agg(F.min("text").alias("text"))
    sample = sorted((r["bad"], r["text"]) for r in one_each.select("bad", "text").collect())
    of = lambda bad: [t for b, t in sample if b is bad]
    model = fit(of(True), of(False), counts.get(True, 0), counts.get(False, 0))
    _forget()  # the driver has no further use for the words
    return model


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])
        _forget()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", below: float = 0.5) -> DataFrame:
    """The input's rows that score below ``below``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(t.as_py() for t in batch.column(place))
            yield batch.filter(pa.array(values < below))
        _forget()

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir) -> DataFrame:
    """Score and prediction for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scores(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
