"""The hidden Markov language model against plain sums over all state paths and plain counts."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from bindery.llm import hmm, lm


def small(states=2, symbols=3, seed=4):
    rng = np.random.default_rng(seed)
    rows = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.uniform(0.1, 1, shape))
    return hmm.Model(rows(states), rows(states), rows(states, states), rows(states, symbols).T.copy())


def paths(model, symbols, begins=True):
    """(states, probability together with the symbols) of every path."""
    for path in itertools.product(range(model.states), repeat=len(symbols)):
        p = (model.start if begins else model.again)[path[0]]
        for t, (s, x) in enumerate(zip(path, symbols)):
            p *= model.emit[x, s] * (model.move[path[t - 1], s] if t else 1)
        yield path, p


def test_likelihoods_are_sums_over_all_paths(monkeypatch):
    model, rng = small(), random.Random(2)
    texts = [np.array([rng.randrange(3) for _ in range(n)], np.uint16) for n in (1, 5, 2, 7, 7, 1, 4)]
    want = [math.log(sum(p for _, p in paths(model, t))) for t in texts]
    assert np.allclose(hmm.log_likelihoods(model, texts), want)
    monkeypatch.setattr(hmm, "SCORED_AT_ONCE", 6)
    assert np.allclose(hmm.log_likelihoods(model, texts), want)


def test_expected_counts_are_those_of_all_paths():
    model, rng = small(), random.Random(3)
    texts = [np.array([rng.randrange(3) for _ in range(n)], np.uint16) for n in (4, 1, 6, 3)]
    begins = [True, False, True, False]
    want = hmm.Model(np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)))
    for text, begin in zip(texts, begins):
        whole = sum(p for _, p in paths(model, text, begin))
        for path, p in paths(model, text, begin):
            (want.start if begin else want.again)[path[0]] += p / whole
            for t, (s, x) in enumerate(zip(path, text)):
                want.emit[x, s] += p / whole
                if t:
                    want.move[path[t - 1], s] += p / whole
    assert np.allclose(hmm.expect(model, texts, begins).flat(), want.flat(), atol=1e-5)


def test_rounds_raise_the_likelihood():
    rng = random.Random(8)
    texts = [np.array([(k % 2) * 3 + rng.randrange(3) for _ in range(40)], np.uint16) for k in range(30)]
    share = np.full(6, 1 / 6)
    model, told = hmm.first(share, 2), []
    for _ in range(6):
        told.append(hmm.log_likelihoods(model, texts).sum())
        model = hmm.maximise(hmm.expect(model, texts, [True] * len(texts)), share, prior=1e-6, least=1e-6)
    assert told == sorted(told) and told[-1] > told[0] + 100
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


TEXTS = [None, "", " \n\t", "Straße", "a A a b\x0bc", "the cat\nsat on the mat " * 40, "é", "unheard"] + [" ".join(random.Random(k).choices("die der und ein rot the cat of and red".split()[5 * (k % 2) :][:5], k=60)) for k in range(40)]


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 2


@pytest.mark.parametrize(("own", "shared"), [(4, 3), (lm.OWN, lm.SHARED), (0, 1)])
def test_scores_are_those_of_plain_python(spark, own, shared):
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (5, TEXTS[5]), (5, "other")]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, codes string, row int, held_out boolean")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = sorted(map(tuple, lm.score(docs, crc, own=own, shared=shared, states=2, rounds=3).collect()), key=repr)
    texts = [(k, [w.lower() for w in (t or "").encode().split()] + [b"\n"]) for k, t in rows]
    counts = collections.Counter(w for k, t in texts if not held(k) for w in t)
    total, types = sum(counts.values()), len(counts)
    ranked = collections.Counter(n for w, n in counts.items() if w != b"\n")
    least, taken = math.inf, 0
    for n in sorted(ranked, reverse=True):
        taken += ranked[n]
        if taken > own:
            break
        least = n
    mine = [b"\n", *sorted((w for w, n in counts.items() if n >= least and w != b"\n"), key=lambda w: (-counts[w], w))]
    name = lambda w: mine.index(w) if w in mine else len(mine) + zlib.crc32(w[-3:]) % shared
    inside, kinds = collections.Counter(), collections.Counter()
    for w, n in counts.items():
        inside[name(w)] += n
        kinds[name(w)] += 1
    share = np.array([inside[k] + 1 for k in range(len(mine) + shared)]) / (total + len(mine) + shared)
    codes = [np.array([name(w) for w in t], np.uint16) for _, t in texts]
    learned = [p for (k, _), c in zip(texts, codes) if not held(k) for p in hmm.pieces(c)]
    model = hmm.first(share, 2)
    for _ in range(3):
        model = hmm.maximise(hmm.expect(model, learned, [True] * len(learned)), share)
    want = []
    for (k, t), c in zip(texts, codes):
        forward = model.start * model.emit[c[0]]
        log = 0.0
        for x in c[1:]:
            log, forward = log + math.log10(forward.sum()), (forward / forward.sum()) @ model.move * model.emit[x]
        log += math.log10(forward.sum())
        log += sum(math.log10((counts[w] + 1) / (inside[x] + kinds[x] + 1)) for w, x in zip(t, c) if x >= len(mine))
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t)
        want.append((k, held(k), len(t), sum(w in counts for w in t), total, base, log))
    want.sort(key=repr)
    by = lambda rows: collections.Counter(r[:5] for r in rows)
    assert by(got) == by(want)
    for place in (5, 6):
        assert np.allclose(sorted(r[place] for r in got), sorted(r[place] for r in want), atol=1e-4)


def test_empty_tables_and_no_training_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(one, F.lit(True)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0.0) and got[1].score < got[2].score < 0


def test_long_texts_are_scored_whole(spark):
    long = "a b " * 30000
    docs = spark.createDataFrame([(k, long if k == 0 else "a b a b") for k in range(30)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.lit(False), states=2, rounds=1).collect()}
    # Two words by turns: a little over log10(2) a word.
    assert got[0].n_tokens == 60001 and -18500 < got[0].score < -17500
