"""A hidden Markov model over symbols: expected counts, re-estimation and exact likelihoods.

All functions work on many sequences at once, step by step in time: sequences lie in the order
of their falling lengths, so those that go on at a step are the first ones. ``expect`` gives
sums that can be added up over any parts of the data; ``maximise`` makes a model of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols of the sequences that are held at once in training, and in scoring, which keeps none
#: of a sequence's states: many long texts then share their steps.
AT_ONCE = 1 << 17
SCORED_AT_ONCE = 1 << 20
#: Training pieces have so many symbols at most.
PIECE = 512


@dataclass
class Model:
    """``start`` of texts and ``again`` of later pieces (states), ``move`` (states, states) and
    ``emit`` (symbols, states): the probability of a symbol in a state."""

    start: np.ndarray
    again: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.again, self.move.ravel(), self.emit.ravel()])


def shaped(flat: np.ndarray, states: int) -> Model:
    """The parts of a flat vector of sums or probabilities."""
    head = states * (2 + states)
    return Model(flat[:states], flat[states : 2 * states], flat[2 * states : head].reshape(states, states), flat[head:].reshape(-1, states))


def first(share: np.ndarray, states: int, seed: int = 1, stay: float = 0.9) -> Model:
    """A model to begin with: states tend to stay, and differ by chance in what they emit around
    the symbols' ``share`` of the corpus."""
    chance = np.random.default_rng(seed).normal(size=(len(share), states))
    emit = share[:, None] * np.exp(0.5 * chance)
    even = np.full(states, 1 / states)
    move = np.full((states, states), (1 - stay) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    return Model(even, even, move, emit / emit.sum(axis=0))


def maximise(sums: Model, share: np.ndarray, prior: float = 1000.0, least: float = 1.0) -> Model:
    """The model of expected counts: emissions with ``prior`` counts of the symbols' ``share``,
    starts and moves with ``least`` counts each."""
    emit = sums.emit + prior * share[:, None]
    rows = lambda x: (x + least) / (x + least).sum(axis=-1, keepdims=True)
    return Model(rows(sums.start), rows(sums.again), rows(sums.move), emit / emit.sum(axis=0))


def _laid_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols by time, offsets of the times) of sequences that have symbols."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    active = np.bincount(sizes, minlength=sizes[0] + 1)[::-1].cumsum()[::-1][1:]
    offsets = np.concatenate([[0], active.cumsum()])
    begins = np.concatenate([[0], sizes.cumsum()[:-1]])
    place = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes)
    place = offsets.astype(np.int32)[place]
    place += np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    by_time = np.empty(sizes.sum(), sequences[0].dtype)
    by_time[place] = np.concatenate([sequences[i] for i in order])
    return order, by_time, offsets


def _groups(sequences: list[np.ndarray], most: int):
    """Runs of sequences, of falling length, of about ``most`` symbols."""
    places = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    held, size = [], 0
    for i in places:
        held.append(i)
        size += len(sequences[i])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each sequence's probability, by the scaled forward recursion."""
    told = np.zeros(len(sequences))
    move, emit = model.move.astype(np.float64), model.emit.astype(np.float64)
    for group in _groups(sequences, SCORED_AT_ONCE):
        order, symbols, offsets = _laid_out([sequences[i] for i in group])
        places = np.array(group)[order]
        sums = np.zeros(len(places))
        now = np.broadcast_to(model.start, (len(places), model.states))
        for t in range(len(offsets) - 1):
            at, end = offsets[t], offsets[t + 1]
            now = now[: end - at]
            now = (now @ move if t else now) * emit[symbols[at:end]]
            scale = now.sum(axis=1)
            now = now / scale[:, None]
            sums[: end - at] += np.log(scale)
        told[places] = sums
    return told


def pieces(sequence: np.ndarray) -> list[np.ndarray]:
    """A sequence in pieces of ``PIECE`` symbols, the last one shorter."""
    return [sequence[at : at + PIECE] for at in range(0, len(sequence), PIECE)]


def expect(model: Model, sequences: list[np.ndarray], begins: list[bool]) -> Model:
    """Expected counts of pieces of texts; ``begins`` tells which of them begin a text."""
    sums = Model(*(np.zeros_like(x, dtype=np.float64) for x in (model.start, model.again, model.move, model.emit)))
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    starts = np.stack([model.again, model.start]).astype(np.float32)
    turned = np.ascontiguousarray(move.T)
    for group in _groups(sequences, AT_ONCE):
        order, symbols, offsets = _laid_out([sequences[i] for i in group])
        opens = np.array([begins[i] for i in group])[order].astype(int)
        seen = emit[symbols]
        forward = np.empty_like(seen)
        scales = np.empty((len(seen), 1), np.float32)
        last = len(offsets) - 2
        now = starts[opens]
        for t in range(last + 1):
            at, end = offsets[t], offsets[t + 1]
            now = now[: end - at]
            now = (now @ move if t else now) * seen[at:end]
            scale = now.sum(axis=1, keepdims=True)
            now /= scale
            forward[at:end], scales[at:end] = now, scale
        seen /= scales
        xi = np.zeros_like(move)
        after = np.ones((offsets[last + 1] - offsets[last], model.states), np.float32)
        for t in range(last - 1, -1, -1):
            at, end = offsets[t], offsets[t + 1]
            n = offsets[t + 2] - end
            weighed = seen[end : end + n] * after
            xi += forward[at : at + n].T @ weighed
            forward[end : end + n] *= after
            after = np.ones((end - at, model.states), np.float32)
            after[:n] = weighed @ turned
        forward[: offsets[1]] *= after
        sums.move += move * xi
        first = forward[: offsets[1]]
        sums.start += first[opens == 1].sum(axis=0)
        sums.again += first[opens == 0].sum(axis=0)
        for k in range(model.states):
            sums.emit[:, k] += np.bincount(symbols, forward[:, k], len(emit))
    return sums
