"""Token ids of whole texts by a byte-level BPE vocabulary file.

The ids are those of the tokenizers library for the file. Texts of plain Latin characters
take a shorter way to the same ids: byte-level BPE splits a text by a pattern and merges
within each part, so a batch of texts is parted at single spaces and its distinct words are
looked up, or merged by the same ranks, once each; the ids of the texts are then gathered by
place from a pool of the words' ids. Any text with other characters, or with the text of a
special token in it, goes through the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level BPE of this family parts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Anything but the characters on which all regular expression engines agree.
ODD = "[^\t\n\r -~¡-¬®-ɏ]"
#: Words kept between batches; beyond that the pool starts again.
CACHE_WORDS = 400_000
#: Bytes of text that are encoded at once, unless one text is longer.
GROUP_BYTES = 8 << 20

_loaded: dict[str, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file: printable ones for
    themselves, the others, in order, for the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.odd = re.compile("|".join([ODD, *map(re.escape, self.special)]))
        # The same for a whole column, with the texts in which blanks meet.
        self.slow = "|".join([ODD, r"[\t\n\r ][\t\n\r ]", *map(re.escape, self.special)])
        self.merges = self._merges(spec)
        if self.merges is not None:
            tokens = (self.merges.decode_single_token_bytes(k) for k in range(self.merges.n_vocab))
            self.blank_first = np.array([t.startswith(b" ") for t in tokens])
        self._forget()

    def _forget(self) -> None:
        self.first: dict[str, int] = {}
        self.after: dict[str, int] = {}
        self.pool, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32)
        self.runs = 0

    def _merges(self, spec: dict) -> tiktoken.Encoding | None:
        """The same merges by rank, if the file is of the plain kind and its ids are ranks."""
        parts, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = parts.get("type") == "ByteLevel" and parts.get("use_regex") and not parts.get("add_prefix_space")
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
        if not plain or spec.get("normalizer") or model.get("type") != "BPE" or any(odd) or model.get("ignore_merges"):
            return None
        bytes_of, special = _byte_of(), set(self.special)
        ranks = {bytes(bytes_of[c] for c in w): n for w, n in model["vocab"].items() if w not in special}
        for n, pair in enumerate(model["merges"]):
            merged = "".join(pair if isinstance(pair, list) else pair.split(" "))
            if model["vocab"].get(merged) != 256 + n:
                return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Put runs of ids into the pool; the place of the first."""
        first, used = self.runs, int(self.ends[self.runs])
        self.runs += len(sizes)
        for name, n in (("pool", used + len(ids)), ("ends", self.runs + 1)):
            held = getattr(self, name)
            if n > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(n, 2 * len(held)) - len(held), held.dtype)]))
        self.pool[used : used + len(ids)] = ids
        self.ends[first + 1 : self.runs + 1] = used + np.cumsum(sizes)
        return first

    def _after_blank(self, words: list[str]) -> np.ndarray:
        """Places of words that follow a blank. Unknown ones are merged together: a token that
        starts with a blank starts a word, as no word holds one."""
        known = self.after.get
        places = np.array([known(w, -1) for w in words], np.int32)
        new = np.flatnonzero(places < 0).tolist()
        if new:
            unknown = [words[k] for k in new]
            ids = self.merges.encode_to_numpy(" " + " ".join(unknown), disallowed_special=())
            starts = np.flatnonzero(self.blank_first[ids])
            at = self._keep(ids, np.diff(starts, append=len(ids)))
            places[new] = np.arange(at, at + len(new))
            self.after.update(zip(unknown, range(at, at + len(new))))
        return places

    def _heads(self, words: list[str]) -> np.ndarray:
        """Places of the words that texts start with."""
        for word in words:
            if word not in self.first:
                ids = self.merges.encode_ordinary(word)
                self.first[word] = self._keep(np.array(ids, np.uint32), np.array([len(ids)]))
        return np.array([self.first[w] for w in words], np.int32)

    def whole(self, text: str) -> list[int]:
        """The ids of one text, without words kept."""
        if self.merges is None or self.odd.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.merges.encode_ordinary(text)

    def _by_words(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of plain texts, one after the other, each followed by ``end``."""
        if len(self.after) + len(self.first) > CACHE_WORDS:
            self._forget()
        parted = pc.split_pattern(texts, " ")
        edges = np.asarray(parted.offsets)
        starts, stops = edges[:-1] - edges[0], edges[1:] - edges[0]
        words = parted.flatten().dictionary_encode()
        # A text's first word has no blank before it, so it is no word of the others.
        inner = np.ones(len(words), bool)
        inner[starts] = False
        codes = np.asarray(words.indices)
        used = np.zeros(len(words.dictionary), bool)
        used[codes[inner]] = True
        place_of = np.zeros(len(used), np.int32)
        place_of[used] = self._after_blank(words.dictionary.filter(pa.array(used)).to_pylist())
        place = place_of[codes]
        place[starts] = self._heads(pc.list_element(parted, 0).to_pylist())
        place = np.insert(place, stops, self._keep(np.array(end, np.uint32), np.array([len(end)])))
        sizes = self.ends[place + 1] - self.ends[place]
        upto = np.cumsum(sizes)
        at = np.arange(int(upto[-1]), dtype=np.int32)
        at += np.repeat((self.ends[place] - (upto - sizes)).astype(np.int32), sizes)
        return self.pool[at].astype("<u4", copy=False), upto[stops + np.arange(len(texts))]

    def encode(self, texts: pa.Array, end: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit, followed by ``end``."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // GROUP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            part = pc.fill_null(texts.slice(a, b - a), "")
            slow = np.ones(b - a, bool)
            if self.merges is not None:
                slow = np.asarray(pc.match_substring_regex(part, self.slow))
            ids, stops = None, iter(())
            if not slow.all():
                ids, ends = self._by_words(part.filter(pa.array(~slow)), list(end))
                stops = iter(ends.tolist())
            at = 0
            for k in range(b - a):
                if slow[k]:
                    yield np.array([*self.whole(part[k].as_py()), *end], dtype="<u4")
                else:
                    stop = next(stops)
                    yield ids[at:stop]
                    at = stop


def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
