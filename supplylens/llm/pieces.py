"""Distinct pieces of texts, and a worker's memory of what was worked out for them."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from supplylens.llm import textarrays as T

_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True


def after_letters(data: np.ndarray) -> np.ndarray:
    """Places right after a sign that is no white space: printable ASCII, or two bytes that begin with C3."""
    out = np.zeros(len(data), bool)
    out[1:] = _ASCII[data[:-1]]
    out[2:] |= data[:-2] == 0xC3
    return out


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces of ``data`` cut at ``starts`` (the first is 0), and which of them each piece is.

    Pieces are told apart by their bytes.
    """
    if not len(starts):
        return [], np.empty(0, np.int64)
    found = T.binary_array(data, np.append(starts, len(data))).dictionary_encode()
    _, bounds, raw = found.dictionary.buffers()
    raw, at = raw.to_pybytes(), np.frombuffer(bounds, np.int32)[:len(found.dictionary) + 1].tolist()
    return [raw[i:j] for i, j in zip(at[:-1], at[1:])], found.indices.to_numpy()


class Memory:
    """What ``work`` gives for pieces, each worked out once while it is remembered.

    Pieces over ``longest`` bytes are not remembered. When ``limit`` pieces are new, those not
    asked for since the last time go, so the common ones stay.
    """

    def __init__(self, work: Callable[[list[bytes]], list], limit: int = 1 << 17, longest: int = 128):
        self._work, self._limit, self._longest = work, limit, longest
        self._new: dict[bytes, object] = {}
        self._old: dict[bytes, object] = {}

    def values(self, pieces: list[bytes]) -> list:
        new, old = self._new, self._old
        out = list(map(new.get, pieces))
        absent = [i for i, value in enumerate(out) if value is None]
        missing = []
        for i, value in zip(absent, map(old.get, [pieces[i] for i in absent])):
            if value is None:
                missing.append(i)
            else:
                out[i] = new[pieces[i]] = value
        if missing:
            asked = [pieces[i] for i in missing]
            found = self._work(asked)
            for i, value in zip(missing, found, strict=True):
                out[i] = value
            new.update((p, value) for p, value in zip(asked, found) if len(p) <= self._longest)
        if len(new) > self._limit:
            self._new, self._old = {}, new
        return out


#: Fixed value: the pattern by which byte-level vocabularies of this family cut a text before they merge.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: its own if printable, else one past 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer file: the bytes of each id, and the ids of many pieces at once.

    Where the file's merges are in the order of their ids, a rank-based encoder with the file's
    own vocabulary gives the same ids faster; it takes many pieces as one text, as none of them
    can join the one before. ``plain`` counts strings of special tokens as ordinary text.
    """

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = plain
        said = json.loads(self._whole.to_str())
        signs = byte_signs()
        self.bytes = [b""] * self._whole.get_vocab_size()
        for token, i in self._whole.get_vocab().items():
            self.bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self._special = [] if plain else [t["content"].encode() for t in said["added_tokens"]]
        vocabulary, added = said["model"]["vocab"], {t["id"] for t in said["added_tokens"]}
        merges = [m if isinstance(m, str) else "".join(m) for m in said["model"]["merges"]]
        ranked = [vocabulary[m.replace(" ", "")] for m in merges] == list(range(256, 256 + len(merges)))
        known = (said["normalizer"] is None and said["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": said["pre_tokenizer"].get("trim_offsets"), "use_regex": True})
        self._fast = None
        if ranked and known:
            import tiktoken
            ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in added}
            self._fast = tiktoken.Encoding("file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _alone(self, pieces: list[bytes]) -> list[int]:
        """Pieces that must be encoded by themselves: their ends could join a neighbour, or they are long or special."""
        if self._fast is None:
            return list(range(len(pieces)))
        text = b"".join(pieces)
        data, size = np.frombuffer(text, np.uint8), np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(size)
        last, before, first = data[ends - 1], data[np.maximum(ends - 2, 0)], data[ends - size]
        clean = (_ASCII[last] | ((before == 0xC3) & (size > 1))) & ((first == 0x20) | (first == 0x0A)) & (size <= 4096)
        for mark in self._special:
            if mark in text:
                clean &= np.array([mark not in p for p in pieces], bool)
        return np.flatnonzero(~clean).tolist()

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (none is empty), one after another, and their bounds."""
        alone = self._alone(pieces)
        rest = sorted(set(range(len(pieces))) - set(alone)) if alone else list(range(len(pieces)))
        joined = b"".join([pieces[i] for i in rest])
        try:
            found = np.array(self._fast.encode_ordinary(joined.decode()) if rest else [], np.uint32)
        except UnicodeDecodeError:
            alone, rest, found = list(range(len(pieces))), [], np.empty(0, np.uint32)
        ends = np.cumsum(self.sizes[found])
        size = np.zeros(len(pieces), np.int64)
        stops = np.searchsorted(ends, np.cumsum([len(pieces[i]) for i in rest]), "left") + 1 if rest else np.empty(0, np.int64)
        size[rest] = np.diff(stops, prepend=0)
        singles = [e.ids for e in self._whole.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in alone], add_special_tokens=False)]
        size[alone] = [len(x) for x in singles]
        bounds = np.concatenate([[0], np.cumsum(size)])
        if not alone:
            return found, bounds
        ids, own = np.zeros(bounds[-1], np.uint32), np.ones(bounds[-1], bool)
        for i, x in zip(alone, singles, strict=True):
            ids[bounds[i]:bounds[i + 1]] = x
            own[bounds[i]:bounds[i + 1]] = False
        ids[own] = found
        return ids, bounds
