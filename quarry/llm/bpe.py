"""Byte-level BPE ids of whole texts, as the tokenizers library gives them for the same vocabulary file.

A pre-token never crosses a space that a non-space character follows, so a text cut there can be encoded word by word:
each distinct word is encoded once and its ids are gathered. Texts with other runs of white space, and texts that hold
a special token's string, are encoded whole. Rank-ordered merging is done by tiktoken with ranks built from the file."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pre-token pattern of byte-level BPE files of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_MADE: dict[int, "Encoder"] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the file: printable bytes as they are, the others from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, file: bytes, most: int = 200_000):
        import tiktoken

        spec = json.loads(file)
        symbols = _byte_symbols()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("add_prefix_space") or spec.get("normalizer") or merged != sorted(merged):
            raise ValueError("not a byte-level BPE file whose ids follow its merges")
        self.special, self.most = [*special], most
        self.enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = np.zeros(max(ranks.values()) + 2, np.int64)
        for b, i in ranks.items():
            self.bytes_of[i] = len(b)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}  # of a word after a space: its place in start and size
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str], size: np.ndarray) -> None:
        """Encodes words, of so many bytes each, as they are after a space."""
        ids = np.array(self.enc.encode_ordinary("".join([" " + w for w in new])), np.uint32)
        stop = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size + 1), "left") + 1
        begin = np.concatenate(([0], stop[:-1]))
        self.start = np.concatenate((self.start, begin + len(self.flat)))
        self.size = np.concatenate((self.size, stop - begin))
        self.flat = np.concatenate((self.flat, ids))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))

    def encode(self, texts: list[str] | pa.Array, most: int = 4_000_000) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit arrays. Texts are split and their distinct words told apart by Arrow,
        about `most` characters at a time."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = column.to_pylist()
        out: list[np.ndarray | None] = [None] * len(texts)
        run, size = [], 0
        for i, t in enumerate(texts):
            if _ODD_SPACE.search(t) or any(s in t for s in self.special):
                out[i] = np.array(self.enc.encode(t, allowed_special="all"), np.uint32)
                continue
            run.append(i)
            size += len(t)
            if size > most:
                self._run(column, run, out)
                run, size = [], 0
        if run:
            self._run(column, run, out)
        return out

    def _run(self, column: pa.Array, run: list[int], out: list) -> None:
        split = pc.split_pattern(column.take(pa.array(run, pa.int64())), " ")
        first = split.offsets.to_numpy()
        known = split.flatten().dictionary_encode()
        which, words, size = known.indices.to_numpy(), known.dictionary.to_pylist(), pc.binary_length(known.dictionary).to_numpy().astype(np.int64)
        get = self.at.get
        at = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.at) + len(new) > self.most:
                self.clear()
                new = np.arange(len(words))
            at[new] = np.arange(len(self.at), len(self.at) + len(new))
            self._learn([words[k] for k in new], size[new])
        heads = [np.array(self.enc.encode_ordinary(words[k]), np.uint32) for k in which[first[:-1]]]
        n = self.size[at][which]
        n[first[:-1]] = 0  # the first word has no space before it
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at][which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = ends[first[1:] - 1]
        begin = 0
        for i, head, stop in zip(run, heads, cut.tolist()):
            out[i] = np.concatenate((head, ids[begin:stop]))
            begin = stop


def encoder(file: bytes) -> Encoder:
    """One encoder for each worker process and file."""
    key = hash(file)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(file)
    return _MADE[key]
