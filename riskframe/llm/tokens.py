"""Byte-level BPE ids of whole texts.

A text goes to the merger in one call, whatever words it holds, and its ids come
back as one array. Texts that hold a special token's string, and white space too
long for the merger's pattern, are encoded by the tokenizers library.
"""

from __future__ import annotations

import json
import re

import numpy as np


class ByteBpe:
    """Encoder for a byte-level BPE ``tokenizer.json`` whose ids are merge
    ranks. Merging is done by tiktoken over the file's own vocabulary, which
    gives the same ids several times faster; other texts go to the tokenizers
    library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # printable stand-ins of the byte-level alphabet: bytes that print stand for themselves, the rest follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None

    def _ids(self, text: str) -> np.ndarray | list[int]:
        if not (self.special and self.special.search(text)):
            try:
                return self.merge.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except ValueError:  # a million spaces or line ends in a row: the pattern's stack is full
                pass
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.asarray(self._ids(t), "<u4").tobytes() for t in texts]


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The encoder for ``path``, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
