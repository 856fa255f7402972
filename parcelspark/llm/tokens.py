"""Exact byte-level BPE over whole texts, and their pieces.

A space with a non-space on both sides always begins a pre-token, and no
pre-token looks past it, so the pieces between such spaces encode independently
of each other.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, "Encoder"] = {}


def ranks_path(tokenizer: str) -> str:
    """Path of the rank file with the same vocabulary as the given tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(tokenizer.replace(".json", ".tiktoken"))


class Encoder:
    """ids as the tokenizer file gives them: the texts of its added tokens become their one id."""

    def __init__(self, tokenizer: str = "byte_bpe_50k.json"):
        import public_tokenizers
        import tiktoken

        with open(ranks_path(tokenizer), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on the text around them")
        self._added = {t["content"]: t["id"] for t in added}
        if any(" " in t for t in self._added):
            raise ValueError("added tokens with spaces would lie across pieces")
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self._spaced = np.zeros(max([*ranks.values(), *self._added.values()]) + 1, bool)
        self._spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def ids(self, text: str) -> np.ndarray:
        """ids as little-endian unsigned 32-bit integers."""
        if not any(t in text for t in self._added):
            return np.array(self._bpe.encode_ordinary(text), "<u4")
        parts = self._split.split(text)  # every second part is an added token
        return np.concatenate([np.array([self._added[p]] if i % 2 else self._bpe.encode_ordinary(p), "<u4") for i, p in enumerate(parts)])

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def pieces(self, text: str) -> tuple[list[str], np.ndarray]:
        """Pieces that encode independently (all but the first without their leading space), and their token counts."""
        if not text:
            return [], np.zeros(0, np.int64)
        parts = text.split(" ")
        if not ("" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts)):
            ids = self.ids(text)
            cuts = np.flatnonzero(self._spaced[ids])
            if len(cuts) == len(parts) - 1:
                return parts, np.diff(np.concatenate([[0], cuts, [len(ids)]]))
        parts = _SAFE.split(text)
        return parts, np.array([self.count(p if i == 0 else " " + p) for i, p in enumerate(parts)], np.int64)


def encoder(tokenizer: str = "byte_bpe_50k.json") -> Encoder:
    """One encoder for each worker process."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]
