"""Token ids of the public byte-level BPE vocabulary, and the files behind it."""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

#: The pre-tokenizer pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Scripts whose letters, digits and blanks every Unicode version classes alike.
_PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*")


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file, by the published rule."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int], list[bytes]]:
    """Ranks by token bytes, special tokens by text, and the bytes of every id.

    In these files a merged token's id grows with its merge rank, so the id is
    the rank.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    for token in special:
        ranks.pop(token.encode(), None)
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in ranks.items():
        table[i] = token
    for token, i in special.items():
        table[i] = token.encode()
    return ranks, special, table


class FastEncoder:
    """Ids of whole texts as uint32 arrays.

    Texts of Latin scripts go through the compiled merge engine over the same
    vocabulary; any other text goes through the reference tokenizer library,
    since the two may class rare code points differently.
    """

    def __init__(self, path: str) -> None:
        import os

        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks, special, _ = load_vocabulary(path)
        self._path, self._library = path, None
        self._special = set(special)
        self._engine = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text):
            return np.array(self._engine.encode(text, allowed_special=self._special, disallowed_special=()), dtype=np.uint32)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
