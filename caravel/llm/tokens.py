"""Token ids inside tasks, from files of public tokenizers."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np

#: Vocabulary of the packing operators: the tokenizers file, and the same vocabulary as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _fast(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=4)
def _full(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@functools.lru_cache(maxsize=4)
def _special(file: str) -> tuple[str, ...]:
    """The texts of the file's added tokens; the tokenizer itself, which takes much memory, isn't loaded for them."""
    with open(file, encoding="utf-8") as f:
        text = f.read()
    at = text.index('"added_tokens"') + len('"added_tokens"')
    return tuple(t["content"] for t in json.JSONDecoder().raw_decode(text[at:].lstrip(" :\r\n\t"))[0])


def encode(text: str, tokenizer: str, ranks: str) -> np.ndarray:
    """The ids (uint32) that the tokenizer file gives for a whole text, without added special tokens.

    Plain texts take the faster encoder over the same vocabulary, whose ids
    are equal; a text that spells a special token goes to the tokenizer itself.
    """
    if any(s in text for s in _special(tokenizer)):
        return np.array(_full(tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)
    return _fast(ranks).encode_to_numpy(text, disallowed_special=())


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``size`` but perhaps the first."""
    count = max(1, -(-n // size))
    first = n - size * (count - 1)
    return [(0, first)] + [(first + size * i, size) for i in range(count - 1)]
