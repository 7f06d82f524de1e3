"""Token ids of texts by a given byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

#: Ranks of the production vocabulary; ids equal those of ``byte_bpe_50k.json``.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The vocabulary's one special token, as a text and as an id.
SPECIAL = {"<|endoftext|>": 50256}
#: The same vocabulary for the library that ships it, which is slower and takes any text.
WHOLE = public_tokenizers.path("byte_bpe_50k.json")
#: A run of white space that the faster library may give up on; it does from about a million characters on.
_LONG_RUN = re.compile(r"(?<!\s)\s{100000}")


@functools.lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer, loaded once per process."""
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
    )


@functools.lru_cache(maxsize=1)
def whole_tokenizer() -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(WHOLE)


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; a null text is empty.

    As in the library that ships the vocabulary, the special token's string stands for its id.
    """
    if not text:
        return np.zeros(0, np.uint32)
    if vocabulary == VOCABULARY and len(text) >= 100000 and _LONG_RUN.search(text):
        return np.array(whole_tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)
    return encoding(vocabulary).encode_to_numpy(text, allowed_special="all")
