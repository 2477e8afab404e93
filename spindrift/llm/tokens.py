"""Token ids by public vocabularies, inside tasks."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Texts whose UTF-8 bytes all lie below this lead byte hold code points under
#: U+0240 only; for these both libraries split words alike, and ranks are faster.
PLAIN_BELOW = 0xC9


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _tokenizer(vocabulary: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=4)
def _special(vocabulary: str) -> tuple[bytes, ...]:
    """Strings in a text that the vocabulary reads as one token of its own."""
    return tuple(t.content.encode() for t in _tokenizer(vocabulary).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def _ranks(vocabulary: str):
    """The same vocabulary as ranks, if its rank file lies beside it."""
    import os

    path = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: bytes, vocabulary: str) -> np.ndarray:
    """Ids (uint32) of one UTF-8 text as tokenizers gives them; nothing is put
    around it, and a special string inside it is its special id."""
    ranks = _ranks(vocabulary)
    if ranks is not None and (not text or np.frombuffer(text, np.uint8).max() < PLAIN_BELOW) and not any(s in text for s in _special(vocabulary)):
        return np.array(ranks.encode_ordinary(text.decode()), dtype=np.uint32)
    return np.array(_tokenizer(vocabulary).encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)
