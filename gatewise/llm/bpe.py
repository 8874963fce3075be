"""Byte-level BPE ids, for the operators that count or pack tokens.

The ids are those of the public ``byte_bpe_50k.json`` under ``tokenizers``.
The same vocabulary as a rank file under ``tiktoken`` gives the same ids about
four times as fast, so texts in Latin letters, ASCII signs, blanks and line
feeds go that way; a text with any other character, where the two libraries'
character classes may differ, or with the text of a special token, goes
through ``tokenizers`` itself.  ``tests/llm`` compares the two.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

#: Characters outside this range are left to ``tokenizers``.
UNUSUAL = re.compile("[^ -~\n¡-ɏ]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to little-endian 32-bit ids."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path or vocabulary_path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> bytes:
        return self.ids(text).astype("<u4", copy=False).tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text))


@cache
def encoder(path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, ranks_path)
