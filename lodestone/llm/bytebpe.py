"""Token ids of the public byte-level BPE vocabulary, as the tokenizers library gives them.

The same vocabulary and merges are read into tiktoken, which is several times faster.  The two libraries split text by
the same pattern, but by their own tables of letters, digits and white space; texts with characters beyond the blocks
checked in the tests go to the tokenizers library itself.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: A character outside the Latin blocks, punctuation and currency, or one that the libraries' patterns may class otherwise.
_OTHER = re.compile("[^\\x00-\\u024F\\u2010-\\u2027\\u2030-\\u205E\\u20A0-\\u20BF]|[\\x1c-\\x1f\\x85]")
#: Fixed value: the pattern that the vocabulary's pre-tokenizer splits text by.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _symbols() -> dict[str, int]:
    """The byte that each printable symbol of the file stands for: printable Latin-1 is itself, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts with the vocabulary at path."""

    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        byte = _symbols()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in self.slow.get_vocab(with_added_tokens=False).items() if piece not in added}
        self.special = set(added)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        """The ids of text; special strings in it are special tokens, as is the library's default."""
        if _OTHER.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if any(x in text for x in self.special):
            return np.array(self.fast.encode(text, allowed_special=self.special), np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder a process."""
    return Encoder(path or vocabulary_path())
