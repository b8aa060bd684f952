"""Token ids of texts by a public byte-level tokenizer; the vocabulary's path is a parameter.

Ids are those of the tokenizers library. Plain texts (ASCII and common Latin characters) are encoded whole by the
same vocabulary's ranks, several times as fast; all other texts, texts that spell a special token, and runs of white
space too long for the ranks' pattern go to the tokenizers library itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import public_tokenizers
import tiktoken

SPECIAL = "<|endoftext|>"
ODD = re.compile(r"[^\n\r\t\x20-\x7e\xa1-\xac\xae-ſ‐-‟…€]")
#: The ranks' pattern tracks back over a run of white space, and stops at a million characters.
RUN = 200_000


class Encoder:
    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, plain: bool = False):
        """vocabulary: a tokenizers JSON file; ranks: the same vocabulary for tiktoken; plain: special tokens' strings in a text are plain text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.ending = np.zeros(1 + max(table.values()), bool)
        self.ending[[i for b, i in table.items() if b[-1:] in (b".", b"!", b"?", b"\n")]] = True
        self.exact = None
        self.plain = plain
        self.table = table

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text as 32-bit integers."""
        odd = (SPECIAL in text and not self.plain) or (not text.isascii() and ODD.search(text))
        if not odd and not (len(text) > RUN and any(m.end() - m.start() > RUN for m in re.finditer(r"\s+", text))):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.vocabulary)
            self.exact.encode_special_tokens = self.plain
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")

    def bytes_of(self) -> list[bytes]:
        """The bytes of each id."""
        got = [b""] * (1 + max(self.table.values()))
        for entry, i in self.table.items():
            got[i] = entry
        return got

    def ends_sentence(self, size: int = 50_257) -> np.ndarray:
        """By id, whether a token's text ends with a full stop, a question or exclamation mark, or a line's end."""
        return np.append(self.ending, np.zeros(max(0, size - len(self.ending)), bool))


@functools.lru_cache(maxsize=4)
def shared(vocabulary: str | None = None, ranks: str | None = None, plain: bool = False) -> Encoder:
    """The encoder that the tasks of one Python worker share: it holds nothing of a text, and loading it costs as much as a megabyte of them."""
    return Encoder(vocabulary, ranks, plain)
