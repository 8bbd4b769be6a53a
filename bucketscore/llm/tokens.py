"""Token ids of whole texts under the byte-level vocabulary of 50,257 entries.

The ids are those that ``tokenizers`` gives for ``byte_bpe_50k.json`` without added special tokens.
The same vocabulary as ranks (``byte_bpe_50k.tiktoken``) gives them several times faster, word by
word: the pattern that splits a text never lets a piece run across a single space between two
other characters, so a text is cut there and the ids of frequent words are kept. Texts with the
vocabulary's own special string, which the ranks do not know, go to ``tokenizers`` whole.
"""

from __future__ import annotations

import array
import base64
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache

END_ID = 1
SPECIAL = "<|endoftext|>"
RUN = re.compile(r"\s\s")
#: Words whose ids a worker keeps; when full, the store starts afresh.
KEPT_WORDS = 600_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        self.vocabulary = vocabulary
        self.ranks = None
        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.vocabulary)

    def _packed(self, ids: list[int]) -> bytes:
        return array.array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = self._packed(self.ranks.encode_ordinary(" " + word))
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or SPECIAL in text:
            return self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        # White space other than one character between two others belongs together; then the text
        # is not cut. Kept words but the first have a space before them, which the key leaves out.
        if text[0].isspace() or text[-1].isspace() or RUN.search(text):
            return self._packed(self.ranks.encode_ordinary(text))
        words = text.split(" ")
        first = self._packed(self.ranks.encode_ordinary(words[0]))
        return first + b"".join(map(self.__getitem__, words[1:]))


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary)


@contextmanager
def encoding(vocabulary: str) -> Iterator[Callable[[str], bytes]]:
    """``encode`` for one task. Its words go at the end, since a worker lives on for other stages' tasks."""
    shared = encoder(vocabulary)
    try:
        yield shared.encode
    finally:
        shared.clear()
