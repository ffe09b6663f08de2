"""Byte-level BPE encoding inside tasks: ids, byte lengths and the vocabulary's own fallback."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Encoding is fastest for short pieces; a text with a longer run of non-space or space goes to
#: the slower encoder, whose time grows linearly in a run's length. Both give the same ids.
_RUN = re.compile(r"\S{4000}|\s{4000}")
_LONG_TEXT = 4000


def default_vocabulary() -> tuple[str, str]:
    """The two files of the vocabulary: as tokenizers JSON and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(json_path, ranks_path)


class Encoder:
    """Encodes whole texts without special tokens: their strings in a text are ordinary text.

    json_path names a tokenizers file. ranks_path may name the same vocabulary as ranks; then
    texts go through that faster encoder, except those with very long runs.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 2, dtype=np.int64)
            for token, rank in ranks.items():
                self.bytes_of[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and (len(text) < _LONG_TEXT or not _RUN.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
