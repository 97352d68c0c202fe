"""Token ids of a byte-level BPE as the tokenizers library gives them, fast enough for whole corpora.

White space only ever starts a pre-token of the vocabulary's pattern, so a text may be cut before a space that stands
alone and the parts encoded apart. Parts repeat, so their ids are kept in a bounded cache. Texts with other spacing, or
with a special token in them, are encoded whole.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Parts kept in a worker's cache before it starts afresh.
CACHE = 300_000


class _Parts(dict):
    """Ids, as little-endian unsigned 32-bit integers, of a lead and a part; None if the part can't be encoded apart."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead = encode, lead

    def __missing__(self, part: str) -> bytes | None:
        if len(self) >= CACHE:
            self.clear()
        # a part with white space at an edge, or none at all, belongs to a longer run of white space
        self[part] = ids = np.array(self.encode(self.lead + part), "<u4").tobytes() if part and not part[0].isspace() and not part[-1].isspace() else None
        return ids


class ByteBpe:
    """Encoder of one vocabulary: ``name`` + .json for tokenizers and the same as ranks, ``name`` + .tiktoken."""

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.parts, self.heads = _Parts(self.plain, " "), _Parts(self.plain, "")

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *parts = text.split(" ")
        try:
            return b"".join([self.heads[head], *map(self.parts.__getitem__, parts)])
        except TypeError:
            return np.array(self.plain(text), "<u4").tobytes()


_LOADED: dict[str, ByteBpe] = {}


def loaded(name: str = "byte_bpe_50k") -> ByteBpe:
    """This worker's encoder."""
    if name not in _LOADED:
        _LOADED[name] = ByteBpe(name)
    return _LOADED[name]
