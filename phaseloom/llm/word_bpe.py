"""Operator 6, BPE encoding and decoding, by backtracking.

An Aho-Corasick automaton over the vocabulary finds all tokens in a word; the longest that starts at each place is tried
first. Two tokens may stand side by side only if the merges of their texts, taken together, leave the border between them;
that is looked up in a pair-compatibility table, filled as pairs are met. Where no token fits, the encoder steps back and
takes the next shorter prefix of the token before. A place once found dead isn't tried again, so time is linear in the
word, and the result is that of applying the merges in their order. Decoding copies each id's stretch of one blob of token
texts, found in an offset table.

Words repeat, so their ids are kept in a bounded cache; a text is split at white space first and each part looked up.

Null and empty texts give no ids. Repeated rows are encoded each. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Parts of texts kept in a worker's cache before it starts afresh.
CACHE = 300_000
_END = ""  # stands for the end-of-word mark, one character


def _byte_letters() -> list[str]:
    """The letter for each byte: printable ones stand for themselves, the others for letters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizers file with BPE, an end-of-word mark, and lower-cased words."""

    def __init__(self, path: str) -> None:
        told = json.load(open(path, encoding="utf-8"))
        model = told["model"]
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Rank of a token: base letters first, then in order of the merges.
        made = {a + b: k for k, (a, b) in enumerate(merges)}
        base = sorted((t for t in vocab if t not in made and t not in self.special), key=vocab.get)
        names = base + sorted(made, key=made.get)
        rank = {t: k for k, t in enumerate(names)}
        self.id_of = np.array([vocab[t] for t in names], "<u4")
        self.halves = [(k, k) for k in range(len(base))] + [(0, 0)] * len(made)
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            self.joined[rank[a], rank[b]] = rank[a + b]
            self.halves[rank[a + b]] = rank[a], rank[b]
        texts = [t.removesuffix(mark) + _END if t.endswith(mark) and t != mark else t for t in names]
        # the end mark belongs to the letter before it, so a token's length counts letters
        self.size = [len(t) - t.endswith(_END) for t in texts]
        self.fits: dict[tuple[int, int], bool] = {}
        self.find = ahocorasick.Automaton()
        #: Only tokens into which their own text is merged can occur.
        rank_of = {t: k for k, t in enumerate(texts) if self.halves[k][0] == k or self.compatible(*self.halves[k], k)}
        for t, k in rank_of.items():
            self.find.add_word(t, k)
        self.find.make_automaton()
        #: The next shorter prefix of a token; one that ends the word has prefixes that don't.
        self.shorter = [next((rank_of[t[:cut]] for cut in range(self.size[k] - 1, 0, -1) if t[:cut] in rank_of), -1) for k, t in enumerate(texts)]
        # the offset table: token texts end to end, each with the space that joins tokens
        shown = {i: t for t, i in {**vocab, **self.special}.items()}
        blob = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.blob, self.offsets = b"".join(blob), np.concatenate([[0], np.cumsum([len(b) for b in blob])]).tolist()
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.word_cache: dict[str, tuple[bytes, bytes]] = {}

    def compatible(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether merging the texts of a and b leaves the border between them.

        Merges are undone from the last back; a merge across the border that is due before the one last undone, or at
        first before ``limit``, would have been made.
        """
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if self.halves[max(a, b)][0] == max(a, b):
                return True  # both are single letters, as these have the lowest ranks
            if a > b:
                limit, a = a, self.halves[a][1]
            else:
                limit, b = b + 1, self.halves[b][0]

    def fit(self, a: int, b: int) -> bool:
        """The pair-compatibility table."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.compatible(a, b)
        return found

    def ranks(self, word: str) -> list[int]:
        """Tokens of one word, given as letters of its bytes."""
        n = len(word)
        longest = [-1] * n
        size = self.size
        best = [0] * n
        for end, k in self.find.iter(word + _END):
            m = size[k]
            start = end - m + (end < n)
            # what covers the word's last letter must have the end mark
            if end != n - 1 and m > best[start]:
                best[start], longest[start] = m, k
        out: list[int] = []
        alive = [True] * (n + 1)
        at, k = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while k >= 0 and not (alive[at + size[k]] and (last < 0 or self.fit(last, k))):
                k = self.shorter[k]
            if k >= 0:
                out.append(k)
                at += size[k]
                k = longest[at] if at < n else -1
            else:
                alive[at] = False
                k = out.pop()
                at -= size[k]
        return out

    def word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a pre-token, little-endian, and their decoded text with a space at the end."""
        found = self.word_cache.get(word)
        if found is None:
            if len(self.word_cache) >= CACHE:
                self.word_cache.clear()
            ids = self.id_of[self.ranks("".join([self.letters[b] for b in word.encode()]))]
            found = self.word_cache[word] = ids.tobytes(), self.decoded(ids.tolist())
        return found

    def decoded(self, ids: list[int]) -> bytes:
        """Texts of ids from the offset table, a space after each."""
        blob, at = self.blob, self.offsets
        return b"".join([blob[at[i] : at[i + 1]] for i in ids])

    def part(self, part: str) -> tuple[bytes, bytes]:
        """As word(), for a stretch without white space."""
        found = self.cache.get(part)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            normal = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            made = [self.word(w) for w in self.words(normal)]
            found = self.cache[part] = b"".join([a for a, _ in made]), b"".join([b for _, b in made])
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a whole text, little-endian, and the text decoded from them."""
        if "<|" in text and self.split_special.search(text):
            made = []
            for piece in self.split_special.split(text):
                if piece in self.special:
                    k = self.special[piece]
                    made.append((np.array([k], "<u4").tobytes(), self.decoded([k])))
                else:
                    made += [self.part(p) for p in self._parts(piece)]
        else:
            made = [self.part(p) for p in self._parts(text)]
        return b"".join([a for a, _ in made]), b"".join([b for _, b in made])[:-1]

    _odd = regex.compile("[\x1c-\x1f]")
    _runs = regex.compile(r"\S+")

    def _parts(self, text: str) -> list[str]:
        # str.split() takes four control characters for white space that the vocabulary's pattern doesn't
        return self._runs.findall(text) if self._odd.search(text) else text.split()


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """This worker's encoder."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text; with_ids: the ids and the text too. No shuffle."""
    more = ", ids binary, decoded string" if with_ids else ""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = loaded(public_tokenizers.path(vocabulary))
        for row in range(0, batch.num_rows, 500):
            made = [bpe.encode(x) for x in batch.column(1).slice(row, 500).to_pylist()]
            out = {
                "doc_id": batch.column(0).slice(row, 500),
                "n_tokens": np.array([len(a) // 4 for a, _ in made], np.int64),
                "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in made],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in made],
            }
            yield out | ({"ids": [a for a, _ in made], "decoded": [b.decode() for _, b in made]} if with_ids else {})

    return C.in_arrow(C.texts(df, id_col, text_col), work, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every whole text of ``documents``."""
    return encode_documents(C.table(spark, sf_dir, "documents"))
