"""Byte-pair encoding and decoding with a published vocabulary.

A word's symbols form a doubly linked list. A priority queue holds the adjacent pairs that
have a merge, by (rank, position). The best pair merges in place, its neighbours'
new pairs go in, and entries whose symbols have changed since are skipped when they come
up. Decoding joins vocabulary strings as the vocabulary's library does without a
decoder, with one space between tokens.

Words repeat, so that each worker keeps a bounded memory of what it has encoded, in two
generations: what the younger one lacks comes over from the older one, and when the younger is
full it takes the older one's place, so that frequent words are never forgotten. Whole stretches
between white space, which no word crosses, are remembered like words: most of a text costs one
split and one look-up per stretch. Vocabulary and merges travel
as one broadcast of fixed size; executors need not have the file.

Defined cases: null and empty texts encode to no tokens; texts of any length are encoded
whole; repeated rows give repeated results; the strings of special tokens are those tokens;
empty tables give empty results; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import resident

#: Encoded words and stretches between white space in one generation of a worker's memory.
REMEMBERED = 200_000
#: Longer ones are not remembered.
REMEMBERED_LENGTH = 64
#: Bits of a symbol's number within the key of a pair.
_SHIFT = 24
#: Python splits at these, the vocabulary's white space leaves them out.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe:
    """A word-level BPE: lower case, white space dropped, words closed by an end mark."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        letters = byte_letters()
        # Symbols have numbers: those of the vocabulary its ids, the rest what follows.
        self.known_ids = max(self.vocab.values()) + 1
        number = dict(self.vocab)
        for symbol in [*letters.values(), *[s + self.end for s in letters.values()], *[x for left, right in merges for x in (left, right, left + right)]]:
            number.setdefault(symbol, max(self.known_ids, len(number)))
        self.inner = [number[letters[b]] for b in range(256)]
        self.final = [number[letters[b] + self.end] for b in range(256)]
        self.ranks = {number[left] << _SHIFT | number[right]: rank for rank, (left, right) in enumerate(merges)}
        self.whole = [number[left + right] for left, right in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.digits = {i: str(i) for i in self.strings}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word after all merges."""
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            get, whole = self.ranks.get, self.whole
            # The rank of the merge that each symbol has with the next one, or -1.
            due = [get(a << _SHIFT | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
            due.append(-1)
            # An entry is rank * n + position: the lowest rank first, then the leftmost.
            queue = [rank * n + i for i, rank in enumerate(due) if rank >= 0]
            heapify(queue)
            while queue:
                rank, i = divmod(heappop(queue), n)
                if due[i] != rank:
                    continue  # stale: one of the two has merged elsewhere since
                j = after[i]
                symbols[i] = symbol = whole[rank]
                symbols[j] = -1
                after[i], due[j], due[i] = (k := after[j]), -1, -1
                if k < n:
                    before[k] = i
                    if (rank := get(symbol << _SHIFT | symbols[k], -1)) >= 0:
                        due[i] = rank
                        heappush(queue, rank * n + i)
                if (h := before[i]) >= 0:
                    due[h] = rank = get(symbols[h] << _SHIFT | symbol, -1)
                    if rank >= 0:
                        heappush(queue, rank * n + h)
        limit = self.known_ids
        return tuple([s for s in symbols if 0 <= s < limit])

    def _keep(self, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= REMEMBERED_LENGTH:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[key] = ids
        return ids

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        """The ids of what stands between white space, lower-cased."""
        if (ids := self.young.get(stretch)) is not None:  # met earlier in the same text
            return ids
        if (ids := self.old.get(stretch)) is not None:
            return self._keep(stretch, ids)
        words = self.words.findall(stretch)
        if words == [stretch]:
            return self._keep(stretch, self.merge(stretch))
        return self._keep(stretch, tuple([i for word in words for i in self._word(word)]))

    def _word(self, word: str) -> tuple[int, ...]:
        if (ids := self.young.get(word)) is not None:
            return ids
        # A word that would be split further on its own is not looked up as a stretch.
        return self._stretch(word) if self.words.findall(word) == [word] else self.merge(word)

    @staticmethod
    def _lower(text: str) -> str:
        # Letter by letter: no final sigma from its place in a word.
        return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                lower = self._lower(part if part.isascii() else unicodedata.normalize("NFC", part))
                if _NOT_SPACE.search(lower):
                    found = [self._word(word) for word in self.words.findall(lower)]
                else:
                    stretches = lower.split()
                    found = list(map(self.young.get, stretches))
                    if None in found:
                        found = [self._stretch(s) if f is None else f for f, s in zip(found, stretches, strict=True)]
                out += chain.from_iterable(found)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids and of the text that they decode to."""
        ids = self.encode(text)
        written = " ".join(map(self.digits.__getitem__, ids))
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


def _on_executor(shared) -> WordBpe:
    """The worker's tokenizer; its memory outlives a task."""
    return resident(("bpe", shared.id), lambda: WordBpe(json.loads(shared.value)))


class _Shared:
    def __init__(self, spark, path: str):
        ship(spark)
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id = hash(text)
        self.broadcast = spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self.broadcast.value


def encoded(docs: DataFrame, vocabulary: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with token_ids, the array of ids of each whole text."""
    shared = _Shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _on_executor(shared)
        for batch in texts:
            yield pd.Series([bpe.encode(t) for t in batch])

    return docs.withColumn("token_ids", ids(F.col(text_col)))


def decoded(tokens: DataFrame, vocabulary: str, *, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with decoded, the text of each array of ids; null stays null."""
    shared = _Shared(tokens.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _on_executor(shared)
        for batch in batches:
            yield pd.Series([None if ids is None else bpe.decode(ids) for ids in batch])

    return tokens.withColumn("decoded", texts(F.col(ids_col)))


def encoding_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256.

    Each text is encoded and its ids decoded in one pass; only digests leave the task.
    """
    shared = _Shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _on_executor(shared)
        for batch in texts:
            yield pd.DataFrame([bpe.digests(t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(F.col(text_col)).alias("d")).select(id_col, "d.*")
