"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of arrays.

Texts are cut at special strings and into pre-tokens. The bytes of all pre-tokens of a batch that are not remembered stand in one ragged array
(symbols and the sequence each belongs to). In every round each sequence applies its lowest-ranked pair at all its places at once;
sequences without a pair that merges leave the array, and the count of their surviving symbols is their count of
tokens. The merge table, fixed by the vocabulary, is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024  # a text of more tokens is over the limit
REMEMBERED = 500_000  # pre-tokens whose counts a task remembers
REMEMBERED_CHARS = 64  # longer pre-tokens are not remembered
CHUNK = 100_000  # pre-tokens held at once
CHUNK_CHARS = 200_000  # characters of new pre-tokens merged at once, which keeps the arrays in the cache; a longer one is merged alone
BATCH_CHARS = 500_000  # a longer text is cut into several lists of pre-tokens
NEVER = np.iinfo(np.int32).max  # the rank of a pair that does not merge

# The pattern that byte-level vocabularies of this kind split texts by. Letters come first here, since most
# pre-tokens are words; no other alternative begins like one.
PRE_TOKENS = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others take
    the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(value) if value in plain else chr(next(others)) for value in range(256)]


class Merges:
    """The merge table: for pairs of symbols the rank and the symbol they become. Symbols 0 to 255 are the bytes."""

    def __init__(self, merges: list[tuple[str, str]], special: list[str]):
        symbols = {letter: number for number, letter in enumerate(byte_letters())}
        for left, right in merges:
            symbols.setdefault(left + right, len(symbols))
        self.size = len(symbols)
        pairs = np.array([symbols[left] * self.size + symbols[right] for left, right in merges], np.int64)
        made = np.array([symbols[left + right] for left, right in merges], np.int32)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.made = made  # by rank
        self.special = special
        byte = np.arange(256)
        self.byte_ranks = self.rank(np.repeat(byte, 256), np.tile(byte, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NEVER) if len(self.pairs) else np.full(len(left), NEVER, np.int32)


def read_merges(path: str) -> Merges:
    """The table of a vocabulary file. Only plain byte-level BPE files are understood."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, added, split = content["model"], content["added_tokens"], content["pre_tokenizer"] or {}
    odd = [token for token in added if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]]
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or content["normalizer"] or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
    return Merges(merges, [token["content"] for token in added])


def surviving(words: list[bytes], merges: Merges) -> np.ndarray:
    """The number of symbols left of each non-empty byte string when no pair merges any more."""
    result = np.fromiter(map(len, words), np.int64, len(words))
    symbol = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    sequence = np.repeat(np.arange(len(words), dtype=np.int32), result)
    rank = np.full(len(symbol), NEVER, np.int32)  # of the pair that starts here
    inner = np.flatnonzero(sequence[:-1] == sequence[1:])
    rank[inner] = merges.byte_ranks[symbol[inner], symbol[inner + 1]]
    while len(symbol):
        first = np.flatnonzero(np.diff(sequence, prepend=np.int32(-1)))
        lengths = np.diff(first, append=len(sequence))
        lowest = np.minimum.reduceat(rank, first)
        result[sequence[first]] = lengths
        live = lowest != NEVER
        if 4 * np.count_nonzero(live) < 3 * len(live):  # sequences that are done leave
            stay = np.repeat(live, lengths)
            symbol, sequence, rank = symbol[stay], sequence[stay], rank[stay]
            lengths, lowest = lengths[live], lowest[live]
        chosen = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != NEVER))
        if not len(chosen):
            break
        # Places of one pair overlap only in a run of equal symbols; there every second place merges, from the left.
        order = np.arange(len(chosen), dtype=np.int64)
        fresh = np.diff(chosen, prepend=-2) != 1
        chosen = chosen[((order - np.maximum.accumulate(np.where(fresh, order, 0))) & 1) == 0]
        symbol[chosen] = merges.made[rank[chosen]]
        rank[chosen] = rank[chosen + 1]  # an end stays an end, other pairs are looked up below
        stay = np.ones(len(symbol), bool)
        stay[chosen + 1] = False
        changed = chosen - np.arange(len(chosen))  # the places once the right halves are gone
        symbol, sequence, rank = symbol[stay], sequence[stay], rank[stay]
        for left in (changed - 1, changed):
            left = left[(left >= 0) & (left + 1 < len(symbol))]
            left = left[sequence[left] == sequence[left + 1]]
            rank[left] = merges.rank(symbol[left], symbol[left + 1])
    return result


class TokenCounter:
    """Counts tokens of texts and remembers the counts of short pre-tokens, up to a bound."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.pattern = regex.compile(PRE_TOKENS)
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in lists, of which a long text has several."""
        for part in self.special.split(text):
            if len(part) <= BATCH_CHARS:
                yield self.pattern.findall(part)
            else:
                found = map(regex.Match.group, self.pattern.finditer(part))
                while some := list(islice(found, CHUNK)):
                    yield some

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens, merged in batches of CHUNK_CHARS characters."""
        found, start, size = {}, 0, 0
        for end, word in enumerate(words, 1):
            size += len(word)
            if size >= CHUNK_CHARS or end == len(words):
                part = words[start:end]
                counts = surviving([word.encode("utf-8", "surrogatepass") for word in part], self.merges)
                found.update(zip(part, counts.tolist()))
                start, size = end, 0
        return found

    def settle(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        """Adds the tokens of held lists of pre-tokens to the totals of their texts."""
        new = set().union(*(words for _, words in held)).difference(self.known)
        self.known.update(self.learn(sorted(new)))
        count = self.known.__getitem__
        for number, words in held:
            totals[number] += sum(map(count, words))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        else:
            for word in new:
                if len(word) > REMEMBERED_CHARS:
                    del self.known[word]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null is an empty text. A special string counts as one token."""
        totals = [len(self.special.findall(text)) if text else 0 for text in texts]
        held, size = [], 0
        for number, text in enumerate(texts):
            for words in self.pre_tokens(text or ""):
                held.append((number, words))
                size += len(words)
                if size >= CHUNK:
                    self.settle(held, totals)
                    held, size = [], 0
        self.settle(held, totals)
        return totals


def token_count(docs: DataFrame, merges: Merges, text: str = "text") -> Column:
    """The number of tokens of a text column; bytes that are not UTF-8 count as replacement characters."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)  # about a megabyte, by the vocabulary

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            texts = [None if raw is None else bytes(raw).decode("utf-8", "replace") for raw in batch]
            yield pd.Series(counter.count(texts), dtype="int64")

    return counted(F.col(text).cast("binary"))


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The documents with n_bytes, n_tokens and over_limit beside their columns, under free names if these are taken. ``path`` is the
    vocabulary file, by default VOCABULARY among the public ones.

    Null and empty texts have no bytes and no tokens. Texts are never cut short. Repeated rows are counted alike; an empty table gives no
    rows.
    """
    size, tokens, over = (free_name(docs, stem) for stem in ("n_bytes", "n_tokens", "over_limit"))
    merges = read_merges(path or public_tokenizers.path(VOCABULARY))
    counted = docs.withColumn(tokens, token_count(docs, merges, text))
    return counted.withColumns(
        {size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), over: F.col(tokens) > limit}
    )
