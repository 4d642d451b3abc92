"""Byte-level BPE encoding and decoding with a given vocabulary file.

A word is a doubly linked list of symbols. A priority queue holds the merges its neighbours allow, by rank and then by place; the least is
taken, its two symbols become one, and the new neighbours enter the queue. Entries whose symbols have changed since are stale and skipped,
so a word of n bytes costs n log n, however long it is. Decoding concatenates the strings of the vocabulary.

The vocabulary is read once in the driver and shipped as a broadcast variable; files above ``MOST_BYTES`` are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import col, fresh

MOST_BYTES = 64 << 20
#: words kept in a worker's memory of encoded words, and their greatest length; it saves time only
MEMORY, MEMORY_WORD = 500_000, 64
#: Fixed values of byte-level pre-tokenization: the split pattern, with white space by the Unicode property, and the printable bytes
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _latin() -> tuple[re.Pattern, re.Pattern]:
    """The split pattern for texts of characters below U+0100, and a search for any character that it does not know.

    There the letters, digits and white space are few enough for classes that ``re`` looks up in one table. Numbers other than 0 to 9
    are left to the general pattern.
    """
    kinds = {c: unicodedata.category(c) for c in map(chr, range(256))}
    letters = "".join(re.escape(c) for c, kind in kinds.items() if kind[0] == "L")
    others = "".join(re.escape(c) for c, kind in kinds.items() if kind in ("No", "Nl"))
    space = r"\t-\r \x85\xA0"
    words = rf"'(?:[stmd]|re|ve|ll)| ?(?:[{letters}]+|[0-9]+|[^{space}{letters}0-9]+)|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(words), re.compile(rf"[^\x00-\xFF]|[{others}]")


LATIN_WORDS, NOT_LATIN = _latin()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next letter from 256 on."""
    shown, letters, spare = set(PRINTABLE), [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else spare))
        spare += b not in shown
    return letters


class Memory(dict):
    """Encoded words. When full, the younger words become the older ones, which still answer until it is full again."""

    def __init__(self, merge: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merge(word.encode())
        if len(word) <= MEMORY_WORD:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """One vocabulary: text to ids and back."""

    def __init__(self, spec: bytes) -> None:
        given = json.loads(spec)
        vocab = given["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        #: rank of a pair by its first symbol, then by its second
        self.after: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.made: list[int] = []
        for rank, pair in enumerate(given["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.after[vocab[a]][vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.bytes = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.words = regex.compile(PATTERN)
        self.memory = Memory(self.merge)

    def merge(self, word: bytes) -> bytes:
        """Ids of one word, as 32-bit integers."""
        sym = [self.first[b] for b in word]
        n, after, made = len(sym), self.after, self.made
        # a symbol that is merged away, and the place behind the last one, hold -1, which is in no pair
        sym.append(-1)
        left, right = list(range(-1, n)), list(range(1, n + 2))
        # one integer per entry: the rank in front, the place behind it
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = []
        for i in range(n - 1):
            if (r := after[sym[i]].get(sym[i + 1])) is not None:
                queue.append(r << bits | i)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            i, rank = entry & place, entry >> bits
            s, j = sym[i], right[i]
            if s < 0 or after[s].get(sym[j]) != rank:
                continue  # stale: one of the two has been merged away
            k, new = right[j], made[rank]
            sym[i], sym[j] = new, -1
            right[i], left[k] = k, i
            h = left[i]
            if h >= 0 and (r := after[sym[h]].get(new)) is not None:
                push(queue, r << bits | h)
            if (r := after[new].get(sym[k])) is not None:
                push(queue, r << bits | i)
        return array("i", [s for s in sym if s >= 0]).tobytes()

    def split(self, text: str) -> list[str]:
        """Words by the split pattern."""
        return (self.words if NOT_LATIN.search(text) else LATIN_WORDS).findall(text)

    def encode(self, text: str | None) -> np.ndarray:
        parts = self.cut.split(text or "") if self.cut else [text or ""]
        ids = []
        for part in parts:
            if part in self.special:
                ids.append(np.int32(self.special[part]).tobytes())
            else:
                ids.append(b"".join(map(self.memory.__getitem__, self.split(part))))
        return np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids) -> str:
        """Concatenated strings of the ids; unknown ids add nothing, bytes that are not UTF-8 become U+FFFD."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(spec: bytes) -> Codec:
    return Codec(spec)


class Tokenizer:
    """Columns of ids and texts by the vocabulary file at ``path`` (read in the driver)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as f:
            spec = f.read(MOST_BYTES + 1)
        if len(spec) > MOST_BYTES:
            raise ValueError(f"the vocabulary exceeds {MOST_BYTES} bytes")
        shipped = spark.sparkContext.broadcast(spec)

        @F.pandas_udf("array<int>")
        def encode(text: pd.Series) -> pd.Series:
            codec = _codec(shipped.value)
            return pd.Series([codec.encode(t) for t in text], dtype=object)

        @F.pandas_udf("string")
        def decode(ids: pd.Series) -> pd.Series:
            codec = _codec(shipped.value)
            return pd.Series([None if i is None else codec.decode(i.tolist()) for i in ids], dtype=pd.ArrowDtype(pa.large_string()))

        self._encode, self._decode = encode, decode

    def ids(self, text: Column) -> Column:
        return self._encode(text)

    def text(self, ids: Column) -> Column:
        return self._decode(ids)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column ``ids`` (underscores are added where the name is taken).

    Whole texts, of any length; strings of special tokens in a text become those tokens; a null text is empty; repeated rows
    stay; an empty table gives an empty result. No rows move between tasks.
    """
    return docs.withColumn(fresh(docs, ids), Tokenizer(docs.sparkSession, path).ids(col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids in a new column; null ids give null, ids outside the vocabulary add nothing."""
    return docs.withColumn(fresh(docs, text), Tokenizer(docs.sparkSession, path).text(col(ids)))
