"""Token ids of whole texts by a public byte-level BPE vocabulary, found prefix by prefix."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Where the vocabularies lie; only the driver reads them.
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before merges, part of the vocabulary's definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and token pairs a worker remembers before it starts anew.
REMEMBERED = 1 << 19


class PairRules:
    """Which tokens may stand side by side in an encoding: the vocabulary's merges, taken apart.

    ``spine_right[t]`` lists what stood at the right end of token t, from t itself back to its last byte,
    and ``spine_left[t]`` the same at its left end. A pair (a, b) is possible unless, at some moment while
    both were being built, their touching ends had a merge that was due before either end's own.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merged: dict[tuple[int, int], int] = {}
        self.spine_right: dict[int, tuple[int, ...]] = {}
        self.spine_left: dict[int, tuple[int, ...]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(token) == 1:
                self.spine_right[rank] = self.spine_left[rank] = (rank,)
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a in self.spine_right and b in self.spine_left and a < rank > b and self.possible(a, b):
                    self.merged[a, b] = rank
                    self.spine_right[rank] = (rank, *self.spine_right[b])
                    self.spine_left[rank] = (rank, *self.spine_left[a])
                    break

    def possible(self, a: int, b: int) -> bool:
        right, left = self.spine_right[a], self.spine_left[b]
        i = j = 0
        while True:
            due = self.merged.get((right[i], left[j]))
            # Of equal merges the left one comes first, hence the one strict comparison.
            if due is not None and (i == 0 or due < right[i - 1]) and (j == 0 or due <= left[j - 1]):
                return False
            if i + 1 == len(right):
                if j + 1 == len(left):
                    return True
                j += 1
            elif j + 1 == len(left) or right[i] > left[j]:
                i += 1
            else:
                j += 1


class Encoder:
    """Exact ids of text without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.rules = PairRules(ranks)
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.rules.spine_left:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _fits(self, a: int, b: int) -> bool:
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            out = self.pairs[a, b] = self.rules.possible(a, b)
        return out

    def word(self, word: str) -> list[int]:
        """The one valid last token of every prefix, then the way back from the whole word."""
        raw = word.encode("utf-8")
        last, size = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for at, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            end, start = at + 1, at + 1 - length
            if last[end] < 0 and (start == 0 or (last[start] >= 0 and self._fits(last[start], token))):
                last[end], size[end] = token, length
        out, end = [], len(raw)
        while end:
            if last[end] < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """NULL and empty texts give no ids."""
        out: list[int] = []
        if text:
            known = self.known
            for w in self.words.findall(text):
                ids = known.get(w)
                if ids is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ids = self.word(w)
                    if len(w) <= 64:
                        known[w] = ids
                out += ids
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file's lines: a token in base64 and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


@lru_cache(maxsize=2)
def _encoder(digest: str, raw: bytes) -> Encoder:
    return Encoder(read_ranks(raw))


def encoded(df: DataFrame, text: str, out: str = "ids", vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with ``out``: the list of token ids of each whole text, without special tokens.

    NULL and empty texts give the empty list; special tokens' strings are ordinary text. The file is read
    by the driver and sent once to each executor (its size is fixed); each worker builds its automaton once.
    The ids are a column function of the text: nothing is shuffled.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    sent = df.sparkSession.sparkContext.broadcast(raw)
    digest = hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(digest, sent.value)
        for batch in batches:
            ids = [np.array(encoder.encode(t), np.int32) for t in batch.to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return df.withColumn(out, arrow_udf(run, "array<int>")(F.col(text)))
