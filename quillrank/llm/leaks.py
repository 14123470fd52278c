"""Held-out texts inside a training corpus, found in suffix arrays of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.lookalike import WORD, form, one_form, unified
from quillrank.runtime import written

#: Words of the corpus in one suffix array, and words of held-out texts sent to the executors at once.
SHARD_WORDS, SENT_WORDS = 400_000, 500_000


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the next ``depth`` words at least (by doubling); equal ones by position."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
        if rank.max() + 1 == len(rank):
            break
    return np.argsort(rank, kind="stable")


def _bounds(shard: np.ndarray, order: np.ndarray, wanted: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted``, where the suffixes that begin with its first ``length`` words lie in ``order``."""
    width = wanted.shape[1]
    padded = np.concatenate([shard, np.full(width, -2, shard.dtype)])
    steps = np.arange(width)
    inside = steps[None, :] < length[:, None]

    def search(past: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            there = padded[order[np.minimum(mid, len(order) - 1)][:, None] + steps]
            unlike = (there != wanted) & inside
            at = unlike.argmax(axis=1)
            rows = np.arange(len(wanted))
            equal = ~unlike[rows, at]
            before = np.where(equal, past, there[rows, at] < wanted[rows, at])
            low = np.where(open_ & before, mid + 1, low)
            high = np.where(open_ & ~before, mid, high)
        return low

    return search(False), search(True)


def _code(word: str) -> int:
    """A word's number in written suffix arrays, above 0; the same in every task."""
    return xxhash.xxh64_intdigest(word) >> 1 | 1


class Held:
    """Held-out texts as word ids, with every suffix that is long enough to count. With ``coded`` ids are those of
    written suffix arrays, else they are numbered here."""

    def __init__(self, units: list[tuple[object, list[str]]], least: int, coded: bool = False) -> None:
        self.ids: dict[str, int] = {}
        number = (lambda x: self.ids.setdefault(x, _code(x))) if coded else (lambda x: self.ids.setdefault(x, len(self.ids)))
        self.keys = [k for k, w in units if w]
        texts = [np.array([number(x) for x in w], np.int64) for _, w in units if w]
        need = [min(least, len(t)) for t in texts]
        self.unit = np.array([u for u, t in enumerate(texts) for _ in range(len(t) - need[u] + 1)], np.int64)
        self.need = np.array([need[u] for u in self.unit], np.int64)
        self.width = max(need, default=1)
        self.flat = np.concatenate([*texts, np.full(self.width, -3)]) if texts else np.zeros(0, np.int64)
        starts = np.cumsum([0, *map(len, texts)])
        self.start = np.array([starts[u] + i for u, t in enumerate(texts) for i in range(len(t) - need[u] + 1)], np.int64)
        self.end, self.first = starts[1:], starts[:-1]
        self.rows = self.flat[self.start[:, None] + np.arange(self.width)] if texts else np.zeros((0, 1), np.int64)

    def search(self, shard: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position in the shard, unit, position in the unit, words in common from there) of every match; the shard's separators are -1."""
        if order is None:
            order = suffix_array(shard, self.width)
            order = order[shard[order] >= 0]  # what no held-out text holds can't begin a match
        if not len(order) or not len(self.rows):
            return (np.zeros(0, np.int64),) * 4
        low, high = _bounds(shard, order, self.rows, self.need)
        many = high - low
        of = np.repeat(np.arange(len(many)), many)
        at = order[np.repeat(low, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
        length = self.need[of].copy()
        there = np.concatenate([shard, [-1]])
        growing = np.arange(len(of))
        while len(growing):  # the longest match from each position
            p, t = at[growing] + length[growing], self.start[of[growing]] + length[growing]
            more = (t < self.end[self.unit[of[growing]]]) & (there[np.minimum(p, len(shard))] == self.flat[t]) & (p < len(shard))
            growing = growing[more]
            length[growing] += 1
        return at, self.unit[of], self.start[of] - self.first[self.unit[of]], length


def _shards(batches: Iterator[pa.RecordBatch], overlap: int, repairs: dict[str, str], number) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, first word in its text, first place, word ids) of several documents with a separator after each; longer
    texts in overlapping pieces."""

    def shard(keys: list, parts: list, begins: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) + 1 for p in parts])
        starts = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), -1, np.int64)
        for s, p in zip(starts, parts, strict=True):
            flat[s : s + len(p)] = p
        return keys, np.array(begins, np.int64), starts, flat

    keys, parts, begins, count = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids = np.array([number(w) for w in WORD.findall(one_form(text, repairs).lower())], np.int64)
            for begin in range(0, max(1, len(ids)), SHARD_WORDS):
                piece = ids[begin : begin + SHARD_WORDS + overlap]
                keys.append(key)
                parts.append(piece)
                begins.append(begin)
                count += len(piece)
                if count >= SHARD_WORDS:
                    yield shard(keys, parts, begins)
                    keys, parts, begins, count = [], [], [], 0
    if parts:
        yield shard(keys, parts, begins)


def _found(held: Held, keys: list, begins: np.ndarray, starts: np.ndarray, flat: np.ndarray, order: np.ndarray | None, schema: pa.Schema) -> pa.RecordBatch:
    """The longest passage of each document and unit, the first of equal ones."""
    at, unit, unit_at, length = held.search(flat, order)
    doc = np.searchsorted(starts, at, "right") - 1
    first = np.lexsort((unit_at, at, -length, unit, doc))
    doc, unit, at, unit_at, length = doc[first], unit[first], at[first], unit_at[first], length[first]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1])] if len(doc) else np.zeros(0, bool)
    doc, unit, at, unit_at, length = doc[new], unit[new], at[new], unit_at[new], length[new]
    columns = {
        "doc": [keys[d] for d in doc], "unit": [held.keys[u] for u in unit], "words": pa.array(length, pa.int32()),
        "doc_at": pa.array(begins[doc] + at - starts[doc], pa.int64()), "unit_at": pa.array(unit_at, pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def _searching(sent, overlap: int, repairs: dict[str, str], schema: pa.Schema):
    """Sorts the suffixes of the documents and looks the held-out ones up, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        get = held.ids.get
        for keys, begins, starts, flat in _shards(batches, overlap, repairs, lambda w: get(w, -4)):
            yield _found(held, keys, begins, starts, flat, None, schema)

    return run


def _indexing(least: int, overlap: int, repairs: dict[str, str], kind: pa.DataType):
    """Suffix arrays of shards, to be written: ``keys, begins, starts, words, suffixes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def number(word: str) -> int:
            if word not in known:
                if len(known) > 1 << 20:
                    known.clear()
                known[word] = _code(word)
            return known[word]

        for keys, begins, starts, flat in _shards(batches, overlap, repairs, number):
            order = suffix_array(flat, least)
            order = order[flat[order] >= 0]
            arrays = [pa.array([keys], pa.list_(kind)), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (begins, starts)], pa.array([flat], pa.list_(pa.int64())), pa.array([order.astype(np.int32)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["keys", "begins", "starts", "words", "suffixes"])

    return run


def _looking_up(sent, schema: pa.Schema):
    """Binary search of a block of held-out texts in written suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                begins, starts, words, order = (batch[c][row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begins", "starts", "words", "suffixes"))
                yield _found(held, batch["keys"][row].as_py(), begins, starts, words, order, schema)

    return run


def leaked(docs: DataFrame, doc: str, text: str, units: DataFrame, unit: str, unit_text: str, least: int = 13) -> DataFrame:
    """``doc, unit, words, doc_at, unit_at``: documents with at least ``least`` consecutive words of a unit, or with all words
    of a shorter one, the length of their longest common passage and the numbers (from 0) of its first word in both,
    the first in the document if several are as long.

    Words are runs of letters and digits in lower case of the texts in one form. Documents that are NULL or
    have no words match nothing; units that are NULL or have no words match nothing; rows with a NULL key
    are left out. Copies of a document under one key count once.

    Each task sorts the suffixes of its documents (shards of a fixed number of words) and looks every suffix
    of the held-out texts up by binary search; documents are not shuffled. Held-out texts go to the executors
    in blocks of at most ``SENT_WORDS`` words. One block is looked up as the suffixes are sorted; for several the
    sorted suffixes are written once and each block is only looked up in them.
    """
    kind_d, kind_u = docs.schema[doc].dataType, units.schema[unit].dataType
    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("key"), F.col(text).alias("text"))
    own = units.where(F.col(unit).isNotNull() & F.col(unit_text).isNotNull()).select(F.col(unit).alias("key"), F.col(unit_text).alias("text"))
    texts, repairs = form(rows, "text", corpus=own.select("text"))
    forms = written(unified(own, "text", "form").select("key", "form").distinct(), "units")
    overlap = (forms.agg(F.max(F.char_length("form"))).first()[0] or 0) // 2 + 1  # a word and its blank are two characters at least
    names = "doc %s, unit %s, words int, doc_at bigint, unit_at int" % (kind_d.simpleString(), kind_u.simpleString())
    schema = pa.schema([("doc", _arrow(kind_d)), ("unit", _arrow(kind_u)), ("words", pa.int32()), ("doc_at", pa.int64()), ("unit_at", pa.int32())])
    send = docs.sparkSession.sparkContext.broadcast
    index: list[DataFrame] = []

    def looked_up(block: list) -> DataFrame:
        if not index:
            made = texts.mapInArrow(_indexing(least, overlap, repairs, _arrow(kind_d)), f"keys array<{kind_d.simpleString()}>, begins array<bigint>, starts array<bigint>, words array<bigint>, suffixes array<int>")
            index.append(written(made, "suffixes"))
        return index[0].mapInArrow(_looking_up(send(Held(block, least, True)), schema), names)

    parts, block, count = [], [], 0
    for row in forms.toLocalIterator():
        words = WORD.findall(row["form"].lower())
        if block and count + len(words) > SENT_WORDS:
            parts.append(looked_up(block))
            block, count = [], 0
        block.append((row["key"], words))
        count += len(words)
    if parts:
        parts.append(looked_up(block))
    else:
        parts.append(texts.mapInArrow(_searching(send(Held(block, least)), overlap, repairs, schema), names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("words", (-F.col("doc_at")).alias("d"), (-F.col("unit_at")).alias("u"))).alias("b")
    return out.groupBy("doc", "unit").agg(best).select("doc", "unit", "b.words", (-F.col("b.d")).alias("doc_at"), (-F.col("b.u")).alias("unit_at"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def without_leaks(docs: DataFrame, doc: str, text: str, units: DataFrame, unit: str, unit_text: str, least: int = 13) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a unit (see :func:`leaked`); rows with a NULL key stay."""
    found = leaked(docs, doc, text, units, unit, unit_text, least).select(F.col("doc").alias("__doc"))
    return docs.join(found, F.col(doc) == F.col("__doc"), "left_anti")
