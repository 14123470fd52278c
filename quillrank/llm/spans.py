"""Long passages that several documents hold character for character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillrank.llm.neardup import _mixed
from quillrank.operators.skew import pairs_within
from quillrank.runtime import bounded, written

#: Characters hashed at a time by a task.
PIECE = 1 << 19
#: Two bases and two codes of characters: together they make a hash of 128 bits.
_BASES, _CODES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xD6E8FEB86659FD93, 0xAF251AF3B0F025B5)
_POSITION = np.uint64((1 << 24) - 1)


def levels(least: int) -> list[int]:
    """Window lengths, each twice the one before; the longest leaves room for a window to begin late."""
    first = max(1, least * 4 // 25)
    return [first, 2 * first, 4 * first]


class Hashes:
    """Hashes (64 bits) of all windows of the code points of several texts laid end to end; of two kinds."""

    def __init__(self, texts: list[str], kind: int = 0) -> None:
        base = _BASES[kind]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(points)
        self.n = n
        value = _mixed((points + np.uint64(1)) * np.uint64(_CODES[kind]))
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * power[:n], out=self.sums[1:])
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.arange(n) - self.starts[self.doc] if n else np.zeros(0, np.int64)

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[at + length] - self.sums[at]) * self.back[at])


def _least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    reach, out = 1, x
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text number, position and window hashes (one array a level) of the windows that stand for a text.

    Of every ``least - longest + 1`` windows in a row the one with the smallest hash is taken, so two texts
    that share ``least`` characters take a window at the same place in them, with room for the longest level.
    """
    lengths = levels(least)
    width = least - lengths[-1] + 1
    empty = np.zeros(0, np.int64)
    h = Hashes(texts)
    n = h.n - lengths[0] + 1
    if n < width:
        return empty, empty, [np.zeros(0, np.uint64)] * len(lengths)
    key = (h.windows(np.arange(n), lengths[0]) & ~_POSITION) | (_POSITION - (h.at[:n].astype(np.uint64) & _POSITION))
    best = _least_ahead(key, width)
    j = np.flatnonzero(h.at[: len(best)] + width - 1 + lengths[0] <= h.sizes[h.doc[: len(best)]])
    picked = ((_POSITION - (best[j] & _POSITION)).astype(np.int64) - h.at[j]) & int(_POSITION)
    at = j + picked
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new]
    at = at[h.at[at] + lengths[-1] <= h.sizes[h.doc[at]]]
    return h.doc[at], h.at[at], [h.windows(at, size) for size in lengths]


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PIECE:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _marking(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch["text"].to_pylist()
            for begin, end in _pieces(every):
                texts = every[begin:end]
                doc, at, hashes = anchors(texts, least)
                ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(at, pa.int32()))] + [pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].slice(begin, end - begin), pa.array([xxhash.xxh128_digest(t) for t in texts], pa.binary()), *lists],
                    names=["key", "cls", "at", *[f"h{k}" for k in range(len(hashes))]],
                )

    return run


def marked(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``key, cls, at, h0, h1, h2`` of each text of at least ``least`` characters, as a written table.

    ``cls`` is equal for equal texts; ``at`` and the hashes of each level are parallel arrays.
    """
    rows = df.where(F.col(key).isNotNull() & (F.char_length(text) >= least)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    hashes = ", ".join(f"h{k} array<bigint>" for k in range(len(levels(least))))
    return written(rows.mapInArrow(_marking(least), f"key {kind}, cls binary, at array<int>, {hashes}"), "marks")


def _of_several(rows: DataFrame, *names: str) -> DataFrame:
    """Values that more than one class has. Two 64-bit hashes of the class stand for it, so the aggregate hashes too."""
    own = [F.xxhash64("cls").alias("c1"), F.xxhash64("cls", F.lit(1)).alias("c2")]
    ends = [f(c).alias(f"{n}_{c}") for c in ("c1", "c2") for n, f in (("low", F.min), ("high", F.max))]
    return rows.select(*names, *own).groupBy(*names).agg(*ends).where("low_c1 <> high_c1 or low_c2 <> high_c2").select(*names)


def repeated(marks: DataFrame, least: int) -> DataFrame:
    """``cls, at, h`` of the windows of the longest level that different texts share, level by level.

    Only windows that are repeated at one length are looked at with twice the length. The loop ends
    early where none survives.
    """
    names = [f"h{k}" for k in range(len(levels(least)))]
    rows = marks.select("cls", F.explode(F.arrays_zip("at", *names)).alias("m")).select("cls", *[F.col(f"m.{c}").alias(c) for c in ("at", *names)])
    for k, name in enumerate(names):
        twice = written(_of_several(rows, name), "twice")
        rows = written(rows.join(bounded(twice), name, "left_semi").select("cls", "at", *names[k:]).dropDuplicates(["cls", "at"]), "windows")
        if rows.isEmpty():
            break
    return rows.select("cls", "at", F.col(names[-1]).alias("h"))


def _texts(df: DataFrame, key: str, text: str, marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cls, text``: one text for each wanted class."""
    one = written(marks.select("cls", "key").join(bounded(wanted), "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key")), "one")
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(bounded(one), "key").select("cls", "text").dropDuplicates(["cls"])


def _region_windows(least: int, once: bool):
    """All windows of ``least`` characters near the anchors of a text; with ``once`` each content of a text once."""
    room = least - levels(least)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, places = batch["text"].to_pylist(), batch["places"].to_pylist()
            for begin, end in _pieces(every):
                texts = every[begin:end]
                one, two = Hashes(texts), Hashes(texts, 1)
                near = np.zeros(one.n + 1, np.int32)
                for i in range(begin, end):
                    start, size = one.starts[i - begin], one.sizes[i - begin]
                    for p in places[i]:  # a shared window begins at most ``room`` before its anchor, or at a later one
                        near[start + max(0, p - room)] += 1
                        near[start + min(size, p + 1)] -= 1
                ok = (np.cumsum(near[:-1]) > 0) & (one.at + least <= one.sizes[one.doc])
                at = np.flatnonzero(ok)
                h, g, doc = one.windows(at, least), two.windows(at, least), one.doc[at]
                if once and len(at):
                    order = np.lexsort((at, g, h, doc))
                    h, g, doc, at = h[order], g[order], doc[order], at[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]
                    h, g, doc, at = h[new], g[new], doc[new], at[new]
                yield pa.RecordBatch.from_arrays(
                    [batch["cls"].take(pa.array(doc + begin)), pa.array(one.at[at], pa.int32()), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["cls", "at", "h", "g"]
                )

    return run


def _windows(df: DataFrame, key: str, text: str, least: int, once: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marks, ``cls, text`` and ``cls, at, h, g``: the windows of ``least`` characters near repeated ones, hashed (128 bits)."""
    marks = marked(df, key, text, least)
    found = repeated(marks, least)
    places = written(found.groupBy("cls").agg(F.collect_set("at").alias("places")), "places")  # as many as a text has anchors
    texts = written(_texts(df, key, text, marks, places.select("cls")), "texts")
    rows = places.join(texts, "cls").select("cls", "text", "places").mapInArrow(_region_windows(least, once), "cls binary, at int, h bigint, g bigint")
    return marks, texts, written(rows, "regions")


def sharing_pairs(df: DataFrame, key: str, text: str, least: int = 300) -> DataFrame:
    """``key_a, key_b``: two documents that hold the same ``least`` characters in a row, smaller key first.

    Characters are code points, blanks and case included. NULL keys and texts that are NULL or shorter
    match nothing. Equal texts are one class until the end.

    No pairs are made to find the passages: every window of ``least`` characters near a repeated one is hashed and
    counted. Windows that exactly the same texts hold say the same, so one of them stands for all: a passage that many
    documents share gives one group of them, whatever its length. The members of a group are those whose characters there
    are equal; only then are pairs made, between classes, and keys are added last.
    """
    marks, texts, windows = _windows(df, key, text, least, True)
    own = [F.xxhash64("cls").alias("c1"), F.xxhash64("cls", F.lit(1)).alias("c2")]
    each = windows.select("h", "g", *own).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("c1").alias("x1"), F.bit_xor("c2").alias("x2")).where("n > 1")
    chosen = written(each.groupBy("n", "x1", "x2").agg(F.min(F.struct("h", "g")).alias("w")).select("w.h", "w.g"), "chosen")
    members = windows.join(bounded(chosen), ["h", "g"]).select("cls", "at").join(texts, "cls")
    passage = F.unhex(F.sha2(F.substring("text", F.col("at") + 1, F.lit(least)), 256))
    grouped = written(members.select(passage.alias("passage"), "cls").distinct(), "members")
    links = pairs_within(grouped, "passage", "cls").select("a", "b").distinct()
    named = written(marks.select("cls", "key").distinct(), "named")
    copies = pairs_within(named, "cls", "key").select("a", "b")
    k, m = named.select(F.col("cls").alias("a"), F.col("key").alias("k")), named.select(F.col("cls").alias("b"), F.col("key").alias("m"))
    unlike = links.join(k, "a").join(m, "b").select(F.least("k", "m").alias("a"), F.greatest("k", "m").alias("b"))
    return unlike.unionByName(copies).select(F.col("a").alias("key_a"), F.col("b").alias("key_b")).where("key_a <> key_b").distinct()


def _covered(windows: DataFrame) -> DataFrame:
    """``cls, at`` of the windows that several texts hold."""
    twice = written(_of_several(windows, "h", "g"), "twice")
    return windows.join(bounded(twice), ["h", "g"], "left_semi").select("cls", "at").distinct()


def shared_lengths(df: DataFrame, key: str, text: str, least: int = 300) -> DataFrame:
    """``key, n_chars, shared_chars``: how many characters of each document lie in a passage of at least
    ``least`` characters that another document holds too; one row per row with a key.

    NULL texts have NULL characters and 0 shared ones. A text that another document repeats as a whole is
    shared as a whole if it is long enough. No pairs of documents are made: each window of ``least``
    characters near a repeated one is hashed (128 bits) and those of more than one text are united.
    """
    marks, _, windows = _windows(df, key, text, least, False)
    last = F.lag("at").over(W.partitionBy("cls").orderBy("at"))
    part = _covered(windows).withColumn("new", F.least(F.lit(least), F.coalesce(F.col("at") - last, F.lit(least)))).groupBy("cls").agg(F.sum("new").alias("part"))
    copies = marks.select("cls", "key").distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    of_class = marks.select("key", "cls").distinct().join(copies, "cls").join(part, "cls", "left").select(F.col("key").alias("__key"), "copies", "part")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.char_length(text).cast("bigint").alias("n_chars"))
    named = rows.join(of_class, F.col("key") == F.col("__key"), "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("bigint")
    return named.select("key", "n_chars", shared.alias("shared_chars"))


def shared_passages(df: DataFrame, key: str, text: str, least: int = 300) -> DataFrame:
    """``key, begin, end``: the stretches of each document that other documents hold in passages of at least ``least`` characters.

    Offsets are code points, half-open. Passages that overlap or touch are one stretch; a text that another document
    repeats as a whole is one. See :func:`shared_lengths`.
    """
    marks, texts, windows = _windows(df, key, text, least, False)
    named = marks.select("cls", "key").distinct()
    whole = named.groupBy("cls").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("cls")
    w = W.partitionBy("cls").orderBy("at")
    first = F.coalesce(F.col("at") > F.lag("at").over(w) + least, F.lit(True))
    parts = _covered(windows).join(whole, "cls", "left_anti").withColumn("first", first).withColumn("stretch", F.sum(F.col("first").cast("int")).over(w))
    ends = parts.groupBy("cls", "stretch").agg(F.min("at").alias("begin"), (F.max("at") + least).alias("end")).join(named, "cls").select("key", "begin", "end")
    copied = named.join(whole, "cls", "left_semi").select(F.col("key").alias("__key"))
    full = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.char_length(text).alias("end")).join(copied, F.col("key") == F.col("__key"), "left_semi").distinct()
    return ends.unionByName(full.select("key", F.lit(0).alias("begin"), "end"))
