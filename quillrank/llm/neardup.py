"""Texts of one scope that differ by small edits, compared by bit planes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.lookalike import WORD, form, one_form
from quillrank.operators.skew import pairs_within
from quillrank.runtime import SENT_ROWS, bounded, written

#: Texts of a group that one task compares; larger groups are cut into pairs of chunks.
GROUP_TEXTS = 4096
#: Words of 64 candidates compared at a time, few enough to stay in the CPU's cache.
BLOCKS = 1 << 14
#: Bits of a fingerprint for so many runs at most; four times as many for four times the runs.
BITS, RUNS = 256, 160
#: Bytes of text that are signed at a time.
PORTION = 4 << 20
#: Texts of a large group that may share a run before its place in their order follows from its frequency.
COMMON = 16
#: Bit planes between two looks at which blocks are out of reach.
STEP = 32

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x9E3779B97F4A7C15)


def run_sets(texts: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``run`` words, sorted within each text, and where texts begin."""
    known: dict[str, int] = {}
    for words in texts:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = np.fromiter((known[w] for words in texts for w in words), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(flat) < run:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = np.zeros(len(flat) - run + 1, np.uint64)
    for k in range(run):
        h = _mixed(h ^ flat[k : len(flat) - run + 1 + k]) + _ODD[k % len(_ODD)]
    starts = doc[: len(h)]
    inside = np.arange(len(h)) + run <= ends[starts]
    h, starts = h[inside], starts[inside]
    order = np.lexsort((h, starts))
    h, starts = h[order], starts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (starts[1:] != starts[:-1])
    h, starts = h[new], starts[new]
    return h, np.searchsorted(starts, np.arange(len(texts) + 1))


def width_class(n: np.ndarray) -> np.ndarray:
    """0 for up to RUNS runs, one more for each four times as many."""
    out = np.zeros(len(n), np.int64)
    limit = RUNS
    while len(n) and n.max() > limit:
        out += n > limit
        limit *= 4
    return out


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each text's parity bits: every run flips the bit its hash names.

    Common runs cancel out, so two fingerprints differ in at most as many bits as the sets have runs
    not in common. Folding the halves of one onto each other keeps that true.
    """
    n = np.diff(bounds)
    kind = width_class(n)
    out: list[bytes] = [b""] * len(n)
    for c in np.unique(kind):
        own = np.flatnonzero(kind == c)
        bits = BITS << (2 * int(c))
        for part in np.array_split(own, max(1, len(own) * bits // (1 << 24) + 1)):
            rows = np.repeat(np.arange(len(part)), n[part])
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part]) if len(part) else np.zeros(0, np.int64)
            bit = (h[at] >> np.uint64(20)) & np.uint64(bits - 1)
            odd = (np.bincount(rows * bits + bit.astype(np.int64), minlength=len(part) * bits) & 1).astype(np.uint8)
            for i, packed in zip(part, np.packbits(odd.reshape(len(part), bits), axis=1, bitorder="little"), strict=True):
                out[i] = packed.tobytes()
    return out


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PORTION`` bytes of text, a longer text alone."""
    ends = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)) // PORTION
    cuts = np.r_[0, np.flatnonzero(np.diff(ends)) + 1, batch.num_rows] if batch.num_rows else np.zeros(0, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def _signing(run: int, least_words: int, repairs: dict[str, str]):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _portions(whole)):
            texts = [WORD.findall(one_form(t or "", repairs).lower()) for t in batch["text"].to_pylist()]
            long = np.array([len(w) >= max(least_words, run) for w in texts], bool)
            kept = [w for w, x in zip(texts, long, strict=True) if x]
            rows = batch.filter(pa.array(long))
            h, bounds = run_sets(kept, run)
            n = np.diff(bounds)
            scopes = rows["scope"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    rows["key"],
                    pa.array([xxhash.xxh128_digest(f"{s}\x1e" + "\x1f".join(w)) for s, w in zip(scopes, kept, strict=True)], pa.binary()),
                    pa.array([xxhash.xxh64_intdigest(str(s)) - (1 << 63) for s in scopes], pa.int64()),
                    pa.array(n, pa.int32()),
                    pa.array(fingerprints(h, bounds), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64))),
                ],
                names=["key", "cls", "scope", "n", "bits", "runs"],
            )

    return sign


def signatures(df: DataFrame, key: str, scope: str, text: str, run: int = 3, least_words: int = 36, least: float = 0.55) -> DataFrame:
    """``key, cls, scope, n, bits, runs`` of the texts with at least ``least_words`` words, one row per key.

    ``cls`` is equal for equal word sequences of one scope, ``scope`` is a number. Words are runs of letters
    and digits in lower case of the text in one form (see :mod:`quillrank.llm.lookalike`). ``runs`` are the
    hashes of the distinct runs of ``run`` words in order. Rows with a NULL key or scope and texts that are NULL or too short
    have no row; whole texts are read. The result is a written table.
    """
    if not 0.25 < least <= 1:
        raise ValueError("least must be above 0.25 and at most 1")
    rows = df.where(F.col(key).isNotNull() & F.col(scope).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(scope).alias("scope"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    texts, repairs = form(rows, "text")
    schema = f"key {kind}, cls binary, scope bigint, n int, bits binary, runs array<bigint>"
    return written(texts.mapInArrow(_signing(run, least_words, repairs), schema), "signatures")


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of packed fingerprints as bit planes: plane b holds bit b of 64 rows in each word."""
    rows, width = bits.shape[0], bits.shape[1] * 8
    pad = -rows % 64
    square = np.unpackbits(np.vstack([bits, np.zeros((pad, bits.shape[1]), np.uint8)]) if pad else bits, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(square.T), axis=1, bitorder="little").view(np.uint64).reshape(width, -1)


def _add(levels: list[list[np.ndarray]], x: np.ndarray, level: int = 0) -> None:
    """Carry-save: three numbers of one weight become a sum and a carry of twice the weight."""
    while True:
        if level == len(levels):
            levels.append([])
        held = levels[level]
        held.append(x)
        if len(held) < 3:
            return
        a, b, c = held
        u = a ^ b
        held[:] = [u ^ c]
        x = (a & b) | (u & c)
        level += 1


def _settle(levels: list[list[np.ndarray]]) -> None:
    """Leaves one number of each weight."""
    level = 0
    while level < len(levels):
        held = levels[level]
        if len(held) == 2:
            a, b = held
            held[:] = [a ^ b]
            _add(levels, a & b, level + 1)
        level += 1


def _beyond(levels: list[list[np.ndarray]], radius: np.ndarray) -> np.ndarray:
    """Bits set where the counter is above its block's radius."""
    top = max(len(levels), int(radius.max()).bit_length() if len(radius) else 0)
    above = np.zeros(len(radius), np.uint64)
    equal = ~above
    for level in range(top - 1, -1, -1):
        r = (np.uint64(0) - ((radius >> np.uint64(level)) & np.uint64(1))).astype(np.uint64)
        c = levels[level][0] if level < len(levels) and levels[level] else np.zeros(len(radius), np.uint64)
        above |= equal & c & ~r
        equal &= ~(c ^ r)
    return above


def _within(query: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) within the radius, over blocks (query q, 64 candidates w)."""
    levels: list[list[np.ndarray]] = []
    width = planes.shape[0]
    for b in range(width):
        _add(levels, planes[b][w] ^ query[b][q])
        if b % STEP == STEP - 1 or b == width - 1:
            _settle(levels)
            near = ~_beyond(levels, radius)
            alive = near != 0
            if b == width - 1:
                break
            if not alive.all():  # blocks with all their candidates out of reach are abandoned
                q, w, radius = q[alive], w[alive], radius[alive]
                if not len(q):
                    return q, w
                levels = [[x[alive] for x in held] for held in levels]
    q, w, near = q[alive], w[alive], near[alive]
    lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(lanes)
    return q[block], w[block] * 64 + lane


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] * 8 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def close_pairs(group: np.ndarray, n: np.ndarray, bits: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of one group whose fingerprints allow a similarity of ``least``.

    Groups are runs of equal values. No pair that is similar enough is missing.
    """
    found_i, found_j = [], []
    kind = width_class(n)
    for c in np.unique(kind):
        width = BITS << (2 * int(c))
        for other in (c, c + 1):
            rows = np.flatnonzero(kind == c)
            cols = rows if other == c else np.flatnonzero(kind == other)
            if not len(cols):
                continue
            mine = np.frombuffer(b"".join(bits[i] for i in rows), np.uint8).reshape(len(rows), -1)
            theirs = mine if other == c else _folded(np.frombuffer(b"".join(bits[i] for i in cols), np.uint8).reshape(len(cols), -1), width)
            planes = _planes(theirs)
            masks = (np.uint64(0) - np.unpackbits(mine, axis=1, bitorder="little").T.astype(np.uint64)).astype(np.uint64)
            # Candidates of a row are the rows of its group; within one class only those after it.
            low = np.searchsorted(group[cols], group[rows], "left") if other != c else np.arange(len(rows)) + 1
            high = np.searchsorted(group[cols], group[rows], "right")
            first, last = low // 64, (high + 63) // 64
            blocks = np.where(high > low, last - first, 0)
            padded = np.zeros(planes.shape[1] * 64, np.int64)
            padded[: len(cols)] = n[cols]
            largest = padded.reshape(-1, 64).max(axis=1)
            loss = (1 - least) / (1 + least)
            begin = 0
            edges = np.cumsum(blocks)
            while begin < len(rows):
                end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + BLOCKS, "right")))
                take = blocks[begin:end]
                q = np.repeat(np.arange(begin, end), take)
                if len(q):
                    w = np.arange(len(q)) - np.repeat(np.cumsum(take) - take, take) + first[q]
                    sizes = np.minimum(largest[w], np.floor(n[rows[q]] / least + 1e-9).astype(np.int64))
                    radius = np.floor(loss * (n[rows[q]] + sizes) + 1e-9).astype(np.uint64)
                    i, j = _within(masks, planes, q, w, radius)
                    ok = (j >= low[i]) & (j < high[i])
                    i, j = i[ok], j[ok]
                    if len(i):
                        a, b = rows[i], cols[j]
                        apart = np.bitwise_count(mine[i] ^ theirs[j]).sum(axis=1)
                        fit = (apart <= loss * (n[a] + n[b]) + 1e-9) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9)
                        found_i.append(np.minimum(a, b)[fit])
                        found_j.append(np.maximum(a, b)[fit])
                begin = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _comparing(least: float):
    """Over rows sorted by group: whole groups are gathered into tiles and compared there."""

    def tile(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        group = rows["grp"].to_numpy()
        change = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[change, len(group)])
        several = np.repeat(sizes > 1, sizes)
        rows = rows.filter(pa.array(several))
        number = np.repeat(np.arange(len(sizes)), sizes)[several]
        i, j = close_pairs(number, rows["n"].to_numpy().astype(np.int64), rows["bits"].to_pylist(), least) if rows.num_rows else (np.zeros(0, np.int64),) * 2
        side = rows["side"].to_numpy()
        ok = (side[i] == 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        cls = rows["cls"].combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        return pa.RecordBatch.from_arrays([cls.take(pa.array(i)), cls.take(pa.array(j))], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < 2 * GROUP_TEXTS:
                continue
            group = held["grp"].to_numpy()
            cut = int(np.searchsorted(-(group != group[-1]).astype(np.int8), 0, "left"))  # the last group may go on
            if cut:
                yield tile(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield tile(held)

    return run


def _heading(least: float, common):
    """``cls, groups``: the runs by one of which a text that is ``least`` similar must be found, the rarest first.

    Any one order of all runs is right; that by frequency keeps the groups small. ``common`` has the most frequent runs
    with their counts, sorted; all others come before them, by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for batch in batches:
            runs = batch["runs"]
            sizes = np.diff(runs.offsets.to_numpy()).astype(np.int64)
            flat = runs.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            scope = batch["scope"].to_numpy(zero_copy_only=False).view(np.uint64)
            code = _mixed(flat ^ _mixed(scope)[doc])
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            weight = np.where(known[at] == code, often[at], 0) if len(known) else np.zeros(len(code), np.int64)
            order = np.lexsort((code, weight, doc))
            heads = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
            ends = np.cumsum(np.r_[0, heads])
            starts = np.cumsum(sizes) - sizes
            picked = code[order[np.repeat(starts - ends[:-1], heads) + np.arange(ends[-1])]]
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(picked.view(np.int64)))], names=["cls", "groups"])

    return run


def _coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``code, n``: each run of a scope and how many rows of these have it."""
    for batch in batches:
        runs = batch["runs"]
        sizes = np.diff(runs.offsets.to_numpy())
        flat = runs.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        scope = batch["scope"].to_numpy(zero_copy_only=False).view(np.uint64)
        code, n = np.unique(_mixed(flat ^ _mixed(np.repeat(scope, sizes))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n, pa.int64())], names=["code", "n"])


def links(signed: DataFrame, least: float = 0.55, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """``x, y, similarity``: classes of one scope whose similarity is at least ``least``.

    The similarity is that of the sets of runs: common ones by all. ``signed`` has the rows of
    :func:`signatures` for the same ``least``; equal word sequences are one class and no link.

    A scope of at most ``group_texts`` classes is compared as a whole. In a larger one, two similar
    texts must share a run among the first ``n - ceil(least * n) + 1`` of any one order of runs. The order is by frequency in
    the scope, the rarest first, so words that many texts share bring no texts together. Each of these
    runs that several texts have is a group; a group above ``group_texts`` is cut into chunks and every pair of chunks is
    compared by its own task. Within a group fingerprints are compared by bit planes, and only what they
    allow is checked exactly. Nothing is lost on the way: every step is a bound, none a guess.
    """
    counts = signed.select("scope", "cls").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("held"))
    large = written(counts.where(F.col("held") > group_texts).select("scope"), "large")
    fields = ["grp", "cls", "n", "bits", "side"]
    if large.isEmpty():
        rows = signed.dropDuplicates(["cls"]).select(F.col("scope").alias("grp"), "cls", "n", "bits", F.lit(0).alias("side"))
    else:
        once = signed.select("cls", "scope", "n", "bits").dropDuplicates(["cls"])
        usual = once.join(bounded(large), "scope", "left_anti").select(F.col("scope").alias("grp"), "cls", "n", "bits", F.lit(0).alias("side"))
        hot = signed.join(bounded(large), "scope", "left_semi")
        coded = hot.select("scope", "runs").mapInArrow(_coding, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
        often = sorted((r["code"] & ((1 << 64) - 1), r["n"]) for r in coded.orderBy(F.col("n").desc(), "code").limit(SENT_ROWS).collect())
        common = signed.sparkSession.sparkContext.broadcast((np.array([c for c, _ in often], np.uint64), np.array([n for _, n in often], np.int64)))
        heads = hot.select("cls", "scope", "runs").mapInArrow(_heading(least, common), "cls binary, groups array<bigint>").dropDuplicates(["cls"])
        each = written(heads.select("cls", F.explode("groups").alias("grp")), "heads")  # narrow: fingerprints go only where a run is shared
        held = written(each.groupBy("grp").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("grp", F.ceil(F.col("held") / group_texts).cast("int").alias("chunks")), "shared-runs")
        place = each.join(bounded(held), "grp").withColumn("mine", F.pmod(F.hash("cls"), F.col("chunks")))
        several = F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))
        paired = place.withColumn("other", F.explode(several))
        grp = F.when(F.col("chunks") == 1, F.col("grp")).otherwise(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other")))
        keyed = paired.select(grp.alias("grp"), "cls", F.when(F.col("mine") == F.col("other"), 0).otherwise(F.col("mine") + 1).alias("side"))
        rows = usual.unionByName(keyed.join(once.select("cls", "n", "bits"), "cls").select(*usual.columns))
    sorted_rows = rows.select(*fields).repartition("grp").sortWithinPartitions("grp", "n")
    maybe = sorted_rows.mapInArrow(_comparing(least), "x binary, y binary")
    pairs = written(maybe.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "maybe")
    sides = written(pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "sides")
    sets = signed.select("cls", "runs").join(bounded(sides), "cls", "left_semi").dropDuplicates(["cls"])
    a = sets.select(F.col("cls").alias("x"), F.col("runs").alias("ra"))
    b = sets.select(F.col("cls").alias("y"), F.col("runs").alias("rb"))
    both = pairs.join(a, "x").join(b, "y").withColumn("common", F.size(F.array_intersect("ra", "rb")))
    similarity = F.col("common") / (F.size("ra") + F.size("rb") - F.col("common"))
    return both.select("x", "y", similarity.alias("similarity")).where(F.col("similarity") >= least)


def similar_pairs(df: DataFrame, key: str, scope: str, text: str, run: int = 3, least_words: int = 36, least: float = 0.55, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """``key_a, key_b``: all pairs of keys of one scope that are equal or similar, smaller key first.

    See :func:`signatures` for what counts as a text and :func:`links` for the search. Pairs are written
    out only here, where the caller wants every pair of keys.
    """
    signed = signatures(df, key, scope, text, run, least_words, least)
    found = links(signed, least, group_texts).select("x", "y")
    members = written(signed.select("cls", "key").distinct(), "members")
    copies = pairs_within(members, "cls", "key").select("a", "b")
    a = members.select(F.col("cls").alias("x"), F.col("key").alias("k"))
    b = members.select(F.col("cls").alias("y"), F.col("key").alias("l"))
    unlike = found.join(a, "x").join(b, "y").select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"))
    return unlike.unionByName(copies).select(F.col("a").alias("key_a"), F.col("b").alias("key_b")).where("key_a <> key_b").distinct()


def classes_with_links(df: DataFrame, key: str, scope: str, text: str, run: int = 3, least_words: int = 36, least: float = 0.55, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """``key, class_id, copies, n_links``: one row per key with the class of equal texts, named by its smallest key, and how
    many other keys of its scope are equal or similar to it. Copies are counted, not paired."""
    signed = signatures(df, key, scope, text, run, least_words, least)
    members = written(signed.select("cls", "key").distinct(), "members")
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("class_id"))
    found = written(links(signed, least, group_texts).select("x", "y"), "links")
    ends = found.select(F.col("x").alias("cls"), F.col("y").alias("other")).unionByName(found.select(F.col("y").alias("cls"), F.col("x").alias("other")))
    far = ends.join(sizes.select(F.col("cls").alias("other"), F.col("copies").alias("there")), "other").groupBy("cls").agg(F.sum("there").alias("linked"))
    named = members.join(sizes, "cls").join(far, "cls", "left")
    return named.select("key", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
