"""One form for text that looks the same: script-aware repair against the corpus's own words."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillrank.runtime import SENT_ROWS, small, written

# Letters of other scripts that look like a Latin letter.
LATIN_TWINS = {
    # Cyrillic, small and capital
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "H",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Latin letters of another shape
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʟ": "L", "ꜱ": "s",
}
# End of fixed values.

_CODES = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A"}
_ODD_LATIN = {c for c in LATIN_TWINS if unicodedata.name(c).startswith("LATIN")}
_FOREIGN = re.compile("[" + "".join(LATIN_TWINS) + "]")
_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")
WORD = re.compile(r"[^\W_]+")


def _script(c: str) -> str:
    """L, C, G or A; O for a Latin letter of another shape; empty for all else."""
    if c < "\u0080":
        return "L" if c.isalpha() else ""
    if c in _ODD_LATIN:
        return "O"
    return _CODES.get(unicodedata.name(c, "").split(" ", 1)[0], "") if c.isalpha() else ""


_TO: dict[str, dict[str, str]] = {"L": LATIN_TWINS}
for _c, _l in LATIN_TWINS.items():  # Latin letters and other scripts' twins, back into each script
    if _script(_c) in "CGA":
        _TO.setdefault(_script(_c), {}).setdefault(_l, _c)
for _s in "CGA":
    for _c, _l in LATIN_TWINS.items():
        if _script(_c) != _s and _l in _TO[_s]:
            _TO[_s].setdefault(_c, _TO[_s][_l])


def _unseen(c: str) -> bool:
    kind = unicodedata.category(c)
    return (kind == "Cf" or (kind == "Cc" and not c.isspace()) or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef")


class _Table(dict):
    """For str.translate: characters without width vanish; filled as characters are met."""

    def __missing__(self, code: int):
        self[code] = out = None if _unseen(chr(code)) else code
        return out


_UNSEEN = _Table()
_LOW = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
#: A text without any of these is its own folded form.
_UNTIDY = re.compile("[^ -~\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u2013\u2014\u2018-\u201d]|  |^ | $")


def folded(text: str) -> str:
    """Compatibility forms as ordinary characters, accents composed, nothing without width, single spaces."""
    if not _UNTIDY.search(text):
        return text
    flat = " ".join(text.split())
    if not _UNTIDY.search(flat):
        return flat
    if text.isascii():
        return " ".join(_LOW.sub("", text).split())
    text = unicodedata.normalize("NFKC", text.translate(_UNSEEN)).translate(_UNSEEN)
    return " ".join(unicodedata.normalize("NFC", text).split())


def suspects(text: str) -> list[tuple[str, str]]:
    """(token, repaired) of a folded text, in order of preference: what look-alikes could stand for.

    A token with letters of several scripts, or written only in letters that are foreign to the text
    and all have twins, is rewritten in the text's dominant script, in its own dominant script, in Latin and in
    each other script it has letters of. Look-alikes alone make no script dominant: a text that has only such
    letters of it counts as Latin.
    """
    if text.isascii() or not _FOREIGN.search(text):
        return []
    whole = Counter(filter(None, map(_script, text)))
    home = max("LCGA", key=lambda s: whole[s])
    if home != "L" and all(c in LATIN_TWINS for c in text if _script(c) == home):
        home = "L"
    out = {}
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token.isascii():
            continue
        own = Counter(filter(None, map(_script, token)))
        if set(own) <= {home}:
            continue
        for target in dict.fromkeys((home, max("LCGA", key=lambda s: own[s]), "L", *(s for s in "CGA" if own[s]))):
            twin = _TO[target]
            fixed = "".join(c if not (s := _script(c)) or s == target else twin.get(c, "") or "\0" for c in token)
            if "\0" not in fixed and fixed != token:
                out[token, fixed] = None
    return list(out)


_PAIR = "array<struct<token string, fixed string>>"


def _suspecting(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("token", pa.string()), ("fixed", pa.string())]))
    for texts in batches:
        yield pa.array([[{"token": a, "fixed": b} for a, b in suspects(folded(t))] if t else [] for t in texts.to_pylist()], kind)


def _folding(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else folded(t) for t in texts.to_pylist()], pa.string())


def _rewritten(text: str, words: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: words.get(m[0], m[0]), text) if words and _FOREIGN.search(text) else text


def _repairing(words: dict[str, str]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else _rewritten(folded(t), words) for t in texts.to_pylist()], pa.string())

    return run


def _repairing_by_row(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for texts, rules in batches:
        yield pa.array([_rewritten(t, {r["token"]: r["fixed"] for r in own or []}) for t, own in zip(texts.to_pylist(), rules.to_pylist(), strict=True)], pa.string())


def _ascii(column: str) -> Column:
    return F.octet_length(column) == F.char_length(column)


def repairs(texts: DataFrame, column: str, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``token, fixed``: the tokens of a corpus that are to be rewritten, each with one result.

    A rewriting is taken if the corpus has it as a word, in any letter case, or if several different tokens
    lead to it (then each of them is a disguise of the same word). Words are those of all texts.
    The result is a written table; it is small unless the corpus is full of disguised words.
    """
    odd = texts.where(~_ascii(column))  # look-alikes are never ASCII
    each = odd.select(F.posexplode(arrow_udf(_suspecting, _PAIR)(F.col(column))).alias("at", "o")).select("at", "o.token", "o.fixed")
    pairs = written(each.groupBy("token", "fixed").agg(F.min("at").alias("at")).withColumn("word", F.lower("fixed")), "suspects")
    wanted = pairs.select("word").distinct()
    if pairs.isEmpty():
        return pairs.select("token", "fixed")
    if small(pairs, sent_rows):
        wanted = F.broadcast(wanted)
    folds = odd.select(arrow_udf(_folding, "string")(F.col(column)).alias("t"))
    split = lambda rows, apart: rows.select(F.explode(F.split(F.lower("t"), apart)).alias("word"))
    both = split(texts.where(_ascii(column)).select(F.col(column).alias("t")), "[^a-z0-9]+").unionByName(split(folds, r"(?U)[^\p{L}\p{M}\p{N}]+"))
    words = both.join(wanted, "word", "left_semi").distinct()
    shared = pairs.groupBy("word").agg(F.count_distinct("token").alias("n")).where("n > 1").select("word")
    known = words.withColumn("rank", F.lit(0)).unionByName(shared.withColumn("rank", F.lit(1))).groupBy("word").agg(F.min("rank").alias("rank"))
    return written(pairs.join(known, "word").groupBy("token").agg(F.min_by("fixed", F.struct("rank", "at", "fixed")).alias("fixed")), "repairs")


def form(df: DataFrame, column: str, corpus: DataFrame | None = None, sent_rows: int = SENT_ROWS) -> tuple[DataFrame, dict[str, str]]:
    """``df`` and a dictionary, such that ``one_form(text, dictionary)`` is each text of ``column`` in one form.

    For operators that read the text in Python anyway. With at most ``sent_rows`` repairs they are the dictionary;
    more are applied here, by joining them to the distinct texts that need them, and the dictionary is empty.
    """
    texts = df.select(F.col(column).alias("t"))
    found = repairs(texts if corpus is None else texts.unionByName(corpus.select(F.col("text").alias("t"))), "t", sent_rows)
    held = [(r["token"], r["fixed"]) for r in found.limit(sent_rows + 1).collect()]  # bounded by sent_rows
    if len(held) <= sent_rows:
        return df, dict(held)
    odd = df.where(~_ascii(column))
    key = F.sha2(F.col(column), 256)
    one = odd.select(key.alias("__h"), arrow_udf(_folding, "string")(F.col(column)).alias("__t")).dropDuplicates(["__h"])
    tokens = one.select("__h", F.explode(F.split("__t", r"(?U)[^\p{L}\p{M}\p{N}]+")).alias("token")).distinct()
    rules = tokens.join(found, "token").groupBy("__h").agg(F.collect_list(F.struct("token", "fixed")).alias("__rules"))  # as many as a text has tokens
    fixed = one.join(rules, "__h").select("__h", arrow_udf(_repairing_by_row, "string")(F.col("__t"), F.col("__rules")).alias("__fixed"))
    whole = df.withColumn("__k", F.when(~_ascii(column), key)).join(fixed, F.col("__k") == F.col("__h"), "left")
    return whole.withColumn(column, F.coalesce("__fixed", column)).select(*df.columns), {}


def one_form(text: str, words: dict[str, str]) -> str:
    return _rewritten(folded(text), words)


def unified(df: DataFrame, column: str, out: str, corpus: DataFrame | None = None, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``df`` with ``out``: its ``column`` in one consistent form, so that equal-looking texts are equal.

    Full-width and other compatibility forms, combining accents, characters without width and runs of
    blanks are brought to one form; then look-alike letters are replaced token by token, where the
    result is a word of the corpus (``df``'s own column and column ``text`` of ``corpus``). Letter case,
    accents and punctuation stay. NULL stays NULL; a text that shows nothing becomes the empty text.
    A token's repair depends only on its text's main script and the corpus.
    """
    rows, words = form(df.withColumn(out, F.col(column)), out, corpus, sent_rows)
    return rows.withColumn(out, arrow_udf(_repairing(words), "string")(F.col(out)))


def once_each(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, column`` of the rows of a file source, redelivered ones (same key and look) once; texts don't move.

    ``df`` has the source's ``_metadata``. Only hashes are grouped; the rows that repeat an earlier one are few, and are left
    out by their place. Rows of one key that differ only in what :func:`folded` settles count as redelivered.
    """
    form = arrow_udf(_folding, "string")(F.col(column))
    shown = F.when(_ascii(column) & ~F.col(column).rlike(r"[^ -~]|  |^ | $"), F.col(column)).otherwise(form)
    at = df.select(F.col(key).alias("k"), F.xxhash64(shown).alias("h"), F.xxhash64(shown, F.lit(1)).alias("g"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    rank = F.row_number().over(W.partitionBy("k", "h", "g").orderBy("f", "r"))
    again = written(at.withColumn("n", rank).where("n > 1").select("f", "r"), "redelivered")
    rows = df.select(key, column, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    left = F.broadcast(again) if small(again) else again
    return rows.join(left, (F.col("__f") == F.col("f")) & (F.col("__r") == F.col("r")), "left_anti").select(key, column)


def equal_looking(df: DataFrame, key: str, column: str, scope: list[str], sent_rows: int = SENT_ROWS) -> DataFrame:
    """``key_a, key_b``: two keys of the same scope whose values look the same but differ in characters.

    ``scope`` names the columns within which values are compared (none: everywhere; NULL is a scope of its
    own). Rows redelivered under one key count once; NULL keys, NULL values and values that show nothing
    are left out. Values of one form are a class; only classes that hold different values are taken further,
    and their pairs are made between values first, keys being added last.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("k"), *[F.col(s).alias(f"s{i}") for i, s in enumerate(scope)], F.col(column).alias("v"))
    looks = unified(rows, "v", "form", sent_rows=sent_rows).where("form <> ''")
    names = [f"s{i}" for i in range(len(scope))]
    values = looks.select("k", F.xxhash64("v", F.lit(7)).alias("v1"), F.xxhash64("v").alias("v2"), F.xxhash64(*names, "form").alias("c1"), F.xxhash64("form", *names, F.lit(1)).alias("c2"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("v1", "v2") for n, f in (("low", F.min), ("high", F.max))]
    mixed = written(values.groupBy("c1", "c2").agg(*ends).where("low_v1 <> high_v1 or low_v2 <> high_v2").select("c1", "c2"), "mixed")
    kept = written(values.join(F.broadcast(mixed) if small(mixed, sent_rows) else mixed, ["c1", "c2"], "left_semi").distinct(), "looking")
    kinds = kept.select("c1", "c2", "v1", "v2").distinct()
    pairs = kinds.join(kinds.select("c1", "c2", F.col("v1").alias("w1"), F.col("v2").alias("w2")), ["c1", "c2"]).where("struct(v1, v2) < struct(w1, w2)")
    other = kept.select("c1", "c2", F.col("v1").alias("w1"), F.col("v2").alias("w2"), F.col("k").alias("l"))
    keys = pairs.join(kept, ["c1", "c2", "v1", "v2"]).join(other, ["c1", "c2", "w1", "w2"]).where("k <> l")
    return keys.select(F.least("k", "l").alias("key_a"), F.greatest("k", "l").alias("key_b")).distinct()
