"""Listings of one product: mined maker–model phrases, found everywhere, and variants compared."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.lookalike import LATIN_TWINS, folded
from quillrank.operators.skew import pairs_within
from quillrank.runtime import SENT_ROWS, bounded, written

#: Phrases in one automaton; a larger dictionary is searched block by block. Phrases of the same words stay in one block.
BLOCK_PHRASES = 200_000
#: Listings that a task holds while the blocks pass.
HELD_LISTINGS = 50_000
#: Two names of a kind are one kind if they stand for the same listing in this part of the rarer one's listings.
KIND_SHARE = 0.05

# Words that name a property in a key, units, and spellings of numbers and values in general use.
KEY_WORDS = {
    "maker": ("manufacturer", "brand", "publisher", "maker"),
    "kind": ("type", "kind"),
    "platform": ("platform",),
    "edition": ("edition", "version"),
    "colour": ("color", "colour"),
    "pack": ("pack",),
    "connection": ("connection", "connectivity"),
    "installment": ("installment", "series", "part"),
}
CONNECTIONS = {"wired": ("wired", "corded", "with cord"), "wireless": ("wireless", "cordless", "cable-free")}
COLOUR_TWINS = {"gray": "grey", "blk": "black"}
EDITION_TWINS = {"std": "standard"}
EDITION_WORDS = ("edition", "ed", "version")
UNITS = {
    "capacity": {"mb": 1, "megabytes": 1, "gb": 1000, "gigabytes": 1000, "tb": 1_000_000, "terabytes": 1_000_000},
    "length": {"cm": 1.0, "m": 100.0, "inches": 2.54, "inch": 2.54, "in": 2.54, "ft": 30.48, "feet": 30.48},
    "weight": {"g": 1.0, "grams": 1.0, "kg": 1000.0, "oz": 28.3495, "ounces": 28.3495},
    "charge": {"mah": 1, "ah": 1000},
}
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6"}
COMPANY_WORDS = ("ltd", "inc", "gmbh", "co", "llc", "corp")
# End of fixed values.

PROPERTIES = ("platform", "edition", "colour", "capacity", "length", "weight", "charge", "pack", "connection")
_TWINS = str.maketrans(LATIN_TWINS)
_UNIT_OF = {u: (p, f) for p, units in UNITS.items() for u, f in units.items()}
_QUANTITY = re.compile(r"(\d+(?:\.\d+)?) ?(" + "|".join(sorted(_UNIT_OF, key=len, reverse=True)) + r")(?![a-z0-9])")
_PACKS = re.compile(r"\b(?:(?:pack|set) of (\d+)|(\d+) (?:pack(?! of)|pieces|piece|pc|pcs|count)|(single))\b")
_PARTS = re.compile(r"[|;,()/\[\]]")
_TOKEN = re.compile(r"\d+\.\d+|[^\W_]+|[|(),;:/\[\]]|(?<!\S)[-–—](?!\S)")
_WORDS = re.compile(r"\d+\.\d+|[^\W_]+")
_JOINED = re.compile(r"(?<=[^\W\d_])[-'’](?=[^\W\d_])")
_ROMAN = re.compile(r"(x{0,3})(ix|iv|v?i{0,3})")
_ROMAN_ENDS = {"": 0, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}
_BOUNDS = set("|(),;:/[]-–—")


def plain(text: str | None) -> str:
    """Lower case, one form for look-alikes: only for comparing, never shown."""
    out = folded(text or "")
    return out.lower() if out.isascii() else out.translate(_TWINS).lower()


def tokens(text: str) -> list[str]:
    """Words and numbers of a plain text; what separates parts stays as ``|``. Hyphens and apostrophes inside words vanish."""
    return ["|" if t in _BOUNDS else t for t in _TOKEN.findall(_JOINED.sub("", text))]


def spaced(text: str) -> str:
    """A plain text as words, hyphens being blanks."""
    return " ".join(_WORDS.findall(text.replace("'", "").replace("’", "")))


class Phrases:
    """Names of several words, each standing for a value; found longest first, then leftmost."""

    def __init__(self, named: dict[tuple[str, ...], str]) -> None:
        self.of: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for words, value in named.items():
            self.of.setdefault(words[0], []).append((words, value))

    def find(self, words: list[str]) -> tuple[str | None, int, int]:
        best: tuple = (0, 0, None)
        for i, w in enumerate(words):
            for names, value in self.of.get(w, ()):
                if -len(names) < best[0] and tuple(words[i : i + len(names)]) == names:
                    best = (-len(names), i, value)
        return best[2], best[1], best[1] - best[0]

    def cut(self, words: list[str]) -> list[str]:
        """The words with every phrase replaced by a bound, longest first at each place."""
        out, i = [], 0
        while i < len(words):
            held = [len(names) for names, _ in self.of.get(words[i], ()) if tuple(words[i : i + len(names)]) == names]
            out.append("|" if held else words[i])
            i += max(held, default=1)
        return out


def _named(table: dict[str, str]) -> Phrases:
    """Phrases as words; hyphened words also as the one word that tokens() makes of them."""
    out = {tuple(spaced(p).split()): v for p, v in table.items()}
    return Phrases({k: v for k, v in (out | {tuple(p.replace("-", "").split()): v for p, v in table.items()}).items() if k})


_CONNECTION_WORDS = _named({p: c for c, names in CONNECTIONS.items() for p in names})
_CONNECTION_TEXT = "|".join(sorted({" ".join(w) for names in CONNECTIONS.values() for p in names for w in (spaced(p).split(), p.replace("-", "").split())}, key=len, reverse=True))
_SAID = re.compile(rf"\b(?:(?:pack|set) of \d+|\d+ (?:pack|pieces|piece|pc|pcs)|single|{_CONNECTION_TEXT})\b")


def maker(value: str) -> str:
    words = spaced(plain(value)).split()
    while len(words) > 1 and words[-1] in COMPANY_WORDS:
        words.pop()
    return " ".join(words)


def number(word: str) -> str | None:
    """A whole number above 0, roman (up to 39) or arabic."""
    if word.isdigit():
        return str(int(word)) if word.isascii() and int(word) > 0 else None
    m = _ROMAN.fullmatch(word) if word else None
    return str(10 * len(m[1]) + _ROMAN_ENDS[m[2]]) if m else None


def joined(words: list[str]) -> str:
    """Words as one, numbers after the first as digits: ``Helio One`` and ``HELIO-1`` are equal."""
    return "".join(words[:1] + [NUMBER_WORDS.get(w) or (not w.isdigit() and number(w)) or w for w in words[1:]])


def platform(value: str) -> str:
    return joined(spaced(plain(value)).split())


def edition(word: str) -> str:
    word = EDITION_TWINS.get(word, word)
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def edition_at(words: list[str], i: int, known: set[str]) -> int | None:
    """Where the edition that belongs to the edition word at ``i`` stands: before it, after it, or after a colon."""
    for j in (i - 1, i + 1, i + 2):
        if 0 <= j < len(words) and edition(words[j]) in known and not (j == i + 2 and words[i + 1] != "|"):
            return j
    return None


def quantities(text: str) -> dict[str, str]:
    """capacity, length, weight and charge of a plain text in one unit each. Sellers round when they convert, so lengths
    and weights keep two digits."""
    out = {}
    for m in _QUANTITY.finditer(text):
        kind, factor = _UNIT_OF[m[2]]
        value = float(m[1]) * factor
        if kind in ("length", "weight"):
            value = float(f"{value:.1e}")
        out.setdefault(kind, f"{value:.12g}")
    return out


def pack_of(text: str) -> str | None:
    m = next((m for part in _PARTS.split(text) if (m := _PACKS.search(spaced(part)))), None)
    return None if not m else "1" if m[3] else str(int(m[1] or m[2]))


class Words:
    """What the catalogue's structured details teach: which key states what, and the names of kinds, platforms, editions,
    colours and selling phrases."""

    def __init__(self, keys: dict[str, str], rows: list[tuple[str, str]]) -> None:
        self.keys = keys
        self.part_words = {w for k, p in keys.items() if p == "installment" for w in k.split()} | set(KEY_WORDS["installment"])
        self.platforms, self.editions, self.colours = set(), set(), set()
        kinds, selling = {}, {}
        for what, value in rows:
            words = spaced(plain(value)).split()
            if what == "platform":
                self.platforms.add(platform(value))
            elif what == "edition":
                self.editions |= {edition(w) for w in words if w not in EDITION_WORDS}
            elif what == "colour":
                self.colours |= {COLOUR_TWINS.get(w, w) for w in words}
            elif what == "kind" and words:
                kinds[plain(value)] = " ".join(words)
            elif what == "selling" and words:
                selling[tuple(words)] = ""
        self.kinds, self.selling = _named(kinds), Phrases(selling)
        heads: dict[str, set[str]] = {}
        for k in kinds.values():
            heads.setdefault(k.rsplit(" ", 1)[-1], set()).add(k)
        self.heads = {w: min(k) for w, k in heads.items() if len(k) == 1}

    def platform_at(self, words: list[str], i: int) -> tuple[str, int] | None:
        for n in (3, 2, 1):
            part = words[i : i + n]
            if len(part) == n and "|" not in part and (name := joined(part)) in self.platforms:
                return name, n
        return None

    def platform_last(self, words: list[str]) -> str | None:
        """The platform that a line ends with."""
        return next((p[0] for n in (3, 2, 1) if len(words) > n and (p := self.platform_at(words, len(words) - n)) and p[1] == n), None)

    def colour_of(self, words: list[str]) -> str | None:
        return next((c for w in words if (c := COLOUR_TWINS.get(w, w)) in self.colours), None)

    def edition_of(self, words: list[str]) -> str | None:
        return next((edition(words[j]) for i, w in enumerate(words) if w in EDITION_WORDS and (j := edition_at(words, i, self.editions)) is not None), None)


def _loaded(text: str | None, kind: type):
    try:
        out = json.loads(text) if text else kind()
    except ValueError:
        return kind()
    return out if isinstance(out, kind) else kind()


def _parse(title: str | None, features: str | None, details: str | None, brand: str | None, words: Words) -> dict:
    """What a listing states, and what is left of its title when all that is taken away."""
    given: dict[str, str] = {}
    amounts: dict[str, str] = {}
    for k, v in _loaded(details, dict).items():
        if v is None or isinstance(v, (dict, list)):
            continue
        what = words.keys.get(plain(k))
        if what:
            given.setdefault(what, plain(str(v)))
        elif (m := _QUANTITY.fullmatch(text := plain(str(v)))) and _UNIT_OF[m[2]][0] not in amounts:
            amounts |= quantities(text)
    lines = [plain(str(x)) for x in _loaded(features, list) if x is not None]
    told = [tokens(x) for x in lines]
    name = plain(title)
    out: dict = dict.fromkeys(("maker", "installment", "said", *PROPERTIES)) | amounts
    kinds: list[str] = []

    if given.get("maker") or brand:
        out["maker"] = maker(given.get("maker") or brand) or None
    if "kind" in given and (k := words.kinds.find(spaced(given["kind"]).split())[0]):
        kinds.append(k)
    if "platform" in given:
        out["platform"] = joined(spaced(given["platform"]).split())
    if "edition" in given:
        out["edition"] = next((e for w in spaced(given["edition"]).split() if (e := edition(w)) in words.editions), None)
    if "colour" in given:
        out["colour"] = words.colour_of(spaced(given["colour"]).split())
    if "pack" in given:
        out["pack"] = pack_of(given["pack"]) or (given["pack"].strip() if given["pack"].strip().isdigit() else None)
    if "connection" in given:
        out["connection"] = _CONNECTION_WORDS.find(spaced(given["connection"]).split())[0]
    if "installment" in given:
        out["installment"] = number(given["installment"].strip())
    for x in told:
        out["platform"] = out["platform"] or words.platform_last(x)
        if out["installment"] is None and len(x) > 1 and all(w in words.part_words for w in x[:-1]):
            out["installment"] = number(x[-1])
        # A line "name kind from maker" states all three.
        kind, a, b = words.kinds.find(x)
        if kind and a > 0 and x[b : b + 1] == ["from"] and len(x) > b + 1 and "|" not in x:
            out["maker"] = out["maker"] or maker(" ".join(x[b + 1 :]))
            kinds.append(kind)
            out["said"] = " ".join(x[:a])
    # The title, part by part: what is recognised is taken away.
    rest = words.selling.cut(tokens(name))
    kind, a, b = words.kinds.find(rest)
    title_words = list(rest)
    if kind:
        kinds.append(kind)
        rest[a:b] = ["|"]
    if not kinds:
        kinds += [k for x in told if (k := words.kinds.find(x)[0])][:1]
    if not kinds and (at := next((i for i, w in enumerate(rest) if w in words.heads), None)) is not None:
        kinds.append(words.heads[rest[at]])  # an unknown name whose last word only one known name has
        rest[at] = "|"
    i = 0
    while i < len(rest):
        hit = words.platform_at(rest, i)
        if hit:
            out["platform"] = out["platform"] or hit[0]
            rest[i : i + hit[1]] = ["|"]
        i += 1
    everywhere = [title_words, *told]
    out["edition"] = out["edition"] or next((e for x in everywhere if (e := words.edition_of(x))), None)
    for i, w in enumerate(rest):
        if w in EDITION_WORDS:
            j = edition_at(rest, i, words.editions)
            if j is not None:
                rest[j] = "|"
            rest[i] = "|"
    for t in (" ".join(title_words).replace("|", " ; "), *lines):
        for what, value in quantities(t).items():
            if out[what] is None:
                out[what] = value
        if out["pack"] is None:
            out["pack"] = pack_of(t)
    for x in everywhere:
        if out["connection"] is None:
            out["connection"] = _CONNECTION_WORDS.find([w for w in x if w != "|"])[0]
        if out["colour"] is None:
            out["colour"] = words.colour_of(x)
    left = _SAID.sub("|", _QUANTITY.sub("|", " ".join(rest))).split()
    out["rest"] = ["|" if COLOUR_TWINS.get(w, w) in words.colours else w for w in left]
    out["kinds"] = list(dict.fromkeys(kinds))
    # What the phrases are looked for in: title and features as words, parts kept apart.
    out["line"] = xxhash.xxh64_hexdigest(spaced(name))
    out["text"] = " | ".join(map(" ".join, everywhere))
    return out


def _model(rest: list[str], brand: str | None) -> tuple[str, ...] | None:
    """The words that only the name can be: the one part left besides the maker."""
    own, words = tuple((brand or "").split()), list(rest)
    for i in range(len(words)):
        if own and tuple(words[i : i + len(own)]) == own:
            words[i : i + len(own)] = ["|"]
    parts: list[list[str]] = [[]]
    for w in words:
        if w in ("|", "by"):
            parts.append([])
        else:
            parts[-1].append(w)
    parts = [p[:-1] if len(p) > 1 and number(p[-1]) else p for p in parts if p]
    parts = [p for p in parts if not (len(p) == 1 and (number(p[0]) or p[0] in ("a", "the")))]
    return tuple(parts[0]) if len(parts) == 1 else None


_FIELDS = ("maker", "installment", *PROPERTIES, "line", "text")


def _reading(words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_parse(*r, words) for r in zip(*[batch[c].to_pylist() for c in ("title", "features", "details", "brand")], strict=True)]
            model = [r["said"] or (" ".join(m) if (m := _model(r["rest"], r["maker"])) else None) if r["maker"] else None for r in rows]
            arrays = [batch["key"], *[pa.array([r[f] for r in rows], pa.string()) for f in _FIELDS], pa.array(model, pa.string())]
            said, kinds = pa.array([r["said"] is not None for r in rows], pa.bool_()), pa.array([r["kinds"] for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*arrays, said, kinds], names=["key", *_FIELDS, "model", "said", "kinds"])

    return run


def _automaton(phrases: list[tuple[str, str, bool]]):
    """All mined phrases, also with their words turned round; each with the makers that use it and whether that is sure."""
    out = ahocorasick.Automaton()
    for brand, model, sure in phrases:
        words = model.split()
        name = " ".join(sorted(words))
        for turned in {model, " ".join(words[1:] + words[:1])}:
            held = out.get(f" {turned} ", None)
            if held is None:
                out.add_word(f" {turned} ", (len(words), {(brand, name): sure}, turned))
            else:
                held[1][brand, name] = sure or held[1].get((brand, name), False)
    out.make_automaton()
    return out


def _best(automaton, line: str, brand: str | None, part: str | None, best: tuple | None) -> tuple | None:
    """(rank, maker, name, installment) of the best phrase in a line, if it is better than ``best``."""
    for end, (size, owners, turned) in automaton.iter(line):
        for (owner, name), sure in owners.items():
            if owner == brand or (brand is None and (len(owners) == 1 or f" {owner} " in line.replace(" | ", " "))):
                # Phrases that are sure first, then the longest, the longer maker, the one that comes first.
                rank = (not sure, -size, -len(owner), end - len(turned), name, owner)
                if best is None or rank < best[0]:
                    after = line[end + 1 :].split(" ", 2)
                    stated = part or (None if after[1:2] and after[1] in _UNIT_OF else number(after[0]))
                    best = (rank, owner, name, stated)
    return best


def _finding(blocks: list):
    """One pass over the listings: a part of them is held while all blocks of phrases are searched in it."""
    built: dict[int, object] = {}

    def automaton(n: int):
        if n not in built:
            if len(built) >= 2:
                built.clear()
            built[n] = _automaton(blocks[n].value)
        return built[n]

    def search(rows: list[tuple]) -> pa.RecordBatch:
        best: list = [None] * len(rows)
        for n in range(len(blocks)):
            phrases = automaton(n)
            if len(phrases):
                best = [_best(phrases, f" {text} ", brand, part, b) for (_, brand, part, text), b in zip(rows, best, strict=True)]
        found = [(r[0], b[1], b[2], b[3]) for r, b in zip(rows, best, strict=True) if b]
        key, owner, name, part = zip(*found, strict=True) if found else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(key, run.kind), *[pa.array(c, pa.string()) for c in (owner, name, part)]], names=["key", "owner", "name", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[batch[c].to_pylist() for c in ("key", "maker", "installment", "text")], strict=True)
            if len(held) >= HELD_LISTINGS:
                yield search(held)
                held = []
        if held:
            yield search(held)

    return run


def _bounded_rows(df: DataFrame, what: str) -> list:
    held = df.limit(SENT_ROWS + 1).collect()
    if len(held) > SENT_ROWS:
        raise ValueError(f"{what} have more than {SENT_ROWS} values")
    return held


def mined_words(rows: DataFrame) -> Words:
    """The closed vocabularies of the catalogue. They don't grow with the listings; the driver checks that.

    A key states a property if a word of its name says so, or if at least half of its values that recur are values
    of keys that say so ("Shade" has the values of "Color"). Kinds are whatever the keys of kinds name.
    """
    pairs = rows.select(F.explode(F.from_json("details", "map<string,string>")).alias("k", "v")).where("v is not null")
    values = written(pairs.groupBy(F.lower(F.trim("k")).alias("k"), F.lower(F.trim("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")), "details")
    keys = [r["k"] for r in _bounded_rows(values.select("k").distinct(), "keys of details")]
    named = {k: p for k in keys for p, words in KEY_WORDS.items() if any(w in words for w in spaced(k).split())}
    plainly = F.lower(F.regexp_replace("v", r"[^\p{L}\p{N}]+", ""))
    if named:
        what = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("k")]
        again = values.where("n > 1 and length(v) > 1").withColumn("w", plainly).withColumn("p", what)
        known = again.where("p is not null").select("w", F.col("p").alias("q")).distinct()
        unnamed = again.where("p is null").drop("p")
        told = unnamed.join(known, "w").groupBy("k", "q").agg(F.sum("n").alias("held"))
        most = told.join(unnamed.groupBy("k").agg(F.sum("n").alias("every")), "k").where("held * 2 >= every and q not in ('maker', 'installment')")
        by_values: dict[str, tuple] = {}
        for r in _bounded_rows(most, "keys of details"):
            by_values[r["k"]] = max(by_values.get(r["k"], (0, "")), (r["held"], r["q"]))
        named |= {k: p for k, (_, p) in by_values.items()}
    vocabulary = {k: p for k, p in named.items() if p in ("platform", "edition", "colour", "kind")}
    empty = values.select(F.lit("").alias("what"), "v").limit(0)
    if vocabulary:
        what = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])[F.col("k")]
        empty = values.select(what.alias("what"), "v").where("what is not null").distinct()
    selling = rows.select(F.explode(F.regexp_extract_all("title", F.lit(r"\[([^\[\]]+)\]"), 1)).alias("v")).where(F.octet_length("v") == F.char_length("v"))
    often = selling.groupBy(F.lower(F.regexp_replace("v", r"[^A-Za-z0-9% ]", "")).alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("selling").alias("what"), "v")
    held = _bounded_rows(empty.unionByName(often), "kinds, platforms, editions, colours and selling phrases")
    return Words({plain(k): p for k, p in named.items()}, sorted((r["what"], r["v"]) for r in held))


def _kind_classes(read: DataFrame) -> dict[str, str]:
    """Each name of a kind with the one that stands for all names of that kind.

    Sellers name one kind in several ways, and many listings use two of them: names that stand together in at least
    ``KIND_SHARE`` of the listings in which the rarer of them stands with another name are one kind.
    """
    several = read.where(F.size("kinds") > 1).select("kinds")
    both = several.select(F.explode("kinds").alias("a"), "kinds").select("a", F.explode("kinds").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    each = {r["a"]: r["n"] for r in _bounded_rows(several.select(F.explode("kinds").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n")), "names of kinds")}
    of = {k: k for k in each}

    def top(k: str) -> str:
        while of[k] != k:
            k = of[k]
        return k

    for r in sorted(_bounded_rows(both, "pairs of kinds"), key=lambda r: (-r["n"], r["a"], r["b"])):
        if r["n"] >= KIND_SHARE * min(each[r["a"]], each[r["b"]]):
            a, b = sorted((top(r["a"]), top(r["b"])))
            of[b] = a
    return {k: top(k) for k in of if top(k) != k}


def _completed(keys: DataFrame) -> DataFrame:
    """Listings that leave a property out, given it by the one fuller variant that agrees in all they state.

    Where several fuller variants agree, the one counts whose listing has the same title; without such a one
    the listing keeps what it states. A fuller variant is looked up by what a listing would say that leaves out the same
    properties, so partial and full listings of a product meet by equality, however many there are.
    """
    group = ["maker", "name", "kind", "installment"]
    stated = sum((F.col(p).isNotNull().cast("int") for p in PROPERTIES), F.lit(0))
    mask = sum((F.when(F.col(p).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(PROPERTIES)), F.lit(0))
    counted = keys.withColumn("stated", stated).withColumn("mask", mask)
    sizes = counted.groupBy(*group).agg(F.max("stated").alias("most"), F.min("stated").alias("fewest")).where("fewest < most")
    ranked = counted.join(bounded(written(sizes, "families")), group)
    part = written(ranked.where("stated < most").select("key", *group, "line", "mask", F.to_json(F.struct(*PROPERTIES)).alias("said")), "partial")
    if part.isEmpty():
        return keys.drop("line")
    full = written(ranked.where("stated = most").select(*group, "line", F.struct(*PROPERTIES).alias("v")).distinct(), "full")
    shown = F.to_json(F.struct(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"v.{p}")).alias(p) for i, p in enumerate(PROPERTIES)]))

    def only(rows: DataFrame, by: list[str]) -> DataFrame:
        masks = part.select(*by, "mask").distinct()
        each = rows.join(masks, by).withColumn("said", shown).groupBy(*by, "mask", "said").agg(F.min("v").alias("v"), F.count_distinct("v").alias("n"))
        return written(each.where("n = 1").drop("n"), "fuller")

    fuller, twins = only(full.drop("line").distinct(), group), only(full, [*group, "line"])
    by = [*group, "mask", "said"]
    one = part.join(bounded(fuller).withColumnRenamed("v", "v0"), by, "left").join(bounded(twins).withColumnRenamed("v", "v1"), [*by, "line"], "left")
    one = written(one.select("key", F.coalesce("v0", "v1").alias("v")).where("v is not null"), "completed")
    joined_keys = keys.drop("line").join(bounded(one), "key", "left")
    return joined_keys.select("key", *group, *[F.coalesce(F.col(p), F.col(f"v.{p}")).alias(p) for p in PROPERTIES])


def product_keys(df: DataFrame, key: str, title: str, features: str, details: str, brand: str | None = None, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """``key, maker, name, kind, installment`` and the variant properties of each listing that could be identified.

    Which keys of the details state what, the names of kinds, platforms, editions and colours, and which names mean one
    kind are mined first (:func:`mined_words`, ``_kind_classes``). Listings that state their maker are trusted: their
    line "name kind from maker", or what is left of their
    titles once maker, kind, properties and selling phrases are taken away, is mined as the maker's model phrase, of any length.
    All phrases are then looked for in every listing's title and features (Aho-Corasick, words in either order),
    and the longest one that is consistent with the listing's maker names the product; phrases that only one listing
    gives, and not by such a line, count only where no other is found. A listing without a stated
    maker takes the phrase's maker if it is the only one or the listing mentions it. Makers are read from the
    details, ``brand`` or that line. Values are compared in one unit and one spelling.

    Copies of a key count once. NULL or broken JSON states nothing; listings without any phrase have no
    row; an unstated kind is a kind of its own (an empty text); no number means the first installment. A property that a
    listing leaves out is taken from the only fuller
    variant that agrees in all the listing states, or of several from the one with the same title; else being unstated is a value of its own.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(title).isNotNull()).select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(features).alias("features"), F.col(details).alias("details"), (F.col(brand) if brand else F.lit(None).cast("string")).alias("brand"))
    rows = rows.groupBy("key").agg(F.min(F.struct("title", "features", "details", "brand")).alias("r")).select("key", "r.*")
    kind = rows.schema["key"].dataType
    fields = ", ".join(f"{f} string" for f in _FIELDS)
    read = written(rows.mapInArrow(_reading(mined_words(rows)), f"key {kind.simpleString()}, {fields}, model string, said boolean, kinds array<string>"), "listings")
    models = read.where("model is not null").groupBy("maker", "model").agg((F.count(F.lit(1)) + F.count_if("said")).alias("support"))
    # Phrases of the same words together: whether a phrase has one maker is then seen in its block.
    bag = F.array_join(F.array_sort(F.split("model", " ")), " ").alias("bag")
    dictionary = written(models.groupBy(bag).agg(F.collect_list(F.struct("maker", "model", (F.col("support") > 1).alias("sure"))).alias("phrases")), "phrases")
    send, blocks, block = df.sparkSession.sparkContext.broadcast, [], []
    for r in dictionary.toLocalIterator():  # one block of bounded size after the other; the workers get them as broadcasts
        more = [(p["maker"], p["model"], p["sure"]) for p in r["phrases"]]
        if block and len(block) + len(more) > block_phrases:
            blocks.append(send(block))
            block = []
        block += more
    blocks.append(send(block))
    run = _finding(blocks)
    run.kind = _arrow(kind)
    found = read.select("key", "maker", "installment", "text").mapInArrow(run, f"key {kind.simpleString()}, owner string, name string, part string")
    same = _kind_classes(read)
    first = F.coalesce(F.get("kinds", F.lit(0)), F.lit(""))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in same.items() for x in kv])[first], first) if same else first
    stated = read.select(F.col("key").alias("__key"), named.alias("kind"), "line", *PROPERTIES)
    whole = found.join(stated, F.col("key") == F.col("__key"))
    keys = whole.select("key", F.col("owner").alias("maker"), "name", "kind", F.coalesce("part", F.lit("1")).alias("installment"), "line", *PROPERTIES)
    return _completed(written(keys, "identified"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def same_products(df: DataFrame, key: str, title: str, features: str, details: str, brand: str | None = None, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """``key_a, key_b``: listings of one product, smaller key first. See :func:`product_keys`."""
    keys = product_keys(df, key, title, features, details, brand, block_phrases)
    same = ["maker", "name", "kind", "installment", *PROPERTIES]
    ids = written(keys.select("key", F.sha2(F.to_json(F.struct(*same)), 256).alias("product")), "products")
    return pairs_within(ids, "product", "key").select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def product_groups(df: DataFrame, key: str, title: str, features: str, details: str, brand: str | None = None, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """``key, product_id, listings``: each identified listing with its product and how many listings that has."""
    keys = product_keys(df, key, title, features, details, brand, block_phrases)
    ids = keys.select("key", F.sha2(F.to_json(F.struct("maker", "name", "kind", "installment", *PROPERTIES)), 256).alias("product_id"))
    sizes = ids.groupBy("product_id").agg(F.count(F.lit(1)).alias("listings"))
    return ids.join(sizes, "product_id").select("key", "product_id", "listings")
