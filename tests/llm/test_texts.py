"""Equal-looking texts, near-duplicates, leaks, spans and products against brute force and on odd inputs."""

import json
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("quillrank.llm")

from quillrank.llm import leaks, lookalike, neardup, products, spans  # noqa: E402

WORDS = "arena bridge castle dragon ember forest garden harbour island jungle knight lantern market needle orchard palace quarry river signal temple umbra valley windmill yonder zephyr".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("a, b", [
    ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("café", "café"), ("zero​width­", "zerowidth"), ("a \n b ", "a b"), ("ﬁsh Ⅱ", "fish II"), ("a\x00b", "ab"),
])
def test_folding(a, b):
    assert lookalike.folded(a) == lookalike.folded(b) == b


@pytest.mark.parametrize("sent", [0, 100_000])
def test_unified(spark, sent):
    data = [(1, "The castle gate"), (2, "The саstle gаte"), (3, "Ѕһіpѕ today"), (4, "Ships today"), (5, "тест слово"), (6, None), (7, " ​ "), (8, "abοve one"), (9, "аbove one"), (10, "Café"), (11, "Cafe"), (12, "xуz")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in data], "k int, t string, __f string")
    got = {r.k: r.out for r in lookalike.unified(df, "t", "out", sent_rows=sent).collect()}
    assert got[2] == got[1] == "The castle gate" and got[3] == got[4] and got[5] == "тест слово" and got[6] is None and got[7] == ""
    assert got[8] == got[9] == "above one"  # no clean copy, but two disguises agree
    assert got[10] != got[11] and got[12] == "xуz"  # accents are seen; no word, no repair
    assert lookalike.unified(df.limit(0), "t", "out").count() == 0


def test_more_look_alikes_than_latin_letters(spark):
    clean = ["CONTROLLER", "XBOX CONTROLLER", "CONTROLLER для дома"]
    odd = ["СОΝТRОLLЕR", "ХВОХ СОΝТRОLLЕR", "СОΝТRОLLЕR для дома"]  # Cyrillic, one Greek letter, Latin R and L
    assert all(sum("\u0400" <= c < "\u0500" for c in t) > sum("A" <= c <= "Z" for c in t) for t in odd)
    genuine = ["тот рост у нас", "это а не то"]  # letters like Latin ones in a Cyrillic text stay
    texts = [*clean, *odd, *genuine, "a y"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.out for r in sorted(lookalike.unified(df, "t", "out").collect())]
    assert got == [*clean, *clean, *genuine, "a y"]
    assert sorted(tuple(r) for r in lookalike.equal_looking(df, "k", "t", []).collect()) == [(0, 3), (1, 4), (2, 5)]


def test_equal_looking_pairs(spark):
    data = [("a", "i", "Good game"), ("b", "i", "Good game"), ("c", "i", "Good game"), ("d", "j", "Good  game"), ("e", "i", "good game"), ("f", "i", "​"), ("g", "i", None), ("a", "i", "Good game"), (None, "i", "Good game")]
    df = spark.createDataFrame(data, "k string, s string, t string")
    assert sorted(tuple(r) for r in lookalike.equal_looking(df, "k", "t", ["s"]).collect()) == [("a", "b"), ("a", "c")]
    assert lookalike.equal_looking(df.limit(0), "k", "t", ["s"]).count() == 0


def reviews(seed=7):
    rng = random.Random(seed)
    rows = []
    for k in range(260):
        item = "hot" if rng.random() < 0.6 else f"i{rng.randrange(6)}"
        n = rng.choice([10, 36, 40, 60, 90, 200, 700])
        words = sentence(rng, n).split()
        rows.append((f"r{k:04d}", item, " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 2])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(n)] = f"new{rng.random()}".replace(".", "")
            rows.append((f"r{k:04d}c{c}", item, " ".join(copy)))
    rows += [("null", "hot", None), ("empty", "hot", ""), (None, "hot", rows[0][2]), ("noitem", None, rows[0][2]), rows[5]]
    return rows


def brute_pairs(rows, run, least_words, least):
    sets, out = {}, set()
    for k, item, t in rows:
        w = lookalike.WORD.findall((t or "").lower())
        if k and item and len(w) >= max(least_words, run):
            sets[k] = (item, set(zip(*(w[i:] for i in range(run)))))
    for a, b in combinations(sorted(sets), 2):
        if sets[a][0] == sets[b][0]:
            x, y = sets[a][1], sets[b][1]
            if len(x & y) >= least * len(x | y):
                out.add((a, b))
    return out


@pytest.mark.parametrize("group", [8, 40, 4096])
@pytest.mark.parametrize("run, least", [(3, 0.55), (5, 0.8)])
def test_similar_pairs_equal_brute_force(spark, group, run, least):
    rows = reviews()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, item string, t string, cls string").repartition(5)
    got = [tuple(r) for r in neardup.similar_pairs(df, "id", "item", "t", run, 36, least, group).collect()]
    want = brute_pairs(rows, run, 36, least)
    assert len(got) == len(set(got)) and set(got) == want
    linked = {r.key: r.n_links for r in neardup.classes_with_links(df, "id", "item", "t", run, 36, least, group).collect()}
    count = defaultdict(int)
    for a, b in want:
        count[a] += 1
        count[b] += 1
    assert {k: n for k, n in linked.items() if n} == dict(count)


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id string, item string, t string")
    assert neardup.similar_pairs(df, "id", "item", "t").count() == 0


def test_bit_planes_count_exactly():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 256, (200, 32), np.uint8)
    planes, masks = neardup._planes(bits), (np.uint64(0) - np.unpackbits(bits, axis=1, bitorder="little").T.astype(np.uint64)).astype(np.uint64)
    q, w = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(planes.shape[1]), indexing="ij"))
    i, j = neardup._within(masks, planes, q, w, np.full(len(q), 118, np.uint64))
    far = np.bitwise_count(bits[:, None, :] ^ bits[None, :, :]).sum(axis=2)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist()) if b < 200} == {tuple(x) for x in np.argwhere(far <= 118).tolist()}


@pytest.mark.parametrize("shard, sent", [(400_000, 500_000), (50, 30)])
def test_leaks_equal_brute_force(spark, monkeypatch, shard, sent):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    monkeypatch.setattr(leaks, "SENT_WORDS", sent)
    rng = random.Random(1)
    units = [(f"t{k}", sentence(rng, rng.choice([3, 8, 13, 14, 30]))) for k in range(12)] + [("empty", ""), ("null", None), ("marks", "?!")]
    docs = []
    for k in range(80):
        words = sentence(rng, rng.choice([0, 5, 40, 150])).split()
        if k % 3 == 0:
            u = units[rng.randrange(12)][1].split()
            cut = u[rng.randrange(3) :][: rng.choice([12, 13, 40])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = cut
        docs.append((k, "  ".join(words).upper() if k % 2 else ", ".join(words)))
    docs += [(900, None), (901, ""), (902, units[2][1].replace("a", "а"))]
    split = lambda t: lookalike.WORD.findall((t or "").translate(str.maketrans(lookalike.LATIN_TWINS)).lower())
    want = set()
    for d, t in docs:
        own = split(t)
        for u, x in units:
            w = split(x)
            m = min(13, len(w))
            if m and any(own[i : i + m] == w[j : j + m] for i in range(len(own) - m + 1) for j in range(len(w) - m + 1)):
                want.add((d, u))
    dd, uu = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(units, "unit_id string, text string")
    rows = leaks.leaked(dd, "doc_id", "text", uu, "unit_id", "text").collect()
    assert {(r.doc, r.unit) for r in rows} == want and len(rows) == len(want)
    assert {r.doc_id for r in leaks.without_leaks(dd, "doc_id", "text", uu, "unit_id", "text").collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert leaks.leaked(dd.limit(0), "doc_id", "text", uu, "unit_id", "text").count() == 0
    assert leaks.leaked(dd, "doc_id", "text", uu.limit(0), "unit_id", "text").count() == 0


@pytest.mark.parametrize("least", [60, 300])
def test_spans_equal_brute_force(spark, least):
    rng = random.Random(least)
    docs = [(k, sentence(rng, rng.choice([0, 5, 60, 200]))) for k in range(60)]
    for k in range(60, 110):
        t = docs[rng.randrange(60)][1]
        at = rng.randrange(len(t) + 1)
        docs.append((k, sentence(rng, rng.randrange(30)) + t[at : at + rng.choice([least - 1, least, least + 1, 5 * least])] + "😀" + sentence(rng, rng.randrange(30))))
    docs += [(200, docs[7][1]), (201, docs[7][1]), (202, None), (203, "ab" * 700), (204, "x" + "ab" * 700), (205, "é" * least), (206, "é" * (least + 5))]
    held = defaultdict(set)
    for k, t in docs:
        for i in range(len(t or "") - least + 1):
            held[t[i : i + least]].add(k)
    want = {p for s in held.values() for p in combinations(sorted(s), 2)}
    df = spark.createDataFrame([(*d, b"x") for d in docs], "doc_id long, text string, cls binary").repartition(5)
    got = [tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text", least).collect()]
    assert set(got) == want and len(got) == len(want)
    shared = {r.key: r.shared_chars for r in spans.shared_lengths(df, "doc_id", "text", least).collect()}
    for k, t in docs:
        covered = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - least + 1):
            if len(held[t[i : i + least]]) > 1:
                covered[i : i + least] = True
        assert shared[k] == covered.sum()
    assert spans.sharing_pairs(df.limit(0), "doc_id", "text").count() == 0


SCHEMA = "item_id string, title string, f string, d string, brand string, product string"


def listing(key, title, f=None, d=None, brand=None):
    return (key, title, None if f is None else json.dumps(f), None if d is None else json.dumps(d), brand, "x")


def test_products(spark):
    cable = {"Manufacturer": "Brask", "Item Type": "link cable", "Cable Length": "3 m", "Color": "red", "Unit Count": "2-pack"}
    game = {"Brand": "TAVRO", "Product Type": "video game", "Edition": "Gold Ed.", "Platform": "Orbix 4"}
    data = [
        listing("a", "Brask | Lilunazi Tactics | link cable | 3 m | red", ["In the box: pack of 2"], cable),
        listing("b", "HOT DEAL Lilu-nazi Tactics play-and-charge cable, 9.8 ft, Red by Brask", ["Contents: set of 2"], {**cable, "Cable Length": "300 cm"}),
        listing("c", "Tactics Lilunazi connection cable [HOT DEAL!]", ["Finished in red", "2 pieces", "Length 118.1 inches"], None, "Brask Ltd."),
        listing("d", "Brask Lilunazi Tactics - link cable - 5 m - red [HOT DEAL!]", None, {**cable, "Cable Length": "5 m"}),
        listing("e", "Tavro Sodoyoso Voyage II - game - Orbix IV - Gold Edition", [], game),
        listing("f", "Game disc Sodoyoso Voyage 2 (ORBIX-4)", ["Sodoyoso Voyage video game from Tavro", "You get the GOLD version"], None),
        listing("g", "Tavro Sodoyoso Voyage - game - Orbix IV - Gold Edition", [], game),
        listing("h", None), listing("i", "", ["x"], {"Brand": None}), ("j", "broken", "[", "{", None, "x"), listing("a", "Brask | Lilunazi Tactics | link cable | 3 m | red", ["In the box: pack of 2"], cable),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    for block in (1, 200_000):
        got = sorted(tuple(r) for r in products.same_products(df, "item_id", "title", "f", "d", "brand", block).collect())
        assert got == [("a", "b"), ("a", "c"), ("b", "c"), ("e", "f")]
    sizes = {r.key: r.listings for r in products.product_groups(df, "item_id", "title", "f", "d", "brand").collect()}
    assert sizes["a"] == 3 and sizes["d"] == 1 and "h" not in sizes
    assert products.same_products(df.limit(0), "item_id", "title", "f", "d", "brand").count() == 0


def test_blocks_of_phrases_change_nothing(spark):
    card = lambda maker: {"Brand": maker, "Item Type": "memory card"}
    data = [
        listing("a", "Brask Lilunazi Tactics memory card", None, card("Brask")),
        listing("b", "Tavroson Lilunazi Tactics memory card", None, card("Tavroson")),
        listing("c", "Tavrosonic Tactics Lilunazi memory card", None, card("Tavrosonic")),
        listing("d", "Lilunazi Tactics memory card by Brask"),  # shared by three makers, names one
        listing("e", "Lilunazi Tactics memory card"),  # names none: not identified
        listing("f", "Corvu Zusano Quest memory card", None, card("Corvu")),
        listing("g", "Delmo Abari Racing memory card", None, card("Delmo")),
        listing("h", "Zusano Quest and Abari Racing memory card"),  # equal matches: the first in the text
    ]
    df = spark.createDataFrame(data, SCHEMA)
    for block in (1, 2, 200_000):
        keys = {r.key: (r.maker, r.name) for r in products.product_keys(df, "item_id", "title", "f", "d", "brand", block).collect()}
        assert keys["d"] == keys["a"] == ("brask", "lilunazi tactics") and "e" not in keys
        assert keys["h"] == keys["f"] == ("corvu", "quest zusano")
        assert sorted(tuple(r) for r in products.same_products(df, "item_id", "title", "f", "d", "brand", block).collect()) == [("a", "d"), ("f", "h")]


def test_names_of_many_words(spark):
    data = [
        listing("a", "Corvu The Long Lost Zusano Quest memory card", ["The Long Lost Zusano Quest memory card from Corvu"], None),
        listing("b", "The Long Lost Zusano Quest memory card by Corvu", None, None),
        listing("c", "Zusano Quest memory card by Corvu", None, {"Brand": "Corvu", "Item Type": "memory card"}),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(tuple(r) for r in products.same_products(df, "item_id", "title", "f", "d", "brand").collect()) == [("a", "b")]


def test_full_listings_are_distinct_before_they_meet_partial_ones(spark, monkeypatch):
    plans, written = {}, products.written
    monkeypatch.setattr(products, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().analyzed().toString()}) or written(df, name))
    card = {"Brand": "Corvu", "Item Type": "memory card"}
    data = [listing(f"k{n}", "Zusano Quest memory card by Corvu", None, {**card, "Color": "red"}) for n in range(3)] + [listing("p", "Zusano Quest memory card by Corvu", None, card)]
    assert products.same_products(spark.createDataFrame(data, SCHEMA), "item_id", "title", "f", "d", "brand").count() == 6
    assert "Deduplicate" in plans["full"] and plans["fuller"].count("Deduplicate") == 1  # and they meet by equality, over distinct masks


def test_names_and_kinds_come_from_the_data(spark):
    """A five-word name that holds a four-word one, and a kind of product that no list names."""
    own = {"Brand": "Brask", "Item Type": "video game"}
    data = [
        listing("a", "Brask | The Long Road Back Home | video game", None, own),
        listing("b", "Brask | The Long Road Back Home | video game", None, own),
        listing("c", "Brask | Long Road Back Home | video game", None, own),
        listing("d", "Brask | Long Road Back Home | video game", None, own),
        listing("e", "Silent Typer mechanical keyboard", None, {"Brand": "Corvu", "Item Type": "mechanical keyboard"}),
        listing("f", "Silent Typer mechanical keyboard", None, {"Brand": "Corvu", "Item Type": "mechanical keyboard"}),
        listing("g", "Quiet Typer wobble board", None, None, "Corvu"),  # no kind is stated anywhere
        listing("h", "Quiet Typer wobble board", None, None, "Corvu"),
        listing("i", "Brask | Long Road Back Home 104 | video game", None, own),
        listing("j", "Brask | Long Road Back Home XIV | video game", None, own),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(tuple(r) for r in products.same_products(df, "item_id", "title", "f", "d", "brand").collect()) == [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]
    keys = {r.key: r for r in products.product_keys(df, "item_id", "title", "f", "d", "brand").collect()}
    assert keys["i"].installment == "104" and keys["j"].installment == "14" and keys["c"].installment == "1" and keys["e"].kind == "mechanical keyboard" and keys["g"].kind == ""


def test_one_dirty_listing_makes_no_phrase(spark):
    card = {"Brand": "Corvu", "Item Type": "memory card"}
    data = [listing(f"k{n}", "Corvu | Zusano Quest | memory card", None, card) for n in range(3)] + [listing("x", "Corvu | Grab Zusano Quest | memory card", None, card)]
    found = products.same_products(spark.createDataFrame(data, SCHEMA), "item_id", "title", "f", "d", "brand").collect()
    assert len(found) == 6


def test_keys_and_names_of_kinds_are_mined(spark):
    data = [listing(f"a{n}", "Corvu Zusano Quest memory card", None, {"Brand": "Corvu", "Item Type": "storage card", "Color": c}) for n, c in enumerate(["red", "blue", "red", "blue"])]
    data += [listing(f"b{n}", "Corvu Zusano Quest storage card", None, {"Brand": "Corvu", "Shade": c, "Item Type": "memory card"}) for n, c in enumerate(["red", "blue", "red", "blue"])]
    keys = {r.key: (r.kind, r.colour) for r in products.product_keys(spark.createDataFrame(data, SCHEMA), "item_id", "title", "f", "d", "brand").collect()}
    assert keys["a0"] == keys["b0"] == ("memory card", "red") and keys["b1"] == ("memory card", "blue")


def test_leaks_in_blocks_say_where(spark, monkeypatch):
    rng = random.Random(31)
    units = [(f"u{k}", " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice([4, 13, 40])))) for k in range(10)]
    docs = []
    for k in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(60))]
        u = units[rng.randrange(10)][1].split()
        at = rng.randrange(len(words) + 1)
        words[at:at] = u[rng.randrange(2) :]
        docs.append((k, " ".join(words)))
    dd, uu = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(units, "unit_id string, text string")
    one = sorted(tuple(r) for r in leaks.leaked(dd, "doc_id", "text", uu, "unit_id", "text").collect())
    texts, own = dict(docs), dict(units)
    for d, u, n, at, unit_at in one:
        assert texts[d].split()[at : at + n] == own[u].split()[unit_at : unit_at + n]
    monkeypatch.setattr(leaks, "SENT_WORDS", 60)
    monkeypatch.setattr(leaks, "SHARD_WORDS", 50)
    assert sorted(tuple(r) for r in leaks.leaked(dd, "doc_id", "text", uu, "unit_id", "text").collect()) == one


def _groups_and_rows(monkeypatch):
    seen, written = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    return seen


def test_a_phrase_that_all_texts_share_brings_none_together(spark, monkeypatch):
    rng = random.Random(12)
    stock = " ".join(f"s{k}" for k in range(12))
    data = [(f"r{k:04d}", "item", stock + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))) for k in range(600)]
    data += [(f"x{k}", "item", data[k][2] + " more") for k in range(5)]
    seen = _groups_and_rows(monkeypatch)
    found = neardup.similar_pairs(spark.createDataFrame(data, "k string, s string, t string").repartition(4), "k", "s", "t", group_texts=100).collect()
    assert sorted(tuple(r) for r in found) == [(f"r{k:04d}", f"x{k}") for k in range(5)]
    assert seen["heads"].join(seen["shared-runs"], "grp").groupBy("grp").count().agg({"count": "max"}).first()[0] == 2


def test_a_passage_that_all_documents_share_is_one_group(spark, monkeypatch):
    rng = random.Random(13)
    stock = sentence(rng, 80)[:400]
    data = [(k, sentence(rng, 12) + chr(0x4E00 + k) + stock + chr(0x4E00 + k) + sentence(rng, 12)) for k in range(120)]
    seen, written = {}, spans.written
    monkeypatch.setattr(spans, "written", lambda df, name: seen.update({name: written(df, name)}) or seen[name])
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert spans.sharing_pairs(df, "doc_id", "text", 300).count() == 120 * 119 // 2
    assert seen["members"].count() <= 130  # one row a document
    ends = {r.key: (r.begin, r.end) for r in spans.shared_passages(df, "doc_id", "text", 300).collect()}
    assert all(stock in t[slice(*ends[k])] and len(t[slice(*ends[k])]) <= 402 for k, t in data)
