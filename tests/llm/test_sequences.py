"""Near duplicates, decontamination, fingerprints and line dedup against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from odolake.llm.components import components
from odolake.llm.decontaminate import GAP, MATCH, MISS, contaminations, keep_clean, local_scores
from odolake.llm.imatch import fingerprints
from odolake.llm.line_dedup import drop_boilerplate
from odolake.llm.near_dedup import aligned_similarity, keep_one, near_classes
from odolake.llm.text import occurrence, shingle_hashes, word_hashes

DOCS = "doc_id bigint, text string"


def prose(draw: random.Random, count: int) -> list[str]:
    return ["".join(draw.choice(["the", "on", "ti", "re", "en"]) for _ in range(draw.randint(1, 4))) for _ in range(count)]


def edited(draw: random.Random, words: list[str], share: float) -> list[str]:
    return [prose(draw, 1)[0] if draw.random() < share else w for w in words]


def runs(text: str) -> set:
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_word_hashes_do_not_depend_on_slices():
    texts = ["Über den Fluss, 12 mal!", None, "", "a" * 500, "x y " * 400]
    whole = {i: w.tolist() for i, w in word_hashes(texts)}
    assert whole == {i: w.tolist() for i, w in word_hashes(texts, size=16)}
    assert len(whole[0]) == 5 and whole[1] == whole[2] == []
    assert whole[0] == dict(word_hashes(["über DEN fluss 12 MAL"]))[0].tolist()
    assert occurrence(np.array([7, 3, 7, 7, 3])).tolist() == [0, 0, 1, 2, 1]
    assert shingle_hashes(np.arange(3, dtype=np.uint64), 5).size == 1


def test_components_of_chains_and_stars(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("x", "z"), ("q", "q"), (None, "a")]
    found = components(spark.createDataFrame(links, "l string, r string"), "l", "r").collect()
    assert {(r["node"], r["root"]) for r in found} == {*((n, "a") for n in "abcde"), *((n, "x") for n in "xyz")}
    assert components(spark.createDataFrame([], "l string, r string"), "l", "r").count() == 0


def test_aligned_similarity_is_ordered_overlap():
    a = np.arange(100, dtype=np.uint64)
    assert aligned_similarity(a, a, 0.8) == 1
    assert aligned_similarity(a, a[:90], 0.8) == pytest.approx(0.9)
    assert aligned_similarity(a, a[::-1].copy(), 0.8) < 0.1
    assert aligned_similarity(a, a[:0], 0.8) == 0


@pytest.fixture(scope="module")
def copies(spark):
    draw = random.Random(4)
    texts = []
    for _ in range(12):
        base = prose(draw, draw.randint(30, 120))
        texts.append(" ".join(base))
        texts += [" ".join(edited(draw, base, draw.choice([0.0, 0.005, 0.02, 0.08]))) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, None), (902, ""), (903, ""), (904, "!?"), (0, texts[0])]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", `Text_key` string, class_id int")


def test_near_classes_match_brute_force(copies):
    rows, docs = copies
    got = [(r["doc_id"], r["class_id"]) for r in near_classes(docs).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    sets = {i: (t, runs(t)) for i, t in rows if t}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, (s, a)), (j, (t, b)) in itertools.combinations(sets.items(), 2):
        if s == t or a and b and len(a & b) / len(a | b) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: found[i] for i in sets} == {i: root(i) for i in sets}
    assert found[900] == 900 and found[901] == 901 and found[903] == 902 and found[904] == 904


def test_keep_one_keeps_columns_and_nulls(copies):
    rows, docs = copies
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    classes = {r["class_id"] for r in near_classes(docs).collect()}
    assert ids == sorted(classes)
    assert keep_one(docs.filter("false")).count() == near_classes(docs.filter("false")).count() == 0


def plain_local(item, words):
    best, before = 0, [0] * (len(words) + 1)
    for x in item:
        now = [0]
        for j, y in enumerate(words):
            now.append(max(0, before[j] + (MATCH if x == y else MISS), before[j + 1] - GAP, now[j] - GAP))
        best, before = max(best, *now), now
    return best


def test_local_scores_match_plain_alignment():
    draw = np.random.RandomState(3)
    item = draw.randint(1, 6, 9)
    windows = draw.randint(1, 6, (40, 25))
    assert local_scores(item, windows)[0].tolist() == [plain_local(item, w) for w in windows]


def test_contaminations_find_edited_copies_and_leave_others(spark):
    draw = random.Random(8)
    items = [prose(draw, 25) for _ in range(4)] + [["short", "one"]]
    filler = [prose(draw, 60) for _ in range(8)]
    moved = items[1][:8] + ["new"] + items[1][8:12] + items[1][13:]
    texts = {0: filler[0] + items[0] + filler[1], 1: filler[2] + moved, 2: filler[3], 3: items[2][:6] + filler[4],
             4: ["a", "Short,", "one!"], 5: [], 7: filler[6] + items[3] + filler[7] * 50 + items[0]}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(6, None), (None, " ".join(items[2]).upper())]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(0, " ".join(items[0])), (9, None), (8, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminations(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (4, 4), (7, 3), (7, 0), (None, 2)}
    assert got[0, 0] == 1.0 and 0.8 < got[1, 1] < 1.0
    kept = keep_clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6] and kept.columns == docs.columns
    assert contaminations(docs, bench.filter("false")).count() == contaminations(docs.filter("false"), bench).count() == 0


def test_a_passage_in_every_text_is_still_found(spark):
    draw = random.Random(9)
    item = prose(draw, 20)
    docs = spark.createDataFrame([(i, " ".join(prose(draw, 30) + item)) for i in range(60)], DOCS)
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string")
    assert contaminations(docs, bench).count() == 60


def test_edited_copies_of_a_passage_that_leaked_widely_are_found(spark):
    """The edited copies lack the rarest n-grams of the item; the last one shares no three words in a row with it."""
    words = [f"w{i}" for i in range(30)]
    two = [f"new{i}" if i in (8, 18) else w for i, w in enumerate(words)]
    often = [x for i, w in enumerate(words) for x in ([w, f"in{i}"] if i % 2 else [w])]
    texts = [f"text {i} " + " ".join(words) for i in range(1_000)] + [" ".join(two), " ".join(often), "w1 w2 and w7 w8"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in contaminations(docs, bench).collect()}
    assert set(got) == set(range(1_002))
    assert got[1_000] == pytest.approx((2 * 28 - 2) / 60) and got[1_001] == pytest.approx((2 * 30 - 14) / 60)


def test_fingerprints_of_edited_texts(spark):
    draw = random.Random(2)
    texts = [" ".join(prose(draw, draw.randint(0, 80))) for _ in range(60)] + [None, "", "é" * 9, "x"]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(1000, texts[5]), (3, texts[1])]
    draw.shuffle(rows)
    got = fingerprints(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", key int")).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: r[0])
    hashes = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        hashes.setdefault(i, set()).add(hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest())
    text_of, prints = dict(rows), {}
    for r in got:
        assert r["n_chars"] == len(text_of[r["doc_id"]] or "") and r["edited_sha256"] in hashes[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text_of[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    long_ones = [r for r in got if r["n_chars"] > 150]
    assert np.mean([r["near_edited"] for r in long_ones]) > 0.3 + np.mean([r["near_next"] for r in long_ones])
    assert fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints(spark.createDataFrame([(4, "abcdefgh")], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_boilerplate_goes_by_host(spark):
    rows = [(i, "h" if i < 8 else None if i < 14 else "k", "\n".join(["menu", f"text {i}", "", "menu"])) for i in range(16)]
    rows += [(20, "h", None), (21, "h", ""), (22, "h", "menu"), (22, "h", "menu"), (23, "k", "menu"), *[(30 + i, "m", "copy\nof one") for i in range(9)]]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, source string, text string, keys string")
    got = [tuple(r) for r in drop_boilerplate(docs, min_pages=5, dropped="n").collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[0][2] == "text 0\n" and by_id[0][4] == 2 and by_id[9][2] == "text 9\n"
    assert by_id[14][2] == "menu\ntext 14\n\nmenu" and by_id[23][2] == "menu"  # too few pages of k
    assert by_id[20][2] is None and by_id[21][2] == "" and by_id[22][2] == ""
    assert by_id[30][2] == "copy\nof one" and by_id[30][3] == "z"  # copies of one page count once
    assert drop_boilerplate(docs.filter("false")).count() == 0
