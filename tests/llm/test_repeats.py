"""Texts and items that repeat themselves: near duplicates, decontamination and lines of a site."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from odolake.llm.decontaminate import Finder, Item, _seeds, contaminations, keep_clean, short_items
from odolake.llm.line_dedup import drop_boilerplate
from odolake.llm import near_dedup
from odolake.llm.near_dedup import aligned_similarity, block_links, keep_one, labelled_runs, near_classes, order_sketches
from odolake.llm.text import word_hashes

DOCS = "doc_id bigint, text string"


def words_of(text):
    return next(iter(word_hashes([text])))[1]


def test_a_text_written_twice_is_another_text(spark):
    draw = random.Random(1)
    base = " ".join(f"w{draw.randrange(10**6)}" for _ in range(100))
    rows = [(1, base), (2, f"{base} {base}"), (3, " ".join([base] * 4)), (4, base + " end"), (5, f"{base} {base} end")]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == [1, 2, 3]
    a, b = (labelled_runs(words_of(t), 5) for _, t in rows[:2])
    assert aligned_similarity(a, b, 0.4) == pytest.approx(96 / 196)  # 196 runs, of which 96 stand in the shorter text


def test_a_very_long_text_and_its_copy_are_one_class(spark):
    draw = random.Random(2)
    long = [f"w{draw.randrange(10**6)}" for _ in range(120_000)]
    near = [*long[:60_000], "other", *long[60_001:]]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:60_000])), (4, "word " * 100_000)], DOCS)
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_many_copies_of_two_originals_give_two_classes(spark):
    draw = random.Random(3)
    rows = []
    for k in range(2):
        base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
        for i in range(150):
            copy = list(base)
            for at in draw.sample(range(150), draw.choice([0, 0, 1, 2])):
                copy[at] = f"e{draw.randrange(10**6)}"
            rows.append((1_000 * k + i, " ".join(copy)))
    classes = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert set(classes.values()) == {0, 1_000} and all(c == i // 1_000 * 1_000 for i, c in classes.items())


@pytest.fixture(scope="module")
def around_the_threshold():
    """Copies of few originals that are like some of the other copies only, and the classes by all pairs that share a sketch."""
    draw = random.Random(7)
    texts = []
    for _ in range(3):
        base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for _ in range(160):
            copy = list(base)
            for at in draw.sample(range(120), draw.choice([1, 2, 3, 4])):
                copy[at] = f"e{draw.randrange(30)}"
            texts.append(" ".join(copy))
    words = [words_of(t) for t in texts]
    runs = [labelled_runs(w, 5) for w in words]
    sketches = [order_sketches(w, 5, near_dedup.SKETCHES, near_dedup.WIDTH) for w in words]
    classes = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if classes[i] != classes[j] and (sketches[i] == sketches[j]).any() and aligned_similarity(runs[i], runs[j], 0.8) >= 0.8:
            low, high = sorted((classes[i], classes[j]))
            classes = [low if c == high else c for c in classes]
    return texts, dict(enumerate(classes))


@pytest.mark.parametrize("size", [512, 40])
def test_no_pair_that_shares_a_sketch_is_left_out(spark, monkeypatch, around_the_threshold, size):
    texts, classes = around_the_threshold
    assert 100 < len(set(classes.values())) < len(texts) - 100  # neither all alone nor a class an original
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", size)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == classes
    if size < 512:
        assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted(set(classes.values()))


def test_the_pipeline_keeps_one_text_of_each_class(spark, around_the_threshold):
    texts, classes = around_the_threshold
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS + ", lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes.values()))


def test_blocks_link_across_and_inside_and_judge_a_pair_once():
    a, b = np.arange(100, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)
    runs = [a, b, a[:95], b[:95], a[:50]]
    labels, sketch = np.arange(5), np.array([[1, 9]] * 3 + [[2, 9]] * 2)
    every, none = np.arange(5), np.array([], dtype=int)
    assert block_links(runs, labels, sketch, 0, every, None, 0.8) == [(0, 2), (1, 3)]
    assert block_links(runs, labels, sketch, 1, every, None, 0.8) == [(1, 3)]  # the others met in the bucket of the first sketch
    assert block_links(runs, labels, sketch, 0, every[:2], every[2:], 0.8) == [(0, 2), (1, 3)]
    assert block_links(runs, np.array([0, 1, 0, 1, 2]), sketch, 0, every, None, 0.8) == []
    assert block_links(runs, labels, sketch, 0, none, every, 0.8) == block_links(runs, labels, sketch, 0, every, none, 0.8) == []


def test_repetitive_texts_take_seconds_and_are_found():
    item = words_of("no " * 200)
    finder = Finder([Item(1, item)], _seeds([Item(1, item)], 0.6), 0.6)
    started = time.perf_counter()
    found = finder.find(["no " * 350_000, "yes no " * 1_000, "no " * 130])
    assert time.perf_counter() - started < 30
    assert [[f["score"] for f in x] for x in found] == [[1.0], [], [0.65]]


def test_windows_hold_every_copy_that_alignment_finds():
    draw = random.Random(5)
    vocabulary = np.arange(1, 7, dtype=np.uint64)
    from odolake.llm.decontaminate import MATCH, local_scores

    for _ in range(150):
        item = np.array(draw.choices(vocabulary, k=draw.randrange(2, 14)), dtype=np.uint64)
        text = np.array(draw.choices(vocabulary, k=draw.randrange(60)), dtype=np.uint64)
        if draw.random() < 0.5:
            at = draw.randrange(text.size + 1)
            text = np.concatenate([text[:at], item, text[at:]])
        finder = Finder([Item(1, item)], _seeds([Item(1, item)], 0.6), 0.6)
        whole = local_scores(item, text[None, :])[0][0] / (MATCH * item.size) if text.size else 0
        best = max((local_scores(item, text[None, a:b])[0][0] / (MATCH * item.size) for _, a, b in finder.windows(text)), default=0)
        assert (best if best >= 0.6 else None) == (whole if whole >= 0.6 else None)


def test_items_of_one_word_are_left_out_and_named(spark):
    docs = spark.createDataFrame([(1, "over the hills"), (2, "far away")], DOCS)
    bench = spark.createDataFrame([(1, "The?"), (2, None), (3, "far away"), (4, "")], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminations(docs, bench).collect()] == [(2, 3)]
    assert [r["doc_id"] for r in keep_clean(docs, bench).collect()] == [1]
    assert sorted(r["item_id"] for r in short_items(bench).collect()) == [1, 2, 4]
    assert [(r["doc_id"], r["item_id"]) for r in contaminations(docs, bench, min_words=1).collect()] == [(1, 1), (2, 3)]


def test_lines_of_one_page_in_a_hundred_go(spark):
    rows = [(i, f"own line {i}\nshared by few" if i < 5 else f"own line {i}\nfooter" if i % 50 == 0 else f"own line {i}", "h") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    kept = {r["doc_id"]: r["text"] for r in drop_boilerplate(docs).collect()}
    assert kept[0] == "own line 0" and kept[50] == "own line 50" and kept[7] == "own line 7"  # five of 400 pages, and seven of them
    more = docs.unionByName(spark.createDataFrame([(i, f"own line {i}", "h") for i in range(400, 1_000)], docs.schema))
    kept = {r["doc_id"]: r["text"] for r in drop_boilerplate(more).collect()}
    assert kept[0] == "own line 0\nshared by few" and kept[50] == "own line 50\nfooter"  # under one in a hundred now
