"""Token files, exact k-means and the audit of a filter chain, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import uuid
import zlib
from itertools import permutations

import numpy as np
import pytest

from odolake.llm import shallot
from odolake.llm.direct_codes import Codes, best_widths, encode
from odolake.llm.filter_audit import audit_filters
from odolake.llm.shallot import cluster_vectors
from odolake.llm import token_files
from odolake.llm.token_files import PieceEncoder, open_segments, read_tokens, segment_bytes, write_tokens
from odolake.session import shared_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("widths", [None, (4, 4, 4, 8, 12), (32,), (8, 24), (12, 20)])
def test_codes_give_back_every_value_and_any_one(widths):
    rng = np.random.default_rng(5)
    for values in ([], [0], [0] * 600, rng.integers(0, 2**32, 700), (2 ** (rng.random(5_000) * 31)).astype(np.int64), [1] * 511 + [2**31] * 514):
        values = np.array(values, dtype=np.uint64)
        codes = Codes(b"odd" + encode(values, widths), 3)
        assert codes.size == values.size and (codes.decode() == values).all()
        places = rng.permutation(values.size)
        assert (codes.take(places) == values[places]).all()
    assert codes[511] == 2**31 and codes[510] == 1
    with pytest.raises(IndexError):
        codes.take([values.size])


def test_widths_are_the_cheapest_and_must_hold_the_values():
    values = np.array([3] * 900 + [50_000] * 100, dtype=np.uint64)
    sizes = {w: len(encode(values, w)) for w in [(4, 12), (8, 8), (16,), (4, 4, 8), (12, 4), (4, 8, 4), (8, 4, 4), (4, 4, 4, 4)]}
    assert len(encode(values)) == min(sizes.values()) and best_widths(values) == min(sizes, key=sizes.get)
    for bad in ((4, 4), (3, 13), (0, 16)):
        with pytest.raises(ValueError):
            encode(values, bad)


def test_pieces_give_the_ids_of_whole_texts():
    random.seed(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "23", ".", ",", "<|endoftext|>", "　", "\x1f", " the", "The", "\r\n", "中文", " ", "x" * 50]
    texts = ["".join(random.choices(parts, k=random.randrange(25))) for _ in range(3_000)]
    encoder = PieceEncoder(BPE)
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    whole = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))  # another kind: no cuts
    assert not whole.cuts
    assert [x.tolist() for x in whole.encode(texts[:50])] == [whole.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:50]]


def test_plain_words_need_no_pattern_and_edge_space_is_not_remembered():
    plain = "The the, the. the... end?! a;b it's don't x1 _ -- it,s the,the .the The"
    texts = [plain, "b c\n", "a c\n d", " lead", "tail \t", "é, é. naïve; ü", "", "one\ntwo three,\nfour", "c\n"]
    encoder = PieceEncoder(BPE)
    for _ in range(2):  # from nothing, and from what is remembered
        assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.known and all(p and p == p.strip() for p in encoder.known)
    encoder, asked = PieceEncoder(BPE), []
    encoder.splits = lambda piece, splits=encoder.splits: asked.append(piece) or splits(piece)
    assert [x.tolist() for x in encoder.encode(["in the, end. it's"])] == [encoder.tokenizer.encode("in the, end. it's").ids]
    assert asked == [" it's"]


def test_words_of_letters_go_to_the_library_together(monkeypatch):
    texts = ["une été, naïve%%% (x) end.\nNext it's", "", "alone", "  two  spaces à  ", "été, été, <|endoftext|> x", "Ŝĉĝ… Ġa ĠĠ, über($)"] * 3
    encoder, asked = PieceEncoder(BPE), []
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.splits = lambda piece, splits=encoder.splits: asked.append(piece) or splits(piece)
    assert [x.tolist() for x in encoder.encode(iter(texts))] == expected
    assert sorted(asked) == sorted([" (x)", " end.\nNext", " it's", " à  "])
    monkeypatch.setattr(token_files, "CHARS_AT_ONCE", 30)
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 2)
    monkeypatch.setattr(token_files, "PIECES_AT_ONCE", 3)
    assert [x.tolist() for x in PieceEncoder(BPE).encode(iter(texts))] == expected


def test_narrow_integers_have_the_same_codes():
    values = np.array([0, 5, 70_000, 2**32 - 1, 16], dtype=np.uint32)
    for widths in (None, (8, 8, 16), (32,), (4, 40)):
        assert encode(values, widths) == encode(values.astype(np.uint64), widths)
        assert Codes(encode(values, widths)).decode().tolist() == values.tolist()


def test_token_files_round_trip(spark):
    texts = {1: "one two  three\n four", 2: None, 3: "", 5: "word " * 30_000 + "y" * 5_000, 7: "é" * 50, 8: "<|endoftext|> x", 10: "last"}
    rows = [(i, t, -i) for i, t in texts.items()] + [(None, "no id", 0), (None, "no id", 0), (5, "again", 0), (7, "é" * 50, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, DOC_ID2 int").repartition(4)
    folder = f"{shared_dir(spark)}/tokens-test-{uuid.uuid4().hex}"
    write_tokens(docs, folder, BPE, segment_ids=100)
    found = read_tokens(spark, folder).toPandas().sort_values("start")
    encode_text = PieceEncoder(BPE).tokenizer.encode
    expected = []
    for doc, text, _ in rows:
        ids = [*encode_text(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), 2))
    got = [(None if np.isnan(d) else int(d), n, c, e) for d, n, c, e in zip(found["doc_id"].astype(float), found["n_tokens"], found["ids_crc32"], found["last_id"])]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert [g[0] or 0 for g in got] == sorted((r[0] or 0) for r in rows)  # ascending, null ids first
    assert found["start"].tolist() == np.cumsum([0, *found["n_tokens"]])[:-1].tolist()
    again = f"{shared_dir(spark)}/tokens-test-{uuid.uuid4().hex}"
    write_tokens(docs, again, BPE)  # other segments, same rows
    assert sorted(map(str, read_tokens(spark, again).collect())) == sorted(map(str, read_tokens(spark, folder).collect()))


def test_one_token_of_a_segment_and_cut_files():
    arrays = [np.array([5, 70_000, 2]), np.array([2]), np.arange(3_000)]
    data = segment_bytes(3, 4, [9, None, -1], arrays) + b"\n" + segment_bytes(3, 5, [], []) + b"\n"
    first, second = open_segments(data)
    assert (first.part, first.number, first.ids, second.ids) == (3, 4, 3_004, 0)
    assert first.token(0, 1) == 70_000 and first.token(2, 2_999) == 2_999 and first.null_ids.tolist() == [False, True, False]
    with pytest.raises(IndexError):
        first.token(1, 1)
    for broken in (data[:200], b"x" + data):
        with pytest.raises(ValueError):
            list(open_segments(broken))


def test_token_files_of_an_empty_table(spark):
    folder = f"{shared_dir(spark)}/tokens-test-{uuid.uuid4().hex}"
    write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, BPE)
    assert read_tokens(spark, folder).count() == 0


def _plain_kmeans(rows, dims, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("k", [1, 2, 7, 60])
def test_clusters_equal_plain_rounds(spark, k):
    rng = random.Random(k)
    rows = [(i, [round(rng.gauss(3 * (i % 4), 1), 1) for _ in range(3)]) for i in range(40)]
    rows += [(100, [0.0] * 3), (101, [0.0] * 3), (101, [0.0] * 3), (102, [0.5, 0.0, 0.0]), (None, [1.0] * 3), (103, [1.0] * 2), (104, None),
             (105, [float("nan"), 0.0, 0.0]), (106, [float("inf"), 0.0, 0.0]), (107, [None, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, Embedding2 string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in cluster_vectors(table, dims=3, clusters=k, rounds=4).collect()), key=str)
    assert got == _plain_kmeans(rows, 3, k, 4)


def test_search_skips_most_distances_and_stays_exact():
    rng = np.random.default_rng(1)
    means = rng.integers(-5_000, 5_000, (20, 8))
    vectors = (means[rng.integers(0, 20, 2_000)] + rng.integers(-200, 200, (2_000, 8))).astype(np.int16)
    centroids = means + rng.integers(-300, 300, means.shape)
    state = [np.zeros(2_000, np.int32), np.ones(2_000, np.int32), np.full(2_000, np.inf), np.zeros(2_000)]
    counts = []
    for _ in range(4):
        counts.append(shallot.assign(vectors, centroids, shallot.neighbours(centroids), *state))
        plain = np.stack([shallot.squared(vectors, c[None, :]) for c in centroids], axis=1)
        assert (state[0] == plain.argmin(axis=1)).all()
        assert (state[2] ** 2 >= plain.min(axis=1) * (1 - 1e-12)).all() and (state[3] ** 2 <= np.sort(plain, axis=1)[:, 1] * (1 + 1e-12)).all()
        moved = np.stack([np.floor(vectors[state[0] == j].mean(axis=0)).astype(int) if (state[0] == j).any() else centroids[j] for j in range(20)])
        shallot.shift_bounds(state[0], state[2], state[3], centroids, moved)
        centroids = moved
    assert counts[-1] < 2_000 * 20 / 5


def test_no_vectors_and_too_large_components(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([(1, [1.0])], schema), dims=3).count() == 0
    with pytest.raises(Exception, match="would not fit a long"):
        cluster_vectors(spark.createDataFrame([(1, [1e30])], schema), dims=1)


def test_audit_equals_filters_applied_in_turn(spark):
    rng = random.Random(7)
    words = ["aa", "bb", "cc", "DD", "#x", "é", "q r"]
    texts = [" ".join(rng.choices(words[:rng.randrange(1, 7)], k=rng.choice([0, 3, 60]))) for _ in range(60)]
    texts += [f"{' '.join(str(i) for i in range(60))}\t\v\n", None, "", "A", " \f ", "same", "same", "x " * 20_000]
    docs = [(i if i % 13 else None, t, rng.choice(["s1", "s2", None, ""])) for i, t in enumerate(texts)]
    docs += [docs[5], docs[64], (66, "same", "s1")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    got = audit_filters(spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, source string, cell string").repartition(3),
                        spark.createDataFrame([(*r, 0) for r in labels], "doc_id bigint, quality int, toxic int, n int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}

    def fails(doc, text):
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [d for d, t, _ in docs if (t or "") == text and d is not None]
        return {f for f, bad in zip("ABCDE", (
            len(found) < 50, 100 * len(set(found)) < 65 * len(found), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            re.search(r"[#$%&*|]", text) is not None, doc is not None and doc > min(ids))) if bad}

    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    judged = [(s or "", fails(d, t), d in good, d in toxic) for d, t, s in docs]
    expected = {}
    for part in {s for s, *_ in judged}:
        for order in map("".join, permutations("ABCDE")):
            rest = [x for x in judged if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in rest if f in x[1]]
                failing = [x for x in judged if x[0] == part and f in x[1]]
                rest = [x for x in rest if f not in x[1]]
                expected[part, order, step] = (len(rest), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing),
                                               sum(x[2] for x in gone), sum(x[3] for x in gone))
    shapley = {}
    for (part, order, step), v in expected.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in expected.items()}


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert audit_filters(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0
