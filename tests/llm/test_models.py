"""The trained operators: gradients, exact recomputation, held-out accuracy on the driver tables, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest

from odolake.llm import masked_lm
from odolake.llm.language import SEGMENT, ByteGRU, identify_languages, keep_identified, train_language_model, training_sample
from odolake.llm.masked_lm import score_texts, train_masked_lm
from odolake.llm.mixing import domain_posteriors, mixing_rates
from odolake.llm.quality import isotonic, score_quality, statistics
from odolake.llm.text import word_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The documents with null, empty and letterless texts, a null id, repeated rows and clashing columns."""
    extra = [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "12 34 !!", "fr", "s", 8), (None, "the thing of", None, None, 1),
             (9004, "word " * 60_000, "en", "s", 0), (9005, "same text here", "en", "s", 1), (9005, "same text here", "en", "s", 1)]
    out = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    return out.selectExpr("*", "1 AS score", "2 AS label", "'x' AS domain", "3 AS held_out")


def test_gradients_of_the_network():
    draw = np.random.RandomState(0)
    model = ByteGRU(["a", "b", "c"], hidden=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    data, labels = draw.randint(97, 101, (SEGMENT // 8, 5)).astype(np.uint8), draw.randint(3, size=5)
    _, grads = model.gradients(data, labels)
    for key, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = model.params[key][at], 1e-3
        model.params[key][at] = kept + step
        above = model.gradients(data, labels)[0]
        model.params[key][at] = kept - step
        below = model.gradients(data, labels)[0]
        model.params[key][at] = kept
        assert grad[at] == pytest.approx((above - below) / (2 * step), rel=0.02, abs=1e-5)


def test_segments_give_the_distribution_of_plain_steps():
    model = ByteGRU(["a", "b"], hidden=4)
    text = "Some words, and ünlike ones; " * 5
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    total = np.zeros(2)
    for begin in range(0, data.size, SEGMENT):
        piece = np.full((SEGMENT, 1), 32, dtype=np.uint8)
        piece[:len(data[begin:begin + SEGMENT]), 0] = data[begin:begin + SEGMENT]
        steps = {way: model._forward(piece, way) for way in "fb"}
        for t, code in enumerate(piece[:, 0]):
            if chr(code).isalpha() and code < 128 or code >= 128:
                scores = model.params["out_f"] @ steps["f"][t][3] + model.params["out_b"] @ steps["b"][t][3]
                e = np.exp(scores[:, 0])
                total += e / e.sum()
    assert model.distributions([text, None, "12"]) == pytest.approx(np.array([total / total.sum(), [0, 0], [0, 0]]), abs=1e-5)


def test_language_held_out_accuracy_and_odd_rows(odd):
    rows = identify_languages(odd).toPandas()
    assert len(rows) == odd.count() and rows["score"].between(0, 1).all()
    truth = odd.select("doc_id", "lang").toPandas().dropna().drop_duplicates("doc_id")
    held = rows[rows["held_out"]].merge(truth, on="doc_id")
    held = held[held["doc_id"] < 9000]
    assert len(held) > 20 and (held["lang_pred"] == held["lang"]).mean() > 0.95
    by_id = rows.drop_duplicates("doc_id").set_index("doc_id")
    assert set(by_id.loc[[9001, 9002, 9003], "lang_pred"]) == {"und"} and set(by_id.loc[[9001, 9002, 9003], "score"]) == {0.0}
    kept = keep_identified(odd)
    assert kept.columns == odd.columns
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in kept.select("doc_id").collect()}
    nothing = odd.selectExpr("* EXCEPT (lang)", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in identify_languages(nothing).select("lang_pred").distinct().collect()} == {"und"}
    assert identify_languages(odd.filter("false")).count() == 0


def test_no_language_is_left_out_for_their_number(spark):
    texts = spark.range(1_800).selectExpr("id AS doc_id", "concat('l', id % 300) AS lang", "concat('text ', id) AS text")
    sample = training_sample(texts)
    learned = {(f"l{i % 300}", f"text {i}") for i in range(1_800) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(sample) == learned and len(sample) == len(learned) and len({lang for lang, _ in learned}) == 300
    model = train_language_model(texts)
    assert len(model.languages) == 300 and np.allclose(model.distributions(["text 1"] * 3).sum(axis=1), 1)


def test_isotonic_fit_is_the_best_nondecreasing_one():
    values, weights = np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1.0, 1, 2, 1, 1, 3])
    x, y = isotonic(np.arange(6.0), values, weights)
    fit = np.interp(np.arange(6.0), x, y)
    assert (np.diff(y) > 0).all()
    assert y == pytest.approx([0.1, (0.5 + 0.6 + 0.2) / 4, (0.9 + 2.4) / 4])
    assert (np.diff(fit) >= 0).all()


def test_quality_held_out_accuracy_and_odd_rows(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = score_quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    extra = spark.createDataFrame([(9001, 1, 0), (None, 1, 0), (5, None, 0), (5, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    scored = score_quality(odd, spark.read.parquet(f"{SF}/labels.parquet").unionByName(extra)).toPandas()
    assert len(scored) == odd.count() and scored["score"].between(0, 1).all()
    assert scored[scored["doc_id"].isin([9001, 9002])]["score"].nunique() == 1
    assert set(score_quality(odd, labels.filter("false")).toPandas()["score"]) == {0.5}
    assert score_quality(odd.filter("false"), labels).count() == 0
    assert np.isfinite(statistics(None)).all() and (statistics(None) == statistics("")).all()


def test_pseudo_likelihood_matches_a_plain_loop(docs):
    model = train_masked_lm(docs)
    v, text = model.vocabulary, docs.select("text").first()[0][:400]
    words = next(iter(word_hashes([text])))[1]
    ids = [v.edge] * 2 + v.ids(words).tolist() + [v.edge] * 2
    plain = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
    assert len(plain) == words.size
    total = 0.0
    for k, word in enumerate(plain):
        around = [ids[k], ids[k + 1], ids[k + 3], ids[k + 4]]
        hidden = np.tanh(sum(model.tables[j][i] for j, i in enumerate(around)) + model.inner_bias)
        scores = hidden @ model.outer + model.outer_bias
        total += scores[v.classes[ids[k + 2]]] - np.log(np.exp(scores).sum()) + v.share[ids[k + 2]]
        if ids[k + 2] == v.rare:
            code = [0, *word.encode(), 0]
            total += sum(v.pairs[a, b] for a, b in zip(code, code[1:]))
    count, found = model.score([text, None, ""])
    assert count.tolist() == [len(plain), 0, 0] and found == pytest.approx([total, 0, 0], rel=1e-4)


def test_pseudo_likelihood_of_odd_rows_and_training(odd):
    rows = score_texts(odd).toPandas().set_index("doc_id")
    assert len(rows) == odd.count()
    assert rows.loc[[9001, 9002], "n_tokens"].tolist() == [0, 0] and rows.loc[[9001, 9002], "log_prob"].tolist() == [0, 0]
    assert rows.loc[[9001, 9002], "mean_log_prob"].isna().all() and rows.loc[9004, "n_tokens"] == 60_000
    assert rows.loc[9005, "log_prob"].nunique() == 1 and (rows["log_prob"] <= 0).all()
    assert score_texts(odd.filter("false")).count() == 0
    draw = np.random.RandomState(1)
    left = draw.randint(6, size=20_000)
    contexts = np.stack([left, left, left, left], axis=1)
    params = masked_lm.first_parameters(6)
    state: dict = {}
    losses = [masked_lm.train(params, contexts, left, 0.01, state) for _ in range(6)]
    assert losses[-1] < 0.3 < losses[0]


def test_every_word_of_a_partition_trains_the_network():
    draw = np.random.RandomState(2)
    texts = [" ".join(draw.choice(["a", "b", "c", "dd"], draw.randint(1, 40))) for _ in range(50)] + ["", "12 word"]
    hashes = np.concatenate([w for _, w in word_hashes(texts)])
    words, counts = np.unique(hashes, return_counts=True)
    vocabulary = masked_lm.Vocabulary(words, counts, hashes.size, np.zeros((256, 256)))
    start = masked_lm.first_parameters(words.size)
    (found,) = masked_lm._refine((vocabulary, start))(iter([pd.DataFrame({"text": texts[:20]}), pd.DataFrame({"text": texts[20:]})]))
    assert found["sums"].iloc[-1].tolist() == [hashes.size]
    for text in ("a b c dd", "dd a"):  # whatever the text, it moves the parameters
        (found,) = masked_lm._refine((vocabulary, start))(iter([pd.DataFrame({"text": [text]})]))
        flat = np.concatenate([start[k].ravel() for k in sorted(start)])
        assert np.abs(np.concatenate(found["sums"].tolist()[:-1]) / len(text.split()) - flat).max() > 1e-4


def test_mixing_reaches_its_targets(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "if(quality = 1, 'good', 'bad') AS domain")
    targets = {"good": 3.0, "bad": 1.0}
    rows = mixing_rates(docs, labels, targets).toPandas()
    assert len(rows) == docs.count() and (rows["rate"] >= 0).all()
    assert (rows["p_good"] + rows["p_bad"]).to_numpy() == pytest.approx(1.0)
    total = rows["tokens"].sum()
    assert (rows["rate"] * rows["tokens"] * rows["p_good"]).sum() == pytest.approx(0.75 * total, rel=1e-4)
    assert (rows["rate"] * rows["tokens"] * rows["p_bad"]).sum() == pytest.approx(0.25 * total, rel=1e-4)


def test_mixing_rates_solve_the_least_squares_problem(spark):
    """Rates stay at zero where the target is below what the others give; compared with long plain projected gradients."""
    rows = [(i, " ".join(["cat"] * 20 if i % 3 else ["dog"] * 30)) for i in range(12)]
    labels = [(i, "c" if i % 3 else "d") for i in range(12)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, domain string")
    got = mixing_rates(docs, marks, {"c": 1.0, "d": 0.0}).toPandas().sort_values("doc_id")
    p, t = got[["p_c", "p_d"]].to_numpy(), got["tokens"].to_numpy(float)
    wanted, rate = np.array([t.sum(), 0.0]), np.ones(len(t))
    a = (p * t[:, None]).T
    gram = (p * t[:, None]).T @ p
    for _ in range(3000):
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram, a @ rate - wanted))
    assert got["rate"].to_numpy() == pytest.approx(rate, abs=1e-3)
    assert (got["rate"].to_numpy()[::3] < 0.01).all()


def test_every_labelled_row_teaches_the_domains(spark):
    docs = spark.range(24_000).selectExpr("id AS doc_id", "'x' AS text").unionByName(spark.createDataFrame([(-1, None)], "doc_id bigint, text string"))
    labels = spark.range(24_000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'b', 'a') AS domain")
    (prior,) = domain_posteriors(docs, labels, ["a", "b"]).filter("doc_id = -1").collect()
    assert prior["p0"] == pytest.approx(18_001 / 24_002, abs=1e-12)


def test_mixing_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "a"), (3, None), (4, "other")], "doc_id bigint, domain string")
    rows = mixing_rates(odd, labels, {"a": 1.0, "b": 1.0}).toPandas()
    assert len(rows) == odd.count()
    assert rows[rows["doc_id"].isin([9001, 9002])]["tokens"].tolist() == [0, 0]
    assert rows[rows["doc_id"] == 9005]["tokens"].tolist() == [3, 3]
    even = domain_posteriors(odd, labels.filter("false"), ["a", "b"]).toPandas()
    assert even["p0"].to_numpy() == pytest.approx(0.5)
    assert mixing_rates(odd.filter("false"), labels, {"a": 1.0}).count() == 0
