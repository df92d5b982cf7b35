"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of a text in segments of `SEGMENT` bytes, from both ends. At every byte the
two states give a distribution over the languages; the mean over the positions that hold letters is the document's.
It is trained in numpy by backpropagation through time on a bounded sample of labelled texts, and applied to every byte
of every text in the tasks. Segments of many texts are stepped through together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column, fold, free_name, small_batches
from .text import lowered

SEGMENT = 64
HIDDEN = 8
BLOCK = 4_096  # segments stepped through at a time
SAMPLE_PER_LANGUAGE = 600  # labelled texts that training reads, at most twice as many
SAMPLE_CHARS = 2_000  # of each, from a place that its hash picks
FULL_SAMPLES = 256  # languages with samples of that size; of more, each has a smaller one, and none is left out
LEAST_SAMPLE = 20
STEPS = 300
UNKNOWN = "und"
HELD_OUT = (4, 2)  # folds, fold that is never learned from
_LETTER = np.zeros(256, dtype=np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class ByteGRU:
    """Parameters: for each direction a byte table (3H, 256) and a state matrix (3H, H), then the output layer.

    Gates stand in the order update, reset, candidate. States are columns, so a block of segments is one matrix.
    """

    def __init__(self, languages: Sequence[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        draw = np.random.RandomState(seed)
        self.languages, self.hidden = list(languages), hidden
        self.params = {}
        for way in "fb":
            self.params[f"table_{way}"] = draw.normal(0, 0.3, (3 * hidden, 256))
            self.params[f"state_{way}"] = draw.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
            self.params[f"out_{way}"] = draw.normal(0, 0.3, (len(languages), hidden))
        self.params["bias"] = np.zeros((len(languages), 1))
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _forward(self, data: np.ndarray, way: str) -> list[tuple[np.ndarray, ...]]:
        """(state before, gates, candidate's state part, state after) at each position; data: (positions, segments)."""
        h, table, matrix = self.hidden, self.params[f"table_{way}"], self.params[f"state_{way}"]
        state = np.zeros((h, data.shape[1]), dtype=np.float32)
        out = []
        for codes in data if way == "f" else data[::-1]:
            a, g = matrix @ state, table[:, codes]
            g[:2 * h] = 0.5 * np.tanh(0.5 * (g[:2 * h] + a[:2 * h])) + 0.5
            g[2 * h:] = np.tanh(g[2 * h:] + g[h:2 * h] * a[2 * h:])
            after = g[2 * h:] + g[:h] * (state - g[2 * h:])
            out.append((state, g, a[2 * h:], after))
            state = after
        return out if way == "f" else out[::-1]

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        h, p, n = self.hidden, self.params, data.size
        steps = {way: self._forward(data, way) for way in "fb"}
        after = {way: np.stack([s[3] for s in steps[way]]) for way in "fb"}  # (positions, hidden, segments)
        scores = p["out_f"] @ after["f"] + p["out_b"] @ after["b"] + p["bias"]
        scores -= scores.max(axis=1, keepdims=True)
        probs = np.exp(scores)
        probs /= probs.sum(axis=1, keepdims=True)
        segments = np.arange(data.shape[1])
        loss = float(-np.log(probs[:, labels, segments] + 1e-9).mean())
        probs[:, labels, segments] -= 1
        probs /= n
        grads = {"bias": probs.sum(axis=(0, 2))[:, None]}
        for way in "fb":
            grads[f"out_{way}"] = np.einsum("tks,ths->kh", probs, after[way])
            matrix, above = p[f"state_{way}"], p[f"out_{way}"].T @ probs
            d_matrix, carried = np.zeros_like(matrix), np.zeros((h, data.shape[1]), dtype=np.float32)
            inputs = np.empty((data.shape[0], 3 * h, data.shape[1]), dtype=np.float32)
            order = range(data.shape[0] - 1, -1, -1) if way == "f" else range(data.shape[0])
            for t in order:
                state, g, a, _ = steps[way][t]
                z, r, c = g[:h], g[h:2 * h], g[2 * h:]
                d = carried + above[t]
                d_c = d * (1 - z) * (1 - c * c)
                inputs[t] = np.concatenate([d * (state - c) * z * (1 - z), d_c * a * r * (1 - r), d_c])
                d_a = np.concatenate([inputs[t, :2 * h], d_c * r])
                d_matrix += d_a @ state.T
                carried = d * z + matrix.T @ d_a
            flat, rows = data.ravel(), inputs.transpose(1, 0, 2).reshape(3 * h, -1)
            grads[f"table_{way}"] = np.stack([np.bincount(flat, row, 256) for row in rows]).astype(np.float32)
            grads[f"state_{way}"] = d_matrix
        return loss, grads

    def train(self, texts: Sequence[bytes], labels: np.ndarray, steps: int = STEPS, width: int = 256, seed: int = 11) -> float:
        """Adam over random segments, drawn evenly from the languages. Returns the mean loss of the last steps."""
        draw = np.random.RandomState(seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        losses = []
        for step in range(1, steps + 1):
            chosen = draw.randint(len(by_label), size=width)
            data = np.full((SEGMENT, width), 32, dtype=np.uint8)
            for i, k in enumerate(chosen):
                text = texts[by_label[k][draw.randint(by_label[k].size)]]
                begin = draw.randint(max(1, len(text) - SEGMENT + 1))
                piece = np.frombuffer(text[begin:begin + SEGMENT], dtype=np.uint8)
                data[:piece.size, i] = piece
            loss, grads = self.gradients(data, chosen)
            losses.append(loss)
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for key, grad in grads.items():
                m, v = moments[key]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                self.params[key] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses[-20:]))

    def _applied(self) -> dict[str, np.ndarray]:
        """Parameters with the halves of the gates' sigmoid folded in."""
        scale = np.ones((3 * self.hidden, 1), dtype=np.float32)
        scale[:2 * self.hidden] = 0.5
        return {k: np.ascontiguousarray(v * scale if k[:5] in ("table", "state") else v) for k, v in self.params.items()}

    def _block(self, data: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
        """Sums of the distributions over the letter positions of each segment, (languages, segments)."""
        h, width = self.hidden, data.shape[1]
        g, a = np.empty((3 * h, width), dtype=np.float32), np.empty((3 * h, width), dtype=np.float32)
        kept = np.empty((len(data), h, width), dtype=np.float32)
        total = np.zeros((len(self.languages), width), dtype=np.float32)
        for way in "fb":
            state = np.zeros((h, width), dtype=np.float32)
            for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
                np.take(p[f"table_{way}"], data[t], axis=1, out=g, mode="clip")
                np.matmul(p[f"state_{way}"], state, out=a)
                gates, fresh = g[:2 * h], g[2 * h:]
                gates += a[:2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                a[2 * h:] *= g[h:2 * h]
                fresh += a[2 * h:]
                np.tanh(fresh, out=fresh)
                state -= fresh
                state *= g[:h]
                state += fresh
                if way == "f":
                    kept[t] = state
                else:
                    scores = p["out_f"] @ kept[t]
                    scores += p["out_b"] @ state
                    scores += p["bias"]
                    np.exp(scores, out=scores)
                    scores *= _LETTER[data[t]] / scores.sum(axis=0)
                    total += scores
        return total

    def distributions(self, texts: Sequence[str | None]) -> np.ndarray:
        """(texts, languages); a row of zeros for a text without letters."""
        p = self._applied()
        out = np.zeros((len(texts), len(self.languages)))
        block = max(1, BLOCK * FULL_SAMPLES // max(FULL_SAMPLES, len(self.languages)))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        count = 0

        def flush() -> None:
            nonlocal count
            if held:
                segments, owner = np.concatenate(held), np.concatenate(owners)
                for begin in range(0, len(segments), block):
                    sums = self._block(np.ascontiguousarray(segments[begin:begin + block].T), p)
                    np.add.at(out, owner[begin:begin + block], sums.T)
            held.clear()
            owners.clear()
            count = 0

        for i, text in enumerate(texts):
            if not isinstance(text, str) or not any(map(str.isalpha, text)):
                continue
            data = np.frombuffer(lowered(text), dtype=np.uint8)
            for begin in range(0, data.size, BLOCK * SEGMENT):
                piece = data[begin:begin + BLOCK * SEGMENT]
                rows = -(-piece.size // SEGMENT)
                padded = np.full(rows * SEGMENT, 32, dtype=np.uint8)
                padded[:piece.size] = piece
                held.append(padded.reshape(rows, SEGMENT))
                owners.append(np.full(rows, i))
                count += rows
                if count >= 4 * BLOCK:
                    flush()
        flush()
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def training_sample(docs: DataFrame, id_column: str = "doc_id", label: str = "lang", text: str = "text",
                    per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(language, excerpt) of labelled texts outside the held-out fold, about `per_language` different ones each.

    Beyond FULL_SAMPLES languages the samples shrink with their number, down to LEAST_SAMPLE texts, so that every language is learned.
    """
    usable = docs.select(column(docs, id_column).alias("i"), column(docs, label).alias("l"), column(docs, text).alias("t")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull() & (fold("i", HELD_OUT[0]) != HELD_OUT[1]))
    counts = usable.groupBy("l").count().collect()
    if not counts:
        return []
    if len(counts) > FULL_SAMPLES:
        per_language = min(per_language, max(LEAST_SAMPLE, per_language * FULL_SAMPLES // len(counts)))
    place = F.pmod(F.xxhash64("t"), F.lit(1_000_000))
    shares = docs.sparkSession.createDataFrame([(r["l"], min(1e6, 1e6 * 1.5 * per_language / r["count"])) for r in counts], "l string, share double")
    begin = F.pmod(F.xxhash64("t", F.lit(1)), F.greatest(F.lit(1), F.length("t") - SAMPLE_CHARS + 1)).cast("int") + 1
    excerpts = usable.join(F.broadcast(shares), "l").filter(place < F.col("share")).select(  # one row per language
        "l", F.substring("t", begin, F.lit(SAMPLE_CHARS)).alias("t"), F.xxhash64("t", F.lit(2)).alias("h"))
    rows = excerpts.dropDuplicates(["l", "t"]).orderBy("h", "l", "t").limit(2 * per_language * len(counts)).collect()
    return [(r["l"], r["t"]) for r in rows]


def train_language_model(docs: DataFrame, **options) -> ByteGRU | None:
    """A trained network, or None where no labelled text has a letter."""
    sample = [(lang, lowered(text)) for lang, text in training_sample(docs, **options) if any(map(str.isalpha, text))]
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    model = ByteGRU(languages)
    model.train([text for _, text in sample], np.array([languages.index(lang) for lang, _ in sample]))
    return model


def language_of(model: ByteGRU | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text: the likeliest language and its pooled probability; `und` with 0 for none."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            found = model.distributions(texts) if model else np.zeros((len(texts), 1))
            names = model.languages if model else [UNKNOWN]
            best, score = found.argmax(axis=1), found.max(axis=1)
            yield pd.DataFrame({"lang_pred": [names[k] if s > 0 else UNKNOWN for k, s in zip(best, score, strict=True)],
                                "score": np.clip(np.round(score, 6), 0.0, 1.0)})

    return predict(text)


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text alone.

    Null texts, and texts without a letter, are `und` with score 0; so is every text if there are no labels to learn from.
    Repeated rows give repeated rows, a null id is not held out, and equal texts have equal results. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = train_language_model(docs, **options)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    held_out = (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    return rows.select("doc_id", held_out, language_of(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """Rows of `docs`, all columns unchanged, whose text has a language that holds at least `min_score` of the pooled
    probability. Texts that are null or have no letters go."""
    small_batches(docs.sparkSession)
    name = free_name(docs, "language")
    judged = docs.withColumn(name, language_of(train_language_model(docs, **options), column(docs, "text")))
    return judged.filter((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= min_score)).drop(name)
