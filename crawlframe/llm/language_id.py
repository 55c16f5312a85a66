"""Language identification with a small byte convolutional network, trained in numpy.

A text is cut into windows of WINDOW bytes. Bytes are embedded, convolved with filters of several widths, pooled by their
maximum over the window, and a softmax gives the languages; a document averages its windows' probabilities.

The network is trained on the driver with a bounded sample (SAMPLE_DOCS documents, SAMPLE_WINDOWS windows of each) drawn by
a hash of the id, evenly over languages, and applied to the whole of every text in Arrow batches.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label are never learned from;
if nothing is labelled all is ``und``; equal probabilities go to the first language by name; repeated rows are answered
once each; an empty table gives no rows; other columns are carried in ``row`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import in_small_batches
from crawlframe.llm.tokens import forget_encoders

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
SAMPLE_DOCS = 2400
SAMPLE_WINDOWS = 4
EPOCHS = 6
BATCH = 64
PAD = 256


def windows_of(text: str) -> np.ndarray:
    """Byte windows of a whole text; the last one of a long text ends with it, that of a short text is padded."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw) // WINDOW
    if not n:
        out = np.full((1, WINDOW), PAD, np.int16)
        out[0, : len(raw)] = raw
        return out
    out = raw[: n * WINDOW].reshape(n, WINDOW).astype(np.int16)
    return out if n * WINDOW == len(raw) else np.concatenate([out, raw[None, -WINDOW:].astype(np.int16)])


class ByteConvNet:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (PAD + 1, EMBEDDING)), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "c": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        embedded = self.p["e"][x].reshape(len(x), -1)
        pooled, seen = [], {}
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(embedded, w * EMBEDDING, axis=1)[:, ::EMBEDDING]
            found = (patches.reshape(-1, w * EMBEDDING) @ self.p[f"w{w}"]).reshape(len(x), -1, FILTERS)
            best = found.max(axis=1) + self.p[f"b{w}"]
            pooled.append(np.maximum(best, 0))
            seen[w] = (patches, found)
        return np.concatenate(pooled, axis=1), seen

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = self._features(x)[0] @ self.p["o"] + self.p["c"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3, seed: int = 11) -> "ByteConvNet":
        """Adam on the cross entropy of single windows; every language weighs the same."""
        rng = np.random.default_rng(seed)
        weight = 1 / np.bincount(y, minlength=len(self.languages)).clip(1)
        weight = (weight / weight[y].mean()).astype(np.float32)
        m, v, t = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows = order[a : a + BATCH]
                t += 1
                for k, g in self._gradients(x[rows], y[rows], weight[y[rows]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - np.float32(rate) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pooled, seen = self._features(x)
        scores = pooled @ self.p["o"] + self.p["c"]
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None] / len(y)
        out = {"o": pooled.T @ p, "c": p.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        back = (p @ self.p["o"].T) * (pooled > 0)
        for i, w in enumerate(WIDTHS):
            patches, found = seen[w]
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = found.argmax(axis=1)
            rows = np.arange(len(x))[:, None]
            chosen = patches[rows, at]
            out[f"w{w}"] = np.einsum("bfk,bf->kf", chosen, g)
            out[f"b{w}"] = g.sum(axis=0)
            into = (g[:, :, None] * self.p[f"w{w}"].T[None]).reshape(len(x), FILTERS, w, EMBEDDING)
            np.add.at(out["e"], x[rows[:, :, None], at[:, :, None] + np.arange(w)], into)
        return out


def training_rows(docs: DataFrame, learn: Column, sample_docs: int) -> list[tuple[str, str]]:
    """(language, window text) of a bounded sample: the same number of documents of each language, by a hash of the id."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_docs).collect()}
    if not counts:
        return []
    each = max(1, sample_docs // len(counts))
    bar = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1, each / n) * 1_000_000))])
    length = F.length("text")
    cuts = [F.substring("text", (1 + (length - WINDOW).cast("double") * i / max(1, SAMPLE_WINDOWS - 1)).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    windows = F.when(length <= WINDOW, F.array("text")).otherwise(F.array(*cuts))
    found = rows.where(spot < bar[F.col("lang")]).select("lang", spot.alias("spot"), "doc_id", windows.alias("w")).orderBy("spot", "doc_id").limit(2 * sample_docs).collect()
    return [(r[0], w) for r in found for w in r[3]]


def fit(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> ByteConvNet | None:
    """A network for ``docs(doc_id, text, lang)`` where ``learn`` holds; None if there is nothing to learn from."""
    rows = [(lang, w) for lang, w in training_rows(docs, learn, sample_docs) if any(map(str.isalpha, w))]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    x = np.concatenate([windows_of(w)[:1] for _, w in rows])
    y = np.array([languages.index(lang) for lang, _ in rows])
    return ByteConvNet(languages).train(x, y)


def predict(docs: DataFrame, net: ByteConvNet | None, keep_text: bool = True) -> DataFrame:
    """``(row, lang_pred, score)``; row holds the document's columns, without text unless keep_text."""
    names = docs.columns
    text_at = names.index("text")
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        net = model.value
        for batch in batches:
            row = batch.column(0)
            n = len(row)
            lang, score = ["und"] * n, np.zeros(n)
            if net:
                held, owner, size = [], [], 0
                total, count = np.zeros((n, len(net.languages))), np.zeros(n)

                def pour() -> None:
                    nonlocal held, owner, size
                    if held:
                        p = net.probabilities(np.concatenate(held))
                        np.add.at(total, np.repeat(owner, [len(h) for h in held]), p)
                    held, owner, size = [], [], 0

                for i, text in enumerate(row.field(text_at)):
                    text = text.as_py()
                    if text and any(map(str.isalpha, text)):
                        windows = windows_of(text)
                        count[i] = len(windows)
                        for a in range(0, len(windows), 256):
                            held.append(windows[a : a + 256])
                            owner.append(i)
                            size += len(held[-1])
                            if size >= 256:
                                pour()
                pour()
                for i in np.flatnonzero(count).tolist():
                    best = int(total[i].argmax())
                    lang[i], score[i] = net.languages[best], min(1.0, total[i][best] / count[i])
            if not keep_text:
                fields = [f for i, f in enumerate(row.type) if i != text_at]
                row = pa.StructArray.from_arrays([row.field(i) for i in range(row.type.num_fields) if i != text_at], fields=fields)
            yield pa.RecordBatch.from_arrays([row, pa.array(lang), pa.array(score)], names=["row", "lang_pred", "score"])

    kept = T.StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    schema = T.StructType([T.StructField("row", kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return in_small_batches(docs).select(F.struct(*[docs[c] for c in names]).alias("row")).mapInArrow(run, schema)


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` with a network learned from the documents that are not held out."""
    net = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    found = predict(docs.select("doc_id", "text"), net, keep_text=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The documents with a language whose score is not below least_score, with their own columns."""
    net = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    return predict(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")
