"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 4-grams of the lower-cased text's characters, weighted (1 + ln tf) x idf and
scaled to length 1. The weights are learned by follow-the-regularised-leader (FTRL-proximal, per coordinate)
with an L1 and an L2 penalty, over a bounded sample of the labelled rows: the SAMPLE rows of least hash. The idf
is counted over all rows that may be learned from. A part
of the sample is kept back from FTRL and sets the temperature that scales the logits. Prediction takes whole
texts and nothing but the text.

Defined results: null, or no letter in it: `und` with score 0; ties go to the first language in order; with
no labelled row to learn from, all texts are `und`; a label that no sample row has cannot be predicted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import Scratch, give_back, small_batches, tidy

BITS, ORDERS = 16, (1, 2, 3, 4)
#: Labelled rows to learn from at most, and the most bytes of text that they may bring to the driver.
SAMPLE, SAMPLE_BYTES = 4000, 64_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.3, 1e-6, 3
UNKNOWN = "und"
_SALT = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x7FEB352D]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram is in a text, one number a slot."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = [np.zeros(0, np.uint32)]
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        h = (h[: len(chars) - n + 1] * np.uint32(0x01000193)) ^ (chars[n - 1 :] * np.uint32(0x85EBCA6B))
        if n in ORDERS:
            slots.append(((h ^ np.uint32(_SALT[n])) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.bincount(np.concatenate(slots), minlength=1 << BITS)


def occurrences(texts: Iterable[str | None]) -> tuple[int, np.ndarray]:
    """How many texts have a letter, and in how many of these each slot occurs."""
    total, df = 0, np.zeros(1 << BITS, np.int64)
    for text in texts:
        if has_letter(text):
            total += 1
            df += counts(text) > 0
    return total, df


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of the unit TF-IDF vector."""
    tf = counts(text)
    at = np.flatnonzero(tf)
    value = (1.0 + np.log(tf[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, value = features(text, self.idf)
        return value @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = EPOCHS, seen: tuple[int, np.ndarray] | None = None) -> Model:
    """rows: (text, language), in a fixed order; every fifth is kept back for calibration.

    seen: a number of texts and in how many of them each slot occurs; without it, those of rows are counted.
    """
    rows = [(t, y) for t, y in rows if has_letter(t)]
    languages = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    learn = [r for i, r in enumerate(rows) if i % 5] or rows
    spare = rows[::5]
    total, df = seen or occurrences(t for t, _ in learn)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    compact = lambda at, value: (at.astype(np.uint16), value.astype(np.float32))  # noqa: E731  (they are all held at once)
    vectors = [(*compact(*features(t, idf)), languages.index(y)) for t, y in learn]
    k = len(languages)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias, bias_n = np.zeros(k), np.zeros(k)
    leader = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            at, x, y = vectors[i]
            zi, ni = z[at], n[at]
            w = leader(zi, ni)
            p = _softmax(x @ w + bias)
            p[y] -= 1.0
            g = np.outer(x, p)
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g2
            bias_n += p * p
            bias -= 0.1 * p / np.sqrt(1.0 + bias_n)
    model = Model(languages, idf, leader(z, n), bias)
    model.temperature = _temperature(np.array([model.logits(t) for t, _ in spare]), np.array([languages.index(y) for _, y in spare]))
    return model


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm.

    With m rows the right label's target is (m + 1) / (m + 2), not 1 (Platt's targets): rows that the model tells
    apart without error say no more than that, and would otherwise drive the temperature to 0.
    """
    m, k = logits.shape
    if k < 2:
        return 1.0
    target = np.full((m, k), 1.0 / ((m + 2) * (k - 1)))
    target[np.arange(m), labels] = (m + 1.0) / (m + 2)
    loss = lambda t: -(target * np.log(_softmax(logits / np.exp(t)) + 1e-300)).sum(axis=1).mean()
    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: text and lang, both there, where crc32(doc_id as text) mod 3 is not 1."""
    return docs.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """`occurrences` over all rows that may be learned from: each task counts its own, the sums come to the driver."""

    def run(batches):
        total, df = occurrences(t.as_py() for batch in batches for t in batch.column("text"))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([total, *df[at].tolist()], pa.int64())], ["slot", "n"])

    with small_batches(docs.sparkSession):
        sums = learning_rows(docs).select("text").mapInArrow(tidy(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    total, df = 0, np.zeros(1 << BITS, np.int64)
    for slot, n in sums:
        if slot < 0:
            total = n
        else:
            df[slot] = n
    return total, df


def fit_on(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the `sample` labelled rows of least hash; of these, in that order, each that sample_bytes still has room for.

    Rows alike in doc_id, lang and text are one.
    """
    name = F.xxhash64("text").alias("name")
    rows = learning_rows(docs).select(F.xxhash64("doc_id", "lang").alias("h"), F.octet_length("text").alias("size"), "doc_id", "lang", name)
    picked = rows.orderBy("h", "doc_id", "name").limit(sample).collect()
    total, names = 0, {}
    for r in picked:
        key = (r["doc_id"], r["lang"], r["name"])
        if key not in names and total + r["size"] <= sample_bytes:
            total += r["size"]
            names[key] = None
    if picked and not names:  # all are longer than that: the shortest
        least = min(picked, key=lambda r: r["size"])
        names[least["doc_id"], least["lang"], least["name"]] = None
    if not names:
        return fit([])
    wanted = docs.sparkSession.createDataFrame(list(names), "doc_id long, lang string, name long")
    got = learning_rows(docs).select("doc_id", "lang", name, "text").join(F.broadcast(wanted), ["doc_id", "lang", "name"], "left_semi")
    got = got.dropDuplicates(["doc_id", "lang", "name"]).orderBy("doc_id", "lang", "text").collect()
    seen = document_frequencies(docs)
    model = fit([(r["text"], r["lang"]) for r in got], seen=seen)
    del got
    give_back()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents without those whose language cannot be told: a null text, or one without a letter.

    The model is fitted on the documents themselves; what it predicts rejects nothing but `und`, and fills the
    column lang (if there is one of type string) where that is null. Where no language was learned, the text alone
    decides and lang stays. Texts alone go to Python; whole rows stay in the JVM. The result is a written table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs))

    def run(texts: pa.Array) -> pa.Array:
        """The language of each text, `und` where it has a letter but none was learned, null where it cannot be told."""
        model = shared.value
        if not model.languages:
            return pa.array([UNKNOWN if has_letter(t.as_py()) else None for t in texts], pa.string())
        found = [model.predict(t.as_py())[0] for t in texts]
        return pa.array([None if x == UNKNOWN else x for x in found], pa.string())

    # or else the filter would be pushed through the projection, and every text identified twice
    told = F.arrow_udf(run, T.StringType(), F.ArrowUDFType.SCALAR).asNondeterministic()
    rows = docs.withColumn("_tilewright_told", told("text")).where("_tilewright_told is not null")
    fill = "lang" in docs.columns and docs.schema["lang"].dataType == T.StringType()
    known = F.coalesce("lang", F.nullif("_tilewright_told", F.lit(UNKNOWN))) if fill else None
    return Scratch(docs.sparkSession, "language").write(rows.select(*[known.alias(c) if fill and c == "lang" else F.col(c) for c in docs.columns]), "kept")
