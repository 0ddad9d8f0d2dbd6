"""Language identification by string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, fold

SCHEMA = "doc_id long, lang_pred string, score double"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), np.uint8, 0x110000)


class Alphabet:
    """Code points as small classes: 0 for all that is no letter, 1 for rare letters, then the frequent ones."""

    def __init__(self, letters: list[str], orders: int) -> None:
        self.orders, self.base = orders, len(letters) + 2
        self.table = _letters().copy()
        for k, letter in enumerate(letters):
            self.table[ord(letter)] = k + 2
        # Where the numbers of the n-grams of each order begin.
        self.offsets = np.cumsum([0] + [self.base**n for n in range(1, orders + 1)])

    def grams(self, text: str, flags: np.ndarray) -> np.ndarray:
        """Numbers of the distinct n-grams of all orders in the whole text; flags are scratch."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        classes = self.table[codes].astype(np.int32)
        # Runs of what is no letter count as one break, so that layout doesn't matter.
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] != 0) | (classes[:-1] != 0)
        classes = np.concatenate((np.zeros(1, np.int32), classes[keep], np.zeros(1, np.int32)))
        number = classes
        flags[: self.offsets[-1]] = False
        for n in range(1, self.orders + 1):
            if n > 1:
                number = number[:-1] * self.base + classes[n - 1 :]
            flags[self.offsets[n - 1] + number] = True
        return np.flatnonzero(flags[: self.offsets[-1]])


@dataclass
class Model:
    """What scoring needs, all of it bounded by the numbers of letters, landmarks and languages."""

    letters: list[str]
    orders: int
    grams: np.ndarray  # the n-grams of the landmarks, sorted
    landmarks: np.ndarray  # presence of each gram (row) in each landmark (column), over the landmark's norm
    weights: np.ndarray  # landmarks x languages
    langs: list[str]
    scale: float

    def kernel(self, texts: list[str], alphabet: Alphabet, flags: np.ndarray) -> np.ndarray:
        """Normalised blended-spectrum presence kernel of each text with each landmark, as one matrix product."""
        present = np.zeros((len(texts), len(self.grams)), np.float32)
        norms = np.ones(len(texts), np.float32)
        for k, text in enumerate(texts):
            grams = alphabet.grams(text, flags)
            norms[k] = max(1, len(grams)) ** 0.5
            at = np.searchsorted(self.grams, grams)
            at[at == len(self.grams)] = 0
            present[k, at[self.grams[at] == grams]] = 1
        return present @ self.landmarks / norms[:, None]

    def scores(self, texts: list[str], alphabet: Alphabet, flags: np.ndarray) -> np.ndarray:
        """Probability-like score of each language: softmax of the one-versus-rest outputs."""
        out = self.kernel(texts, alphabet, flags) @ self.weights * self.scale
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def _sampled(labelled: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows of each language in expectation, chosen by a hash of the id.

    Every language of the table is counted; the chance of a row depends on its language only.
    """
    counts = labelled.groupBy("lang").count().collect()
    chance = F.lit(0.0)
    for r in counts:
        chance = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows / r["count"]))).otherwise(chance)
    return labelled.where(F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30) < chance)


def fit_language(
    labelled: DataFrame, *, landmarks: int = 40, train_rows: int = 600, letters: int = 60, orders: int = 3, ridge: float = 1e-3, scale: float = 6.0
) -> Model | None:
    """Fit on rows (doc_id, text, lang) with a text and a language.

    The bounds, for each language: ``landmarks`` texts (their n-grams span the Nyström space)
    and ``train_rows`` texts for the ridge regression, both samples by hash of the id, in
    expectation; only landmark texts and one row of kernel values for each training text
    come to the driver. Returns None if no row is labelled.
    """
    chosen = sorted(_sampled(labelled, landmarks, "landmark").select("doc_id", "lang", "text").collect(), key=lambda r: (r.lang, r.doc_id))
    chosen = [r for r in chosen if has_letter(r.text)]
    if not chosen:
        return None
    found: dict[str, int] = {}
    for r in chosen:
        for c in r.text.lower():
            if c.isalpha():
                found[c] = found.get(c, 0) + 1
    common = sorted(sorted(found, key=lambda c: (-found[c], c))[:letters])
    alphabet = Alphabet(common, orders)
    flags = np.zeros(alphabet.offsets[-1], bool)
    sets = [alphabet.grams(r.text, flags) for r in chosen]
    grams = np.unique(np.concatenate(sets))
    presence = np.zeros((len(grams), len(sets)), np.float32)
    for k, s in enumerate(sets):
        presence[np.searchsorted(grams, s), k] = len(s) ** -0.5
    langs = sorted({r.lang for r in chosen})
    model = Model(common, orders, grams, presence, np.zeros((len(sets), len(langs))), langs, scale)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        alphabet = Alphabet(own.letters, own.orders)
        scratch = np.zeros(alphabet.offsets[-1], bool)
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "k": [x.tolist() for x in own.kernel(list(batch["text"]), alphabet, scratch)]})

    train = _sampled(labelled, train_rows, "train").select("lang", "text").mapInPandas(run, "lang string, k array<double>").collect()
    between = presence.T @ presence
    values, vectors = np.linalg.eigh(between.astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # the landmark kernel's inverse square root
    x = np.array([r.k for r in train]) if train else between
    names = [r.lang for r in train] if train else [r.lang for r in chosen]
    phi = x @ root
    y = np.array([[1.0 if name == lang else -1.0 for lang in langs] for name in names])
    # Languages weigh the same, however many rows they have.
    each = {lang: max(1, names.count(lang)) for lang in langs}
    w = np.array([1.0 / each[name] if name in each else 0.0 for name in names])[:, None]
    gram = phi.T @ (phi * w) + ridge * np.eye(phi.shape[1])
    model.weights = root @ np.linalg.solve(gram, phi.T @ (y * w))
    return model


def predict_language(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score. ``und`` with score 0 if the text is null or has no letter.

    Whole texts become presence vectors over the landmarks' n-grams; each batch is scored by two
    matrix products against the broadcast model, whose size does not grow with the data.
    """
    spark = docs.sparkSession
    batches_of(spark, 500)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        alphabet = Alphabet(own.letters, own.orders) if own else None
        flags = np.zeros(alphabet.offsets[-1], bool) if own else None
        for batch in batches:
            texts = batch["text"].tolist()
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": "und", "score": 0.0})
            known = [k for k, t in enumerate(texts) if own and isinstance(t, str) and has_letter(t)]
            for at in range(0, len(known), 250):
                rows = known[at : at + 250]
                scores = own.scores([texts[k] for k in rows], alphabet, flags)
                out.iloc[rows, 1] = [own.langs[k] for k in scores.argmax(axis=1)]
                out.iloc[rows, 2] = scores.max(axis=1).astype(float)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def identify_language(docs: DataFrame, *, folds: int = 5, key_col: str | None = None, **fit: float) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; with ``key_col``, a long column, that key, lang_pred, score.

    Learns from documents with a text and a lang whose id is not in fold 0; lang, source and id
    are not used to predict. Score is the softmax of the one-versus-rest outputs, 0 to 1.

    Cases: null text or one without letters is ``und`` with score 0; a null id is neither held
    out nor learned from; without labelled rows all is ``und``; repeated rows are each judged;
    ties go to the language that sorts first.
    """
    ids = docs.withColumn("fold", fold(F.col("doc_id"), folds))
    labelled = ids.where((F.col("fold") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    predicted = predict_language(docs, fit_language(labelled, **fit), id_col=key_col or "doc_id")
    if key_col:
        return predicted.select(F.col("doc_id").alias(key_col), "lang_pred", "score")
    return predicted.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
