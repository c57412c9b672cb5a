"""Language identification by string kernels.

The kernel of two texts is a blended spectrum of character n-gram presence: for each order n up to ``orders``, the
number of n-grams that both have, over the root of the product of their numbers of n-grams; the mean over n. With
``landmarks`` texts it gives Nystroem features, and one-versus-rest kernel ridge regression on them gives a value for
each language. All texts are scored whole, by products of matrices over batches of documents.

Fitting uses a bounded sample: for each language ``per_class`` labelled texts at most, chosen by a hash of the id, and of
longer texts the first ``most_chars`` characters. Each language has four landmarks at least. Nothing else is bounded.

Defined results
    null text, or a text without a letter   lang_pred 'und', score 0
    no labelled text to learn from          'und' and 0 for every row
    null lang                               such a row is not learned from
    null id                                 crc32 of the empty string decides its fold
    repeated rows, ties                     a tie between languages goes to the first by code point
    empty table                             empty result
    other columns                           are not read
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardenflow.llm.common import crc_mod, fresh, settle

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass
class Grams:
    """Characters as small numbers, and n-grams as columns: those that some landmark has."""

    letters: np.ndarray  # number of each code point, 0 for others
    base: int
    columns: list[np.ndarray]  # by order: column of each n-gram, or -1
    width: int

    def codes(self, text: str) -> np.ndarray:
        return self.letters[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]

    def present(self, codes: np.ndarray, n: int, mark: np.ndarray) -> np.ndarray:
        """The different n-grams of a text; ``mark`` is a scratch array of zeros and is left so."""
        grams = codes[: len(codes) - n + 1].astype(np.int64) if len(codes) >= n else codes[:0].astype(np.int64)
        for j in range(1, n):
            grams = grams * self.base + codes[j : len(codes) - n + 1 + j]
        mark[grams] = True
        out = np.flatnonzero(mark)
        mark[grams] = False
        return out

    def matrix(self, texts: list[str]) -> np.ndarray:
        """A row for each text: for each of its n-grams that has a column, 1 / root of its number of n-grams."""
        out = np.zeros((len(texts), self.width), np.float32)
        marks = [np.zeros(len(c), bool) for c in self.columns]
        for row, text in zip(out, texts, strict=True):
            codes = self.codes(text)
            for n, (columns, mark) in enumerate(zip(self.columns, marks, strict=True), 1):
                found = self.present(codes, n, mark)
                where = columns[found]
                row[where[where >= 0]] = 1 / np.sqrt(max(1, len(found)) * len(self.columns))
        return out


def _grams(texts: list[str], landmarks: list[str], orders: int, alphabet: int) -> Grams:
    """Numbers for the ``alphabet`` most frequent characters of ``texts`` and columns for the n-grams of ``landmarks``."""
    points, counts = np.unique(np.frombuffer("".join(texts).lower().encode("utf-32-le", "replace"), np.uint32), return_counts=True)
    points = np.sort(points[np.argsort(-counts, kind="stable")][:alphabet])
    letters = np.zeros(0x110000, np.uint8)
    letters[points] = np.arange(1, len(points) + 1)
    grams = Grams(letters, len(points) + 1, [np.full((len(points) + 1) ** n, -1, np.int32) for n in range(1, orders + 1)], 0)
    for n, columns in enumerate(grams.columns, 1):
        mark = np.zeros(len(columns), bool)
        for text in landmarks:
            mark[grams.present(grams.codes(text), n, np.zeros(len(columns), bool))] = True
        columns[mark] = np.arange(grams.width, grams.width + mark.sum())
        grams.width += int(mark.sum())
    return grams


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    landmarks: np.ndarray  # n-gram columns x landmarks
    weights: np.ndarray  # landmarks x languages

    def values(self, texts: list[str]) -> np.ndarray:
        return (self.grams.matrix(texts) @ self.landmarks) @ self.weights

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is half the distance between the two highest values, within 0 and 1."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = [i for i, x in enumerate(texts) if x and LETTER.search(x)]
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            values = self.values([texts[i] for i in part]).astype(np.float64)
            best = values.argmax(axis=1)
            if values.shape[1] > 1:
                top = np.sort(values, axis=1)
                scores[part] = np.round(np.clip((top[:, -1] - top[:, -2]) / 2, 0, 1), 6)
            else:
                scores[part] = 1
            for i, b in zip(part, best, strict=True):
                langs[i] = self.languages[b]
        return langs, scores


def fit(texts: list[str], langs: list[str], landmarks: int = 128, orders: int = 3, alphabet: int = 95, ridge: float = 0.1) -> Model | None:
    """``texts`` and ``langs`` are in the order in which landmarks are taken, in turn from each language."""
    languages = sorted(set(langs))
    if not languages:
        return None
    turn, seen = [], dict.fromkeys(languages, 0)
    for lang in langs:
        turn.append((seen[lang], lang))
        seen[lang] += 1
    order = sorted(range(len(texts)), key=lambda i: turn[i])
    marks = [texts[i] for i in order[: max(landmarks, 4 * len(languages))]]
    grams = _grams(texts, marks, orders, alphabet)
    z = grams.matrix(marks).astype(np.float64)
    values, vectors = np.linalg.eigh(z @ z.T)
    kept = values > 1e-8 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])  # K_mm to the power -1/2, as far as it has rank
    x = np.concatenate([grams.matrix(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(np.float64) @ z.T @ whiten
    y = np.array([[1.0 if a == b else -1.0 for b in languages] for a in langs])
    share = np.array([langs.count(a) for a in langs], float)
    weight = (len(langs) / len(languages) / share)[:, None]  # each language counts alike
    solved = np.linalg.solve(x.T @ (weight * x) + ridge * np.eye(x.shape[1]), x.T @ (weight * y))
    return Model(languages, grams, np.ascontiguousarray(z.T, np.float32), (whiten @ solved).astype(np.float32))


def training_sample(rows: DataFrame, per_class: int, most_chars: int, most_broadcast: int = 10_000) -> pd.DataFrame:
    """text and lang of at most ``per_class`` rows of each language, by the order of a hash of the id.

    Rows are thinned to about twice that where they are read; ``most_broadcast`` languages at most are broadcast.
    """
    rows = rows.filter("lang is not null and text is not null").withColumn("text", F.substring("text", 1, most_chars))
    rows = rows.withColumn("u", F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40)))
    rates = settle(rows.groupBy("lang").count().select(F.col("lang").alias("l__"), (F.lit(2.0 * per_class) / F.col("count")).alias("rate")), "rates")
    rates = F.broadcast(rates) if rates.count() <= most_broadcast else rates
    few = rows.join(rates, F.col("lang") == F.col("l__")).filter("u < rate")
    order = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    few = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_class)
    return few.select("lang", "k", "text").toPandas().sort_values(["k", "lang"], ignore_index=True)


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 250, most_chars: int = 20_000, **options):
    """A broadcast model (or None) of the labelled rows of ``docs`` whose crc32(id) mod 3 is not 1."""
    rows = docs.filter(crc_mod(id_col, 3) != 1).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = training_sample(rows, per_class, most_chars)
    sample = sample[sample["text"].map(lambda x: bool(LETTER.search(x))).astype(bool)]
    return docs.sparkSession.sparkContext.broadcast(fit(sample["text"].tolist(), sample["lang"].tolist(), **options))


def predictor(model):
    """A function of a text column that gives ``lang_pred, score``."""

    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.value.predict(texts.tolist()) if model.value else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; rows whose crc32(id) mod 3 is 1 are held out of the fit."""
    predict = predictor(trained(docs, id_col, text_col, lang_col, **options))
    out = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, 3) == 1).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` with a language, all columns kept; rejected are 'und' and scores under ``min_score``.

    Each row is decided where it is read, so nothing is joined or shuffled.
    """
    predict = predictor(trained(docs, id_col, text_col, lang_col, **options))
    found = fresh(docs, "found")
    out = docs.withColumn(found, predict(F.col(text_col).cast("string")))
    return out.filter((F.col(found)["lang_pred"] != UNDETERMINED) & (F.col(found)["score"] >= min_score)).select(*docs.columns)
