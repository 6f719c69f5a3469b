"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Character 3-grams of the lower-cased text (white space, digits and punctuation become one blank)
are hashed into WIDTH bins. A text's vector is (1 + log count) * idf, scaled to length one.
Document frequencies come from all training rows; the centroids (several for each language, by
spherical k-means) are fitted in one task for each language on at most `per_lang` rows of it,
chosen by the hash of doc_id - the documented bound of the fit. A text gets the language of the
centroid with the largest cosine. It is rejected when that cosine is under the centroid's own
limit, `slack` times the first percentile of its members' cosines (less for short texts, whose
cosines are small by nature: times the square root of their 3-grams over FULL), or when it has no
letter.

Two scans of the text, no shuffle of it: the first adds up document frequencies (WIDTH numbers a
task), the second predicts. The model (languages * clusters * WIDTH floats) goes to the tasks
with the function.

Defined results: a null text and a text without letters get `und` and score 0, rejected; without
any training row all texts do. Repeated rows are predicted alike; ties between centroids go to
the first in (language, cluster) order; an empty table gives an empty result. Very long texts
are counted in chunks that overlap by the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, strings, table

WIDTH, PER_LANG, CLUSTERS, SLACK, FULL, CHUNK = 4096, 400, 4, 0.5, 400, 1 << 20


def _blanked() -> np.ndarray:
    out = np.full(256, 32, dtype=np.uint32)
    out[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    return out


BLANKED = _blanked()


def counts(text: str) -> np.ndarray:
    """3-grams of the whole text by bin."""
    out = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        raw = (" " + text[max(0, at - 2) : at + CHUNK].lower() + " ").encode("utf-8", "replace")
        b = BLANKED[np.frombuffer(raw, dtype=np.uint8)]
        b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
        if len(b) > 2:
            code = (b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]
            out += np.bincount((code * np.uint32(2_654_435_761)) >> np.uint32(32 - 12), minlength=WIDTH)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vectors(many: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.array(many, dtype=np.float32)
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, and the number of texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH + 1, dtype=np.int64), 0
        for batch in batches:
            for text in strings(batch.column(0)):
                if text:
                    df[:WIDTH] += counts(text) > 0
                    n += 1
        df[WIDTH] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["bin", "n"])

    got = docs.select("text").mapInArrow(add, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # WIDTH + 1 rows at most
    df = np.zeros(WIDTH + 1, dtype=np.int64)
    for r in got:
        df[r["bin"]] = r["n"]
    return df[:WIDTH], int(df[WIDTH])


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each other one the row farthest from all before."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    def __init__(self, langs: list[str], centres: np.ndarray, limits: np.ndarray, idf: np.ndarray) -> None:
        self.langs, self.centres, self.limits, self.idf = langs, centres, limits, idf

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        use = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for lo in range(0, len(use), 256):
            part = use[lo : lo + 256]
            grams = [counts(texts[i]) for i in part]
            near = vectors(grams, self.idf) @ self.centres.T
            best = np.argmax(near, axis=1)
            for i, b, row, n in zip(part, best.tolist(), near, grams, strict=True):
                limit = self.limits[b] * min(1.0, n.sum() / FULL) ** 0.5
                out[i] = (self.langs[b], float(min(1.0, max(0.0, row[b]))), bool(row[b] < limit))
        return out


def fit(train: DataFrame, per_lang: int = PER_LANG, clusters: int = CLUSTERS, slack: float = SLACK) -> Model:
    """Learn from text and lang of the given rows."""
    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Model([], np.zeros((0, WIDTH), np.float32), np.zeros(0), idf)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 1.2 * per_lang / v))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h").head(per_lang)
        texts = [t for t in part["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centre": [], "low": []})
        x = vectors([counts(t) for t in texts], idf)
        c = k_means(x, clusters)
        near = x @ c.T
        own = np.argmax(near, axis=1)
        low = [float(np.percentile(near[own == i, i], 1)) if (own == i).any() else 0.0 for i in range(len(c))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [r.tolist() for r in c], "low": low})

    got = rows.where(drawn).withColumn("h", F.xxhash64("doc_id")).groupBy("lang").applyInPandas(centroids, "lang string, centre array<float>, low double").collect()  # clusters rows a language
    got = sorted(got, key=lambda r: (r["lang"], r["centre"]))
    return Model([r["lang"] for r in got], np.array([r["centre"] for r in got], np.float32).reshape(-1, WIDTH), np.array([slack * r["low"] for r in got]), idf)


def predict(docs: DataFrame, model: Model, keep: list[Column], with_text: bool = False) -> DataFrame:
    """keep (and the text), then lang_pred, score and rejected; only `text` goes into a prediction."""
    given = docs.select(*keep, F.col("text"))
    kept = len(keep) + with_text
    out = T.StructType(given.schema.fields[:kept]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.predict(list(strings(batch.column(batch.num_columns - 1))))
            made = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:kept] + made, names=out.names)

    return given.mapInArrow(each, out)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 4) != 2)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not rejected; columns as before."""
    others = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    known = predict(docs, model, [F.col(c).alias(k) for c, k in others.items()], with_text=True).where(~F.col("rejected"))
    return known.select(*[F.col(others[c]).alias(c) if c in others else c for c in docs.columns])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, fit(training_rows(docs)), [F.col("doc_id"), held])
