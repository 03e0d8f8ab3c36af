"""Language identification by the nearest of several centroids per language.

A text's vector has the logarithmic counts of its byte trigrams (lower-cased, all that
is no letter as one blank, hashed to 4,096 places), times the inverse document
frequency, normalised. Per language, spherical k-means makes up to ``clusters``
centroids. A text gets the language of the centroid with the greatest cosine; one whose
cosine is below the language's limit is rejected as too far from all centroids. The
limit is a share of the smallest cosines of the language's own training texts, and less for
texts of few trigrams, whose cosine can't be great.

Training takes at most ``per_language`` labelled texts of each label, chosen by a hash
of doc_id; the model's size depends on the number of labels only. Prediction reads whole
texts of all rows and shuffles nothing.

Defined cases: null text and text without a letter are ``und`` with score 0, rejected;
without any labelled text every row is; ties go to the label that sorts first; repeated
rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.scratch import written
from twinledger.llm.tokens import in_blocks

PLACES = 4096
UNKNOWN = "und"
_BLOCK = 1_000_000
_ROWS = 256
_FULL = 200  # distinct trigrams from which on the limit holds in full
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    """Whether any character is in one of the categories of letters; numerals like ½ are not."""
    return any(map(str.isalpha, text))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte trigrams, one row per text."""
    raws = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    codes = _FOLD[np.frombuffer(b"".join(raws), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    if len(codes) < 3:
        return np.zeros((len(texts), PLACES), np.float32)
    joined = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
    inside = (row[:-2] == row[2:]) & (joined != 0x202020)
    place = (joined * np.uint32(2654435761)) >> np.uint32(20)
    spots = (row[:-2] * PLACES + place)[inside]
    return np.bincount(spots, minlength=len(raws) * PLACES).reshape(len(raws), PLACES).astype(np.float32)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    found = np.log1p(counts) * idf
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norm > 0, norm, 1)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; the start is spread by farthest choice."""
    centres = vectors[:1]
    while len(centres) < min(k, len(vectors)):
        centres = np.vstack([centres, vectors[np.argmin((vectors @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Model:
    labels: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: dict[str, float]  # least cosine that a label accepts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and whether it is rejected, of each text."""
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        told = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.labels else []
        for at in range(0, len(told), _ROWS):
            rows = told[at:at + _ROWS]
            counts = trigram_counts([texts[i] for i in rows])
            near = weigh(counts, self.idf) @ self.centroids.T
            # The cosine of a short text can't be great: the limit falls with the root of its distinct trigrams.
            ease = np.sqrt(np.minimum(1.0, (counts > 0).sum(axis=1) / _FULL))
            for i, c, score, share in zip(rows, near.argmax(axis=1), near.max(axis=1), ease):
                labels[i] = self.labels[c]
                scores[i] = min(1.0, max(0.0, float(score)))
                rejected[i] = scores[i] < share * self.limits[labels[i]]
        return labels, scores, rejected


def train(
    docs: DataFrame, per_language: int = 400, clusters: int = 4, lowest: float = 0.01, slack: float = 0.5,
) -> Model:
    """Fits on ``docs`` with doc_id, text and lang; rows without text, letters or label are left out."""
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("hash", F.xxhash64("doc_id"))
    # Of a label with many rows, hashes below a bound that twice the wanted number is expected to meet.
    share = labelled.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count("*")).alias("share"))
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id", F.xxhash64("text"))
    # One row per label: as a broadcast, the bound holds before any row is shuffled.
    sample = labelled.join(F.broadcast(share), "lang").filter(
        F.pmod("hash", F.lit(1 << 32)) < F.col("share") * (1 << 32)
    ).withColumn("turn", F.row_number().over(by_hash)).filter(F.col("turn") <= per_language)

    def features(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in in_blocks(texts, _BLOCK):
                counts = trigram_counts(texts[s])
                yield pd.DataFrame({"lang": pdf["lang"][s], "turn": pdf["turn"][s], "counts": [r.tobytes() for r in counts]})

    rows = written(sample.select("lang", "turn", "text").mapInPandas(features, "lang string, turn int, counts binary"), "langid")

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(r, np.float32) for r in pdf.sort_values("turn")["counts"]])

    def frequency(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pdf)], "df": [(matrix(pdf) > 0).sum(axis=0).astype(np.int64).tobytes()]})

    held = rows.groupBy("lang").applyInPandas(frequency, "n long, df binary").collect()  # one row per label
    n = sum(r.n for r in held)
    df = sum((np.frombuffer(r.df, np.int64) for r in held), np.zeros(PLACES, np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def centroids(key, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = weigh(matrix(pdf), idf)
        centres = cluster(vectors, clusters)
        limit = slack * float(np.quantile((vectors @ centres.T).max(axis=1), lowest))
        return pd.DataFrame({
            "lang": key[0], "c": range(len(centres)), "limit": limit, "centre": [c.astype(np.float32).tobytes() for c in centres]})

    found = rows.groupBy("lang").applyInPandas(centroids, "lang string, c int, limit double, centre binary").collect()
    found.sort(key=lambda r: (r.lang, r.c))
    return Model(
        [r.lang for r in found], np.stack([np.frombuffer(r.centre, np.float32) for r in found]) if found else np.zeros((0, PLACES)),
        idf, {r.lang: r.limit for r in found})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced."""
    from twinledger.llm.scratch import without

    docs = without(docs, "lang_pred", "score", "rejected")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores), pa.array(rejected)],
                [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = docs.schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is in the fold that training leaves out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold
