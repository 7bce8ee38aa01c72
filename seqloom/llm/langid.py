"""Language identification by nearest centroid over TF-IDF character n-grams.

Features are hashed n-grams of the folded text (1 to 3 code points, words
padded by a space), so a vector has a fixed width. Document frequencies come
from every training document. The centroids of each language come from
spherical k-means over a bounded sample of labelled rows (`SAMPLE` per
language, those with the least hash of text and doc_id).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import ship

DIMS = 1 << 13
#: Bound of the labelled sample that the centroids are fitted on, per language.
SAMPLE = 1500
CLUSTERS = 4
#: Below this cosine to the nearest centroid a document is rejected.
REJECT = 0.1
UNKNOWN = "und"

#: Rows drawn by a bound of the hash for each one wanted, so that enough are there.
DRAWN = 1.5

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")
_MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Hashed features of a whole text, one for each 1-, 2- and 3-gram."""
    folded = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(folded.encode("utf-32-le", "replace"), np.uint32)
    one, two = c * _MIX[0], c[:-1] * _MIX[0] + c[1:] * _MIX[1]
    three = two[:-1] * _MIX[2] + c[2:] * _MIX[1] + np.uint32(1)
    h = np.concatenate([one, two, three])
    h = (h ^ (h >> np.uint32(15))) * _MIX[1]
    return (h ^ (h >> np.uint32(13))) & np.uint32(DIMS - 1)


def vector(text: str) -> np.ndarray:
    """Term frequencies, damped by a square root."""
    return np.sqrt(np.bincount(grams(text), minlength=DIMS).astype(np.float32))


def _weighted(v: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = v * idf
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """How many training texts there are, and how many have each feature.

    Each task sends one vector of fixed width.
    """

    def count(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                df += np.bincount(grams(text), minlength=DIMS) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(df[at], n)})

    got = train.select("text").mapInPandas(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS, np.int64)
    at = got["at"].to_numpy()
    df[at[at >= 0]] = got["n"].to_numpy()[at >= 0]
    return int(got["n"].to_numpy()[at < 0].sum()), df


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from the rows farthest from those chosen."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.stack([m / (np.linalg.norm(m) or 1) if (m := x[of == i].sum(0)).any() else c[i] for i in range(len(c))])
    return c


class Model:
    """Weights and centroids: at most languages x CLUSTERS vectors of DIMS floats."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray):
        self.idf, self.langs, self.centroids = idf, langs, centroids

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, cosine); no letters or no model: ("und", 0)."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        cos = self.centroids @ _weighted(vector(text), self.idf)
        best = int(cos.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cos[best])))


def draw(train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): for each language the `sample` rows of least hash of text and doc_id, or all.

    A language's share of the hash range is set by its count, so all but about
    DRAWN * sample rows of it are filtered where they are read; the few left are
    ranked. Equal rows count once. Languages are a small set of names.
    """
    sizes = {r[0]: r[1] for r in train.groupBy("lang").agg(F.count("*")).collect()}
    bound = F.when(F.lit(False), F.lit(0))
    for lang, n in sorted(sizes.items()):
        if n > 4 * sample:
            bound = bound.when(F.col("lang") == lang, F.lit(int(2**64 * (DRAWN * sample + 200) / n) - 2**63))
    few = train.withColumn("_h", F.xxhash64("text", "doc_id")).where(F.coalesce(F.col("_h") < bound, F.lit(True)))
    few = few.groupBy("lang", "_h").agg(F.min("text").alias("text"))
    return few.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_nth") <= sample).select("lang", "text")


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learns from train(doc_id, text, lang).

    Rows with a null text or language or no letter are left out. doc_id only
    spreads the draw of the sample; with no rows left nothing is learned.
    """
    ship(train.sparkSession)
    train = train.where("text IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "text", "lang")
    n, df = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    drawn = draw(train, sample)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(set(pdf["text"]))
        c = _kmeans(np.stack([_weighted(vector(t), idf) for t in texts]), clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [r.astype(np.float32).tobytes() for r in c]})

    got = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary").toPandas().sort_values(["lang", "centroid"])
    return Model(idf, got["lang"].tolist(), np.stack([np.frombuffer(c, np.float32) for c in got["centroid"]]) if len(got) else np.zeros((0, DIMS), np.float32))


def predict(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """docs plus lang_pred, score (cosine) and rejected.

    A text that is null or has no letter is `und` with score 0 and rejected; a
    cosine below `reject` is rejected but keeps its nearest language. Columns
    of these three names in docs are replaced; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast((model.idf, model.langs, model.centroids))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = Model(*sent.value)
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    into = "_guess"
    while into in docs.columns:
        into += "_"
    return docs.withColumn(into, guess("text")).select(*docs.columns, F.col(f"{into}.lang_pred").alias("lang_pred"), F.col(f"{into}.score").alias("score"), ((F.col(f"{into}.lang_pred") == UNKNOWN) | (F.col(f"{into}.score") < reject)).alias("rejected"))


def op10_language_id(spark, sf_dir) -> DataFrame:
    """The contract's query: learns where crc32(doc_id) mod 3 is not 1, predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = fit(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
