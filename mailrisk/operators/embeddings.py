"""Comparison, pooling and reduction of embedding sets ``(id, dataset, embedding)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizerModel, Normalizer, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.functions import vectors as V
from mailrisk.operators.bayes import words
from mailrisk.operators.joins import lookup_join


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def mean_vector(c: Column) -> Column:
    """Aggregate: element-wise mean of array vectors, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(_doubles(c))))


def centroid(df: DataFrame, by: str = "dataset", vector: str = "embedding") -> DataFrame:
    rows = df.filter(F.col(vector).isNotNull())
    return rows.groupBy(by).agg(mean_vector(F.col(vector)).alias("centroid"))


def mean_pool(tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """Mean of the token vectors a document's mask keeps; null when it keeps none.

    One aggregate: tokens that are not kept count as zero vectors, and the mean
    over all tokens is scaled to the mean over the kept ones.
    """
    kept = F.coalesce(F.col("mask") == 1, F.lit(False)).cast("double")
    masked = F.transform(F.col("vec"), lambda x: x.cast("double") * kept)
    sums = tokens.groupBy(doc).agg(
        vector_to_array(Summarizer.mean(array_to_vector(masked))).alias("_mean"),
        F.count(F.lit(1)).alias("_all"),
        F.sum(kept).alias("_kept"),
    )
    scale = F.col("_all") / F.nullif(F.col("_kept"), F.lit(0.0))
    scaled = F.when(scale.isNotNull(), F.transform("_mean", lambda x: x * scale))
    return sums.select(doc, scaled.alias("embedding"))


def first_token_pool(tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """The vector of each document's token at position 0."""
    return tokens.filter("pos = 0").select(doc, F.col("vec").alias("embedding"))


def _pairs(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Both sides' vectors of each named pair; ``table`` has one row per set.

    Each set's row goes to the pairs it is in, so the sets are computed once.
    """
    sides = [
        F.struct(F.lit(p[0]).alias("set_a"), F.lit(p[1]).alias("set_b"), F.lit(name).alias("dataset"), F.lit(side).alias("side"))
        for p in pairs
        for name, side in zip(p, "ab")
    ]
    named = table.sparkSession.range(1).select(F.inline(F.array(*sides)))
    both = table.join(F.broadcast(named), "dataset")  # two rows per pair the caller names

    def vector(side: str) -> Column:
        return F.any_value(F.when(F.col("side") == side, F.col("centroid")), True)

    joined = both.groupBy("set_a", "set_b").agg(vector("a").alias("vec_a"), vector("b").alias("vec_b"))
    return joined.dropna(subset=["vec_a", "vec_b"])


def centroid_similarity(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cosine of the mean vectors of each named pair of sets."""
    both = _pairs(centroid(df), pairs)
    return both.select("set_a", "set_b", V.cosine_similarity("vec_a", "vec_b").alias("similarity"))


def mean_pairwise_distance(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean cosine distance over all row pairs of each named pair of sets.

    The mean of all dot products of unit vectors is the dot product of their
    means, so every row counts and no pair of rows is ever formed.
    """
    units = df.select("dataset", V.unit("embedding").alias("embedding"))
    both = _pairs(centroid(units), pairs)
    return both.select("set_a", "set_b", (F.lit(1.0) - V.dot("vec_a", "vec_b")).alias("distance"))


def nearest_set(similarity: DataFrame, of: str, first: str, second: str) -> DataFrame:
    """Which of two sets ``of`` is nearer to, from a ``centroid_similarity`` table."""

    def to(name: str) -> Column:
        hit = ((F.col("set_a") == of) & (F.col("set_b") == name)) | (
            (F.col("set_b") == of) & (F.col("set_a") == name)
        )
        return F.max(F.when(hit, F.col("similarity")))

    sims = similarity.agg(to(first).alias("sim_first"), to(second).alias("sim_second"))
    closer = V.closer_set("sim_first", "sim_second", first, second)
    return sims.select(F.lit(of).alias("set_name"), "sim_first", "sim_second", closer.alias("closer"))


def pca_kmeans(
    df: DataFrame, k: int = 2, seed: int = 42, vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(points, centres): plane coordinates ``x``, ``y`` and cluster of every row, and of the
    centres, which also have their ``centre`` among the vectors."""
    rows = df.withColumn("_raw", array_to_vector(_doubles(F.col(vector))))
    scaler = StandardScaler(inputCol="_raw", outputCol="_f", withMean=True, withStd=False).fit(rows)
    # k-means reads its input many times; partitions lost with an executor are rebuilt
    centred = scaler.transform(rows).persist(StorageLevel.MEMORY_AND_DISK)
    plane = PCA(k=2, inputCol="_f", outputCol="_xy").fit(centred)
    clusters = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(centred)
    centred.unpersist()
    points = _coordinates(clusters.transform(plane.transform(scaler.transform(rows))))
    centres = df.sparkSession.createDataFrame(
        [(i, c.tolist(), (c + scaler.mean.toArray()).tolist()) for i, c in enumerate(clusters.clusterCenters())],
        "cluster int, c array<double>, centre array<double>",
    ).withColumn("_f", array_to_vector("c"))
    centres = _coordinates(plane.transform(centres)).drop("c")
    return points.drop("_raw", "_f"), centres.drop("_f")


def _coordinates(df: DataFrame) -> DataFrame:
    xy = vector_to_array("_xy")
    return df.withColumns({"x": xy[0], "y": xy[1]}).drop("_xy")


def embed_text(
    df: DataFrame, text: str, dim: int = 256, out: str = "embedding"
) -> DataFrame:
    """One vector of length one per text from hashed word counts; row-wise, no shuffle.

    The place of a word is the start of its MD5; ``dim`` is a power of 16.
    """
    digits = len(f"{dim:x}") - 1
    if dim != 16**digits or digits < 1:
        raise ValueError("dim must be a power of 16")
    places = F.transform(words(F.col(text)), lambda w: F.substring(F.md5(w), 1, digits))
    names = [f"{i:0{digits}x}" for i in range(dim)]
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="_places", outputCol="_tf")
    counted = counter.transform(df.withColumn("_places", places))
    scaled = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return scaled.select(*df.columns, vector_to_array("_unit", "float32").alias(out))


# --- principal axes ----------------------------------------------------------------


def covariance(df: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of vectors of one length, null and ragged ones left out, in one pass.

    Each task sums its vectors and their products, relative to a first row; the sums
    of tasks are added in Spark, and one d x d table comes to the driver.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(_doubles(F.col(vector)).alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("no vectors")
    shift, d = np.array(first["x"]), len(first["x"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - shift
            n, total, product = n + len(flat), total + flat.sum(0), product + flat.T @ flat
        if n:
            values = np.concatenate([[n], total, product[np.triu_indices(d)]])
            yield pa.RecordBatch.from_arrays([pa.array([values], pa.list_(pa.float64()))], names=["s"])

    parts = rows.filter(F.size("x") == d).mapInArrow(sums, "s array<double>")
    total = np.array(parts.agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).first()["s"])
    n, mean, upper = int(total[0]), total[1 : d + 1] / total[0], total[d + 1 :]
    product = np.zeros((d, d))
    product[np.triu_indices(d)] = upper
    product = product + np.triu(product, 1).T
    return n, mean + shift, (product - n * np.outer(mean, mean)) / max(1, n - 1)


def principal_axes(df: DataFrame, k: int = 2, vector: str = "embedding") -> DataFrame:
    """(axis, variance, share, residual, direction) of the ``k`` directions of largest variance.

    ``share`` is the axis' part of all variance; ``residual`` is how far the
    direction is from the eigen equation of the covariance.
    """
    _, _, cov = covariance(df, vector)
    values, vectors = np.linalg.eigh(cov)
    rows = []
    for i in range(1, min(k, len(values)) + 1):
        v = vectors[:, -i] * (1.0 if vectors[np.argmax(np.abs(vectors[:, -i])), -i] > 0 else -1.0)
        off = float(np.linalg.norm(cov @ v - values[-i] * v))
        rows.append((i, float(values[-i]), float(values[-i] / max(np.trace(cov), 1e-300)), off, v.tolist()))
    return df.sparkSession.createDataFrame(rows, "axis int, variance double, share double, residual double, direction array<double>")


# --- token vectors -------------------------------------------------------------------

# Texts to their tokens' vectors (texts, tokens, d) and the mask (texts, tokens); shorter texts are padded with mask 0.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def encode_tokens(
    df: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder], dim: int, batch_size: int = 32
) -> DataFrame:
    """Token table (doc, pos, mask, vec) of an encoder outside Spark, for ``mean_pool`` and ``first_token_pool``.

    ``make_encoder`` is called once in each Python worker, the encoder on up to
    ``batch_size`` texts.  Padding stays in the table with mask 0; a missing text
    counts as empty.  Rows of one ``key`` are one document.
    """

    def make_predict() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        encode = make_encoder()

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            vectors, mask = encode([str(t) for t in texts.reshape(-1)])
            if vectors.shape != (len(texts), mask.shape[1], dim):
                raise ValueError(f"an encoder must give vectors of {dim} values for each of {mask.shape[1]} tokens")
            return {"vecs": vectors.reshape(len(texts), -1).astype(np.float32), "mask": mask.astype(np.int32)}

        return predict

    result = T.StructType([T.StructField("vecs", T.ArrayType(T.FloatType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])
    call = predict_batch_udf(make_predict, return_type=result, batch_size=batch_size)
    encoded = df.select(F.col(key).alias("doc"), call(F.coalesce(F.col(text), F.lit(""))).alias("_e"))
    place = F.col("pos") * dim + 1
    tokens = encoded.select("doc", "_e.vecs", F.posexplode("_e.mask").alias("pos", "mask"))
    return tokens.select("doc", "pos", "mask", F.slice("vecs", place, F.lit(dim)).alias("vec"))


def learn_word_vectors(df: DataFrame, text: str, dim: int = 64, min_count: int = 5, window: int = 5, seed: int = 42) -> DataFrame:
    """(word, vec): vectors of the words with at least ``min_count`` occurrences, from the words they stand among.

    Learned by Spark's Word2Vec, whose table of words is held by the driver: raise
    ``min_count`` with the corpus.  Texts are cut into sentences of 1,000 words.
    """
    model = Word2Vec(
        vectorSize=dim, minCount=min_count, windowSize=window, maxSentenceLength=1000, seed=seed, maxIter=2,
        numPartitions=max(1, min(16, df.rdd.getNumPartitions())), inputCol="_words", outputCol="_mean",
    )
    fitted = model.fit(df.select(words(F.col(text)).alias("_words")))
    return fitted.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def word_tokens(df: DataFrame, key: str, text: str, vectors: DataFrame) -> DataFrame:
    """Token table (doc, pos, mask, vec) with the learned vector of each word; words without one are left out."""
    found = df.select(F.col(key).alias("doc"), F.posexplode(words(F.col(text))).alias("pos", "word"))
    known = lookup_join(found, vectors, "word", spread="doc", how="inner")
    return known.select("doc", "pos", F.lit(1).alias("mask"), "vec")
