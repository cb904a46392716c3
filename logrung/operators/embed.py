"""Message vectors: hashed tokens under a random projection, and pooled tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.functions.vectors import COUNT_FLOOR
from logrung.session import landed

#: Tokens share a document frequency by the first hexadecimal digits of their hash.
BUCKET_DIGITS = 3
_BITS = 128
_SPACES = re.compile(rb"[ \t\n\x0b\f\r]+")
#: Tokens whose signs a task keeps between batches.
_KEPT_TOKENS = 1 << 15
_BYTES_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class HashedEmbedder:
    """A seeded projection of tokens to ``size`` signs, weighed by inverse document frequency.

    ``weights`` is a table of one row, the weight of each of 16**3 hash
    buckets: its size does not depend on the corpus, and there is no vocabulary.
    """

    weights: DataFrame
    text: str
    size: int
    seed: int


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.substring(F.md5(word), 1, BUCKET_DIGITS)


def fit_embedder(df: DataFrame, text: str = "message", size: int = 64, seed: int = 94) -> HashedEmbedder:
    """Document frequencies of token buckets; one pass, summed before the shuffle."""
    buckets = F.array_distinct(F.transform(_words(F.col(text)), _bucket))
    seen = df.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    rows = df.count()
    found = seen.select("bucket", (1 + F.log((F.lit(rows) + 1) / (F.col("n") + 1.0))).alias("weight"))
    # 4096 numbers at most, in the order of the buckets; an unseen bucket weighs most.
    held = dict(map(tuple, found.collect()))
    unseen = float(df.sparkSession.range(1).select(1 + F.log(F.lit(rows + 1.0))).first()[0])
    weights = [held.get(f"{i:0{BUCKET_DIGITS}x}", unseen) for i in range(16**BUCKET_DIGITS)]
    table = df.sparkSession.createDataFrame([(weights,)], "weights array<double>")
    return HashedEmbedder(landed(table, "token-weights"), text, size, seed)


def embed_messages(model: HashedEmbedder, df: DataFrame, output: str = "embedding") -> DataFrame:
    """Append the weighted mean of the signs of a message's tokens; row-local.

    Sign d of a token is bit d of its md5 with the seed, in blocks of 128. A
    message without tokens gets zeros. Equal messages of a batch are embedded
    once, and tokens are added in the order of the message.
    """
    # 4096 numbers.
    weights = np.array(model.weights.select("weights").first()[0], dtype=float)
    size, seed, blocks = model.size, model.seed, -(-model.size // _BITS)

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signs = _TokenSigns(weights, size, seed, blocks)
        for texts in batches:
            places, distinct = pd.factorize(texts)
            vectors = list(signs.vectors(list(distinct)))
            yield pd.Series([vectors[i] for i in places], index=texts.index, dtype=object)

    # As bytes, which are hashed and cut as they are.
    text = F.coalesce(F.col(model.text), F.lit("")).cast("binary")
    return df.withColumn(output, embed(text))


class _TokenSigns:
    """Weighed signs of tokens, kept for the next messages in a table that starts anew when it is full."""

    def __init__(self, weights: np.ndarray, size: int, seed: int, blocks: int):
        self._weights, self._size, self._seed, self._blocks = weights, size, seed, blocks
        self._reset()

    def _reset(self) -> None:
        self._codes: dict[bytes, int] = {}
        # The last column is the weight itself, so that the total is summed with the rest.
        self._table = np.zeros((1024, self._size + 1))

    def _code(self, token: bytes) -> int:
        code = self._codes.get(token)
        if code is None:
            code = self._codes[token] = len(self._codes)
            if code == len(self._table):
                self._table = np.concatenate((self._table, np.zeros_like(self._table)))
            weight = self._weights[int(hashlib.md5(token).hexdigest()[:BUCKET_DIGITS], 16)]
            digest = b"".join(hashlib.md5(b"%d:%d:" % (self._seed, k) + token).digest() for k in range(self._blocks))
            bits = np.unpackbits(np.frombuffer(digest, np.uint8))[: self._size]
            self._table[code, :-1] = weight * (1.0 - 2.0 * bits)
            self._table[code, -1] = weight
        return code

    def vectors(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The vector of each text, some texts at a time, so that their tokens' signs stay few."""
        ends = np.cumsum([len(t) for t in texts])
        first = 0
        while first < len(texts):
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + _BYTES_AT_ONCE, "right")))
            yield from self._some(texts[first:last])
            first = last

    def _some(self, texts: list[bytes]) -> np.ndarray:
        tokens = [[w for w in _SPACES.split(t) if w] for t in texts]
        # Texts by falling length: those with a token at a place are always the first ones.
        order = sorted(range(len(tokens)), key=lambda i: -len(tokens[i]))
        lengths = np.array([len(tokens[i]) for i in order])
        sums = np.zeros((len(texts), self._size + 1))
        for place in range(int(lengths[0])):
            if len(self._codes) > _KEPT_TOKENS:
                self._reset()
            holders = order[: int(np.searchsorted(-lengths, -place))]
            codes = [self._code(tokens[i][place]) for i in holders]
            sums[holders] += self._table[codes]
        return sums[:, :-1] / np.maximum(sums[:, -1:], COUNT_FLOOR)


def pool_tokens(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean-pool token rows (keys, dim, value, mask) to (keys, dim, pooled)."""
    total = F.sum(F.col("value") * F.col("mask"))
    count = F.greatest(F.sum(F.col("mask").cast("double")), F.lit(COUNT_FLOOR))
    return rows.groupBy(*keys, "dim").agg((total / count).alias("pooled"))


def reduce_dims(
    df: DataFrame, n_dims: int, vector: str = "embedding", output: str = "reduced"
) -> DataFrame:
    """Append the first principal components of an array column, centred.

    ``n_dims`` is clamped to the width. Each component's sign is chosen so
    that its largest loading is positive.
    """
    width = df.select(F.size(vector).alias("n")).first()
    if width is None:
        return df.withColumn(output, F.lit(None).cast("array<double>"))
    k = min(n_dims, width["n"])
    rows = df.withColumn("_x", array_to_vector(F.col(vector)))
    centred = StandardScaler(inputCol="_x", outputCol="_centred", withMean=True, withStd=False)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pc")
    fitted = Pipeline(stages=[centred, pca]).fit(rows.select("_x"))
    loadings = fitted.stages[1].pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    flip = ElementwiseProduct(inputCol="_pc", outputCol="_signed", scalingVec=Vectors.dense(signs))
    moved = flip.transform(fitted.transform(rows))
    return moved.withColumn(output, vector_to_array(F.col("_signed"))).drop(
        "_x", "_centred", "_pc", "_signed"
    )
