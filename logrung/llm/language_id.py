"""Language identification by interpolated Kneser-Ney character models.

One model of character 4-grams for each language, kept as sorted hash arrays in
a file that workers map into memory. A text goes to the language with the
lowest cross-entropy per character; texts that no model explains as well as it
explains its own held-back texts are rejected.

A character is a lower-cased letter in 16 bits; runs of anything else are one
boundary. Four characters fill 64 bits, so the hash of a 4-gram is a bijection
and has no collisions. Letters beyond the basic plane share one code.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logrung.llm.draws import RANGE, draw, share
from logrung.llm.encode import free_encoders, give_back_memory, giving_back
from logrung.llm.files import attempt_name, open_for_reading, open_for_writing, shared_folder
from logrung.llm.text_stats import fold_of
from logrung.llm.words import mix64, text_slices
from logrung.session import landed

ORDER = 4
#: Bound of the training texts of a language; all of them below it.
TEXTS_PER_LANGUAGE = 4000
#: One training text in so many calibrates the rejection instead of being counted.
CALIBRATION_SHARE = 8
#: Fewer calibration texts than this say too little; all texts of such a language are counted, and cross-fitted.
LEAST_CALIBRATION = 10
#: Cross-fits leave out one piece in so many, of texts cut to so many characters.
CROSS_FITS = 4
PIECE = 400
#: Characters beyond which more text makes a cross-entropy no surer.
_SURE = 400
#: One nat for each character of a long text, more for shorter ones; texts in several languages stay.
LEAST_LIMIT = 20.0
UNKNOWN = "und"


@cache
def _code_table() -> np.ndarray:
    """Code point of the basic plane -> lower-cased letter, 0 for anything else."""
    table = np.zeros(1 << 16, np.uint16)
    for point in range(1 << 16):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 and ord(lower) < 1 << 16 else point
    return table


def char_codes(text: str) -> np.ndarray:
    """Codes of a text: three boundaries, the letters, a last boundary; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _code_table()[np.minimum(points, 0xFFFF)].astype(np.uint64)
    if len(points) and points.max() > 0xFFFF:
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            codes[i] = 0xFFFF if unicodedata.category(chr(points[i]))[0] == "L" else 0
    letter = codes != 0
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inner = codes[keep]
    return np.concatenate(([0] * (ORDER - 1), inner[np.argmax(inner != 0) :], [0] * int(inner[-1] != 0))).astype(np.uint64)


def four_grams(text: str | None) -> np.ndarray:
    """The packed 4-gram that ends at each letter or boundary of a text."""
    c = char_codes(text) if text else np.zeros(0, np.uint64)
    if not len(c):
        return c
    s16, s32, s48 = np.uint64(16), np.uint64(32), np.uint64(48)
    return (c[:-3] << s48) | (c[1:-2] << s32) | (c[2:-1] << s16) | c[3:]


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1) if order < 4 else keys


def _hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return mix64(keys ^ np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class KneserNey:
    """Sorted hash arrays of one language: log probabilities of seen n-grams, log weights of histories."""

    def __init__(self, floor: float, grams: list[tuple], histories: list[tuple], mean: float, limit: float):
        self.floor, self.grams, self.histories = floor, grams, histories
        self.mean, self.limit = mean, limit

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
        """From distinct 4-grams and their counts; lower orders use continuation counts."""
        grams, histories = [], []
        levels = [(keys, counts)]
        for order in (3, 2, 1):
            # How many longer n-grams end in this one.
            levels.append(np.unique(_suffix(levels[-1][0], order), return_counts=True))
        floor = 1.0 / alphabet
        lower_keys, lower_p = None, None
        for order, (k, c) in zip((1, 2, 3, 4), reversed(levels), strict=True):
            once, twice = int((c == 1).sum()), int((c == 2).sum())
            discount = once / (once + 2 * twice) if once else 0.5
            history = k >> np.uint64(16)
            own, at = np.unique(history, return_inverse=True)
            total, kinds = np.bincount(at, c, len(own)), np.bincount(at, minlength=len(own))
            weight = discount * kinds / total
            if order == 1:
                back = np.full(len(k), floor)
            else:
                back = lower_p[np.searchsorted(lower_keys, _suffix(k, order - 1))]
            p = np.maximum(c - discount, 0) / total[at] + weight[at] * back
            for store, x, v in ((grams, k, p), (histories, own, weight)):
                h = _hashed(x, order)
                sort = np.argsort(h)
                store.append((h[sort], np.log(v[sort]).astype(np.float32)))
            lower_keys, lower_p = k, p
        return KneserNey(float(np.log(floor)), grams, histories, 0.0, np.inf)

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, values[at]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each 4-gram after the other three."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for order in (4, 3, 2, 1):
            k = _suffix(keys[open_], order)
            seen, value = self._look(self.grams[order - 1], _hashed(k, order))
            out[open_[seen]] += value[seen]
            open_, k = open_[~seen], k[~seen]
            if not len(open_):
                return out
            known, weight = self._look(self.histories[order - 1], _hashed(k >> np.uint64(16), order))
            out[open_[known]] += weight[known]
        out[open_] += self.floor
        return out


def _entropies(texts: pa.Array, models: list[KneserNey]) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy of each text under each model, characters of each text), a slice of the texts at a time."""
    out, sizes = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64)
    for first, last in text_slices(texts):
        parts = [four_grams(t) for t in texts.slice(first, last - first).to_pylist()]
        lengths = np.array([len(p) for p in parts])
        sizes[first:last] = lengths
        keys = np.concatenate(parts)
        if len(keys):
            codes, distinct = pd.factorize(keys)
            filled = np.flatnonzero(lengths)
            begins = (np.cumsum(lengths) - lengths)[filled]
            for j, model in enumerate(models):
                sums = np.add.reduceat(model.log_p(distinct)[codes], begins)
                out[first + filled, j] = -sums / lengths[filled]
    return out, sizes


def _surprise(entropy: np.ndarray, mean: float, sizes: np.ndarray) -> np.ndarray:
    """How far a cross-entropy lies above a model's usual one, in units that allow for short texts."""
    return (entropy - mean) * np.sqrt(np.minimum(np.maximum(sizes, 1), _SURE))


_MODEL = pa.schema(
    [
        ("lang", pa.string()),
        ("kind", pa.string()),
        ("order", pa.int32()),
        ("keys", pa.list_(pa.uint64())),
        ("values", pa.list_(pa.float32())),
        ("numbers", pa.list_(pa.float64())),
    ]
)


def _save(models: dict[str, KneserNey], path: str) -> None:
    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))

    with open_for_writing(path) as out, pa.ipc.new_file(out, _MODEL) as writer:
        for lang, m in models.items():
            for kind, tables in (("gram", m.grams), ("history", m.histories)):
                for order, (keys, values) in enumerate(tables, 1):
                    row = [[lang], [kind], pa.array([order], pa.int32()), lists(keys), lists(values)]
                    row.append(pa.array([[m.floor, m.mean, m.limit]], pa.list_(pa.float64())))
                    writer.write_batch(pa.record_batch([pa.array(x) if isinstance(x, list) else x for x in row], schema=_MODEL))


@cache
def _load(path: str) -> tuple[list[str], list[KneserNey]]:
    """Models of a file; their arrays are views of the mapping."""
    found: dict[str, KneserNey] = {}
    if path:
        with open_for_reading(path) as source:
            table = pa.ipc.open_file(source).read_all()
        for batch in table.to_batches():
            lang, kind = batch["lang"][0].as_py(), batch["kind"][0].as_py()
            floor, mean, limit = batch["numbers"][0].as_py()
            model = found.setdefault(lang, KneserNey(floor, [], [], mean, limit))
            pair = tuple(batch[c][0].values.to_numpy() for c in ("keys", "values"))
            (model.grams if kind == "gram" else model.histories).append(pair)
    langs = sorted(found)
    return langs, [found[x] for x in langs]


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, key, n): 4-gram counts of all given texts, summed in each task's batches before the shuffle."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(four_grams(text))
            for lang, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                    names=["lang", "key", "n"],
                )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, texts_per_language: int = TEXTS_PER_LANGUAGE) -> str:
    """Fit a model for each language of the rows that ``learn`` marks; returns the model file.

    Rows with null text or language take no part. Of a language with more
    texts than ``texts_per_language`` a share of about that many is drawn by a
    hash of the id and text; that bounds the model. Counts are summed by Spark;
    the driver sees distinct 4-grams of the bounded sample. Without any usable
    row the file name is empty and every text is ``und``.
    """
    spark = docs.sparkSession
    usable = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), F.col("doc_id").alias("doc_id")
    )
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ""
    # The text draws too, so that rows of one repeated id are not drawn or left as one.
    below = F.lit(RANGE)
    for lang, n in sizes.items():
        if n > texts_per_language:
            below = F.when(F.col("lang") == lang, share(texts_per_language, n)).otherwise(below)
    sample = landed(
        usable.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(CALIBRATION_SHARE)) == 0)
        .where(draw("doc_id", "text", F.lit(11)) < below)
        .select("lang", "text", "calibrates"),
        "language-sample",
    )
    lettered = F.col("text").rlike(r"\p{L}")
    calibrating = {
        r.lang: r.n for r in sample.groupBy("lang").agg(F.count_if(F.col("calibrates") & lettered).alias("n")).collect()
    }
    small = F.col("lang").isin([x for x, n in calibrating.items() if n < LEAST_CALIBRATION])
    counts = _gram_counts(sample.where(~F.col("calibrates") | small)).toPandas()
    if not len(counts):
        return ""
    keys = counts["key"].to_numpy().view(np.uint64)
    alphabet = len(np.unique(_suffix(keys, 1))) + 1
    models = _built(counts, alphabet)
    pieces = _pieces(sample.where(small))
    fits, unsure = _cross_fits(_gram_counts(pieces).toPandas(), alphabet)
    folder = shared_folder(spark, "language-models")
    draft = attempt_name(folder, "draft", ".arrow")
    _save(models | fits, draft)
    whole = sample.where(F.col("calibrates") & ~small).select("lang", F.col("lang").alias("model"), "text")
    held = pieces.select(F.split_part("lang", F.lit("\x00"), F.lit(1)).alias("lang"), F.col("lang").alias("model"), "text")
    _calibrate(models, whole.unionByName(held), draft, unsure)
    path = attempt_name(folder, "models", ".arrow")
    _save(models, path)
    return path


def _built(counts: pd.DataFrame, alphabet: int) -> dict[str, KneserNey]:
    """A model for each name in ``lang`` of (lang, key, n)."""
    models = {}
    for lang, own in counts.groupby("lang", sort=True):
        keys, n = own["key"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(keys)
        models[lang] = KneserNey.build(keys[order], n[order], alphabet)
    return models


def _pieces(texts: DataFrame) -> DataFrame:
    """(lang, text): texts in pieces, the language followed by the number of the cross-fit that leaves the piece out.

    Copies of a text are left out together.
    """
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PIECE).cast("int"))
    cut = texts.select("lang", "text", F.explode(starts).alias("i"))
    fit = F.pmod(F.xxhash64("text") + F.col("i"), F.lit(CROSS_FITS)).cast("string")
    return cut.select(
        F.concat("lang", F.lit("\x00"), fit).alias("lang"), F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("text")
    )


def _cross_fits(counts: pd.DataFrame, alphabet: int) -> tuple[dict[str, KneserNey], set[str]]:
    """Models of each language by all pieces but those of one number, under the name that these pieces have.

    Also the languages whose pieces all have one number: their model has counted the pieces it is measured on.
    """
    fits, unsure = {}, set()
    for lang, own in counts.groupby(counts["lang"].str.partition("\x00")[0] if len(counts) else "lang"):
        names = own["lang"].unique()
        if len(names) == 1:
            unsure.add(lang)
        for name in names:
            others = own[(own["lang"] != name) | (len(names) == 1)].groupby("key", as_index=False)["n"].sum()
            fits |= _built(others.assign(lang=name), alphabet)
    return fits, unsure


def _calibrate(models: dict[str, KneserNey], texts: DataFrame, path: str, unsure: set[str]) -> None:
    """Set each model's usual cross-entropy and the surprise above which a text is rejected.

    Measured on texts (lang, model, text) of its own language that the named
    model has not counted. The limit is twice what all but one in a thousand
    of them stay below, and no less than LEAST_LIMIT where few texts say
    little about the rest. A language with too few of them, or one of
    ``unsure``, takes the largest limit and at least the largest usual
    cross-entropy of the others; LEAST_LIMIT and its own where there is no other.
    """

    @giving_back
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(zip(*_load(path), strict=True))
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(names.tolist()) & own.keys()):
                rows = pa.array(np.flatnonzero(names == name))
                found, sizes = _entropies(batch.column(2).take(rows), [own[name]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(found[:, 0]), pa.array(sizes)], names=["lang", "entropy", "size"]
                )

    rows = texts.select("lang", "model", "text").mapInArrow(measure, "lang string, entropy double, size long").toPandas()
    rows = rows[rows["size"] > 0]
    open_ = []
    for lang, model in models.items():
        own = rows[rows["lang"] == lang]
        if len(own):
            model.mean = float(np.average(own["entropy"], weights=np.minimum(own["size"], _SURE)))
        if len(own) < LEAST_CALIBRATION or lang in unsure:
            open_.append(model)
            continue
        surprise = _surprise(own["entropy"].to_numpy(), model.mean, own["size"].to_numpy())
        model.limit = max(2 * float(np.quantile(surprise, 0.999)), LEAST_LIMIT)
    known = [m for m in models.values() if np.isfinite(m.limit)]
    for model in open_:
        model.limit = max((m.limit for m in known), default=LEAST_LIMIT)
        model.mean = max([model.mean, *(m.mean for m in known)])


PREDICTION = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("cross_entropy", T.DoubleType()),
    ]
)


def predictor(path: str):
    """A column function of a text: its language, a score, and whether the model accepts it.

    The score is the share of the chosen language when each language weighs
    exp(-cross-entropy x characters), characters counted up to a few words.
    Null texts and texts without a letter are ``und`` with score 0 and are not
    accepted. Equal cross-entropies go to the language that sorts first.
    """

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        free_encoders()
        langs, models = _load(path)
        found, sizes = _entropies(texts, models)
        give_back_memory(cycles=False)
        n = len(sizes)
        if not langs:
            blank = [UNKNOWN] * n
            return pa.StructArray.from_arrays(
                [pa.array(blank, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.float64())],
                names=PREDICTION.names,
            )
        best = np.argmin(found, axis=1)
        entropy = found[np.arange(n), best]
        gap = (found - entropy[:, None]) * np.minimum(sizes, 20)[:, None]
        score = 1 / np.exp(-gap).sum(axis=1)
        mean, limit = np.array([m.mean for m in models]), np.array([m.limit for m in models])
        lettered = sizes > 0
        accepted = lettered & (_surprise(entropy, mean[best], sizes) <= limit[best])
        names = np.array(langs, object)[best]
        names[~lettered] = UNKNOWN
        return pa.StructArray.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array(np.where(lettered, score, 0.0)),
                pa.array(accepted),
                pa.array(entropy, mask=~lettered),
            ],
            names=PREDICTION.names,
        )

    return predict


def training_rows(doc_id: Column, folds: int = 4, held_out: int = 2) -> Column:
    """All folds but ``held_out``."""
    return fold_of(doc_id, folds) != held_out


def language_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row.

    Row-local after the fit: repeated rows get the same answer, an empty table
    gives no rows.
    """
    learn = training_rows(F.col("doc_id"))
    path = train(docs, learn)
    found = docs.select("doc_id", (~learn).alias("held_out"), predictor(path)(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")


def accepted_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language some model accepts; other columns pass through whatever their names."""
    path = train(docs, training_rows(F.col("doc_id")))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        predictor(path)(F.col("text").cast("string")).alias("found"),
    )
    return whole.where("found.accepted").select("row.*")
