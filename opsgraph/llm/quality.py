"""Quality classifier: random Fourier features, ridge, isotonic calibration.

* ``statistics(documents)`` computes bounded statistics of each whole text
  (shares of character classes, word lengths, repetition of words and lines).
  Labels, language, source and id are never among them.
* ``fit(stats, labels)`` standardises the statistics, maps them to ``FEATURES``
  random cosines that approximate a Gaussian kernel, sums the normal equations
  inside each partition, adds the partial sums in Spark, and solves the ridge
  system of fixed size on the driver.  Of the labelled rows at most
  ``MAX_TRAIN`` (those with the least hash of the id) are used.
* Calibration: every third training row is kept out of the ridge fit (where these are of
  one class only, as with a few labels, all training rows calibrate); its raw scores are counted in ``CALIBRATION_BINS`` bins and pooled into a monotone step
  function, smoothed by linear interpolation.
* A document whose calibrated score is at least ``THRESHOLD`` is predicted 1.

Defined cases: null and empty texts have zero statistics and get the score that
belongs to them; labels that are null or belong to no document are ignored, of
repeated labels of an id the largest counts; of repeated texts of an id those with the least statistics train; rows
with a null doc_id are scored, not held out and never train; with no label at all, or one class
only, every score is that class' share (0.5 without labels); very long texts are
read whole; repeated rows are scored one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, table
from .textops import chunks, prefix_sums, span_hash, word_spans

FEATURES = 192
GAMMA = 0.15
RIDGE = 1.0
MAX_TRAIN = 200_000
CALIBRATION_BINS = 512
THRESHOLD = 0.3
SEED = 11

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOP, _MARK, _PIPE = range(8)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = _STOP
_CLASS[[ord(c) for c in "|<>{}[]=\\/"]] = _PIPE
NAMES = ("log_bytes", "log_words", "upper", "lower", "digit", "space", "high", "stop", "mark", "pipe", "word_mean", "word_sd", "long_words",
         "short_words", "capital_words", "marked_words", "distinct_words", "top_word", "line_mean", "repeated_lines", "bang", "stop_per_word")


def _statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 8 + _CLASS[buf], minlength=n * 8).reshape(n, 8)
    share = counts / np.maximum(size, 1)[:, None]
    bang = np.bincount(doc[buf == 33], minlength=n)
    start, end, d = word_spans(buf, off)
    words = np.bincount(d, minlength=n)
    per = np.maximum(words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(d, length, n) / per
    sd = np.sqrt(np.maximum(np.bincount(d, length**2, n) / per - mean**2, 0))
    part = lambda mask: np.bincount(d[mask], minlength=n) / per
    kind = _CLASS[buf]
    s = prefix_sums(buf)
    h = span_hash(s, start, end)
    order = np.lexsort((h, d))
    hs, ds = h[order], d[order]
    new = np.ones(len(hs), bool)
    if len(hs):
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    firsts = np.flatnonzero(new)
    often = np.diff(np.append(firsts, len(hs)))
    top = np.zeros(n)
    np.maximum.at(top, ds[firsts], often)
    newline = np.zeros(256, bool)
    newline[10] = True
    ls, le, ld = word_spans(buf, off, newline)
    lines = np.bincount(ld, minlength=n)
    lh = span_hash(s, ls, le)
    order = np.lexsort((lh, ld))
    lh, lds = lh[order], ld[order]
    again = (lh[1:] == lh[:-1]) & (lds[1:] == lds[:-1])
    repeated = np.bincount(lds[1:][again], minlength=n) / np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), *(share[:, k] for k in range(8)), mean, sd, part(length > 12), part(length < 3),
        part(kind[start] == _UPPER) if len(start) else np.zeros(n), part(np.isin(kind[end - 1], (_MARK, _PIPE))) if len(end) else np.zeros(n),
        np.bincount(ds[firsts], minlength=n) / per, top / per, size / np.maximum(lines, 1), repeated, bang / per, counts[:, _STOP] / per])


def statistics(documents: DataFrame) -> DataFrame:
    """``doc_id, row_key, stats array<float>`` of every row, from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(2)):
                stats = _statistics(buf, off).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(NAMES), pa.int32()), pa.array(stats.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["doc_id", "row_key", "stats"])

    return documents.select(F.col("doc_id").cast("long"), row_key(), "text").mapInArrow(run, "doc_id long, row_key long, stats array<float>")


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


class Model:
    """Standardisation, random cosines, ridge weights and the calibration steps; its size is fixed."""

    def __init__(self, mean, scale, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = rng.normal(0, np.sqrt(2 * GAMMA / len(NAMES)), (len(NAMES), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def pool_adjacent(x, weight, positive) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of shares ``positive / weight`` over ascending x: centres and values of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, w, p in zip(x, weight, positive):
        blocks.append([a * w, w, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _normal_equations(train: DataFrame, model: Model) -> np.ndarray:
    """The summed (F + 1) x (F + 2) system of ``features, label``; tasks send one partial sum each, in row blocks."""
    d = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            x = model.features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            total += x.T @ np.column_stack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total))], names=["row", "part"])

    def add(rows: pa.Table) -> pa.Table:
        total = rows.column("part").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, d + 1).sum(axis=0)
        return pa.table({"row": rows.column("row").slice(0, 1), "part": pa.array([total])})

    parts = train.select("stats", "label").mapInArrow(partial, "row int, part array<double>")
    rows = {r["row"]: r["part"] for r in parts.groupBy("row").applyInArrow(add, "row int, part array<double>").collect()}
    return np.array([rows.get(i, [0.0] * (d + 1)) for i in range(d)])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on the rows of ``labels(doc_id, <label>)`` that have statistics; at most about ``max_train`` of them."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    train = stats.groupBy("doc_id").agg(F.min("stats").alias("stats")).join(known, "doc_id")
    n = train.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003))
    if n > max_train:
        train = train.filter(spread < int(1_000_003 * max_train / n))
    train = materialize(train.select("stats", "label", (spread % 3).alias("fold")), "train")
    moments = train.agg(*[f(F.col("stats")[i].cast("double")).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.avg("label").alias("share")).first()
    if moments["share"] is None or moments["share"] in (0.0, 1.0):
        model = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
        model.y = np.array([0.5 if moments["share"] is None else moments["share"]])
        return model
    model = Model([moments[f"m{i}"] for i in range(len(NAMES))], [max(moments[f"s{i}"], 1e-6) for i in range(len(NAMES))])
    system = _normal_equations(train.filter("fold <> 0"), model)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.beta = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.raw(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((x + 1) / 3 * CALIBRATION_BINS, 0, CALIBRATION_BINS - 1).astype(np.int32)), pa.array(x), batch.column(1)], names=["bin", "x", "label"])

    # with one class alone among the rows kept out, all training rows calibrate
    kept = train.filter("fold = 0").agg(F.avg("label")).first()[0]
    out = train if kept in (None, 0.0, 1.0) else train.filter("fold = 0")
    held = out.select("stats", "label").mapInArrow(count, "bin int, x double, label int")
    bins = held.groupBy("bin").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()
    if bins:
        model.x, model.y = pool_adjacent([b["x"] for b in bins], [b["n"] for b in bins], [b["p"] for b in bins])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, row_key, score, predicted`` of every row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "row_key", "score", "predicted"])

    return stats.select("doc_id", "row_key", "stats").mapInArrow(run, "doc_id long, row_key long, score double, predicted int")


def held_out(doc_id):
    """Whether a row is held out by its id; one without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, row_key``; learns only from rows that are not held out."""
    stats = materialize(statistics(documents), "statistics")
    model = fit(stats, labels.filter(~held_out(F.col("doc_id"))))
    return score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "row_key")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are predicted 1, unchanged; rows of one doc_id with other texts are judged apart."""
    poor = classify(documents, labels).filter("predicted = 0").select(F.col("row_key").alias("__poor")).distinct()
    return documents.join(poor, row_key() == F.col("__poor"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
