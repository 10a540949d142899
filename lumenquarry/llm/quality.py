"""Quality classifier: ridge over random Fourier features of document statistics, isotonically calibrated (operator 1).

1. Every text gives a fixed vector of statistics (shares of kinds of bytes, word lengths, repetition of words, word
   pairs and lines); neither language, source nor id is among them. They are written once, so texts are read once.
2. Labelled rows outside the held-out fold give means and deviations; a standardised vector z becomes
   sqrt(2 / D) * cos(W z + b), whose inner products approximate a Gaussian kernel.
3. Each partition sums its part of the normal equations, a shuffle adds them cell by cell; the driver solves D equations.
4. A calibration fold of the labelled rows, in fixed bins of the raw score, gives a monotone map by pooling adjacent violators.

All labelled rows of the training folds are used. Null labels and labels other than 0 and 1 are left out; several labels of a
document are rows of their own. Null and empty texts have the statistics of an empty text and a score like any other.
Without usable labels, or with one class only, every score is the training share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import hash_words, held_out, mix, save, text_buffer

DIMENSIONS, SEED, RIDGE, BANDWIDTH, BINS = 160, 20240501, 1e-3, 2.5, 2000
THRESHOLD = 0.7
LINE = np.zeros(256, bool)
LINE[10] = True
#: Kinds of bytes whose shares are statistics, and single marks that are.
KINDS = {
    "lower": [*range(97, 123)], "upper": [*range(65, 91)], "digit": [*range(48, 58)], "space": [32], "line": [10], "other_space": [9, 11, 12, 13], "control": [*range(9), *range(14, 32), 127],
    "stop": [46], "comma": [44], "bang": [33, 63], "quote": [34, 39], "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "bar": [124], "symbol": [35, 36, 37, 38, 42, 43, 61, 64, 92, 94, 95, 96, 126], "dash": [45, 47, 58, 59], "far": [*range(192, 256)],
}
GROUP = np.full(256, len(KINDS), np.int64)
for _i, _bytes in enumerate(KINDS.values()):
    GROUP[_bytes] = _i
STATISTICS = [*KINDS, "log_bytes", "log_words", "word_length", "distinct_words", "most_frequent_word", "distinct_pairs", "repeated_lines", "line_words", "entropy"]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, offsets = text_buffer(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    width = len(KINDS) + 1
    counts = np.zeros((n, width))
    step = 1 << 20
    for at in range(0, len(data), step):
        part = GROUP[data[at : at + step]]
        lo, hi = np.searchsorted(offsets, [at, min(len(data), at + step)], "right") - 1
        hi = min(hi, n - 1)
        own = np.repeat(np.arange(lo, hi + 1), np.diff(np.clip(offsets[lo : hi + 2], at, at + len(part))))
        counts[lo : hi + 1] += np.bincount((own - lo) * width + part, minlength=(hi + 1 - lo) * width).reshape(-1, width)
    share = counts / np.maximum(size, 1)[:, None]
    out[:, : len(KINDS)] = np.sqrt(share[:, : len(KINDS)])
    words, at = hash_words(data, offsets)
    lines, line_at = hash_words(data, offsets, LINE)
    k = len(KINDS)
    for d in range(n):
        w, li = words[at[d] : at[d + 1]], lines[line_at[d] : line_at[d + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            out[d, k + 3 : k + 5] = len(c) / len(w), math.sqrt(c.max() / len(w))
            if len(w) > 1:
                pairs = mix(w[:-1] * np.uint64(3) + w[1:])
                out[d, k + 5] = len(np.unique(pairs)) / len(pairs)
            out[d, k + 2] = min(40.0, (size[d] - counts[d, 3] - counts[d, 4]) / len(w))
            out[d, k + 7] = math.log1p(len(w) / max(1, len(li)))
        if len(li):
            out[d, k + 6] = 1 - len(np.unique(li)) / len(li)
    out[:, k], out[:, k + 1] = np.log1p(size), np.log1p(np.diff(at))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, k + 8] = -np.where(share > 0, share * np.log(np.where(share > 0, share, 1)), 0).sum(1)
    return out


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """key, extra, x (array<double>) of all documents."""
    rows = docs.select(key, *extra, F.col(text).alias("__text"))
    schema = StructType([f for f in rows.schema.fields if f.name != "__text"]).add("x", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = statistics(part.column(part.num_columns - 1))
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], col], names=schema.names)

    return rows.mapInArrow(run, schema)


def fourier(z: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED, bandwidth: float = BANDWIDTH) -> np.ndarray:
    """Random Fourier features of standardised rows, the rows themselves, and a constant."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / bandwidth, (z.shape[1], dimensions)), rng.uniform(0, 2 * np.pi, dimensions)
    z = np.clip(z, -8, 8)
    return np.hstack([math.sqrt(2 / dimensions) * np.cos(z @ w / math.sqrt(z.shape[1] / 8) + b), z / 8, np.ones((len(z), 1))])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(STATISTICS)))


CELLS = StructType([StructField("cell", LongType()), StructField("value", DoubleType())])


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, ridge: float = RIDGE) -> dict | None:
    """A model from rows of x, y (0 or 1) and calibrate (boolean: used for the monotone map, not for the weights)."""
    k = len(STATISTICS)
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_pop))).first()
    if not first.n or first.y in (0.0, 1.0):
        return {"constant": first.y if first.n else 0.5}
    mean, dev = np.array([first[f"avg{i}"] for i in range(k)]), np.array([first[f"stddev_pop{i}"] for i in range(k)])
    dev = np.where(dev > 1e-9, dev, 1.0)
    model = {"mean": mean, "dev": dev, "dimensions": dimensions}

    def normal(batches):
        gram = total = None
        for batch in batches:
            if batch.num_rows:
                f = fourier((_matrix(batch, "x") - mean) / dev, dimensions)
                y = batch.column(batch.schema.get_field_index("y")).to_numpy().astype(float)
                g, t = f.T @ f, f.T @ y
                gram, total = (g, t) if gram is None else (gram + g, total + t)
        if gram is not None:
            cells = np.concatenate([gram[np.triu_indices(len(gram))], total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=CELLS.names)

    own = rows.where(~F.col("calibrate")).select("x", "y")
    sums = own.mapInArrow(normal, CELLS).groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # a fixed number of cells
    width = dimensions + k + 1
    cells = np.zeros(width * (width + 1) // 2 + width)
    cells[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    gram = np.zeros((width, width))
    gram[np.triu_indices(width)] = cells[:-width]
    gram += np.triu(gram, 1).T
    rows_n = max(1.0, gram[-1, -1])
    model["weights"] = np.linalg.solve(gram + np.eye(width) * ridge * rows_n, cells[-width:])
    raw = raw_scores(rows.where("calibrate"), model).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") + 0.5) / 2)).alias("r"), "y")
    bins = raw.groupBy(F.floor(F.col("r") * BINS).alias("bin")).agg(F.avg("r").alias("r"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS + 1 rows at most
    at, value = isotonic([(b.r, float(b.y), float(b.n)) for b in bins])
    model["at"], model["value"] = (at, value) if len(at) else ([0.0, 1.0], [first.y, first.y])
    return model


def isotonic(bins: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Pools adjacent violators of (place, sum, weight) in order of place: knots of a monotone map, a block at its mean place."""
    blocks: list[list[float]] = []
    for r, y, n in bins:
        blocks.append([r * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def raw_scores(rows: DataFrame, model: dict) -> DataFrame:
    """rows (with x) and their uncalibrated score, column raw; x goes."""
    schema = StructType([f for f in rows.schema.fields if f.name != "x"]).add("raw", DoubleType())

    def run(batches):
        for batch in batches:
            raw = fourier((_matrix(batch, "x") - model["mean"]) / model["dev"], model["dimensions"]) @ model["weights"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in schema.names[:-1]), pa.array(raw)], names=schema.names)

    return rows.mapInArrow(run, schema)


def predict(rows: DataFrame, model: dict) -> DataFrame:
    """rows (with x) and score, the calibrated probability of label 1; x goes."""
    if "constant" in model:
        return rows.drop("x").withColumn("score", F.lit(float(model["constant"])))
    scored = raw_scores(rows, model)
    at, value = list(map(float, model["at"])), list(map(float, model["value"]))
    schema = StructType([f for f in scored.schema.fields if f.name != "raw"]).add("score", DoubleType())

    def run(batches):
        for batch in batches:
            r = np.clip((batch.column(batch.num_columns - 1).to_numpy() + 0.5) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.interp(r, at, value))], names=schema.names)

    return scored.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", parts: int = 4, held: int = 2, calibrate: int = 3) -> DataFrame:
    """All of docs: key, held_out, score, predicted. Labels are learned from outside fold `held` of crc32(key as text) modulo parts only;
    fold `calibrate` of them gives the monotone map. A null key counts as held out."""
    fold = held_out(key, parts)
    rows = save(statistics_table(docs.select(key, "text"), key), "quality_statistics")
    usable = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("double").alias("y"))
    usable = usable.where(fold != held)
    training = save(rows.join(usable, key).select("x", "y", (fold == calibrate).alias("calibrate")), "quality_training")
    model = fit(training)
    scored = predict(rows, model)
    return scored.select(key, F.coalesce(fold == held, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
