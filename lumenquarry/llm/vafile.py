"""Exact top-k search by inner product over a vector-approximation file (operator 5).

*File.* One Parquet table in the shared folder holds a row number, the id, the approximation and, as a column of its own, the exact
vector of whole components floor(256 * x). The approximation is one byte a component: the component shifted right by the vector's
own `shift`, so that `bits` bits are left. A cell's lower and upper ends follow from it: low and low + 2**shift - 1.

*Scan.* Queries come in blocks of at most about `block`; for each, the columns of the approximation are scanned once, and the exact
vectors aren't read. One matrix product gives the inner product with the low ends; the sums of a query's positive and negative parts
widen it to an upper and a lower bound of the score. The kth largest lower bound is a floor for the kth score; what has an upper
bound below it is out. Floors start from the first cells of the file (any k rows give a valid floor), rise over a task's batches,
and are joined over all tasks. Of rows with equal vectors (128 bits of a digest) only the k smallest ids can be among the best k,
so a vector that very many rows share makes k candidates a task.

*Reading.* Exact vectors of a query's candidates are read in order of falling upper bound (a distance's rising lower bound), by row
number, in rounds that grow eightfold, until the kth score found is above the upper bounds that are left. Scores of equal size go to
the smaller id, so bounds equal to the kth score are still read.

Vectors that are null or hold null or non-finite components take no part; vectors of different lengths aren't compared.
A component of which 256 * x is beyond a double counts as non-finite. Components are whole numbers held in doubles, without limit;
bounds beyond a double's integers are widened by their error, and products beyond them worked out in integers of any length. Scores
are decimals of 38 digits (at their ends beyond), which cover 58-bit components of 1,024 dimensions. Rows with a null id take no
part. Repeated ids are rows of their own, as queries too (query_id names both lists); a query skips all candidates of its own id.
"""

from __future__ import annotations

from decimal import Decimal
from hashlib import blake2b
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from .common import discard, save

BLOCK, SEED = 2048, 4096
FILE = "at long, vec_id long, n int, shift int, cells binary, digest binary, v array<double>"
NEAR = "ask long, at long, vec_id long, lower double, upper double, digest binary"
FOUND = StructType([StructField("ask", LongType()), StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DecimalType(38, 0))])
LIMIT = 10**38 - 1


def integers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>, whole numbers): the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * 256)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  doubles beyond are whole
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrices(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch by their length: their places in it, and themselves."""
    size = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(size)))
    out = []
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        out.append((own, flat[at[own][:, None] + np.arange(n)[None, :]].reshape(len(own), n)))
    return out


def _exact(queries: np.ndarray, rows: np.ndarray) -> bool:
    """Whether sums of products stay within a double's integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    return most < 2**53


def _scores(queries: np.ndarray, rows: np.ndarray) -> list[int]:
    """The inner product of each query with the row of the same place."""
    if _exact(queries, rows):
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64).tolist()
    return [sum(map(mul, map(int, q), map(int, row))) for q, row in zip(queries.tolist(), rows.tolist())]


def cells_of(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shift, and its cells, a byte a component (bits: 8 at most)."""
    top = np.frexp(np.abs(rows).max(axis=1, initial=0))[1]  # the bit length of the largest component
    shift = np.maximum(0, top + 1 - bits)
    return shift, np.floor(np.ldexp(rows, -shift[:, None])).astype(np.int8)


def _binaries(data: np.ndarray) -> pa.Array:
    n, width = data.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The values of a binary column, all of one width, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _approximate(bits: int):
    def run(batches):
        for batch in batches:
            for own, rows in _matrices(batch.column(2)):
                shift, cells = cells_of(rows, bits)
                digest = np.frombuffer(b"".join(blake2b(r, digest_size=16).digest() for r in np.ascontiguousarray(rows)), np.uint8).reshape(-1, 16)
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(own), rows.shape[1], np.int32)), pa.array(shift.astype(np.int32)), _binaries(cells), _binaries(digest), part.column(2)], names=["at", "vec_id", "n", "shift", "cells", "digest", "v"])

    return run


def approximate(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", bits: int = 7) -> DataFrame:
    """The vector-approximation file of a table, written to the shared folder."""
    rows = integers(vectors, key, vector).select(F.monotonically_increasing_id().alias("at"), "vec_id", "v")
    return save(rows.mapInArrow(_approximate(bits), FILE), "vector_cells")


def bounds(queries: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of the score of every query with every cell's vector."""
    low = np.ldexp(cells.astype(np.float64), shift[:, None])
    wide = np.ldexp(1.0, shift) - 1
    with np.errstate(over="ignore", invalid="ignore"):
        base = queries @ low.T
        lower, upper = base + np.minimum(queries, 0).sum(axis=1)[:, None] * wide, base + np.maximum(queries, 0).sum(axis=1)[:, None] * wide
        ends = np.maximum(np.abs(low), np.abs(low + wide[:, None]))
        if not _exact(queries, 2 * ends):  # sums beyond a double's integers: widen by their error
            error = (np.abs(queries) @ ends.T) * (2.0**-50 * max(8, low.shape[1]))
            lower, upper = np.nan_to_num(lower - error, nan=-np.inf, posinf=-np.inf, neginf=-np.inf), np.nan_to_num(upper + error, nan=np.inf, posinf=np.inf, neginf=np.inf)
    return lower, upper


class Candidates:
    """What can still be among the best k of queries of one length; floors: scores that k rows reach for certain."""

    MOST = 1 << 18

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors.copy()
        self.parts, self.size = [], 0

    def add(self, at: np.ndarray, ids: np.ndarray, cells: np.ndarray, shift: np.ndarray, digest: np.ndarray) -> None:
        for a in range(0, len(ids), 4096):
            b = a + 4096
            for c in range(0, len(self.ids), 512):
                d = c + 512
                lower, upper = bounds(self.queries[c:d], cells[a:b], shift[a:b])
                other = ids[a:b][None, :] != self.ids[c:d][:, None]
                if other.shape[1] >= self.k:  # what k cells of these alone reach
                    at_least = np.where(other, lower, -np.inf)
                    self.floors[c:d] = np.maximum(self.floors[c:d], np.partition(at_least, other.shape[1] - self.k, axis=1)[:, other.shape[1] - self.k])
                j, i = np.nonzero(other & (upper >= self.floors[c:d, None]))
                self.parts.append((j + c, at[a:b][i], ids[a:b][i], lower[j, i], upper[j, i], digest[a:b][i]))
                self.size += len(j)
                if self.size > self.MOST:
                    self.shrink()
                    self.MOST = max(self.MOST, 2 * self.size)

    def shrink(self) -> tuple[np.ndarray, ...]:
        """Of equal vectors the k smallest ids, of these what reaches the floors, which rise."""
        parts = self.parts or [(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0), np.zeros(0), np.zeros((0, 2), np.int64))]
        found = tuple(map(np.concatenate, zip(*parts)))
        j, _, ids, _, _, digest = found
        found = tuple(x[self._first(np.lexsort((ids, digest[:, 1], digest[:, 0], j)), j, digest[:, 0], digest[:, 1])] for x in found)
        j, lower = found[0], found[3]
        by = np.lexsort((-lower, j))
        place = _places(j[by])
        kth = by[place == self.k - 1]
        self.floors[j[kth]] = np.maximum(self.floors[j[kth]], lower[kth])
        near = found[4] >= self.floors[j]
        found = tuple(x[near] for x in found)
        self.parts, self.size = [found], len(found[0])
        return found

    def _first(self, by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        return by[_places(*(x[by] for x in keys)) < self.k]


def _places(*keys: np.ndarray) -> np.ndarray:
    """The place of each element in its stretch of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)


def _scan(sets: dict[int, Candidates], batches) -> None:
    """Passes batches of the approximation: at, vec_id, n, shift, cells, digest."""
    for batch in batches:
        at, ids, size, shift = (batch.column(i).to_numpy() for i in range(4))
        for n in np.unique(size):
            if n in sets:
                own = np.flatnonzero(size == n)
                part = batch.take(pa.array(own))
                sets[n].add(at[own], ids[own], _bytes(part.column(4), n).view(np.int8), shift[own], _bytes(part.column(5), 16).view(np.int64))


def _scanner(sent, k: int):
    def run(batches):
        sets = {n: Candidates(ids, queries, k, floors) for n, (_, ids, queries, floors) in sent.value.items()}
        _scan(sets, batches)
        for n, s in sets.items():
            j, at, ids, lower, upper, digest = s.shrink()
            if len(j):
                yield pa.RecordBatch.from_arrays([*map(pa.array, (sent.value[n][0][j], at, ids, lower, upper)), _binaries(digest.view(np.uint8))], names=["ask", "at", "vec_id", "lower", "upper", "digest"])

    return run


def _reader(sent):
    """ask, vec_id, v to scores."""

    def run(batches):
        place = {int(a): (n, i) for n, (asks, _, _, _) in sent.value.items() for i, a in enumerate(asks)}
        for batch in batches:
            asks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own, rows in _matrices(batch.column(2)):
                _, q_ids, queries, _ = sent.value[rows.shape[1]]
                i = np.array([place[int(a)][1] for a in asks[own]], np.int64)
                scores = pa.array([Decimal(max(-LIMIT, min(LIMIT, x))) for x in _scores(queries[i], rows)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(asks[own]), pa.array(q_ids[i]), pa.array(ids[own]), scores], names=["ask", "query_id", "vec_id", "score"])

    return run


def _block(file: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """The best k rows of the file for each query of a block, written."""
    spark = file.sparkSession
    groups: dict[int, list] = {}
    for x in asked.combine_chunks().to_batches():
        for own, rows in _matrices(x.column(2)):
            groups.setdefault(rows.shape[1], []).append((x.column(0).to_numpy()[own], x.column(1).to_numpy()[own], rows))
    sets = {n: tuple(map(np.concatenate, zip(*parts))) for n, parts in groups.items()}
    cells = file.select("at", "vec_id", "n", "shift", "cells", "digest")
    seeds = {n: Candidates(ids, queries, k) for n, (_, ids, queries) in sets.items()}
    _scan(seeds, cells.limit(SEED).toArrow().to_batches())
    for s in seeds.values():
        s.shrink()
    sent = spark.sparkContext.broadcast({n: (*x, seeds[n].floors) for n, x in sets.items()})
    near = save(cells.mapInArrow(_scanner(sent, k), NEAR), "vector_near")
    by = Window.partitionBy("ask")
    lower = near.withColumn("place", F.row_number().over(by.orderBy(F.desc("lower")))).where(F.col("place") <= k)
    floors = lower.groupBy("ask").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    few = near.withColumn("same", F.row_number().over(Window.partitionBy("ask", "digest").orderBy("vec_id", "at"))).where(F.col("same") <= k)
    few = few.join(floors, "ask").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    listed = save(few.withColumn("place", F.row_number().over(by.orderBy(F.desc("upper"), "at"))).select("ask", "at", "vec_id", "upper", "place"), "vector_listed")
    discard(near)
    best, done, upto = save(spark.createDataFrame([], FOUND), "vector_found"), 0, max(4 * k, 16)
    left = listed
    while not left.isEmpty():
        wanted = left.where(F.col("place") <= upto).select("ask", "at", "vec_id")
        scored = wanted.join(file.select("at", "v"), "at").select("ask", "vec_id", "v").mapInArrow(_reader(sent), FOUND)
        new = save(best.unionAll(scored).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).drop("rank"), "vector_found")
        discard(best)
        best, done, upto = new, upto, upto * 8
        # certain where the kth score is above every bound left; a bound is compared a little above itself, as the decimal may round it
        kth = best.groupBy("ask").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("kth"))
        left = listed.where(F.col("place") > done).join(kth, "ask").where(F.col("kth").isNull() | (F.col("upper") + F.abs("upper") * 1e-15 >= F.col("kth") - F.abs("kth") * 1e-15)).drop("kth")
    discard(listed)
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, bits: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k rows of vectors with the largest scores."""
    spark = vectors.sparkSession
    file = approximate(vectors, key, vector, bits)
    asked = save(integers(queries, key, vector).select(F.monotonically_increasing_id().alias("ask"), "vec_id", "v"), "vector_queries")
    blocks = max(1, -(-asked.count() // block))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == b).toArrow()  # about `block` rows
        if own.num_rows:
            found.append(_block(file, own, k))
    discard(file, asked)
    out = spark.read.schema(FOUND).parquet(*(x._written for x in found)) if found else spark.createDataFrame([], FOUND)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.select("query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score")
