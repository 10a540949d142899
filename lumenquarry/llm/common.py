"""What the operators of this subpackage share: tables in the shared folder, Arrow helpers, words and their hashes.

words_of() gives the words themselves, digests() 64 bits of a cryptographic digest of each. hash_words() is for statistics
only, where two words of one hash do no harm: it works in numpy over whole Arrow buffers, and a word's hash is a difference of
running sums of byte values times powers of an odd number (modulo 2**64), which the splitmix finaliser then mixes.
Windows of about a megabyte keep the memory of a task bounded whatever a batch or text holds.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, BATCH = 1 << 20, 2000
POWER, MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, with a local master only, one under /tmp where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints/lumenquarry").rstrip("/")


_kept: list[str] = []  # what save() has written and discard() not deleted


def save(df: DataFrame, name: str) -> DataFrame:
    """df as written Parquet in the shared folder: cuts lineage, and a lost executor loses nothing of it. clear() deletes what is left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(conf).delete(found, True)
    _kept.remove(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of save() that no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, df._written)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators of this process have written and that results may still read: call it when these are done with."""
    for path in [*_kept]:
        _delete(spark, path)


def release() -> None:
    """Gives memory that a task no longer uses back to the system: Python workers live on for other tasks. Call it when a task's own tables are gone."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends Arrow batches of BATCH rows at most: texts of a batch are held by the executor and by its Python worker, twice each."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return df


def shielded(df: DataFrame, use) -> DataFrame:
    """use(df, name) on columns u0, u1, ..., which clash with nothing that an operator adds; name: df's columns to these. What use returns
    begins with the same columns, which get their own names back; others keep theirs."""
    own = [f"u{i}" for i in range(len(df.columns))]
    out = use(df.toDF(*own), dict(zip(df.columns, own)))
    return out.toDF(*df.columns, *out.columns[len(own) :])


def held_out(column: str, parts: int):
    """The fold of a row: crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string")) % parts


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


BREAK = re.compile(rb"[\x09-\x0d\x20]")


def words_of(data: bytes, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, in stretches of about a window (a longer word is whole)."""
    at = 0
    while at < len(data):
        cut = BREAK.search(data, at + window) if at + window < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


class Digests(dict):
    """64 bits of a digest of each word; a bounded memo."""

    MOST, LONGEST = 150_000, 64

    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = out
        return out


def digests(data: bytes, memo: Digests) -> np.ndarray:
    """Digests of the words of a text, in order."""
    parts = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) for words in words_of(data)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(POWER))[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for windows of n bytes (WINDOW at most); only the largest table asked for is kept."""
    size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
    if not (kept := [k for k in _tables if k >= size]):
        _tables.clear()
        _tables[size] = (powers(POWER, size + 1), powers(pow(POWER, -1, 1 << 64), size + 1))
        return _tables[size]
    return _tables[kept[0]]


def hash_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row (A-Z lower-cased; breaks: bytes between words), and the n + 1 offsets of the texts in them.

    Windows are of fixed size; the sum of a word that a window's end cuts goes on into the next, however long the word is."""
    hashes, starts, n = [], [], len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    held, length, begun = np.uint64(0), 0, 0  # of the word cut by the last window's end: sum and bytes so far, start
    for at in range(0, n, WINDOW):
        part = data[at : at + WINDOW]
        end = at + len(part)
        inside, cut = ~breaks[part], edge[at : end + 1]
        first = inside & cut[:-1]
        first[0] |= inside[0]
        first[1:] |= inside[1:] & ~inside[:-1]
        last = inside & cut[1:]
        last[-1] |= inside[-1]
        last[:-1] |= inside[:-1] & ~inside[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[: len(part)], out=sums[1:])
        own, size, start = (sums[e] - sums[s]) * down[s], (e - s).astype(np.uint64), s + at
        if length:
            own[:1] = held + own[:1] * np.uint64(pow(POWER, length, 1 << 64))
            size[0] += np.uint64(length)
            start[0] = begun
            length = 0
        if len(s) and e[-1] == len(part) and end < n and not (edge[end] or breaks[data[end]]):
            held, length, begun = own[-1], int(size[-1]), int(start[-1])
            own, size, start = own[:-1], size[:-1], start[:-1]
        hashes.append(mix(own + size))
        starts.append(start)
    hashes, starts = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (starts, np.int64)))
    return hashes, np.searchsorted(starts, offsets)


def hash_shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, in order; fewer words: the whole sequence as one; none: none. And their n + 1 offsets."""
    count = np.diff(offsets)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(at[-1], np.uint64)
    if len(words) >= k:
        q = np.uint64(POWER)
        run = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            run = run * q + words[i : len(words) - k + 1 + i]
        run = mix(run + np.uint64(k))
        full = np.flatnonzero(count >= k)
        keep = np.repeat(offsets[full] - at[full], each[full]) + np.repeat(at[full], each[full]) + _within(each[full])
        out[np.repeat(at[full], each[full]) + _within(each[full])] = run[keep]
    for d in np.flatnonzero((count > 0) & (count < k)):
        run = 0
        for w in words[offsets[d] : offsets[d + 1]].tolist():
            run = (run * POWER + w) & MASK
        out[at[d]] = mix(np.array([(run + int(count[d])) & MASK], np.uint64))[0]
    return out, at


def _within(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def add_columns(batch: pa.RecordBatch, **new) -> pa.RecordBatch:
    """batch with further columns; one of the same name is replaced."""
    names = [c for c in batch.schema.names if c not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new.values()], names=[*names, *new])
