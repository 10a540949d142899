"""Token-id files: flat unsigned integers, 64-bit document offsets, read through memory maps (operator 7).

A folder holds, for each part, ``part-N.bin`` (the ids, 2 or 4 bytes each, as the vocabulary needs), ``part-N.idx``
(little-endian unsigned 64-bit: where each document begins in the part, and the part's end) and ``part-N.key`` (the
documents' keys, an Arrow stream). Parts are ranges of the key, so all documents together stand in its ascending order
(nulls first, equal keys by text). A part's base is the sum of the ids of the parts before it.

A task writes under a name of its own attempt and renames at its end, so a task that runs twice or dies leaves no harm.
Null texts count as empty: their document is the end id alone. An empty table makes no document.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

CACHED = 900_000
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder; any that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+://?", uri) else (pafs.LocalFileSystem(), uri)


class WordEncoder:
    """Ids of texts by the tokenizers library. Where the tokenizer drops white space, a text's ids are those of its words, and the library sees each word once."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(True) - 1, end_id or 0, *self.tokenizer.get_vocab(True).values()) < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        assert sys.byteorder == "little"  # as the files are
        self.by_word = drops_space(spec)
        self.lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}]))
        self.words, self.pieces = _Words(self), _Pieces(self)

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if m := PLAIN.fullmatch(text):  # letters that have no other form, then marks: two pieces for the splitting pattern
            letters, marks = m.groups()
            if self.lowers:
                letters = letters.lower()
            return self.pieces[letters] + self.pieces[marks] if marks else self.pieces[letters]
        return self.ids(text)

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return self.ids(text)
        if len(self.words) > CACHED:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.encode().split()))


class _Words(dict):
    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        out = self.encoder.word(word)
        if len(word) <= 64:
            self[word] = out
        return out


class _Pieces(dict):
    """Letters alone and marks alone, which many words share."""

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        out = self.encoder.ids(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


def drops_space(spec: dict) -> bool:
    """Whether no token can hold or depend on white space: it is normalised to single spaces first, and a split keeps matches of a pattern that takes none."""
    norm = spec.get("normalizer") or {}
    norms = norm.get("normalizers", [norm])
    pre = spec.get("pre_tokenizer") or {}
    pres = pre.get("pretokenizers", [pre])
    split = pres[0] if pres else {}
    return (
        any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in norms)
        and all(n.get("type") in ("NFC", "Lowercase", "Replace") for n in norms)
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and "\\s" not in split["pattern"].get("Regex", "\\s").replace("[^\\s", "[^")
        and " " not in split["pattern"].get("Regex", " ")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in spec.get("added_tokens", ()))
    )


@lru_cache(2)
def encoder(path: str, end_id: int | None) -> WordEncoder:
    return WordEncoder(path, end_id)


MANIFEST = StructType([StructField("part", IntegerType()), StructField("docs", LongType()), StructField("ids", LongType()), StructField("width", IntegerType())])


def write_token_files(df: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int | None = None, parts: int | None = None) -> DataFrame:
    """Writes the files of all rows of df into folder and returns the manifest: part, docs, ids, width, base."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    storage(folder)[0].create_dir(storage(folder)[1], recursive=True)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, own = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, base = storage(folder)
        enc = encoder(tokenizer, end_id)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        names = {k: f"{base}/part-{part}.{k}" for k in ("bin", "idx", "key")}
        ids = docs = 0
        keys = None
        with fs.open_output_stream(f"{names['bin']}.{own}") as bin_, fs.open_output_stream(f"{names['idx']}.{own}") as idx, fs.open_output_stream(f"{names['key']}.{own}") as key_:
            for batch in batches:
                keys = keys or pa.ipc.new_stream(key_, pa.schema([batch.schema.field(0)]))
                keys.write_batch(batch.select([0]))
                starts = []
                for t in batch.column(1):
                    data = enc.text(t.as_py() or "") + end
                    bin_.write(data)
                    starts.append(ids)
                    ids += len(data) // enc.dtype.itemsize
                docs += len(starts)
                idx.write(np.array(starts, "<u8").tobytes())
            idx.write(np.array([ids], "<u8").tobytes())
            if keys:
                keys.close()
        for name in names.values():
            fs.move(f"{name}.{own}", name) if docs else fs.delete_file(f"{name}.{own}")
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (docs, pa.int64()), (ids, pa.int64()), (enc.dtype.itemsize, pa.int32()))], names=MANIFEST.names)

    found = sorted(rows.mapInArrow(write, MANIFEST).collect())  # a row for each part
    bases = np.cumsum([0, *(r.ids for r in found)]).tolist()
    fs, base = storage(folder)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps([r.asDict() | {"base": b} for r, b in zip(found, bases)]).encode())
    return spark.createDataFrame([(*r, b) for r, b in zip(found, bases)], StructType([*MANIFEST.fields, StructField("base", LongType())]))


def open_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids and offsets of a part, mapped (read whole from a store that can't be mapped), and its keys."""
    fs, base = storage(folder)
    name = f"{base}/part-{part}"
    dtype = f"<u{width}"
    if isinstance(fs, pafs.LocalFileSystem):
        idx = np.memmap(f"{name}.idx", "<u8", "r")
        ids = np.memmap(f"{name}.bin", dtype, "r") if os.path.getsize(f"{name}.bin") else np.zeros(0, dtype)
    else:
        ids, idx = (np.frombuffer(fs.open_input_file(f"{name}.{k}").read(), t) for k, t in (("bin", dtype), ("idx", "<u8")))
    with fs.open_input_file(f"{name}.key") as f:
        keys = pa.ipc.open_stream(f.read()).read_all().column(0).combine_chunks()
    return ids, idx, keys


def read_token_files(spark: SparkSession, folder: str, key: StructField, manifest: DataFrame) -> DataFrame:
    """A row per document: its key, start (ids of all documents before it), n_tokens, and ids_crc32 of its ids as little-endian unsigned 32-bit integers."""
    out = StructType([key, StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, idx, keys = open_part(folder, row["part"], row["width"])
                at = np.asarray(idx).astype(np.int64)
                for i in range(0, len(keys), 4096):
                    k = min(len(keys), i + 4096)
                    crc = [zlib.crc32(ids[at[j] : at[j + 1]].astype("<u4").tobytes()) for j in range(i, k)]
                    yield pa.RecordBatch.from_arrays([keys.slice(i, k - i), pa.array(at[i:k] + row["base"]), pa.array(np.diff(at[i : k + 1])), pa.array(crc, pa.int64())], names=out.names)

    n = manifest.count()
    return manifest.repartition(max(1, n), "part").mapInArrow(read, out)
