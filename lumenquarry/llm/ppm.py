"""Language-model scoring by prediction by partial matching (operator 10).

The model is a byte-context trie of order 4. A document is its UTF-8 bytes and one end symbol (0xFF, which UTF-8 never
uses), before it stand four 0xFE. With counts c(s) of the d symbols seen n times in all after a context, a symbol has
c(s) / (n + d) and escape has d / (n + d) (estimate C). After an escape the symbols of the longer context are excluded from
the shorter one; they are a subset of its symbols, so one sum for each context tells what they take away. After order 0
come the symbols never seen, all alike, of 256.

*Pretrained.* Each task counts its five-byte runs and words (by what they are, not by a hash), one shuffle adds the counts, so
what is learned covers every training document. Shorter contexts' counts are sums of the longest ones'. One pass over the texts
scores all runs and words that are among the `held` most frequent of training (their probabilities, sent to all tasks: the bound is
checked); what a text holds besides goes, counted by text, through a shuffle: words meet the table of all words, distinct runs
the trie of their block, and the sums go back to the text's row. All contexts that a chain of escapes visits, down to order 2,
end in the same two bytes, so runs are dealt into blocks by those: about `block` runs each, at most 2**24 where two bytes have
more; orders 1 and 0 have 65,536 and 256 cells. The number of passes doesn't depend on what was learned.

*Adaptive.* `adaptive_bits` learns from the text itself as it goes, starting from nothing.

Null and empty texts are the end symbol alone. Without training documents every symbol has 1/256.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, DoubleType, LongType, StructField, StructType

from .common import WINDOW, discard, held_out, release, save, text_buffer, words_of

ORDER, START, END = 4, 0xFE, 0xFF
BLOCK = 500_000
HELD_RUNS, HELD_WORDS = 1 << 21, 300_000  # sent to all tasks at most
OPEN = 1_500_000  # runs that a task counts before it puts them together
LONGEST = 64


def runs(data: np.ndarray, offsets: np.ndarray):
    """Codes of the five-byte runs that end in each byte and end of the texts, a window at a time: (codes, text numbers)."""
    n = len(data)
    count = len(offsets) - 1
    for at in range(0, n, WINDOW):
        end = min(n, at + WINDOW)
        code = data[at:end].astype(np.uint64)
        first, last = np.searchsorted(offsets, [at, end], "right") - 1
        own = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], at, end))) if last < count else np.repeat(np.arange(first, count), np.diff(np.clip(offsets[first:], at, end)))
        since = np.arange(at, end) - offsets[own]
        for k in range(1, ORDER + 1):
            back = np.full(end - at, START, np.uint64)
            lo = max(0, k - at)
            back[lo:] = data[at + lo - k : end - k]
            back[since < k] = START
            code |= back << np.uint64(8 * k)
        yield code, own
    size = np.diff(offsets)
    code = np.full(count, END, np.uint64)
    for k in range(1, ORDER + 1):
        back = np.full(count, START, np.uint64)
        has = size >= k
        back[has] = data[offsets[1:][has] - k]
        code |= back << np.uint64(8 * k)
    yield code, np.arange(count)


class _Counts:
    """Sums by key, put together whenever OPEN more have come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > OPEN:
            self.merge()

    def full(self) -> bool:
        return bool(self.parts) and len(self.parts[0][0]) > 2 * OPEN

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts = [_sums(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        self.size = 0
        return self.parts[0]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def word_key(word: bytes) -> bytes:
    """A word itself; of a long one a space, which no word holds, and its sha256."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def _texts(column: pa.Array):
    for at in range(0, len(column), 256):
        for text in column.slice(at, 256).cast(pa.large_binary()):
            yield text.as_py() or b""


COUNTS = StructType([StructField("kind", ByteType()), StructField("key", LongType()), StructField("word", BinaryType()), StructField("n", LongType())])
RUN, WORD, DOCS = 0, 1, 2


def count_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts over all texts: five-byte runs (kind 0, by key), words (1, by word_key), documents (2)."""

    def run(batches):
        grams, words, n = _Counts(), Counter(), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for code, _ in runs(data, offsets):
                grams.add(code)
                if grams.full():  # the shuffle adds
                    yield from _rows(RUN, *grams.merge())
                    grams = _Counts()
            for t in _texts(batch.column(0)):
                for part in words_of(t):
                    words.update(part)
                if len(words) > HELD_WORDS:
                    yield from _word_rows(words)
                    words.clear()
            n += batch.num_rows
        yield from _rows(RUN, *grams.merge())
        yield from _word_rows(words)
        yield from _rows(DOCS, np.zeros(1, np.uint64), np.array([n]))
        del grams, words
        release()

    return docs.select(text).mapInArrow(run, COUNTS).groupBy("kind", "key", "word").agg(F.sum("n").alias("n"))


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray):
    for i in range(0, len(keys), 1 << 18):
        k = keys[i : i + (1 << 18)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(counts[i : i + len(k)].astype(np.int64))], names=COUNTS.names)


def _word_rows(words: Counter):
    items = iter(words.items())
    while part := list(islice(items, 1 << 16)):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), WORD, np.int8)), pa.array(np.zeros(len(part), np.int64)), pa.array([word_key(w) for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=COUNTS.names)


class Trie:
    """Counts of one block of contexts (orders 2 to ORDER), and the fixed tables of orders 1 and 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.pairs = pairs  # of orders 1 and 0: counts by byte and symbol
        self.orders = {}
        lower = None
        for k in range(2, ORDER + 1):
            g, c = _sums(keys & np.uint64((1 << 8 * (k + 1)) - 1), counts)
            ctx = g >> np.uint64(8)
            at = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(g) else np.zeros(0, np.int64)
            if lower is None:
                short = pairs[(g >> np.uint64(8) & np.uint64(255)).astype(np.int64), (g & np.uint64(255)).astype(np.int64)].astype(np.float64)
            else:
                short = lower[1][np.searchsorted(lower[0], g & np.uint64((1 << 8 * k) - 1))].astype(np.float64)
            add = lambda x, at=at: np.add.reduceat(x, at) if len(at) else x[:0]
            self.orders[k] = (g, c.astype(np.float64), ctx[at], add(c.astype(np.float64)), np.diff(np.append(at, len(g))).astype(np.float64), add(short))
            lower = (g, c)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's symbol after its context."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        gone_n, gone_d = np.zeros(len(codes)), np.zeros(len(codes))  # what exclusion takes away
        for k in range(ORDER, -1, -1):
            own = codes[left]
            if k >= 2:
                g, c, ctx, n, d, short = self.orders[k]
                context, gram = (own >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1), own & np.uint64((1 << 8 * (k + 1)) - 1)
                at, seen = _find(ctx, context)
                here, hit = _find(g, gram)
                count = np.where(hit, c[here] if len(c) else 0.0, 0.0)
                n, d, short = (np.where(seen, x[at] if len(x) else 0.0, 0.0) for x in (n, d, short))
            else:
                symbol, prev = (own & np.uint64(255)).astype(np.int64), (own >> np.uint64(8) & np.uint64(255)).astype(np.int64)
                flat = self.pairs.sum(0)
                if k:
                    count = self.pairs[prev, symbol].astype(np.float64)
                    n, d = (x[prev].astype(np.float64) for x in (self.pairs.sum(1), (self.pairs > 0).sum(1)))
                    short = ((self.pairs > 0) @ flat)[prev].astype(np.float64)
                else:
                    count, n, d, short = flat[symbol].astype(np.float64), float(flat.sum()), float((flat > 0).sum()), 0.0
            total, kinds = n - gone_n, d - gone_d
            can = total + kinds > 0
            hit = count > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                out[left] += np.where(can, np.log10(np.where(hit, count, kinds) / (total + kinds)), 0.0)
            stay = ~hit
            left = left[stay]
            gone_n, gone_d = (np.broadcast_to(x, stay.shape)[stay] for x in (short, d))
            if not len(left):
                return out
        out[left] -= np.log10(256 - gone_d)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts with the largest n: whole powers of two, `most` at most."""
    level = F.floor(F.log2("n"))
    sizes = dict(counts.groupBy(level.alias("level")).count().collect())  # 64 rows at most
    least, total = 64, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    return counts.where(level >= least)


def score(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (), block: int = BLOCK, held: tuple[int, int] = (HELD_RUNS, HELD_WORDS)) -> DataFrame:
    """Per row of docs: key, extra, n_tokens (words and an end), n_known of them seen in train, train_tokens,
    base_score (log10 under words alone, add-one) and score (log10 under the trie)."""
    spark = docs.sparkSession
    counts = save(count_corpus(train, text), "ppm_counts")
    sizes = {r.kind: (r.keys, r.n) for r in counts.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()}
    n_docs = sizes.get(DOCS, (0, 0))[1]
    total, distinct = sizes.get(WORD, (0, 0))[1] + n_docs, sizes.get(WORD, (0, 0))[0] + (n_docs > 0)
    grams, words = counts.where(F.col("kind") == RUN).select("key", "n"), counts.where(F.col("kind") == WORD).select("word", "n")
    pair = lambda c: F.shiftright(c, 8).bitwiseAND(65535).cast("int")
    by_pair = grams.groupBy(pair("key").alias("pair"), F.col("key").bitwiseAND(255).alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
    pairs = np.zeros((256, 256), np.int64)
    for r in by_pair.groupBy(F.expr("pair & 255").alias("prev"), "symbol").agg(F.sum("n").alias("n")).collect():  # at most 65,536
        pairs[r.prev, r.symbol] = r.n
    block_of, at, open_ = [0] * 65536, 0, 0
    for r in by_pair.groupBy("pair").agg(F.sum("keys").alias("keys")).orderBy("pair").collect():  # at most 65,536
        if open_ and open_ + r["keys"] > block:
            at, open_ = at + 1, 0
        block_of[r.pair] = at
        open_ += r["keys"]
    context = Window.partitionBy(F.shiftright("key", 8))
    valued = grams.withColumn("total", F.sum("n").over(context) + F.count("*").over(context))
    top = frequent(valued, held[0]).select("key", F.log10(F.col("n") / F.col("total")).alias("value")).toArrow()  # held[0] rows at most
    keys, values = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    by = np.argsort(keys)
    keys, values = keys[by], values[by]
    top = frequent(words, held[1]).toArrow()  # held[1] rows at most
    vocabulary = (top.column(0).to_pylist(), top.column(1).to_numpy())
    sent = spark.sparkContext.broadcast((keys, values, vocabulary, total, distinct, n_docs))
    extra = tuple(c for c in extra if c not in (key, text))
    seen = save(_pass(docs.select(key, *extra, text), sent), "ppm_seen")
    codes = seen.where(F.col("__kind") == RUN).select("__id", "__code", "__n")
    value = _block_values(codes.select("__code").distinct(), grams, pairs, block_of, pair)
    runs_ = codes.join(value, "__code").groupBy("__id").agg(F.sum(F.col("__n") * F.col("__value")).alias("__score"))
    rare = seen.where(F.col("__kind") == WORD).select("__id", F.col("__word").alias("word"), "__n").join(words, "word")
    more = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1))) - math.log10(1 / (total + distinct + 1))
    known = rare.groupBy("__id").agg(F.sum("__n").alias("__known"), F.sum(F.col("__n") * more).alias("__base"))
    own = seen.where(F.col("__kind") == DOCS).join(runs_, "__id", "left").join(known, "__id", "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c[2:])
    out = own.select(key, *extra, F.col("__n").alias("n_tokens"), plus("__n_known", "__known"), F.lit(total).cast("long").alias("train_tokens"), plus("__base_score", "__base"), plus("__score_sum", "__score").alias("score"))
    out = save(out, "ppm_scores")
    discard(counts, seen)
    return out


OWN = (("__kind", ByteType()), ("__id", LongType()), ("__code", LongType()), ("__word", BinaryType()), ("__n", LongType()), ("__n_known", LongType()), ("__base_score", DoubleType()), ("__score_sum", DoubleType()))


def _pass(df: DataFrame, sent) -> DataFrame:
    """Of each row (text last) one of kind DOCS: its other columns, a number of its own, and the sums of what is sent; of kind RUN and WORD what is not, counted by row."""
    rest = df.schema.fields[:-1]
    schema = StructType([*(StructField(f.name, f.dataType) for f in rest), *(StructField(c, t) for c, t in OWN)])

    def made(fields, others, n, **own):
        cols = [*(others or [pa.nulls(n, t) for t in fields])]
        for c, t in zip((c for c, _ in OWN), (pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())):
            cols.append(pa.array(own[c], t) if c in own else pa.nulls(n, t))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        from pyspark import TaskContext

        keys, values, (known, count), total, distinct, n_docs = sent.value
        unseen = math.log10(1 / (total + distinct + 1))
        table = np.append(np.log10((count + 1) / (total + distinct + 1)), unseen)
        index = dict(zip(known, range(len(known))))
        get, none = index.get, len(known)
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, fields = batch.num_rows, [c.type for c in batch.columns[:-1]]
            ids = np.arange(first, first + n)
            first += n
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            score = np.zeros(n)
            for code, own in runs(data, offsets):
                if len(code):
                    u, back = np.unique(code, return_inverse=True)
                    at, hit = _find(keys, u)
                    score += np.bincount(own, np.where(hit, values[at] if len(values) else 0.0, 0.0)[back], n)
                    left = np.flatnonzero(~hit[back])
                    if len(left):
                        order = np.lexsort((back[left], own[left]))
                        doc, place = own[left][order], back[left][order]
                        cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))))
                        yield made(fields, None, len(cut), __kind=np.full(len(cut), RUN, np.int8), __id=ids[doc[cut]], __code=u[place[cut]].view(np.int64), __n=np.diff(np.append(cut, len(doc))))
            tokens, seen, base = np.ones(n, np.int64), np.full(n, int(n_docs > 0)), np.full(n, math.log10((n_docs + 1) / (total + distinct + 1)))
            rare, rare_ids, rare_n, held = [], [], [], 0
            for d, t in enumerate(_texts(batch.column(batch.num_columns - 1))):
                for words in words_of(t):
                    own = np.fromiter((get(w, none) for w in words), np.int64, len(words))
                    tokens[d] += len(words)
                    base[d] += table[own].sum()
                    miss = np.flatnonzero(own == none)
                    seen[d] += len(words) - len(miss)
                    for w, c in Counter(words[i] for i in miss.tolist()).items():
                        if (i := index.get(k := word_key(w))) is not None:  # a long word that was sent under its short key
                            seen[d] += c
                            base[d] += c * (table[i] - unseen)
                        else:
                            rare.append(k), rare_n.append(c), rare_ids.append(int(ids[d]))
                held = len(rare)
                if held > 1 << 16:
                    yield made(fields, None, held, __kind=np.full(held, WORD, np.int8), __id=rare_ids, __word=rare, __n=rare_n)
                    rare, rare_ids, rare_n, held = [], [], [], 0
            if held:
                yield made(fields, None, held, __kind=np.full(held, WORD, np.int8), __id=rare_ids, __word=rare, __n=rare_n)
            yield made(fields, batch.columns[:-1], n, __kind=np.full(n, DOCS, np.int8), __id=ids, __n=tokens, __n_known=seen, __base_score=base, __score_sum=score)
        del keys, values, known, index, get, table
        release()

    return df.mapInArrow(run, schema)


def _block_values(codes: DataFrame, grams: DataFrame, pairs: np.ndarray, block_of: list[int], pair) -> DataFrame:
    """__code, __value: log10 of each run's probability, by the trie of its block."""
    spark = codes.sparkSession
    blocks = lambda own: F.broadcast(spark.createDataFrame(list(enumerate(block_of)), f"pair int, {own} int"))  # 65,536 rows
    asked, model = (df.withColumn("pair", pair(c)).join(blocks(own), "pair").drop("pair") for df, c, own in ((codes, "__code", "__block"), (grams, "key", "block")))

    def run(_, own: pa.Table, counts: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        code = column(own, "__code")
        value = Trie(column(counts, "key").view(np.uint64), column(counts, "n"), pairs).log10(code.view(np.uint64)) if len(code) else np.zeros(0)
        out = pa.table({"__code": code, "__value": value})
        release()
        return out

    return asked.groupBy("__block").cogroup(model.groupBy("block")).applyInArrow(run, "__code long, __value double")


def score_split(docs: DataFrame, key: str = "doc_id", parts: int = 7, held: int = 2) -> DataFrame:
    """All of docs scored by a model of those whose crc32 of the key, as text, modulo parts isn't held (a null key counts as held)."""
    rows = docs.select(key, "text").withColumn("held_out", F.coalesce(held_out(key, parts) == held, F.lit(True)))
    return score(rows, rows.where(~F.col("held_out")), key, extra=("held_out",)).select(key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def adaptive_bits(text: str, order: int = ORDER) -> float:
    """Code length of a text in bits by a trie that starts empty and learns each symbol after coding it."""
    data = (text or "").encode() + bytes([END])
    past = bytes([START]) * order
    counts: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for s in data:
        out: set[int] = set()
        for k in range(order, -1, -1):
            own = counts.get(past[len(past) - k :])
            if not own:
                continue
            n, d = sum(c for t, c in own.items() if t not in out), sum(t not in out for t in own)
            if s in own:
                bits -= math.log2(own[s] / (n + d))
                break
            if d:
                bits -= math.log2(d / (n + d))
            out |= own.keys()
        else:
            bits += math.log2(256 - len(out))
        for k in range(order + 1):
            own = counts.setdefault(past[len(past) - k :], {})
            own[s] = own.get(s, 0) + 1
        past = (past + bytes([s]))[-order:]
    return bits
