"""Benchmark decontamination by a generalised suffix automaton of the test items (operator 6).

Words are numbered by the items' vocabulary; a training word that no item has resets the match. One pass per text tracks
the longest run of words ending here that some item holds. Where that run is `window` words or more, the last `window`
words are hit, and the items are those of the state that holds that window. An item shorter than the window counts as one
window; the states on whose suffix chain it ends know it.

The automaton has at most twice as many states as the items have words. Items with more words than `block_words` in all are
dealt into blocks of at most that many (plus one item), and the texts pass one block after another, so what a task holds
stays bounded whatever the size of the benchmark.

Null texts and items have no words. Repeated items count each by its id; items with null id take part in hits but aren't listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import release, shielded

BLOCK_WORDS = 500_000

#: Bytes of words (digits, letters, all beyond ASCII) for themselves, A-Z as a-z, all others as a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split(b" ")


class Automaton:
    """Substrings of all items: for each state the longest length, the suffix link and the steps by word number."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.names = window, [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for k, (_, words) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            paths.append(ids)
        n = len(self.link)
        self.held = [-1] * n  # the state, of this or its suffixes, that holds the last `window` words
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.held[s] = s if self.length[up] < window <= self.length[s] else self.held[up]
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}  # items shorter than a window, by the state they end in: length, item
        for k, ids in enumerate(paths):
            state = 0
            for c in ids:
                state = self.step[state][c]
                if self.held[state] >= 0:
                    self.items.setdefault(self.held[state], set()).add(k)
            if 0 < len(ids) < window:
                state = 0
                for c in ids:
                    state = self.step[state][c]
                while self.length[self.link[state]] >= len(ids):
                    state = self.link[state]
                self.short.setdefault(state, []).append((len(ids), k))
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.ends[s] = (*self.ends[self.link[s]], *self.short.get(s, ()))

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if (q := step[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(link)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, [start, end), merged; and the items that have a window in the text."""
        step, link, length, held, ends, window = self.step, self.link, self.length, self.held, self.ends, self.window
        spans: list[list[int]] = []
        found: set[int] = set()
        state = size = 0
        for i, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = size = 0
                continue
            while c not in step[state]:
                if not state:
                    size = -1
                    break
                state = link[state]
                size = length[state]
            if size < 0:
                state = size = 0
                continue
            state = step[state][c]
            size += 1
            start = i + 1
            if size >= window:
                start = i + 1 - window
                found |= self.items.get(held[state], ())
            if ends[state]:
                for n, k in ends[state]:
                    if n <= size:
                        start = min(start, i + 1 - n)
                        found.add(k)
            if start <= i:
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


def union(*spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(s for each in spans for s in each):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


MATCHES = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(StringType()))])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a column `__match`: n_words, spans of hit words ([start, end) word numbers, merged) and the ids of the items, as text."""
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum((F.length(F.coalesce("text", F.lit(""))) + 1) / 2)).first()[0] or 0  # no text has more words
    blocks = max(1, -(-int(total) // block_words))
    out = docs.withColumn("__match", F.lit(None).cast(MATCHES))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()  # bounded: about block_words words
        out = _pass(out, [(r.id, [w for w in words_of(r.text) if w]) for r in own], window, text)
    return out


def _pass(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        own = _automaton(sent, window)
        for batch in batches:
            before, rows = batch.column("__match"), []
            for t, old in zip(batch.column(text), before):
                words = [w for w in words_of(t.as_py()) if w]
                spans, found = own.match(words)
                names = {own.names[k] for k in found} - {None}
                if old.is_valid:
                    old = old.as_py()
                    spans, names = union(spans, [tuple(s) for s in old["spans"]]), names | set(old["items"])
                rows.append({"n_words": len(words), "spans": spans, "items": sorted(names)})
            at = batch.schema.get_field_index("__match")
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))
        release()

    return docs.mapInArrow(run, docs.schema)


_built: dict[tuple[int, int], Automaton] = {}


def _automaton(sent, window: int) -> Automaton:
    key = (sent._id if hasattr(sent, "_id") else id(sent.value), window)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([x for x in sent.value if x[1]], window)
    return _built[key]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the items' ids, sorted as text, comma-joined), contaminated."""
    m = find_matches(docs.select(key, "text"), benchmark, window)
    hit = F.aggregate(F.col("__match.spans"), F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return m.select(
        key, F.col("__match.n_words").alias("n_words"), hit.alias("n_hit"), F.size("__match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__match.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans and what stands between them, else unchanged."""
    if not spans or text is None:
        return text
    data = text.encode()
    marks = np.frombuffer(data.translate(WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, least_span: int = 10, most_coverage: float = 0.5) -> DataFrame:
    """docs (its columns) without what the benchmark holds: spans of least_span words or more, or of whole shorter items, leave the text;
    documents of which more than most_coverage of the words are hit leave altogether."""
    return shielded(docs, lambda own, name: _cut(own, benchmark, window, least_span, most_coverage, name["text"]))


def _cut(docs: DataFrame, benchmark: DataFrame, window: int, least_span: int, most_coverage: float, text: str) -> DataFrame:
    names = docs.columns
    m = find_matches(docs, benchmark, window, text)
    hit = F.aggregate(F.col("__match.spans"), F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    m = m.where(~(hit > F.lit(most_coverage) * F.col("__match.n_words")))
    schema = StructType([f for f in m.schema.fields if f.name != "__match"])

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("__match")).field("spans").to_pylist()
            texts = [cut_spans(t, [s for s in own if s[1] - s[0] >= least_span or s[1] - s[0] < window]) if own else t for t, own in zip(batch.column(text).to_pylist(), spans)]
            at = batch.schema.get_field_index(text)
            new = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield new.select(schema.names)
        release()

    return m.mapInArrow(run, schema).select(names)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
