"""BPE encoding and decoding by a bounded-lookahead streaming transducer (operator 9).

*Lookahead.* What stands right of a position can only reach left through a chain of merges of rising rank,
each of which takes, left of the place reached so far, a token u, because its right part v begins with (has in its
left spine) the token that the chain's last merge took. The longest such chain, weighted by the bytes of its u,
is found by one pass over the merge list: no byte further right than that changes where a token ends.

*Transducer.* For every prefix of a piece of text exactly one token can end it: the one whose pair with the last token
of what stands before it stays two tokens under the merge list. So one token per byte of a window is all the
state; tokens that end the lookahead or more before the newest byte are stable and leave the window.
A unit's end (where the splitting pattern starts a new piece) makes all of it stable at once.

*Decoder.* Bytes of ids go through an incremental UTF-8 state machine, so characters cut by chunks come out whole.

Null texts count as empty; an empty text has no ids. Every text is fed in portions; of what has come, the part before a single
space between two other characters is done at once. A unit without such a place is held until it ends, and its long
pieces go through the transducer in chunks. What the transducer gives for short units is remembered; the memo tables are
bounded, also within a text; encode_table() drops them when its task ends.
"""

from __future__ import annotations

import codecs
import gc
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release

#: The splitting pattern of byte-level BPE, and the bytes that stand for themselves in its vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))

UNIT = 1 << 14
HEAD = 8
CACHED = 700_000
CHUNK = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """Characters of the vocabulary file and the bytes they stand for: printable ones for themselves, the others from 256 on, in order."""
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Loose(Exception):
    """White space stands beside a space: units end elsewhere."""


class _Cache(dict):
    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out


class Vocabulary:
    """A merge list with its ids, ranks, lookahead and memo tables."""

    cached = CACHED

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        of = lambda s: bytes(letters[c] for c in s)
        self.id = {of(s): i for s, i in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = [(of(u), of(v)) for u, v in merges]
        self.rank = {pair: r for r, pair in reversed(list(enumerate(self.merges)))}
        self.id_rank = {(self.id[u], self.id[v]): r for (u, v), r in self.rank.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes = {i: b for b, i in self.id.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lookahead = lookahead(self.merges)
        made = {u + v: (r, u, v) for (u, v), r in reversed(self.rank.items())}
        self.right_spine, self.left_spine = (_Cache(lambda t, side=side: self._spine(made, t, side)) for side in (2, 1))
        self.alone = _Cache(lambda t: self.merged(self.bytes[t]) == [self.bytes[t]])
        self.pair = _Cache(self._pair)
        self.pieces = _Cache(self._piece)
        self.heads: dict[bytes, list[int]] = {}  # the state after the first bytes, which many pieces share
        self.units, self.loose = _Cache(self._tight), _Cache(lambda s: self._unit(" " + s))
        self.first = _Cache(self._unit)
        self.splits = regex.compile(PATTERN)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @cached_property
    def ends(self) -> dict[bytes, int]:
        """Every suffix of a token: its own id, or -1. Only long pieces need it."""
        return {token[i:]: -1 for token in self.id for i in range(len(token))} | self.id

    def merged(self, text: bytes) -> list[bytes]:
        """Merges by rank, leftmost first: the definition, used on single tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _tight(self, unit: str) -> tuple[int, ...]:
        """Ids of a space and a unit that neither begins nor ends with white space."""
        if unit.isalpha() and len(unit) <= 64:
            return self._piece(" " + unit)
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Loose
        return self._unit(" " + unit)

    def _spine(self, made: dict, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """What stands at a token's edge while it is made: each token there, and the rank of the merge that takes it away."""
        out, until, at = [], len(self.merges), self.bytes[token]
        while True:
            out.append((self.id[at], until))
            if at not in made:
                return tuple(out)
            until, at = made[at][0], made[at][side]

    def _pair(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay two: no merge of what stands left and right of their border comes before those that take it away (of equal ones, the left comes first)."""
        if not (self.alone[pair[0]] and self.alone[pair[1]]) or pair[1] in self.special.values():
            return False
        rank = self.id_rank.get
        for x, x_until in self.right_spine[pair[0]]:
            for y, y_until in self.left_spine[pair[1]]:
                if (r := rank((x, y))) is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The transducer over a whole piece that is short: nothing has to leave the window before its end."""
        data = piece.encode()
        if len(data) > 96:
            t = Transducer(self)
            return (*t.feed(data), *t.finish())
        if (token := self.id.get(data)) is not None and self.alone[token]:
            return (token,)
        own, pair, alone, last = self.id.get, self.pair, self.alone, list(self.heads.get(head := data[:HEAD], ()))
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end):
                if (t := own(data[start:end])) is not None and (pair[last[start - 1], t] if start else alone[t]):
                    last.append(t)
                    break
        if len(head) == HEAD and head not in self.heads:
            self.heads[head] = last[:HEAD]
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[out[-1]])
        return tuple(reversed(out))

    def _unit(self, unit: str) -> tuple[int, ...]:
        found = self.splits.findall(unit)
        return self.pieces[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def trim(self) -> None:
        """Keeps the memo tables bounded (`cached` units, of others less); they hold no state."""
        n = self.cached
        for cache, most in ((self.units, n), (self.loose, n // 8), (self.heads, n // 4), (self.first, n // 8), (self.pieces, n // 4), (self.pair, n)):
            if len(cache) > most:
                cache.clear()


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token's end no longer changes, whatever follows."""
    reach: dict[bytes, int] = {}
    left = {u + v: u for u, v in reversed(merges)}
    most = 0
    for u, v in merges:
        spine, best = v, 0
        while spine is not None:
            best = max(best, reach.get(spine, 0))
            spine = left.get(spine)
        reach[u] = max(reach.get(u, 0), len(u) + best)
        most = max(most, reach[u])
    return most


class Transducer:
    """Ids of one piece of text (between two splits), fed in any portions."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = b""
        self.last: list[int] = []  # for each byte of the window, the token that ends the prefix up to it
        self.before = -1  # the last token that has left

    def feed(self, data: bytes) -> list[int]:
        v, last, out = self.v, self.last, []
        step = 4 * v.lookahead + 1024
        for at in range(0, len(data), step):
            n = len(last)
            self.window += data[at : at + step]
            window, ends, pair = self.window, v.ends, v.pair
            for end in range(n + 1, len(window) + 1):
                start, token = end - 1, -1
                while start >= 0 and (t := ends.get(window[start:end])) is not None:
                    if t >= 0:
                        back = last[start - 1] if start else self.before
                        if (v.alone[t] if back < 0 else pair[back, t]):
                            token = t
                            break
                    start -= 1
                last.append(token)
            if len(window) > step:
                out += self._leave(len(window) - v.lookahead)
        return out

    def finish(self) -> list[int]:
        out = self._leave(len(self.window))
        self.before = -1
        return out

    def _leave(self, stable: int) -> list[int]:
        """Takes the tokens that end at or before stable out of the window."""
        v, end, path = self.v, len(self.window), []
        while end > 0:
            token = self.last[end - 1]
            path.append((end, token))
            end -= len(v.bytes[token])
        gone = [(e, t) for e, t in reversed(path) if e <= stable]
        if gone:
            cut = gone[-1][0]
            self.window, self.before = self.window[cut:], gone[-1][1]
            del self.last[:cut]
        return [t for _, t in gone]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


SAFE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """feed() takes text in any portions and returns the ids that are stable; finish() returns the rest."""

    def __init__(self, v: Vocabulary):
        self.v, self.held = v, ""

    def feed(self, text: str) -> list[int]:
        self.held += text
        if len(self.held) < 2 * UNIT:
            return []
        longest = max(map(len, self.v.special), default=1)
        cut = next((m.start() for m in SAFE.finditer(self.held, len(self.held) - UNIT, len(self.held) - longest - 1)), None)
        if cut is None:
            return []  # no place to cut yet: encode() streams such a unit when it ends
        if self.v.specials is not None:
            for m in self.v.specials.finditer(self.held):
                if m.start() < cut < m.end():
                    return []
        ready, self.held = self.held[:cut], self.held[cut:]
        return _whole(self.v, ready)

    def finish(self) -> list[int]:
        out, self.held = _whole(self.v, self.held), ""
        return out


def encode(v: Vocabulary, text: str) -> list[int]:
    """Ids of a text; strings of special tokens get their ids."""
    e = Encoder(v)
    if len(text) < 2 * UNIT:
        e.held = text
        return e.finish()
    out: list[int] = []
    for at in range(0, len(text), 4 * UNIT):
        out += e.feed(text[at : at + 4 * UNIT])
    return out + e.finish()


def _whole(v: Vocabulary, text: str) -> list[int]:
    """Ids of a text that ends where a unit does."""
    if v.specials is None or v.specials.search(text) is None:
        return out if isinstance(out := _plain(v, text), list) else list(out)
    out, at = [], 0
    for m in v.specials.finditer(text):
        out += _plain(v, text[at : m.start()])
        out.append(v.special[m[0]])
        at = m.end()
    return [*out, *_plain(v, text[at:])]


def _plain(v: Vocabulary, text: str) -> Iterable[int]:
    if not text:
        return ()
    v.trim()
    units, rest = text.split(" "), v.units
    if len(text) < 64 * len(units) + 256 or max(map(len, units)) <= 256:
        try:
            return [*v.first[units[0]], *chain.from_iterable(map(rest.__getitem__, units[1:]))] if units[0] and not (units[0][-1].isspace() or units[-1][-1:].isspace()) else _apart(v, text)
        except _Loose:
            pass
    return _apart(v, text)


def _apart(v: Vocabulary, text: str) -> Iterable[int]:
    """Units of any kind, the long ones streamed."""
    return chain.from_iterable(_long(v, u, i > 0) if len(u) > 256 else v.loose[u] if i else v.first[u] for i, u in enumerate(SAFE.split(text)))


def _long(v: Vocabulary, unit: str, spaced: bool) -> Iterator[int]:
    """A unit that isn't worth remembering."""
    for m in v.splits.finditer(" " + unit if spaced else unit):
        if len(piece := m[0]) <= 64:
            yield from v.pieces[piece]
        else:
            t = Transducer(v)
            for i in range(0, len(piece), CHUNK):
                yield from t.feed(piece[i : i + CHUNK].encode())
            yield from t.finish()


class Decoder:
    """Text of ids, fed in any portions; bytes of a character that isn't whole yet stay in the state."""

    def __init__(self, v: Vocabulary):
        self.bytes, self.state = v.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode(v: Vocabulary, ids: list[int]) -> str:
    d = Decoder(v)
    return "".join([*(d.feed(ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)), d.finish()])


def encode_table(df: DataFrame, path: str, text: str = "text", ids: str = "ids", cached: int = 40_000) -> DataFrame:
    """df with the ids (array<int>) of its texts; a column of that name is replaced. cached: units that a task remembers; fewer take less memory, more time."""

    def run(batches):
        v = vocabulary(path)
        v.cached = cached
        for batch in batches:
            keep = [c for c in batch.schema.names if c != ids]
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                col = pa.array((encode(v, t.as_py() or "") for t in part.column(part.schema.get_field_index(text))), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), col], names=[*keep, ids])
        del v
        vocabulary.cache_clear()  # the worker goes on with other operators
        gc.collect()
        release()

    rest = df.drop(ids)
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return df.mapInArrow(run, StructType([*rest.schema.fields]).add(ids, ArrayType(IntegerType())))


def round_trip(df: DataFrame, path: str, derive: Callable[[list[int], str], tuple], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text; a row of key and what derive(ids, decoded text) gives, columns as in schema."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    rows = df.select(key, text)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([rows.schema[key], *kinds.fields])

    def run(batches):
        v, want = vocabulary(path), to_arrow_schema(out)
        v.cached = CACHED
        for batch in batches:
            made = []
            for t in batch.column(1):
                ids = encode(v, t.as_py() or "")
                made.append(derive(ids, decode(v, ids)))
            cols = list(zip(*made)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(want)[1:]))], schema=want)

    return rows.mapInArrow(run, out)
