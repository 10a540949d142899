"""Exact n-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification a pair (operator 2).

A text's set: its distinct runs of `n` words, each named by 64 bits made of digests of its words. Texts of the same set are one
node, named by 64 bits of a digest of the set; two sets of one name (128 bits tell them apart) start the naming again with
another salt. Copies are never paired. Two nodes link when 100 * |intersection| >= percent * |union|, which is decided on the
words themselves, not on their digests.

1. *Order.* Blocks of sets hand on the runs that OFTEN or more of their sets hold; the counts are added up, and the most
   frequent (HEAVY at most) are sent to all tasks. Every set is put in order of (count, hash): runs that many texts share come
   last, whatever the counts miss only costs time. Two linked sets share one of their first s - ceil(t s) + 1 runs in that order.
2. *Buckets.* The prefixes are dealt by run. A bucket of up to SMALL nodes hands on all its pairs that pass the length and
   positional filters. A larger bucket first hands on a star only: pairs with one node of their length class. Of its stars a
   node keeps the STARS whose centres it meets in the most buckets.
3. Each candidate pair goes once through the suffix filter (sets are cut at 64 fixed pivots of the hash space; the sum of the
   smaller sides bounds the intersection), then through the same filter with about one cell for two runs; of what is left
   both texts are read and compared exactly.
4. *Components* of the links found (large star, small star). Large buckets whose nodes lie in one component are done: any link
   inside adds nothing. The others hand on stars again, from the largest component of a length class to the nodes of all others,
   with other centres, as long as that finds many links: groups of near copies become one component in a few linear passes.
5. Of the buckets that still hold several components, the pairs between these go through all filters inside the bucket, but for
   pairs that an earlier run is known to bring together (each entry holds the SEEN runs of its node before it), and then step 3,
   so no link between different components is lost while groups of near copies aren't paired all with all.
   This is what groups() does, which needs components only. join() returns every link: it has no stars, and in step 5 each
   node counts as its own component. A large bucket is cut into parts of about PART nodes; every two parts meet in one cell.

Null, empty and blank texts have an empty set, link with nothing, and are their own component. Rows with equal ids are
rows of their own; a null id takes no part in the smallest id, and is the component of a group of null ids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import Digests, digests, discard, hash_shingles, release, save, words_of

SMALL, PIVOTS, STARS, SEEN = 3, 64, 3, 16
BLOCK, OFTEN, HEAVY = 1 << 23, 3, 1 << 22  # runs counted at a time; sets of a block that make a run frequent; runs (12 bytes each) sent to all tasks
STAR_CLASS = 1.25
GAIN = 0.05  # share of the links known so far that a further pass of stars has to bring for another one
PART = 4096  # nodes of a bucket that meet in one cell
OPEN_ROWS = 50_000  # a bucket with more goes on in parts, only its centre held
IN_PLAN = 3_000_000  # numbers (8 bytes each) of the rows to read that may be sent to all tasks; more are joined


def _texts(column: pa.Array):
    """The UTF-8 bytes of each text, a few at a time; null counts as empty."""
    for at in range(0, len(column), 256):
        for text in column.slice(at, 256).cast(pa.large_binary()):
            yield text.as_py() or b""


def _sets(column: pa.Array, n: int, memo: Digests):
    """The sorted distinct runs of each text, in order of the texts."""
    for text in _texts(column):
        words = digests(text, memo)
        yield np.unique(hash_shingles(words, np.array([0, len(words)]), n)[0])


def name_of(own: np.ndarray, salt: int = 0) -> tuple[int, bytes]:
    """A set's name, and 128 bits that tell two sets of one name apart."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True), digest


def heavy_runs(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent runs, sorted, and about how many sets hold each; HEAVY at most, whole powers of two of the counts."""

    def often(held):
        runs, count = np.unique(np.concatenate(held), return_counts=True)
        runs, count = runs[count >= OFTEN], count[count >= OFTEN]
        return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(count, pa.int64())], names=["run", "n"])

    def run(batches):
        held, rows, seen, memo = [], 0, set(), Digests()
        for batch in batches:
            for own in _sets(batch.column(0), n, memo):
                if len(own) and (node := name_of(own)[0]) not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    held.append(own)
                    rows += len(own)
                    if rows >= BLOCK:
                        yield often(held)
                        held, rows = [], 0
        if held:
            yield often(held)
        del held, seen, memo
        release()

    counted = save(docs.select(text).mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")), "join_heavy")
    levels = dict(counted.groupBy(F.floor(F.log2("n")).alias("level")).count().collect())  # 64 rows at most
    least, total = 64, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > HEAVY:
            break
        least = level
    found = counted.where(F.floor(F.log2("n")) >= least).toArrow()  # HEAVY rows at most
    discard(counted)
    runs, count = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(runs)
    return runs[order], np.minimum(count[order], 2**31 - 1).astype(np.int32)


def counts_of(own: np.ndarray, runs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The counts of the runs of a set; 0 for those that aren't among the frequent ones."""
    if not len(runs):
        return np.zeros(len(own), np.int32)
    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
    return np.where(runs[at] == own, count[at], 0)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


def prefixes(docs: DataFrame, key: str, text: str, n: int, percent: int, salt: int = 0) -> DataFrame:
    """Per row: key, at (a hash of it), node (null: empty set), digest of the set, size, prefix (hashes in order), spread and fine (sizes between pivots)."""
    spark = docs.sparkSession
    heavy = spark.sparkContext.broadcast(heavy_runs(docs, text, n))
    schema = StructType([docs.schema[key], StructField("at", LongType()), StructField("node", LongType()), StructField("digest", BinaryType()), StructField("size", LongType()), StructField("prefix", BinaryType()), StructField("spread", BinaryType()), StructField("fine", BinaryType())])

    def run(batches):
        runs, counts = heavy.value
        memo = Digests()
        for batch in batches:
            rows = []
            for own in _sets(batch.column(2), n, memo):
                if not len(own):
                    rows.append((None, None, 0, None, None, None))
                    continue
                count = counts_of(own, runs, counts)
                length = prefix_length(len(own), percent)
                light = own[count == 0]
                first = light[:length] if len(light) >= length else own[np.lexsort((own, count))[:length]]
                spread = np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=PIVOTS).astype("<u4").tobytes()
                rows.append((*name_of(own, salt), len(own), first.tobytes(), spread, fine_spread(own)))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds))], names=schema.names)
        del memo
        release()

    return docs.select(F.col(key), F.xxhash64(key), F.col(text)).mapInArrow(run, schema)


def named_sets(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of prefixes(), and a row for each node; no two sets have one name."""
    salt = 0
    while True:
        rows = save(prefixes(docs, key, text, n, percent, salt), "join_sets")
        one = rows.where("node is not null").groupBy("node").agg(F.min_by(F.struct("at", "size", "prefix", "spread", "fine"), "at").alias("s"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        nodes = save(one.select("node", "s.*", F.col("lo").alias("digest"), (F.col("lo") != F.col("hi")).alias("clash")), "join_nodes")
        if nodes.where("clash").isEmpty():
            return rows, nodes
        discard(rows, nodes)
        salt += 1


def _entries(nodes: DataFrame) -> DataFrame:
    """run, node, size, place: a row for each run of each prefix."""

    def run(batches):
        for batch in batches:
            prefix = batch.column(2)
            count = np.array([len(x) // 8 for x in prefix.to_pylist()], np.int64)
            hashes = np.frombuffer(b"".join(prefix.to_pylist()), np.int64)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(np.repeat(batch.column(1).to_numpy(), count).astype(np.int32)), pa.array(place.astype(np.int32))], names=["run", "node", "size", "place"])

    return nodes.select("node", "size", "prefix").mapInArrow(run, "run long, node long, size int, place int")


def _can_link(size_x, place_x, size_y, place_y, percent: int):
    """Length and positional filter (size_x <= size_y), on arrays: whether sets whose first common run is this one can link."""
    most = np.minimum(size_x - place_x, size_y - place_y)
    return (100 * size_x >= percent * size_y) & ((100 + percent) * most >= percent * (size_x + size_y))


PAIRS = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("run", LongType()), StructField("size", IntegerType()), StructField("place", IntegerType())])


def _buckets(entries: DataFrame, percent: int) -> DataFrame:
    """Of each small bucket: candidate pairs (a < b); of each large one stars (a: centre, b, size: buckets) and members (a, run, size, place; b null)."""

    def run(batches):
        held, big = None, None  # rows of the bucket that is still open; the centres of an open large bucket
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            if big is not None:  # its last row is held; what goes on of it
                stop = int(np.searchsorted(cols[0], big[0], "right"))
                if stop > 1:
                    rows, big = _large([c[1:stop] for c in cols], big)
                    yield from rows
                if stop == len(cols[0]):
                    held = [c[-1:] for c in cols]
                    continue
                cols, big = [c[stop:] for c in cols], None
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from _work([c[:cut] for c in cols], percent)
            held = [c[cut:] for c in cols]
            if len(held[0]) > OPEN_ROWS:
                rows, big = _large(held, None)
                yield from rows
                held = [c[-1:] for c in held]
        if held is not None and big is None:
            yield from _work(held, percent)

    ordered = entries.repartition("run").sortWithinPartitions("run", "size", "node")
    return ordered.mapInArrow(run, PAIRS)


def _pair_rows(a: np.ndarray, b: np.ndarray, star: bool = False):
    if star:
        pairs, count = np.unique(np.stack([a, b], 1)[a != b], axis=0, return_counts=True)
        count = pa.array(count, pa.int32())
    else:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        count = pa.nulls(len(pairs), pa.int32())
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), count, pa.nulls(len(pairs), pa.int32())], names=PAIRS.names)


def _first_pairs(buckets: DataFrame, every: bool = False) -> DataFrame:
    """a, b (a < b): all pairs of small buckets, and, if not every, of each node its STARS best stars."""
    pairs = buckets.where("b is not null")
    if every:
        return pairs.where("size is null").select("a", "b").distinct()
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    stars = pairs.where("size is not null").groupBy("a", "b").agg(F.sum("size").alias("n")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= STARS)
    return pairs.where("size is null").select("a", "b").unionAll(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _member_rows(run, node, size, place):
    if len(run):
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(run), pa.array(size), pa.array(place)], names=PAIRS.names)


def _classes(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(size) / np.log(STAR_CLASS)).astype(np.int64)


def _work(cols, percent: int):
    """Whole buckets, in order of run, size, node."""
    run, node, size, place = cols
    if len(run) < 2:
        return
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    count = np.diff(np.append(first, len(run)))
    per_row = np.repeat(count, count)
    small = np.flatnonzero((per_row > 1) & (per_row <= SMALL))
    a, b = [], []
    s_run, s_node, s_size, s_place = (x[small] for x in (run, node, size, place))
    for d in range(1, SMALL):
        if len(small) <= d:
            break
        x, y = slice(0, len(small) - d), slice(d, len(small))
        ok = (s_run[x] == s_run[y]) & _can_link(s_size[x], s_place[x], s_size[y], s_place[y], percent)
        a.append(s_node[x][ok])
        b.append(s_node[y][ok])
    if a:
        yield from _pair_rows(np.concatenate(a), np.concatenate(b))
    large = np.flatnonzero(per_row > SMALL)
    if len(large):
        run, node, size, place = (x[large] for x in (run, node, size, place))
        yield from _member_rows(run, node, size, place)
        new = np.concatenate(([True], run[1:] != run[:-1]))
        cls = _classes(size)
        head = new.copy()
        head[1:] |= cls[1:] != cls[:-1]
        yield from _pair_rows(_centres(node, head), node, star=True)


def _centres(node: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each row the smallest node from its head on to the next: the same centres wherever the same nodes meet, so few different pairs."""
    at = np.flatnonzero(head)
    return np.repeat(np.minimum.reduceat(node, at), np.diff(np.append(at, len(node))))


def _large(cols, big):
    """A part of one large bucket; big: (run, class, centre) of the part before."""
    run, node, size, place = cols
    cls = _classes(size)
    head = np.concatenate(([True], cls[1:] != cls[:-1]))
    centre = _centres(node, head)
    if big is not None:
        centre = np.where(cls == big[1], big[2], centre)
    return [*_member_rows(run, node, size, place), *_pair_rows(centre, node, star=True)], (run[0], cls[-1], centre[-1])


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the large buckets (n: their nodes) that pass the length, positional and suffix filters.

    The suffix filter is applied inside the bucket, so that pairs it drops are never written."""

    def run(batches):
        held = None
        for batch in batches:
            cols = [*(c.to_numpy() for c in batch.columns[:7]), _spreads(batch.column(7)), _befores(batch.column(8)), _objects(batch.column(9))]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            cut = int(_heads(cols)[-1])
            yield from _cross([c[:cut] for c in cols], percent)
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from _cross(held, percent)

    parts = members.withColumn("parts", F.ceil(F.col("n") / PART)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = met.withColumn("cell", F.shiftleft(F.least("part", "other"), 31) + F.greatest("part", "other"))
    ordered = cells.repartition("run", "cell").sortWithinPartitions("run", "cell", "size", "node")
    return ordered.select("run", "cell", "node", "size", "place", "component", "part", "spread", "before", "fine").mapInArrow(run, "a long, b long")


def _heads(cols) -> np.ndarray:
    """Where a cell of a bucket begins."""
    run, cell = cols[:2]
    return np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (cell[1:] != cell[:-1]))))


def _cross(cols, percent: int):
    if not len(cols[0]):
        return
    first = _heads(cols)
    found: list[np.ndarray] = []
    for s, e in zip(first, np.append(first[1:], len(cols[0]))):
        _, cell, node, size, place, component, part, spread, before, fine = (c[s:e] for c in cols)
        if (component == component[0]).all():
            continue
        one_part = cell[0] >> 31 == cell[0] & (1 << 31) - 1
        reach = np.searchsorted(100 * size.astype(np.int64), percent * size.astype(np.int64))  # no smaller set links
        for i in range(1, len(node)):
            lo = reach[i]
            ok = (component[lo:i] != component[i]) & (one_part | (part[lo:i] != part[i])) & _can_link(size[lo:i], place[lo:i], size[i], place[i], percent)
            at = lo + np.flatnonzero(ok)
            at = at[_can_share(spread[at], spread[i], size[at].astype(np.int64) + int(size[i]), percent)]
            mine = before[i][before[i] != 0]
            if len(mine) and len(at):
                at = at[~(before[at][:, :, None] == mine).any((1, 2))]
            if len(at):
                at = at[[_can_share_fine(fine[j], fine[i], percent) for j in at]]
            if len(at):
                other = node[at]
                found.append(np.stack([np.minimum(other, node[i]), np.maximum(other, node[i])], 1))
            if len(found) > 2000:
                yield _two(found)
                found = []
    if found:
        yield _two(found)


def _two(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _spreads(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, PIVOTS)


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _befores(column: pa.Array) -> np.ndarray:
    """Lists of up to SEEN runs as rows of a matrix, filled up with 0."""
    count = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), SEEN), np.int64)
    out[np.arange(SEEN) < count[:, None]] = column.flatten().to_numpy()
    return out


def _can_share(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: whether sets cut at the pivots can share enough; sizes: the sum of both sets' sizes."""
    return (100 + percent) * np.minimum(x, y).sum(-1, dtype=np.int64) >= percent * sizes


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets, cut at the pivots, can share enough."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("spread").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _spreads(batch.column(2)), _spreads(batch.column(3))
            ok = _can_share(x, y, x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64), percent)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long")


def fine_spread(own: np.ndarray) -> bytes | None:
    """Sizes between 2**k pivots of the hash space, about two runs each; None where one is above 255."""
    bits = max(6, int(len(own)).bit_length() - 1) if len(own) else 6
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _can_share_fine(x: bytes | None, y: bytes | None, percent: int) -> bool:
    if x is None or y is None:
        return True
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) != len(y):
        n = min(len(x), len(y))
        x, y = (v.reshape(n, -1).sum(1, dtype=np.int64) for v in (x, y))
    return (100 + percent) * int(np.minimum(x, y).sum(dtype=np.int64)) >= percent * int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64))


def _fine_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fine").alias(f"f{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep.append(_can_share_fine(x, y, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def shared_runs(x: list[bytes], y: list[bytes], n: int) -> tuple[int, int, int]:
    """Distinct runs of n words in both, in x and in y; words are numbered by what they are, runs of numbers packed and numbered again where 63 bits run out."""
    number: dict[bytes, int] = {}
    for words in (x, y):
        for w in words:
            number.setdefault(w, len(number))
    if min(len(x), len(y)) < n:  # a shorter text is one run of its own length
        whole = [1 if len(w) < n else len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) for w in (x, y)]
        return int(x == y), *whole
    bits = max(1, (len(number) - 1).bit_length())
    ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in (x, y)]
    cut = len(x) - n + 1
    code, width = np.concatenate([v[: len(v) - n + 1] for v in ids]), bits
    for k in range(1, n):
        if width + bits > 63:
            _, code = np.unique(code, return_inverse=True)
            width = max(1, len(code).bit_length())
        code = code << bits | np.concatenate([v[k : len(v) - n + 1 + k] for v in ids])
        width += bits
    a, b = np.unique(code[:cut]), np.unique(code[cut:])
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b): the texts of those that pass the fine filter are read and compared once."""
    pairs = save(_fine_filter(pairs, nodes, percent), "join_pairs")
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "at", "digest"), "node"), "join_wanted")
    at = wanted.select("at").distinct()
    if wanted.count() <= IN_PLAN:
        at = F.broadcast(at)  # IN_PLAN numbers at most

    def texts(batches):
        memo = Digests()
        for batch in batches:
            found = [hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in _sets(batch.column(0), n, memo)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).cast(pa.string())], names=["digest", "text"])
        del memo
        release()

    read = docs.select(F.xxhash64(key).alias("at"), F.col(text)).join(at, "at", "left_semi").select(text)
    found = read.mapInArrow(texts, "digest binary, text string")
    own = save(found.join(wanted, "digest").groupBy("node").agg(F.min("text").alias("text")), "join_texts")
    side = lambda c: own.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "ta", "b", "tb")

    def compare(batches):
        last, x = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3)):
                if a != last:
                    last, x = a, _words(ta)
                both, n_x, n_y = shared_runs(x, _words(tb), n)
                keep.append(100 * both >= percent * (n_x + n_y - both))
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    out = save(joined.mapInArrow(compare, "a long, b long"), "join_links")
    discard(wanted, own, pairs)
    return out


def _words(text: pa.Scalar) -> list[bytes]:
    return [w for part in words_of(text.as_py().encode()) for w in part]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for all nodes of the edges: large star and small star, until nothing changes."""
    own = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "components")
    before = None
    while True:
        both = own.unionAll(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        new = save(small, "components")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(own)
        own = new
        if state == before:
            break
        before = state
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(named: DataFrame, turn: int) -> DataFrame:
    """a, b (a < b): in every bucket and length class a node of the component that holds most of it, with each node of all others; of each node its STARS best."""
    cls = F.floor(F.log("size") / F.log(F.lit(STAR_CLASS)))
    classed = named.withColumn("cls", cls)
    each = classed.groupBy("run", "cls", "component").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("centre"))
    most = each.groupBy("run", "cls").agg(F.max(F.struct("n", F.col("component").alias("most"), "centre")).alias("m"), F.count("*").alias("kinds")).where("kinds > 1").select("run", "cls", "m.most", "m.centre")
    met = classed.join(most, ["run", "cls"]).where("component != most").groupBy("centre", "node").agg(F.count("*").alias("n"))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "centre")
    kept = met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= STARS)
    return kept.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, every: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (key, node, size), links (a, b: verified pairs of nodes) and labels (node, component: a node) of the texts of docs.

    The links are all there are between different nodes. Without every: every link between different components of what the stars
    join, and enough of the others to make each component."""
    rows, nodes = named_sets(docs, key, text, n, percent)
    buckets = save(_buckets(_entries(nodes), percent), "join_buckets")
    verify = lambda pairs: _verify(pairs, nodes, docs, key, text, n, percent)
    done = save(_suffix_filter(_first_pairs(buckets, every), nodes, percent), "join_pairs")
    links = verify(done)
    label = save(components(links), "join_labels")
    members = buckets.where("b is null").select(F.col("a").alias("node"), "run", "size", "place")

    def mixed(members: DataFrame) -> DataFrame:
        """The entries of the buckets that hold several components, with these, and n: the bucket's nodes."""
        named = members.withColumn("component", F.col("node")) if every else members.drop("component", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = named.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("run", "n")
        return save(named.join(several, "run"), "join_mixed")

    open_ = mixed(members)
    turn, known = 0, links.count()
    while not every and not open_.isEmpty():
        turn += 1
        fresh = save(_suffix_filter(_stars(open_, turn).join(done, ["a", "b"], "left_anti"), nodes, percent), "join_pairs")
        more = verify(fresh)
        done, links = done.unionAll(fresh), links.unionAll(more)
        if not (found := more.count()):
            break
        label, old = save(components(links), "join_labels"), label
        open_, before = mixed(open_), open_
        discard(old, before)
        known += found
        if found < GAIN * known:  # what is left comes cheaper from step 5
            break
    if not open_.isEmpty():
        earlier = Window.partitionBy("node").orderBy("place").rowsBetween(-SEEN, -1)
        apart = open_.withColumn("before", F.collect_list("run").over(earlier)).join(nodes.select("node", "spread", "fine"), "node")
        fresh = save(_across(apart, percent).distinct().join(done, ["a", "b"], "left_anti"), "join_pairs")
        more = verify(fresh)
        links = links.unionAll(more)
        label = save(components(links), "join_labels")
    discard(nodes, buckets, open_)
    return rows.select(key, "node", "size"), links, label


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the smallest key of its component)."""
    rows, _, label = join(docs, key, text, n, percent, every=False)
    named = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.where("component is not null").groupBy("component").agg(F.min(key).alias("component_id"))
    out = named.where("component is not null").join(least, "component").select(key, F.col("size").alias("n_shingles"), "component_id")
    alone = named.where("component is null").select(key, F.col("size").alias("n_shingles"), F.col(key).alias("component_id"))
    return out.unionAll(alone)
