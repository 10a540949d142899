"""Language identification by Bayesian evidence fusion (operator 8).

Classes are the languages of the training texts and `und`, under which every letter triple is alike.

* text: triples of letters and bytes beyond ASCII (all else is one space), hashed to 2**16 cells; each language's cells are
  counted by one grouped aggregation over all training texts, add-half smoothed. A text's mean log likelihood counts
  as that of at most EFFECTIVE triples, as neighbouring triples aren't independent.
* markup: the primary subtag that a page declares (html lang, xml:lang or content-language); its likelihood under each
  language comes from a grouped aggregation over the pages' text decisions, add-one smoothed.
* address suffix: the same for the host's last label.
* host: the prior of a page's language, from the text decisions of the other pages of its host, smoothed towards
  those of its domain (last two labels), which are smoothed towards all pages'.

The posterior is the normalised product. Rows without any letter have only the other evidence; without any evidence they are
`und`. Null text, html and url count as missing. A training row with null language or text is left out. Without training rows
everything is `und`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import discard, release, save, shielded, small_batches, text_buffer

CELLS, EFFECTIVE, ALPHA, BETA = 1 << 16, 60, 10.0, 50.0
UND, UND_PRIOR, MOST_LANGUAGES = "und", 0.01, 512
#: Letters and bytes beyond ASCII for themselves (A-Z as a-z), all others as a space.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
TAGS = re.compile(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]{1,10};")
OPEN = re.compile(r"(?i)<(?:html|meta)\b")
HTML, META = re.compile(r"(?i)<html\b"), re.compile(r"(?i)<meta\b")
LANG = re.compile(r"""(?i)\b(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})\b""")
NAMED, CONTENT = re.compile(r"(?i)content-language"), re.compile(r"""(?i)content\s*=\s*["']?([a-z]{2,3})\b""")


def triples(data: np.ndarray, offsets: np.ndarray):
    """Cells of all triples that hold a letter, a window at a time: (cells, text numbers)."""
    n = len(data)
    step = 1 << 18
    for at in range(0, n - 2, step):
        end = min(n - 2, at + step)
        x = LETTERS[data[at : end + 2]].astype(np.uint64)
        code = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
        lo = int(np.searchsorted(offsets, at, "right")) - 1
        cut = np.clip(offsets[lo:], at, end)
        own = np.repeat(np.arange(lo, len(offsets) - 1), np.diff(cut))
        keep = (np.arange(at, end) + 2 < offsets[own + 1]) & (x[1:-1] != 32)
        yield ((code[keep] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64), own[keep]


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihoods of the cells under each (and under `und`, last)."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, numbers = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            data, offsets = text_buffer(batch.column(1))
            for cells, own in triples(data, offsets):
                both = np.bincount(numbers[own] * CELLS + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
                for name, counts in zip(names.tolist(), both):
                    held[name] = held.get(name, 0) + counts
            if len(held) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages: the model's size would have no bound")
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "cell", "n"])
        held.clear()
        release()

    sums = save(rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "language_cells")
    langs = sorted(r.lang for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model's size would have no bound")
    counts = np.zeros((CELLS, len(langs) + 1))
    for i, name in enumerate(langs):  # each at most CELLS rows
        own = sums.where(F.col("lang") == name).select("cell", "n").toArrow()
        counts[own.column(0).to_numpy(), i] = own.column(1).to_numpy()
    discard(sums)
    return [*langs, UND], np.log((counts + 0.5) / (counts.sum(0) + 0.5 * CELLS))


def log_likelihoods(column: pa.Array, table: np.ndarray) -> np.ndarray:
    data, offsets = text_buffer(column)
    n, width = len(offsets) - 1, table.shape[1]
    out, count = np.zeros((n, width)), np.zeros(n)
    for cells, own in triples(data, offsets):
        if len(own):
            lo, hi = own[0], own[-1] + 1
            values = table[cells]
            for j in range(width):
                out[lo:hi, j] += np.bincount(own - lo, values[:, j], hi - lo)
            count[lo:hi] += np.bincount(own - lo, minlength=hi - lo)
    return out * (np.minimum(count, EFFECTIVE) / np.maximum(count, 1))[:, None]


def plain_text(html: str | None) -> str:
    return TAGS.sub(" ", html or "")


def declared(html: str | None) -> str | None:
    """The first declaration of the whole page; each stretch from a tag to the next > is read a fixed number of times."""
    at = 0
    while html and (tag := OPEN.search(html, at)):
        at = html.find(">", tag.end()) + 1 or len(html)
        part = html[tag.start() : at].removesuffix(">")
        found = []
        if (m := HTML.search(part)) and (said := LANG.search(part, m.end())):
            found.append((m.start(), said[1]))
        if (m := META.search(part)) and (named := NAMED.search(part, m.end())):
            found += [(m.start(), said[1]) for said in [*CONTENT.finditer(part, named.end())][-1:]]
        if found:
            return min(found)[1].lower()
    return None


def evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], html: str | None = None, text: str | None = None) -> DataFrame:
    """keep, ll (log likelihood of each class), declared."""
    sent = rows.sparkSession.sparkContext.broadcast(model[1])
    at_text, kept = keep.index(html or text) if (html or text) in keep else len(keep), len(keep)  # a text that is kept is sent once
    rows = small_batches(rows.select(*keep, *([F.col(html or text).alias("__text")] if at_text == kept else [])))
    schema = StructType(rows.schema.fields[:kept]).add("__ll", ArrayType(DoubleType())).add("__declared", StringType())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, said = part.column(at_text), pa.nulls(part.num_rows, pa.string())
                if html:
                    raw = texts.to_pylist()
                    texts, said = pa.array([plain_text(h) for h in raw], pa.string()), pa.array([declared(h) for h in raw], pa.string())
                ll = log_likelihoods(texts, sent.value)
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32)), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], col, said], names=schema.names)
        release()

    return rows.mapInArrow(run, schema)


def _by(rows: DataFrame, column: str, classes: int, prefix: str) -> DataFrame:
    """Counts of the text decisions by column: one array a value."""
    counts = F.array(*(F.sum(F.when(F.col("__best") == i, 1.0).otherwise(0.0)) for i in range(classes)))
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column)).agg(counts.alias(prefix))


def fuse(rows: DataFrame, langs: list[str], host=None) -> DataFrame:
    """rows (with __ll, __declared) and lang, confidence: the class with the largest posterior, and that. host: a column of host names, or null."""
    k, names = len(langs), rows.columns
    host = F.lower(host) if host is not None else F.lit(None).cast("string")
    flat = F.forall("__ll", lambda x: x == 0)
    best = F.when(flat, None).otherwise(F.array_position("__ll", F.array_max("__ll")) - 1)
    own = rows.withColumns({"__host": host, "__best": best})
    own = own.withColumns({"__suffix": F.regexp_extract("__host", r"([^.:]+)(?::\d+)?$", 1), "__domain": F.regexp_extract("__host", r"([^.]+\.[^.:]+)(?::\d+)?$", 1)})
    known = F.when(F.col("__declared").isin(langs), F.col("__declared")).when(F.col("__declared").isNotNull(), F.lit("other"))
    own = own.withColumn("__declared", known)
    decided = save(own.select("__best", "__host", "__domain", "__suffix", "__declared"), "language_evidence")  # texts are read again below rather than written
    zero = F.array(*[F.lit(0.0)] * k)
    mark = F.when(F.col("__best").isNull(), zero).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("__best")).cast("double")))
    total = [r["__best"] for r in decided.where("__best is not null").groupBy("__best").agg(F.count("*").alias("n")).select(F.struct("__best", "n").alias("__best")).collect()]
    overall = np.ones(k)
    for r in total:
        overall[r["__best"]] += r["n"]
    overall[-1] = max(overall[-1], 0)
    everyone = overall / overall.sum()
    everyone[-1] = UND_PRIOR * min(1.0, max(everyone[-1], 1e-3) * 100)
    everyone = [float(x) for x in everyone / everyone.sum()]
    prior = F.array(*map(F.lit, everyone))
    sizes = F.array(*(F.lit(float(x)) for x in overall))
    for by, column in [*zip(("__host", "__domain", "__suffix", "__declared"), ("__h", "__d", "__s", "__m"))]:
        own = own.join(save(_by(decided, by, k, column), "language_counts"), by, "left")  # written: where its size is small, no row of own is moved
    own = own.withColumn("__mark", mark)
    less = lambda c: F.zip_with(F.coalesce(c, F.col("__mark")), F.col("__mark"), lambda a, b: F.greatest(a - b, F.lit(0.0)))  # noqa: E731  without the row's own decision
    own = own.withColumns({"__h": less(F.col("__h")), "__d": less(F.col("__d"))})
    sum_ = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    domain = F.zip_with(F.col("__d"), prior, lambda n, p: (n + BETA * p) / (sum_(F.col("__d")) + BETA))
    own = own.withColumn("__p", domain)
    own = own.withColumn("__p", F.zip_with("__h", "__p", lambda n, p: (n + ALPHA * p) / (sum_(F.col("__h")) + ALPHA)))
    said = lambda c: F.when(F.col(c).isNull(), zero).otherwise(F.zip_with(F.col(c), sizes, lambda n, t: F.log((n + 1) / (t + k))))
    parts = [F.col("__ll"), F.transform("__p", lambda p: F.log(p)), said("__m"), said("__s")]
    logs = parts[0]
    for x in parts[1:]:
        logs = F.zip_with(logs, x, lambda a, b: a + b)
    own = own.withColumn("__log", logs).withColumn("__top", F.array_max("__log"))
    weights = F.transform("__log", lambda x: F.exp(x - F.col("__top")))
    nothing = F.col("__best").isNull() & F.col("__declared").isNull() & (sum_(F.col("__h")) == 0)
    lang = F.when(nothing, F.lit(UND)).otherwise(F.get(F.array(*map(F.lit, langs)), F.array_position("__log", F.col("__top")).cast("int") - 1))
    rest = [c for c in names if c not in ("__ll", "__declared")]
    return own.select(*rest, lang.alias("__lang"), (1 / sum_(weights)).alias("__confidence"))


def identify_pages(pages: DataFrame, training: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, lang, confidence."""
    model = train(training)
    host = F.regexp_extract(F.coalesce(F.col("__url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)", 1)
    rows = evidence(pages.withColumn("__url", F.col(url)), model, [key, "__url"], html=html)
    return fuse(rows, model[0], F.nullif(host, F.lit(""))).select(key, F.col("__lang").alias("lang"), F.col("__confidence").alias("confidence"))


def keep_identified(docs: DataFrame, training: DataFrame, least: float = 0.5, text: str = "text", host: str = "source") -> DataFrame:
    """docs without those that are in no language (`und`) or whose language has a posterior below least; its columns as they are."""
    model = train(training, text)

    def kept(own: DataFrame, name) -> DataFrame:
        rows = evidence(own, model, own.columns, text=name[text])
        out = fuse(rows, model[0], F.col(name[host]) if host in name else None)
        return out.where((F.col("__lang") != UND) & (F.col("__confidence") >= least)).select(own.columns)

    return shielded(docs, kept)
