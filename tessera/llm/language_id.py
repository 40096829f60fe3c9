"""Language identification of web pages by fusing evidence in log odds.

text      likelihood of the visible text under hashed character trigrams of each language,
          tempered to that of ``EVIDENCE`` trigrams, as neighbours are not independent
declared  P(declared language | language): the markup's lang attribute, from grouped counts
suffix    P(last label of the host | language), from grouped counts
host      prior of the host, smoothed towards that of its domain, and that towards the
          whole: soft counts of the text's posteriors, summed by group over all pages,
          without the page's own

The trigram model is fitted on a bounded sample of documents (``MAX_DOCS``, in order of
a hash of the id); counts and priors cover all pages.  Groups are pre-aggregated, so
a hot host is a few rows in a shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import below, cut, lowest
from tessera.llm.url_filter import parts

MAX_DOCS = 20_000
#: a table of documents in more is an error, as the model of each (128 KB) is held by the driver and by each worker
MAX_LANGUAGES = 200
FIT_PARTITIONS = 16
BUCKETS = 1 << 14
EVIDENCE = 30.0
SMOOTHING = 10.0

#: what opens a comment, an element whose content is not read, or any other tag
_MARK = re.compile(r"(?ai)<(?:(!--)|(script|style|template|noscript|nav|footer|header|aside)(?![\w-])|[a-z/!?])")
#: without an end tag these go to the end of the page, as browsers have it; the others then are tags like any other
_RAW = {"script", "style", "template", "noscript"}
_CLOSE = {name: re.compile(rf"(?ai)</{name}(?![\w-])") for name in ("script", "style", "template", "noscript", "nav", "footer", "header", "aside")}
_COMMENT_END = re.compile("-->")
_TAG_END = re.compile(">")
#: references beyond Unicode's range, which the library refuses when they are very long
_NO_CHARACTER = re.compile(r"(?a)&#(?:\d{9,}|[xX][0-9a-fA-F]{9,});?")
#: a comment (to the end where it is not closed) or an html tag with its attributes
_HTML = re.compile(r"(?is)<!--(?:.*?-->|.*)|<html\b([^>]*)")
_LANG = re.compile(r"(?is)\s(?:xml:)?lang\s*+=\s*+(?:[\"']\s*+)?([A-Za-z]{1,8})")


def visible_text(page: str | None) -> str:
    """The text of a page without markup, comments, scripts, styles and navigation.

    One pass: an end is looked for only beyond the last place where one of its kind
    was found, so the time is linear in the page, whatever it holds.  ``<`` before
    anything but a letter, ``/``, ``!`` or ``?``, or without a ``>`` after it, is text."""
    page = page or ""
    out: list[str] = []
    found: dict[re.Pattern, tuple[int, int] | None] = {}

    def after(end: re.Pattern, start: int) -> int | None:
        """Where the first ``end`` from ``start`` on ends."""
        if end in found and (found[end] is None or found[end][0] >= start):
            return found[end] and found[end][1]
        m = end.search(page, start)
        found[end] = m and m.span()
        return m and m.end()

    at = 0
    while m := _MARK.search(page, at):
        out.append(page[at : m.start()])
        name = m[2] and m[2].lower()
        if m[1]:
            stop = after(_COMMENT_END, m.end()) or len(page)
        else:
            closed = after(_CLOSE[name], m.end()) if name else None
            stop = len(page) if closed is None and name in _RAW else after(_TAG_END, closed or m.end())
        if stop is None:
            at = m.start()
            break
        out.append(" ")
        at = stop
    out.append(page[at:])
    return entities.unescape(_NO_CHARACTER.sub("\ufffd", "".join(out)))


def declared_language(page: str | None) -> str | None:
    """What the first html tag outside comments declares, wherever it is."""
    tag = next((m for m in _HTML.finditer(page or "") if m[1] is not None), None)
    m = _LANG.search(tag[1]) if tag else None
    return m[1].lower() if m else None


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed character trigrams of a whole text; digits and marks are spaces."""
    t = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    return np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)


class TextModel(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # languages x buckets

    def likelihoods(self, text: str | None) -> np.ndarray:
        """Tempered log likelihood of each language, 0 for the best."""
        counts = trigram_counts(text)
        n = counts.sum()
        if not n or not self.languages:
            return np.zeros(len(self.languages))
        at = np.nonzero(counts)[0]
        ll = self.logs[:, at] @ counts[at] * (min(1.0, EVIDENCE / n))
        return ll - ll.max()


def fit_text(docs: DataFrame, max_docs: int = MAX_DOCS) -> TextModel:
    """Trigram model from ``docs(doc_id, text, lang)``; rows without a language are not used."""
    known = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = known.select("doc_id", F.xxhash64("doc_id", F.lit(23)).alias("h"))
    total = ids.agg(F.approx_count_distinct("doc_id")).first()[0]
    chosen = lowest(below(ids, max_docs, total).distinct(), max_docs, total).select(F.col("doc_id").alias("chosen"))
    # bounded by max_docs, so a few partitions hold it, however many the table has
    some = known.join(F.broadcast(chosen), known["doc_id"] == F.col("chosen")).select("lang", "text").repartition(FIT_PARTITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in sums and len(sums) == MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                sums[lang] = sums.get(lang, 0) + trigram_counts(text)
        for lang, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.astype("<i8").tobytes()])], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in cut(some.mapInArrow(run, "lang string, counts binary")).toLocalIterator():  # a row per language and partition
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"], "<i8")
        if len(total) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(total)
    logs = np.array([np.log((total[x] + 0.5) / (total[x].sum() + 0.5 * BUCKETS)) for x in languages]).reshape(len(languages), BUCKETS)
    return TextModel(languages, logs.astype(np.float32))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max()) if len(z) else z
    return e / e.sum() if len(z) else z


EVIDENCES = "page_id long, host string, domain string, suffix string, declared string, ll array<double>, post array<double>"


def _evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = parts(url)[0].rpartition("@")[2].partition(":")[0]
                labels = host.split(".")
                ll = model.likelihoods(visible_text(page))
                rows.append((key, host, ".".join(labels[-2:]), labels[-1], declared_language(page) or "", ll.tolist(), _softmax(ll).tolist()))
            if rows:
                kinds = [pa.int64()] + [pa.string()] * 4 + [pa.list_(pa.float64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in EVIDENCES.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, EVIDENCES)


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Soft counts of each language by key."""
    return rows.groupBy(key).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(n)]).alias(f"{key}_sum"))


def identify_languages(pages: DataFrame, docs: DataFrame, *, max_docs: int = MAX_DOCS, smoothing: float = SMOOTHING) -> DataFrame:
    """``(page_id, host, lang, confidence, text_lang, declared_lang)``, one row per row of ``pages(page_id, url, html)``.

    Without any language known from ``docs`` both languages are null and the
    confidence is 0.  Null urls have an empty host, null and empty pages no text: the
    other evidence decides.  Ties go to the first language in order.  Repeated rows
    count as often as they occur."""
    model = fit_text(docs, max_docs)
    langs, n = model.languages, len(model.languages)
    rows = cut(_evidence(pages, model))
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), F.when(F.col("declared") != "", F.col("declared")).alias("declared_lang"))
    keyed = {k: _sums(rows, k, n) for k in ("host", "domain", "suffix", "declared")}
    whole = rows.agg(*[F.sum(F.get("post", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    total = np.array([x or 0.0 for x in whole]) + 1.0
    share = (total / total.sum()).tolist()

    # what hangs on the host alone is joined host by host, so that pages are joined by host and by declared language only
    hosts = rows.select("host", "domain", "suffix").distinct().join(keyed["host"], "host").join(keyed["domain"], "domain").join(keyed["suffix"], "suffix")
    joined = rows.drop("domain").join(cut(hosts.drop("domain", "suffix")), "host").join(cut(keyed["declared"]), "declared")
    lit = lambda xs: F.array(*map(F.lit, xs))
    less = lambda col: F.zip_with(col, "post", lambda s, p: F.greatest(s - p, F.lit(0.0)))  # noqa: E731  without the page's own
    count = lambda col: F.aggregate(col, F.lit(0.0), lambda s, x: s + x)

    def smooth(own, parent):
        return F.zip_with(own, parent, lambda c, p: c + smoothing * p)

    def likelihood(own):
        """P(value | language) up to a factor: counts with a share of the whole added, by the language's total."""
        return F.transform(F.zip_with(own, lit(share), lambda c, p: c + smoothing * p), lambda x, i: F.log(x / F.get(lit(total.tolist()), i)))

    joined = joined.withColumns({f"{k}_own": less(f"{k}_sum") for k in keyed})
    joined = joined.withColumn("domain_prior", smooth("domain_own", lit(share))).withColumn("domain_prior", F.transform("domain_prior", lambda x: x / (count(F.col("domain_own")) + smoothing)))
    joined = joined.withColumn("prior", F.transform(smooth("host_own", "domain_prior"), lambda x: F.log(x / (count(F.col("host_own")) + smoothing))))
    quiet = lit([0.0] * n)
    declared = F.when(F.col("declared") == "", quiet).otherwise(likelihood("declared_own"))
    suffix = F.when(F.col("suffix") == "", quiet).otherwise(likelihood("suffix_own"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = joined.withColumn("z", add(add("ll", "prior"), add(declared, suffix)))
    best = F.array_max("z")
    name = lambda z: F.get(lit(langs), F.array_position(z, F.array_max(z)).cast("int") - 1)
    odds = F.aggregate(F.transform("z", lambda x: F.exp(x - best)), F.lit(0.0), lambda s, x: s + x)
    return joined.select(
        "page_id",
        "host",
        name(F.col("z")).alias("lang"),
        (1 / odds).alias("confidence"),
        name(F.col("ll")).alias("text_lang"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared_lang"),
    )
