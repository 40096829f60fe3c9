"""URL filter rules in a sorted, memory-mapped array of 64-bit digests.

A rule is a host and a path prefix; it fits its host and all subdomains, where the
path of the url starts with the rule's, and the longest rule that fits wins.  The
rules lie in one file: sorted xxhash64 digests, offsets, verdicts and the strings
themselves.  A url's candidates (its host suffixes with as many labels as some rule
has, each with the path prefixes of the lengths that rules have) are probed together
by binary search and confirmed on the stored string, so a collision decides nothing.

Spark ships the file to each machine (addFile), where it is mapped, not read into
memory; its size is checked against ``MAX_BYTES`` first.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 2 << 30
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:stop].translate(_LOWER), rest[stop:]
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


class DigestArray:
    """Strings with a small number each, probed by digest.

    File: n, then n sorted digests, n + 1 offsets, n numbers (a byte each) and the strings."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view("<u8")[0])
        self.digests = whole[8 : 8 + 8 * n].view("<u8")
        self.offsets = whole[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.numbers = whole[16 + 16 * n : 16 + 17 * n]
        self.text = whole[16 + 17 * n :]

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, int]], digest=xxhash.xxh64_intdigest) -> None:
        rows = sorted((digest(k.encode("utf-8", "surrogatepass")), k.encode("utf-8", "surrogatepass"), v) for k, v in dict(entries).items())
        with open(path, "wb") as f:
            f.write(np.array([len(rows)], "<u8").tobytes())
            f.write(np.array([r[0] for r in rows], "<u8").tobytes())
            f.write(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype("<u8").tobytes())
            f.write(np.array([r[2] for r in rows], np.uint8).tobytes())
            f.write(b"".join(r[1] for r in rows))

    def find(self, keys: list[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The number of each key, -1 where it is not stored."""
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        wanted = np.fromiter(map(digest, raw), np.uint64, len(raw))
        out = np.full(len(raw), -1, np.int64)
        first = np.searchsorted(self.digests, wanted, "left")
        last = np.searchsorted(self.digests, wanted, "right")
        for i in np.nonzero(last > first)[0]:
            for k in range(first[i], last[i]):  # more than one where digests collide
                if self.text[self.offsets[k] : self.offsets[k + 1]].tobytes() == raw[i]:
                    out[i] = self.numbers[k]
        return out


@lru_cache(maxsize=8)
def mapped(path: str) -> DigestArray:
    return DigestArray(path)


def ship(spark: SparkSession, entries: dict[str, int]) -> str:
    """Writes the array, gives it to all executors and returns its name there."""
    with tempfile.TemporaryDirectory() as d:
        DigestArray.write(f"{d}/rules", entries.items())
        if (size := os.path.getsize(f"{d}/rules")) > MAX_BYTES:
            raise ValueError(f"{size} bytes of rules; at most {MAX_BYTES} are shipped")
        with open(f"{d}/rules", "rb") as f:
            content = f.read()
    name = f"url-rules-{hashlib.sha256(content).hexdigest()[:24]}"
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.exists(path):  # the driver's own copy; executors fetch it from the driver
        source = os.path.join(tempfile.mkdtemp(), name)
        with open(source, "wb") as f:
            f.write(content)
        spark.sparkContext.addFile(source)
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``(<id_col>, host, path, rule, verdict)`` for each row of ``pages``.

    ``rules``: (verdict, host, path prefix), verdict "allow" or "block"; of two for the
    same host and path the last holds.  A url that no rule fits gets ``otherwise`` and
    a null rule; of two rules of equal length that fit, the one whose host has fewer
    labels wins.  Null urls and those without ``://`` have an empty host and path.
    Repeated rows, null ids and other columns are no trouble; the latter are not read."""
    if {v for v, _, _ in rules} - {"allow", "block"}:
        raise ValueError("a verdict is allow or block")
    rules = [(v, h.translate(_LOWER), p) for v, h, p in rules]
    name = ship(pages.sparkSession, {h + "\0" + p: int(v == "block") for v, h, p in rules})
    # (labels, path length), longest rule first within a url is decided by the strings' lengths
    shapes = sorted({(h.count("."), len(p)) for _, h, p in rules})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = mapped(SparkFiles.get(name))
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            keys, rows = [], []
            for i, (host, path) in enumerate(split):
                at, suffix = len(host), {}
                for dots in range(shapes[-1][0] + 1 if shapes else 0):
                    at = host.rfind(".", 0, at)
                    suffix[dots] = host[at + 1 :]
                    if at < 0:
                        break
                for dots, length in shapes:
                    if dots in suffix and length <= len(path):
                        keys.append(suffix[dots] + "\0" + path[:length])
                        rows.append(i)
            best: list[tuple[str, str] | None] = [None] * len(split)
            found = array.find(keys)
            for k in np.nonzero(found >= 0)[0]:
                rule = keys[k].replace("\0", "", 1)
                if best[rows[k]] is None or len(rule) > len(best[rows[k]][0]):
                    best[rows[k]] = (rule, "block" if found[k] else "allow")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b[1] if b else otherwise for b in best], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    return chosen.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
