"""Writers: JSON lines, metrics, atomic files, journals, deterministic archives."""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile
import tempfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: metrics of one document
MOST_ROWS = 1_000_000
MOST_METRICS = 100_000


def write_jsonl(rows: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """One JSON object a line, UTF-8, in order.  ``single`` makes one file of a result that is known to be small."""
    ordered = rows.coalesce(1).sortWithinPartitions(*order) if single else rows.orderBy(*order)
    ordered.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_bytes_atomic(path: str, content: bytes) -> bool:
    """Written beside the target, flushed to disk and renamed; false where the target has these bytes already."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() == content:
                return False
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
    directory = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(directory)
    finally:
        os.close(directory)
    return True


def write_json_atomic(path: str, value: Any) -> bool:
    return write_bytes_atomic(path, (json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode())


def write_metrics(metrics: DataFrame, path: str) -> dict[str, Any]:
    """One JSON document of a (metric, value) table, written before any gate may fail.

    All metrics are in it; a document is for some thousands, so more than ``MOST_METRICS`` are an error."""
    rows = metrics.orderBy("metric").limit(MOST_METRICS + 1).collect()
    if len(rows) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} metrics: write them as a table")
    found = {r["metric"]: r["value"] for r in rows}
    write_json_atomic(path, found)
    return found


def write_comparison(rows: DataFrame, path: str, order: list[str]) -> None:
    """A sorted CSV report with a header: one file, so one task; more than ``MOST_ROWS`` rows are an error."""
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write them as a table")
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def append_journal(path: str, row: dict[str, Any], key: str) -> bool:
    """Adds a row to a small JSON-lines journal, rewritten atomically; false where the key is in it."""
    content = b""
    if os.path.exists(path):
        with open(path, "rb") as f:
            content = f.read()
    if any(json.loads(line)[key] == row[key] for line in content.splitlines() if line.strip()):
        return False
    line = json.dumps(row, ensure_ascii=False, sort_keys=True, allow_nan=False).encode() + b"\n"
    return write_bytes_atomic(path, content + line)


def merge_ledgers(ledgers: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of all ledgers, columns by name, those one lacks null; sorted with null as first."""
    out = ledgers[0]
    for ledger in ledgers[1:]:
        out = out.unionByName(ledger, allowMissingColumns=True)
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in order])


def gzip_bytes(content: bytes) -> bytes:
    """gzip without a time or a name: equal content gives equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as f:
        f.write(content)
    return out.getvalue()


def tar_bytes(files: dict[str, bytes]) -> bytes:
    """A tar archive in order of names, without times, owners or modes of the machine."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(files[name]), 0, 0o644
            tar.addfile(info, io.BytesIO(files[name]))
    return out.getvalue()


def write_split(rows: DataFrame, path: str, metadata: dict[str, Any]) -> None:
    """Encoded rows as parquet with a metadata document beside them."""
    rows.write.mode("overwrite").parquet(path)
    write_json_atomic(path.rstrip("/") + ".json", metadata)
