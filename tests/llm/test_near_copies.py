import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import near_copies
from tessera.llm.common import table

DOCS = "doc_id long, text string, component_id string, cls string"


def plain_sets(texts):
    out = []
    for text in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\x09\x0a\x0b\x0c\x0d":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_components(rows):
    """rows: (id, text); the smallest id reachable, by index."""
    sets = plain_sets(t for _, t in rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, empty = defaultdict(list), []
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        near = [j for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
        for j in near if s else empty:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
        if not s:
            empty.append(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [low.get(find(i)) for i in range(len(rows))]


def held(rows):
    return sorted(zip([r[0] for r in rows], plain_components(rows), strict=True), key=str)


def got(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables_against_brute_force(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = held(rows)
    assert got(near_copies.similar_components(docs)) == want
    left = near_copies.near_copies_removed(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({low for _, low in want})


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [
        (9, None), (3, ""), (4, " \t\n"), (5, "Two words"), (6, "two\nWORDS "), (7, "two words more"), (None, "two words"), (None, "alone"),
        (10, long), (11, long + " more"), (12, "ÄÖ ä é İ ß  x"), (13, "äÖ ä é İ ß  x"),
        (20, "a b c d e f"), (20, "a b c d e f"), (20, "another text that has the same id"), (21, "another text that has the same id"),
    ]
    docs = spark.createDataFrame([(*r, "clash", None) for r in rows], DOCS)
    assert got(near_copies.similar_components(docs)) == held(rows)
    left = near_copies.near_copies_removed(docs)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], (r["text"] or "")[:11] if r["doc_id"] in (12, 13) else (r["text"] or "")[:12]) for r in left.collect()), key=str)
    want = [(3, ""), (5, "Two words"), (7, "two words mo"), (None, "two words"), (None, "alone"), (10, long[:12]), (12, "ÄÖ ä é İ ß "), (13, "äÖ ä é İ ß ")]
    assert kept == sorted([(k, t[:12]) for k, t in want] + [(20, "a b c d e f"), (20, "another text")], key=str)


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near_copies.similar_components(docs).collect() == []
    assert near_copies.near_copies_removed(docs).collect() == []


def test_hot_groups(spark):
    """Copies, and crowds of texts that differ in a word or more, dealt out in small tiles."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, "the same text of seven words again") for i in range(150)]
    rows += [(1000 + i, " ".join(words[: i % 120] + [f"x{i}"] + words[i % 120 :])) for i in range(150)]
    for i in range(150):
        text = [f"v{k}" for k in range(120)]
        for k in rng.sample(range(120), 1 + i % 5):
            text[k] = f"y{i}-{k}"
        rows.append((3000 + i, " ".join(text)))
    rows += [(5000 + i, " ".join(f"{i}-{k}" for k in range(30))) for i in range(150)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], DOCS).repartition(7)
    assert got(near_copies.similar_components(docs, tile=16)) == held(rows)


def test_blocks_find_pairs_at_the_threshold():
    """Of pairs at a similarity of 0.8, at least 0.93 share a block and are within the distance that is looked at."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(400):
        both, one, two = (rng.integers(0, 2**64, n, np.uint64) for n in (400, 50, 50))
        x = np.stack([near_copies.wide_fingerprint(np.concatenate([both, part])) for part in (one, two)])
        values = near_copies.block_values(x, *near_copies.plan(1_000_000))
        d = np.bitwise_count(x[0] ^ x[1]).sum()
        assert near_copies.SURE < d
        found += bool((values[0] == values[1]).any()) and d <= near_copies.OPEN
    assert found >= 0.93 * 400
