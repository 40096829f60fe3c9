import random

import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.common import connected_components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, component_id string, fp string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> bit & 1 for s in shingles) * 2 > len(shingles):
            out |= 1 << bit
    return out


def plain_components(fps):
    """fps: (id, fingerprint); smallest id reachable, by index."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [low.get(find(i)) for i in range(len(fps))]


def held(rows):
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    return sorted(zip([k for k, _ in fps], [f for _, f in fps], plain_components(fps), strict=True), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert got(simhash.simhash_components(docs)) == held(docs.collect())


def test_edges(spark):
    rows = [(3, None, "x", "y"), (1, "", "x", "y"), (7, " \t\n", None, None), (None, "", "x", "y"), (5, "one", "", ""), (4, "ONE", "", ""), (6, "a b", "", ""), (6, "a b", "", ""), (8, "w " * 70000, "", ""), (2, "É é É", "", ""), (9, "é é é", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(simhash.simhash_components(docs)) == held(docs.collect())
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "", "x", "y"), (1, None, "x", "y"), (None, "", "x", "z"), (5, "one two", "", ""), (4, "one two", "", ""), (6, "a b", "", ""), (6, "a b", "", "")]
    left = simhash.near_duplicates_removed(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "component_id", "fp"]
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 4, 6]


def test_rows_that_repeat_an_id_are_judged_each(spark):
    """A row goes for its own text, not for that of another row with its id."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, words(1), "", ""), (2, words(1), "", ""), (3, words(3), "", ""), (3, words(1), "", ""), (4, words(3), "", ""), (5, words(5), "", ""), (5, words(5), "x", "x")]
    left = simhash.near_duplicates_removed(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, words(1)), (3, words(3)), (5, words(5))]


def test_different_texts_that_share_an_id_stay(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(7, words(1), "", ""), (7, words(2), "", ""), (8, words(2), "", ""), (7, words(1), "", "")]
    left = simhash.near_duplicates_removed(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(7, words(1)), (7, words(2))]


@pytest.mark.parametrize("tile", [2, 16, 1024])
def test_links_within_hot_keys(spark, tile):
    rng = random.Random(tile)
    base = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(300):  # a crowd that shares most keys
        x = base
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [(f - (f >> 63 << 64),) for f in fps]
    comps = {r["node"] % 2**64: r["component"] for r in connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile)).collect()}
    want = plain_components(list(enumerate(fps)))
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(comps.get(f, f"alone {f}"))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (None, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_a_hot_fingerprint_and_a_hot_crowd(spark):
    """A third of the rows share a text, and another third differ in a word each."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "the same text again and again") for i in range(150)]
    rows += [(1000 + i, " ".join(words[: i % 60] + [f"x{i}"] + words[i % 60 :])) for i in range(150)]
    rows += [(5000 + i, " ".join(f"{i}-{k}" for k in range(30))) for i in range(150)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], DOCS).repartition(7)
    assert got(simhash.simhash_components(docs)) == held(docs.collect())
