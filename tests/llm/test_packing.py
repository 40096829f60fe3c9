import random
import zlib
from collections import defaultdict

import numpy as np

from tessera.llm import packing, queries
from tessera.llm.common import table
from tessera.llm.tokens import WORD_BPE, vocabulary

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(WORD_BPE))
    t.encode_special_tokens = True
    return t


def check(rows, docs, window=2048):
    """rows of pieces against documents [(id, text)] with distinct ids."""
    t = library()
    ids = {k: t.encode(text or "", add_special_tokens=False).ids + [1] for k, text in docs}
    covered, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == covered[r["doc_id"]] and r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        want = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(want)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {k: len(v) for k, v in ids.items()}
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_documents_whole_and_nearly_without_padding(spark):
    docs = table(spark, SF, "documents")
    rows = queries.op1_packing(spark, SF).collect()
    padding = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert padding == 0


def test_edges(spark):
    texts = [None, "", " ", "One two\ttwo", "ΑΣ ΣΑ Σ", "é é ́x", "<|endoftext|>", "x" * 100, "a b c\x1fd", "it's 1234 *** don't", "w " * 5000, "İstanbul ǅ ß", "日本語のテキスト " * 40]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ids string").coalesce(1)
    out = packing.pack(df)
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in out.collect()]
    check(rows, docs)
    assert packing.pack(df.limit(0)).count() == 0
    again = packing.pack(spark.createDataFrame([(None, "a"), (2**60 + 1, "a"), (2**60 + 1, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted(str(r["doc_id"]) for r in again) == sorted(["None", str(2**60 + 1), str(2**60 + 1)])


def test_best_fit_is_the_tightest_window():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, window) for _ in range(rng.randrange(40))]
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                want.append(min(fits))
                room.remove(min(fits))
            else:
                want.append(window)
            room.append(want[-1] - lengths[i])
        tree_windows = packing.best_fit_decreasing(lengths, window)
        assert sorted(window - sum(lengths[i] for i in w) for w in tree_windows) == sorted(room)


def test_plan_covers_everything():
    rng = random.Random(4)
    for _ in range(300):
        window = rng.choice([8, 64, 2048])
        lengths = [rng.randint(1, 3 * window) for _ in range(rng.randrange(30))]
        got = packing.plan(lengths, window)
        pieces = sorted(p for s in got for p in s)
        for i, n in enumerate(lengths):
            at = 0
            for _, start, length in [p for p in pieces if p[0] == i]:
                assert start == at and length > 0
                at += length
            assert at == n
        used = [sum(p[2] for p in s) for s in got]
        assert all(0 < u <= window for u in used)
        assert sum(u != window for u in used) <= window.bit_length() and all(u & (u - 1) == 0 for u in used)
