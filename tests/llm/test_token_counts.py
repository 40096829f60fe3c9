import hashlib
import random

import public_tokenizers

from tessera.llm import queries, token_counts, tokens
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def library():
    return tokens.byte_encoding(tokens.vocabulary(tokens.BYTE_BPE), public_tokenizers.PATTERN)


def test_random_edits_match_a_fresh_count():
    enc, rng = library(), random.Random(7)
    bits = [" ", "\n", "  ", "word", "Wörter", "'s", "12", "!?", "日本", "🙂", "\t", " the", "x" * 30]
    for leaf in (1, 4, 16, 64):
        for _ in range(60):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
            tree = token_counts.TokenTree(text, lambda t: len(enc.encode_ordinary(t)), leaf)
            for _ in range(25):
                start = rng.randrange(-2, len(text) + 3)
                end = start + rng.randrange(-1, 12)
                new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 0, 1, 2, 40])))
                a = min(max(start, 0), len(text))
                b = min(max(end, a), len(text))
                text = text[:a] + new + text[b:]
                tree.edit(start, end, new)
                assert tree.text() == text and tree.n_chars == len(text)
                assert tree.n_tokens == len(enc.encode_ordinary(text))


def test_only_what_is_touched_is_read_again():
    enc = library()
    tree = token_counts.TokenTree("some words here " * 20_000, lambda t: len(enc.encode_ordinary(t)))
    read = tree.encoded
    for k in range(100):
        tree.edit(3000 * k, 3000 * k + 5, "other")
    assert tree.encoded - read < 100 * 4 * token_counts.LEAF


def test_query_against_brute_force(spark):
    from pyspark.sql import functions as F

    enc = library()
    at = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.length("text") + 1)
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").select("doc_id", "text", at(1).alias("a"), at(2).alias("b"), at(3).alias("c")).collect()}
    rows = queries.op5_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r["doc_id"]]
        text, n = d["text"], len(d["text"])
        text = text[: d["a"]] + text[d["a"] + 40 :]
        b = min(d["b"], len(text))
        text = text[:b] + " [note 1] " + text[b:]
        text = text[: d["c"]] + "x" + text[d["c"] :]
        text = text[: max(0, n - 10)] + "\nEnd."
        assert r["n_tokens"] == len(enc.encode_ordinary(d["text"])) and r["n_edits"] == 4
        assert r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["n_tokens_edited"] == len(enc.encode_ordinary(text)) and r["n_chars_edited"] == len(text)


def test_edges(spark):
    rows = [(1, None, None), (None, "", [(0, 0, "a b")]), (2, "a b c", [None, (None, None, " d"), (1, None, None), (-5, 99, "new")]), (3, "w " * 300_000, [(10, 20, "x" * 5000)]), (2, "a b c", [])]
    rows = [(*r, 1, "x") for r in rows]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}, n_tokens long, id string")
    out = token_counts.edited_counts(df, df["edits"]).collect()
    assert sorted((r["n_edits"], r["n_chars_edited"]) for r in out) == sorted([(0, 0), (1, 3), (4, 3), (1, 604_990), (0, 5)])
    assert token_counts.edited_counts(df.limit(0), df["edits"]).count() == 0


def test_long_white_space():
    enc = library()
    tree = token_counts.TokenTree("a b" + " " * 1_200_000 + "c", lambda t: len(tokens.encode_bytes(t, enc)))
    tree.edit(1_000_000, 1_000_000, "x")
    head, tail = "a b" + " " * 999_997 + "x", " " * 200_003 + "c"
    assert tree.text() == head + tail
    assert tree.n_tokens == len(enc.encode_ordinary(head)) + len(enc.encode_ordinary(tail))


def test_a_later_job_reads_stored_trees(spark, tmp_path):
    """Each job stores what it made; the next encodes only what its edits touch, and counts stay those of a fresh count."""
    from pyspark.sql import functions as F

    enc, rng = library(), random.Random(9)
    bits = [" ", "\n", "word", "Wörter", "'s", "12", "!?", "日本", "🙂", " the", " quick"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.choice([0, 5, 400, 3000]))) for i in range(40)}
    df = spark.createDataFrame([(i, t or None, 3) for i, t in texts.items()], "doc_id long, text string, n_tokens int")
    token_counts.token_trees(df).write.parquet(f"{tmp_path}/0")
    assert df.select("doc_id", "text", token_counts.tree_column(F.col("text")).alias("tree")).exceptAll(spark.read.parquet(f"{tmp_path}/0")).isEmpty()
    stored = spark.read.parquet(f"{tmp_path}/0")
    for r in stored.collect():
        pieces = token_counts.matcher(public_tokenizers.PATTERN)(texts[r["doc_id"]])
        assert r["tree"]["chars"] == [len(p) for p in pieces] and r["tree"]["tokens"] == [len(enc.encode_ordinary(p)) for p in pieces]
    for job in range(1, 4):
        edits = F.array(F.struct(F.lit(50 * job).alias("start"), F.lit(50 * job + 3).alias("end"), F.lit("ab ").alias("text")), F.struct(F.lit(700).alias("start"), F.lit(700).alias("end"), F.lit("z").alias("text")))
        token_counts.edit_trees(spark.read.parquet(f"{tmp_path}/{job - 1}"), edits).write.parquet(f"{tmp_path}/{job}")
        rows = spark.read.parquet(f"{tmp_path}/{job}").collect()
        for r in rows:
            text = texts[r["doc_id"]]
            text = text[: 50 * job] + "ab " + text[50 * job + 3 :]
            texts[r["doc_id"]] = text = text[:700] + "z" + text[700:]
            assert r["text"] == text and r["n_chars_edited"] == len(text) == sum(r["tree"]["chars"])
            assert r["n_tokens_edited"] == len(enc.encode_ordinary(text)) == sum(r["tree"]["tokens"])
            assert r["reencoded_chars"] <= 150
        assert sum(r["reencoded_chars"] for r in rows) < 0.02 * sum(map(len, texts.values()))


def test_a_tree_of_another_text_is_refused():
    import numpy as np
    import pytest

    with pytest.raises(ValueError, match="another text"):
        token_counts.TokenTree("abc", len, tree=(np.array([2], np.int32), np.array([1], np.int32)))


def test_matches_of_ascii_texts_are_those_of_the_pattern():
    import regex

    ours, library_ = token_counts.matcher(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(10)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(128), 32, 32, 10, 39, 115, 65])) for _ in range(rng.randrange(30)))
        assert ours(text) == library_.findall(text)
    assert token_counts.matcher(r"\p{Lu}+|.")("ABc") == ["AB", "c"]
    assert token_counts.matcher(r"[\p{L}x]+|\p{N}")("ab1") == ["ab", "1"]
