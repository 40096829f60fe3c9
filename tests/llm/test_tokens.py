import hashlib

import public_tokenizers

from tessera.llm import queries, tokens
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def library():
    return tokens.byte_encoding(tokens.vocabulary(tokens.BYTE_BPE), public_tokenizers.PATTERN)


def test_documents_match_the_library(spark):
    enc = library()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = queries.op7_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pieces_of_long_texts():
    enc = library()
    for text in ["", " ", "a  b\n\n c\td's 12 ** ", "x" * 500, " \n " * 200, "wörd  'll　  z \x1f y\n" * 60, "日本 語\n" * 50]:
        for size in (1, 2, 7, 64):
            assert "".join(tokens.safe_pieces(text, size)) == text
            assert tokens.encode_bytes(text, enc, size) == enc.encode_ordinary(text)


def test_edges(spark):
    texts = [None, "", "<|endoftext|>", "🙂 é\x00", "a " * 200_000, "x" * 20_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = df.select("doc_id", tokens.encode_column(df["text"]).alias("text")).select("doc_id", "text", tokens.decode_column("text").alias("ids")).collect()
    assert {r["doc_id"]: bytes(r["ids"]).decode() for r in out} == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: list(r["text"]) for r in out} == {i: library().encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_white_space_runs():
    """Runs are one match, less the last character before text; the library takes a million at most."""
    enc = library()
    for run in (" ", "\n", " \t\n\u3000", "\u2028\x85 "):
        for text in ("a{}b", "{}", "a{}", "{}'s", "x {}1{}\n!"):
            for n in (1, 2, 3, 50, 300):
                t = text.format(run * n, run * n)
                out, at = [], 0
                for start, end in tokens.space_matches(t, 5):
                    out += enc.encode_ordinary(t[at:start]) + enc._encode_single_piece(t[start:end])
                    at = end
                assert out + enc.encode_ordinary(t[at:]) == enc.encode_ordinary(t)
    long = "a" + " " * 200_000 + "b\n" + "\n" * 150_000
    assert tokens.encode_bytes(long, enc) == enc.encode_ordinary(long)
    for text in (" " * 2_000_001 + "x y", "a " + "\n" * 2_000_000):
        ids = tokens.encode_bytes(text, enc)
        assert enc.decode_bytes(ids).decode() == text


def test_long_white_space_and_clashing_columns(spark):
    text = "a" + " " * 2_000_000 + "b"
    df = spark.createDataFrame([(1, text, [1], b"x", 1), (2, None, None, None, None)], "doc_id long, text string, ids array<int>, bytes binary, n_tokens int")
    out = df.select("doc_id", "n_tokens", tokens.decode_column(tokens.encode_column(df["text"])).alias("bytes")).collect()
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in out} == {1: text, 2: ""}
