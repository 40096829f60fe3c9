"""Public tokenizers for executors: word BPE by the tokenizers library, byte-level BPE by tiktoken.

Vocabulary files are parameters and are read where they lie on each machine; each
Python worker loads one once.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts by a tokenizer file whose pre-tokenizer never joins across white space.

    Texts are cut at spaces and line ends; each distinct chunk goes to the library
    once and is then looked up.  At most ``keep`` chunks and those of one call are
    held: beyond that the later half goes, as frequent chunks are met early.  ASCII
    texts are lower-cased first, where ``lowercase`` says that the file does so
    itself, so that fewer chunks are distinct."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # control strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.lowercase = '"type":"Lowercase"' in self.library.to_str()
        self.keep, self.known = keep, {}

    def _chunks(self, text: str | None) -> list[str]:
        text = (text or "").replace("\n", " ")
        return (text.lower() if self.lowercase and text.isascii() else text).split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids for each text; a null text is empty."""
        cut = list(map(self._chunks, texts))
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if len(self.known) + len(new) > self.keep:
            self.known = dict(islice(self.known.items(), self.keep // 2))
            new = list(set(chain.from_iterable(cut)).difference(self.known))
        code = self.code
        for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[w] = array(code, e.ids).tobytes()
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, words)), self.dtype) for words in cut]
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return out


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=4)
def byte_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = 1 << 16) -> Iterable[str]:
    """``text`` in pieces of about ``size`` characters, cut only where a match must end.

    A match of the byte-level patterns is white space alone, or at most one leading
    space and then no white space; so one always ends between a character that is
    not white space and a following space or line end, and what comes before that
    place has no part in what matches after it."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        if at == len(text):
            break
        yield text[start:at]
        start = at
    yield text[start:]


#: a run of Unicode's White_Space, as the patterns' \\s has it
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: white space in a row beyond this does not go through the library's regex, whose stack ends at a million
LONG_RUN = 1 << 16


def space_matches(text: str, least: int = LONG_RUN) -> Iterator[tuple[int, int]]:
    """The matches of more than ``least`` white-space characters: a run, less its last one where text follows."""
    for m in _SPACES.finditer(text):
        start, end = m.span()
        if end < len(text):
            end -= 1
        if end - start > least:
            yield start, end


def encode_bytes(text: str | None, encoding, size: int = 1 << 16) -> list[int]:
    """Ids of a whole text, as the library gives them; white-space runs of any length are one match each."""
    if not text:
        return []
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    out: list[list[int]] = []
    at = 0
    for start, end in space_matches(text):
        out += map(encoding.encode_ordinary, safe_pieces(text[at:start], size))
        out.append(encoding._encode_single_piece(text[start:end]))
        at = end
    out += map(encoding.encode_ordinary, safe_pieces(text[at:], size))
    return list(chain.from_iterable(out))


def encode_column(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Ids of a text column by byte-level BPE, ``array<int>``; null and empty texts give an empty array."""
    import public_tokenizers

    path, pattern = path or vocabulary(BYTE_BPE), pattern or public_tokenizers.PATTERN

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        encoding = byte_encoding(path, pattern)
        return pd.Series([np.array(encode_bytes(t, encoding), np.int32) for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that ids stand for; an unknown id is an error, a null row is empty."""
    import public_tokenizers

    path, pattern = path or vocabulary(BYTE_BPE), pattern or public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        encoding = byte_encoding(path, pattern)
        return pd.Series([encoding.decode_bytes([] if r is None else r.tolist()) for r in rows], dtype=object)

    return decode(ids)
