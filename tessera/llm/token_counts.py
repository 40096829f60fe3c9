"""Token counts that follow edits.

A document's text is a sequence of pre-tokens, the matches of the tokenizer's pattern, each of which is encoded alone.  They are the leaves
of a segment tree whose nodes hold the characters and tokens below them; its lowest inner nodes have ``LEAF`` pre-tokens each and are
only taken apart where an edit falls.  The tree of a document is stored as two arrays, the characters and the tokens of each leaf, beside the text: a
later job has all sums from them without the tokenizer.

An edit matches the pattern again from the last place before it to the first place after it where a match must end, whatever
stands on the other side (white space after a character that is none); of these pre-tokens it encodes those that were not there before,
and updates the sums above.  All others keep their counts.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory
from tessera.llm.tokens import BYTE_BPE, byte_encoding, encode_bytes, vocabulary

#: pre-tokens below a lowest inner node
LEAF = 64
EDITS = "array<struct<start: long, end: long, text: string>>"
TREE = "struct<chars: array<int>, tokens: array<int>>"
SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, reencoded_chars long, edited_sha256 string"
EDITED = f"doc_id long, text string, tree {TREE}, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, reencoded_chars long"

#: a place where a match ends, and what is before it has no part in what matches after it
_BREAK = re.compile(r"(?<=\S)[ \n]")


def _last_break(text: str, end: int) -> int:
    """The last break before ``end``, or -1."""
    while True:
        end = max(text.rfind(" ", 0, end), text.rfind("\n", 0, end))
        if end <= 0:
            return -1
        if not text[end - 1].isspace():
            return end


@functools.lru_cache(maxsize=4)
def matcher(pattern: str) -> Callable[[str], list[str]]:
    """All matches in a text, in order.

    ASCII texts go through the standard library, which is faster and where letters and digits need no properties."""
    import regex

    every = regex.compile(pattern).findall
    plain = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9") if "[" not in pattern.replace(r"[^\s\p{L}\p{N}]", "") else r"\p"
    plain = re.sub(r"(?<![\w^])(a-zA-Z|0-9)(?=\+)", r"[\1]", plain)
    if r"\p" in plain:
        return every
    ascii_only = re.compile(plain, re.ASCII).findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PieceCounts:
    """Tokens of single pre-tokens; at most ``keep`` short ones are remembered."""

    def __init__(self, encoding, keep: int = 300_000):
        self.encoding, self.keep, self.known = encoding, keep, {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(encode_bytes(piece, self.encoding))
            if len(piece) <= 32 and len(self.known) < self.keep:
                self.known[piece] = n
        return n

    def many(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self(p) if n is None else n for p, n in zip(pieces, found, strict=True)]
        return np.array(found, np.int32)


@functools.lru_cache(maxsize=4)
def piece_counts(path: str, pattern: str) -> PieceCounts:
    """Of a Python worker, for all its tasks."""
    return PieceCounts(byte_encoding(path, pattern))


def leaves_of(text: str, count: PieceCounts, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token of a text."""
    pieces = matcher(pattern)(text)
    return np.fromiter(map(len, pieces), np.int32, len(pieces)), count.many(pieces)


class TokenTree:
    """Character and token sums over the pre-tokens of one text.

    ``tree``: the characters and tokens of each, as leaves() gives them; without it the whole text is encoded."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF, pattern: str | None = None, tree: tuple[np.ndarray, np.ndarray] | None = None):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self.matches = matcher(pattern or default_pattern())
        if tree is None:
            pieces = self.matches(text)
            tree = np.fromiter(map(len, pieces), np.int32, len(pieces)), np.fromiter(map(self._tokens, pieces), np.int32, len(pieces))
        chars, tokens = tree
        ends = np.cumsum(chars, dtype=np.int64)
        if (int(ends[-1]) if len(ends) else 0) != len(text):
            raise ValueError("a tree of another text")
        cuts = [*range(0, len(chars), leaf), len(chars)] if len(chars) else [0, 0]
        at = [0 if c == 0 else int(ends[c - 1]) for c in cuts]
        self.texts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        self.leaf_chars = [chars[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.leaf_tokens = [tokens[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self._sum_up()

    def _tokens(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.count(piece)

    def _sum_up(self) -> None:
        """The sums of all nodes above the lowest ones."""
        self.size = 1 << max(0, (len(self.texts) - 1).bit_length())
        rest = [0] * (self.size - len(self.texts))
        self.chars = [0] * self.size + [len(t) for t in self.texts] + rest
        self.tokens = [0] * self.size + [int(t.sum()) for t in self.leaf_tokens] + rest
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each pre-token: what is stored."""
        return np.concatenate(self.leaf_chars), np.concatenate(self.leaf_tokens)

    def _node_of(self, at: int) -> tuple[int, int]:
        """The lowest inner node with character ``at`` and the number of characters before it."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return min(k - self.size, len(self.texts) - 1), before

    def _region(self, start: int, end: int) -> tuple[int, int, int, int, int]:
        """(i, j, before, p, q): lowest nodes i to j, which begin at ``before``, and characters p to q of the text, from one break to another around the edit."""
        i, before = self._node_of(max(start - 1, 0))
        found = None
        while True:  # the last break at which both characters are before the edit
            lead = self.texts[i - 1][-1:] if i else ""
            at = _last_break(lead + self.texts[i], max(0, start - before) + len(lead))
            if at > 0:
                found = before + at - len(lead)
                break
            if i == 0:
                break
            i -= 1
            before -= len(self.texts[i])
        p = 0 if found is None else found
        j, after = self._node_of(min(end, max(self.n_chars - 1, 0)))
        q = None
        while True:  # the first break at which both characters are after the edit
            lead = self.texts[j - 1][-1:] if j else ""
            m = _BREAK.search(lead + self.texts[j], max(0, end + 1 - after) + len(lead)) if after + len(self.texts[j]) > end + 1 or j + 1 < len(self.texts) else None
            if m is not None and after + m.start() - len(lead) > end:
                q = after + m.start() - len(lead)
                break
            if j + 1 == len(self.texts):
                break
            after += len(self.texts[j])
            j += 1
        return i, j, before, p, self.n_chars if q is None else q

    def edit(self, start: int, end: int, text: str) -> None:
        """Characters ``start`` to ``end``, clipped to the text, become ``text``."""
        n = self.n_chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        i, j, before, p, q = self._region(start, end)
        one = i == j
        whole = self.texts[i] if one else "".join(self.texts[i : j + 1])
        chars, tokens = (x[i] if one else np.concatenate(x[i : j + 1]) for x in (self.leaf_chars, self.leaf_tokens))
        ends = (np.cumsum(chars) + before).tolist()
        first, last = bisect.bisect_right(ends, p), bisect.bisect_left(ends, q) + 1 if q > p else bisect.bisect_right(ends, p)
        last = min(last, len(ends))
        old, at = [], p - before
        for c in chars[first:last].tolist():
            old.append(whole[at : at + c])
            at += c
        new = self.matches(whole[p - before : start - before] + text + whole[end - before : q - before])
        same = next((k for k, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
        tail = next((k for k, (a, b) in enumerate(zip(old[same:][::-1], new[same:][::-1], strict=False)) if a != b), min(len(old), len(new)) - same)
        fresh = [self._tokens(x) for x in new[same : len(new) - tail]]
        kept = tokens[first:last]
        middle_tokens = np.concatenate([kept[:same], np.array(fresh, np.int32), kept[len(old) - tail :]]).astype(np.int32)
        middle_chars = np.fromiter(map(len, new), np.int32, len(new))
        whole = whole[: start - before] + text + whole[end - before :]
        self._replace(i, j, whole, np.concatenate([chars[:first], middle_chars, chars[last:]]).astype(np.int32), np.concatenate([tokens[:first], middle_tokens, tokens[last:]]).astype(np.int32))

    def _replace(self, i: int, j: int, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New leaves for the lowest nodes i to j; their number stays unless nodes would get too large."""
        room = j - i + 1
        nodes = room if len(chars) <= 2 * self.leaf * room else -(-len(chars) // self.leaf)
        cuts = [len(chars) * k // nodes for k in range(nodes + 1)]
        ends = np.concatenate([[0], np.cumsum(chars)])
        self.texts[i : j + 1] = [text[int(ends[a]) : int(ends[b])] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.leaf_chars[i : j + 1] = [chars[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.leaf_tokens[i : j + 1] = [tokens[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if nodes != room:
            self._sum_up()
            return
        for k in range(i, j + 1):
            at = self.size + k
            more_chars, more_tokens = len(self.texts[k]) - self.chars[at], int(self.leaf_tokens[k].sum()) - self.tokens[at]
            while at:
                self.chars[at] += more_chars
                self.tokens[at] += more_tokens
                at >>= 1


def tree_column(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The leaves of a text's tree, to be stored beside it; a null text is empty."""
    path, pattern = path or vocabulary(BYTE_BPE), pattern or default_pattern()

    @F.pandas_udf(TREE)
    def build(texts: pd.Series) -> pd.DataFrame:
        count = piece_counts(path, pattern)
        made = [leaves_of(t or "", count, pattern) for t in texts]
        return pd.DataFrame({"chars": pd.Series([c for c, _ in made], dtype=object), "tokens": pd.Series([t for _, t in made], dtype=object)})

    return build(text)


def token_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, text, tree)`` of each row of ``docs``, to be stored: what edit_trees() takes.  Texts stay as they are, a null one has an empty tree."""
    path, pattern = path or vocabulary(BYTE_BPE), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counts(path, pattern)
        for batch in batches:
            made = [leaves_of(t or "", count, pattern) for t in batch.column(1).to_pylist()]
            if made:
                tree = pa.StructArray.from_arrays([_lists([x[k] for x in made]) for k in (0, 1)], fields=list(_ARROW_TREE))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tree], names=["doc_id", "text", "tree"])
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, text string, tree {TREE}")


_ARROW_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def edit_trees(trees: DataFrame, edits: Column, *, id_col: str = "doc_id", text_col: str = "text", tree_col: str = "tree", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Stored texts and trees after edits, one row (``EDITED``) per row: to be stored in turn and edited again.

    ``edits`` is a column of ``EDITS``: character ranges of the text as the edits
    before left it, applied in order; ranges are clipped, null bounds mean the end of
    the text, null texts and null edits are empty.  A null document is empty.  Repeated rows and null ids are edited each;
    other columns are not read; an empty table gives none.  A tree that is not one of its text is an error.
    ``reencoded_chars`` counts what the edits made the tokenizer read again."""
    path, pattern = path or vocabulary(BYTE_BPE), pattern or default_pattern()
    names = [f.split()[0] for f in ("doc_id", "text", "tree", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "reencoded_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counts(path, pattern)
        for batch in batches:
            rows = []
            stored = [_slices(batch.column(k)) for k in (2, 3)]
            for r, (key, text, changes) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True)):
                tree = TokenTree(text or "", count, pattern=pattern, tree=(stored[0][r], stored[1][r]))
                first = tree.n_tokens
                for e in changes or []:
                    if e is not None:
                        start = tree.n_chars if e["start"] is None else e["start"]
                        tree.edit(start, tree.n_chars if e["end"] is None else e["end"], e["text"] or "")
                rows.append((key, tree.text(), tree.leaves(), first, len(changes or []), tree.n_tokens, tree.n_chars, tree.encoded))
            if rows:
                columns = list(zip(*rows, strict=True))
                made = pa.StructArray.from_arrays([_lists([x[k] for x in columns[2]]) for k in (0, 1)], fields=list(_ARROW_TREE))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), made, *[pa.array(c, pa.int64()) for c in columns[3:]]], names=names)
        release_memory()

    chosen = trees.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(tree_col)["chars"].alias("chars"), F.col(tree_col)["tokens"].alias("tokens"), edits.cast(EDITS).alias("edits"))
    return chosen.mapInArrow(run, EDITED)


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[a:b].astype(np.int32) for a, b in zip(at, at[1:], strict=False)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def edited_counts(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Counts before and after edits, one row (``SCHEMA``) per row of ``docs``, whose trees are made for it; otherwise as edit_trees()."""
    trees = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), edits.cast(EDITS).alias("edits")).withColumn("tree", tree_column(F.col("text"), path, pattern))
    return counts_of(edit_trees(trees, F.col("edits"), path=path, pattern=pattern))


def counts_of(edited: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` from those of ``EDITED``."""
    return edited.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "reencoded_chars", F.sha2("text", 256).alias("edited_sha256"))
