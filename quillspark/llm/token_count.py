"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A text is cut into leaves of about ``leaf_chars`` characters, only in front of a
space or line feed that follows a non-blank.  The splitting pattern of the
tokenizer always starts a pre-token there and never looks beyond, so the counts of
leaves add up to the count of the text.  The tree holds sums of characters and
tokens.

An edit (start, characters to delete, text to insert) re-encodes the leaves that
it touches and those next to them whose border is no longer such a place, and
updates the sums on the way to the root; all other leaves keep their counts.  The
leaves' lengths and counts are returned; given back as ``state`` with the text that
they belong to, they set up the tree without encoding anything, so a document that is edited
again and again is encoded once.

Defined results: a null or empty text has 0 tokens and an empty tree; edits apply
in order, each to the text that the one before left; starts and lengths beyond
the text are cut to it, negative ones count as 0; a null insertion is empty; a
text without a place to cut is one leaf; a state that is null or does not fit its text
counts as none.  Repeated rows each get their own result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..environment import require

LEAF_CHARS = 1024
# Fixed value: the splitting pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EDITS_DDL = "array<struct<start:long,n_delete:long,insert:string>>"
STATE_DDL = "struct<leaf_chars:array<int>,leaf_tokens:array<int>>"
RESULT_DDL = "n_tokens long, n_tokens_edited long, n_leaves long, n_encoded_chars long, n_reencoded_chars long, leaf_chars array<int>, leaf_tokens array<int>, text_edited string"
_LONGS = ("n_tokens", "n_tokens_edited", "n_leaves", "n_encoded_chars", "n_reencoded_chars")
_RESULT = pa.struct([*[(c, pa.int64()) for c in _LONGS], ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32())), ("text_edited", pa.string())])
_CUT = re.compile(r"(?<=\S)[ \n]")
_encodings: dict[str, object] = {}


def default_ranks() -> str:
    return require("public_tokenizers").path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The encoding of a rank file; read once a worker."""
    if path not in _encodings:
        tiktoken = require("tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def cut(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    leaves, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + leaf_chars)
        end = m.start() if m else len(text)
        leaves.append(text[at:end])
        at = end
    return leaves


class TokenTree:
    """``state``: lengths and counts of the leaves of this text, of an earlier tree."""

    def __init__(self, text: str, count, leaf_chars: int = LEAF_CHARS, state: tuple[list[int], list[int]] | None = None) -> None:
        self.count, self.leaf_chars, self.encoded = count, leaf_chars, 0
        if state and state[0] and len(state[0]) == len(state[1]) and sum(state[0]) == len(text) and min(state[0]) >= 0:
            ends = np.cumsum(state[0]).tolist()
            self._build([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], list(state[1]))
        else:
            self._build(cut(text, leaf_chars), None)

    def _build(self, leaves: list[str], tokens: list[int] | None) -> None:
        self.leaves = leaves
        if tokens is None:
            tokens = self.count(leaves)
            self.encoded += sum(map(len, leaves))
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        sums = np.zeros((2 * self.size, 2), np.int64)
        if leaves:
            sums[self.size : self.size + len(leaves), 0] = [len(x) for x in leaves]
            sums[self.size : self.size + len(leaves), 1] = tokens
        span = self.size
        while span > 1:
            sums[span // 2 : span] = sums[span : 2 * span].reshape(-1, 2, 2).sum(1)
            span //= 2
        self.sums = sums

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def tokens(self) -> list[int]:
        return self.sums[self.size : self.size + len(self.leaves), 1].tolist()

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at``, and the place within it (the last leaf's end for the text's end)."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.sums[node, 0] and self.sums[node + 1, 0] > 0:
                at -= int(self.sums[node, 0])
                node += 1
        return min(node - self.size, len(self.leaves) - 1), at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        self.sums[node] = len(text), tokens
        node //= 2
        while node:
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            node //= 2

    def edit(self, start: int, n_delete: int, insert: str) -> None:
        start = max(0, min(start, self.n_chars))
        stop = min(self.n_chars, start + max(0, n_delete))
        if not self.leaves:
            self._build(cut(insert, self.leaf_chars), None)
            return
        a, at = self._find(start)
        b, end = self._find(stop)
        middle = self.leaves[a][:at] + insert + self.leaves[b][end:]
        # extend to borders where the pattern surely starts a pre-token
        while a > 0 and not (middle and self._border(a, middle)):
            a -= 1
            middle = self.leaves[a] + middle
        while b + 1 < len(self.leaves) and not (middle and self._starts(b, middle)):
            b += 1
            middle += self.leaves[b]
        parts = cut(middle, self.leaf_chars)
        counts = self.count(parts)
        self.encoded += len(middle)
        room = b - a + 1
        if len(parts) <= room:
            for i in range(room):
                self._set(a + i, parts[i] if i < len(parts) else "", counts[i] if i < len(parts) else 0)
        else:
            old = self.tokens()
            self._build(self.leaves[:a] + parts + self.leaves[b + 1 :], old[:a] + counts + old[b + 1 :])

    def _border(self, a: int, middle: str) -> bool:
        before = next((self.leaves[i][-1] for i in range(a - 1, -1, -1) if self.leaves[i]), None)
        return before is None or (not before.isspace() and middle[0] in " \n")

    def _starts(self, b: int, middle: str) -> bool:
        after = next((self.leaves[i][0] for i in range(b + 1, len(self.leaves)) if self.leaves[i]), None)
        return after is None or (after in " \n" and not middle[-1].isspace())


def counter(path: str):
    """A function from texts to their token counts."""
    encode = encoding(path).encode_ordinary
    return lambda texts: [len(encode(x)) for x in texts]


def n_tokens(text: Column, *, ranks_path: str | None = None) -> Column:
    """The token count of a text (null: 0), for operators that need no tree."""
    path = ranks_path or default_ranks()

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path)
        for batch in batches:
            yield pa.array([count([x.as_py() or ""])[0] for x in batch], pa.int64())

    return run.asNondeterministic()(text)


def count_tokens(
    docs: DataFrame, *, text_col: str = "text", edits: Column | None = None, state: Column | None = None, keep_text: bool = False, ranks_path: str | None = None, leaf_chars: int = LEAF_CHARS, out: str = "tokens"
) -> DataFrame:
    """``docs`` with a struct column ``out``: the counts before and after ``edits``
    (an array column, see EDITS_DDL), the characters encoded in all and for the edits,
    the leaves after the edits, and the edited text if ``keep_text``.  With ``state`` (a struct of leaf_chars
    and leaf_tokens from an earlier result for this text) no other leaves are encoded than
    those that the edits touch.  No shuffle."""
    path = ranks_path or default_ranks()
    edits = (F.array() if edits is None else F.coalesce(edits, F.array())).cast(EDITS_DDL)
    state = (F.lit(None) if state is None else F.struct(state["leaf_chars"].alias("leaf_chars"), state["leaf_tokens"].alias("leaf_tokens"))).cast(STATE_DDL)

    @F.arrow_udf(RESULT_DDL)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = counter(path)
        for texts, changes, states in batches:
            rows = []
            for text, own, known in zip(texts, changes, states, strict=True):
                k = known.as_py() or {}
                kept = (k["leaf_chars"], k["leaf_tokens"]) if k.get("leaf_chars") and k.get("leaf_tokens") and None not in k["leaf_chars"] + k["leaf_tokens"] else None
                tree = TokenTree(text.as_py() or "", count, leaf_chars, kept)
                before, first = tree.n_tokens, tree.encoded
                for e in own.as_py() or ():
                    if e:
                        tree.edit(e["start"] or 0, e["n_delete"] or 0, e["insert"] or "")
                sums = (before, tree.n_tokens, len(tree.leaves), tree.encoded, tree.encoded - first)
                rows.append(dict(zip(_LONGS, sums, strict=True)) | {"leaf_chars": [len(x) for x in tree.leaves], "leaf_tokens": tree.tokens(), "text_edited": tree.text() if keep_text else None})
            yield pa.array(rows, _RESULT)

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col), edits, state))


def gather_edits(edits: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """A table of edits (id, edit_no, start, n_delete, insert) as one ordered array an id."""
    one = F.struct("edit_no", F.struct(F.col("start").cast("long"), F.col("n_delete").cast("long"), F.col("insert")).alias("edit"))
    return edits.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["edit"]).alias("edits"))


def review_edits(text: Column) -> Column:
    """The edits of the query: an insertion after a third, a deletion in the
    middle and a replacement near the end of every text."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    edit = lambda start, k, s: F.struct(start.cast("long").alias("start"), F.lit(k).cast("long").alias("n_delete"), F.lit(s).alias("insert"))
    return F.array(edit(F.floor(n / 3), 0, " (reviewed) "), edit(F.floor(n / 2), 7, ""), edit(F.floor(n * 3 / 4), 4, "x\n"))


def digest(docs: DataFrame) -> DataFrame:
    t = lambda k: F.col(f"tokens.{k}").alias(k)
    return count_tokens(docs, edits=review_edits(F.col("text"))).select("doc_id", t("n_tokens"), t("n_tokens_edited"), t("n_leaves"), t("n_reencoded_chars"))
