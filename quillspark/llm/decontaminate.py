"""Benchmark decontamination with an Aho-Corasick automaton.

Words are maximal runs of bytes outside ``[\\x00-/:-`{-\\x7f]`` after A-Z are
lower-cased, so any character beyond ASCII belongs to a word.  All windows of 13
consecutive words of each benchmark item (a shorter, non-empty item is one
window) go into one automaton.  Its letters are whole words: each word of the
benchmark has a number, written as two digits, so a window has 26 nodes at most, and of a
document only the runs of words of the benchmark are scanned, each once.  Hits are mapped
back to code point offsets of the original text.

The automaton is built once in a Python worker from the broadcast benchmark.  It
takes about 1.4 kB a window; a benchmark of more than ``block_windows`` words is
scanned in blocks, each with one automaton in memory at a time, built once for every
``_HELD_CHARS`` characters of documents.  The result is the same.

Defined results: a null or empty text has no words and is clean; an item without
words has no windows; repeated rows each get their own result; an item id that
occurs in several rows counts once, and so do all items without an id, whose words
count as hit but which have no name in the list of items.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..environment import require

WINDOW = 13
_WORD_BYTES = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80) else 0x20 for c in range(256))
_RESULT = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
)
RESULT_DDL = "n_words long, n_hit long, n_items long, items array<string>, starts array<long>, ends array<long>"
_HELD_CHARS = 32 << 20
_FIRST, _SECOND = 0x1, 0x4000  # code points of first and second digits
_built: dict = {}


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Matcher:
    """The automaton of some items, (id, text) each.  A word is two letters, the digits of
    its number to a base that keeps the nodes narrow; words of no item are two blanks."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW) -> None:
        texts = [(item, normal_words(text)) for item, text in items]
        known = list(dict.fromkeys(w for _, words in texts for w in words))
        base = math.isqrt(len(known)) + 1
        if base > _SECOND - _FIRST:
            raise ValueError(f"block_windows allows {len(known)} different words in a block")
        self.letters = {w: chr(_FIRST + n // base) + chr(_SECOND + n % base) for n, w in enumerate(known)}
        owners: dict[str, set] = {}
        for item, words in texts:
            line = "".join([self.letters[w] for w in words])
            for i in range(0, max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(line[2 * i : 2 * (i + size)], set()).add(item)
        self.auto = None
        if owners:
            self.auto = require("ahocorasick").Automaton()
            for w, ids in owners.items():
                self.auto.add_word(w, (len(w) // 2, tuple(ids)))
            self.auto.make_automaton()
            # only runs of known words that are long enough can hold a window
            self.runs = re.compile(f"[^\\0]{{{min(map(len, owners))},}}")

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """A hit mask over ``words`` (None: no hit) and the items that occur."""
        edge, items = None, set()
        if words and self.auto is not None:
            known = self.letters.get
            line = "".join([known(w, "\0\0") for w in words])
            for run in self.runs.finditer(line):
                for at, (n, ids) in self.auto.iter(run[0]):
                    if edge is None:
                        edge = np.zeros(len(words) + 1, np.int32)
                    last = (run.start() + at) // 2
                    edge[last - n + 1] += 1
                    edge[last + 1] -= 1
                    items.update(ids)
        return (None if edge is None else np.cumsum(edge[:-1]) > 0), items


def original_spans(text: str, mask: np.ndarray) -> tuple[list[int], list[int]]:
    """Code point ranges of runs of hit words in the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(_WORD_BYTES, np.uint8)[raw] != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    runs = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return point[starts[runs[::2]]].tolist(), point[stops[runs[1::2] - 1]].tolist()


def _matcher(key: str, number: int, block, size: int) -> Matcher:
    """Built once a worker; one is in memory at a time."""
    if (key, number) not in _built:
        _built.clear()
        _built[key, number] = Matcher(block.value, size)
    return _built[key, number]


def _scan_texts(texts: list[str | None], blocks: list, size: int, key: str) -> list[dict]:
    found: list = [(None, set())] * len(texts)
    counts = [0] * len(texts)
    for number, block in enumerate(blocks):
        matcher = _matcher(key, number, block, size)
        for i, t in enumerate(texts):
            words = normal_words(t)
            counts[i] = len(words)
            mask, items = matcher.scan(words)
            if mask is not None:
                old, had = found[i]
                found[i] = (mask if old is None else old | mask, had | items)
    out = []
    for t, n, (mask, items) in zip(texts, counts, found, strict=True):
        a, b = original_spans(t, mask) if mask is not None else ([], [])
        names = sorted(x for x in items if x is not None) + [x for x in items if x is None]
        out.append({"n_words": n, "n_hit": int(mask.sum()) if mask is not None else 0, "n_items": len(items), "items": names, "starts": a, "ends": b})
    return out


def _scanner(blocks: list, size: int, key: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[list[str | None]] = []

        def flush() -> Iterator[pa.Array]:
            found = iter(_scan_texts([t for own in held for t in own], blocks, size, key))
            for own in held:
                yield pa.array([next(found) for _ in own], _RESULT)
            held.clear()

        for batch in batches:
            held.append(batch.to_pylist())
            if len(blocks) == 1 or sum(len(t) for own in held for t in own if t) > _HELD_CHARS:
                yield from flush()
        yield from flush()

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_windows: int, size: int = WINDOW) -> list:
    """Broadcasts of items with about ``block_windows`` words each at most; a longer item is
    cut into pieces that overlap by all but one of a window's words."""
    sc = benchmark.sparkSession.sparkContext
    blocks, block, n = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator()
    for r in rows:
        words = normal_words(r.t)
        for k in range(0, max(1, len(words) - size + 1), block_windows):
            piece = words[k : k + block_windows + size - 1]
            if block and n + len(piece) > block_windows:
                blocks.append(sc.broadcast(block))
                block, n = [], 0
            block.append((r.i, b" ".join(piece).decode("utf-8", "surrogatepass")))
            n += len(piece)
    blocks.append(sc.broadcast(block))
    return blocks


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = 250_000,
    out: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, n_items, items (ids as
    strings, sorted), starts, ends (hit ranges in the original text) and
    contaminated.  A column of that name in the input is replaced.  No shuffle; the
    other columns stay on the JVM."""
    run = _scanner(benchmark_blocks(benchmark, item_col, item_text_col, block_windows, window), window, uuid.uuid4().hex)

    @F.arrow_udf(RESULT_DDL)
    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    hit = docs.withColumn(out, scan_texts.asNondeterministic()(F.col(text_col)))
    return hit.withColumn(out, F.col(out).withField("contaminated", (F.col(f"{out}.n_hit") > 0) & (20 * F.col(f"{out}.n_hit") >= F.col(f"{out}.n_words"))))


def digest(found: DataFrame, id_col: str = "doc_id", out: str = "contamination") -> DataFrame:
    c = lambda k: F.col(f"{out}.{k}")
    ids = F.array_join(c("items"), ",")
    return found.select(F.col(id_col).alias("doc_id"), c("n_words").alias("n_words"), c("n_hit").alias("n_hit"), c("n_items").alias("n_items"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), c("contaminated").alias("contaminated"))
