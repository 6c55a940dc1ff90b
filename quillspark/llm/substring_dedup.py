"""Substring deduplication by compacted de Bruijn paths of 50-word windows.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  A window is 50 consecutive words; each
word of a window whose sequence also starts in a document of smaller id is removed.

Graph.  Windows are the edges of a de Bruijn graph, between the 49-word nodes that
overlapping windows share.  The graph is dealt into partitions by minimisers: every window has
one anchor, its 16-word k-mer of least hash (leftmost of equals), and equal windows have
equal anchors at equal places.  The consecutive windows of a text with one anchor are a
*piece*, a walk of at most 35 edges, identified by (anchor, hash of all its words).

Compaction.  An anchor that occurs in one document is dropped.  If all pieces at an
anchor are equal, no node between their edges branches: the piece is one compacted record.  Where they
differ, the piece's smallest document opens it into edges.  In- and out-degrees are counted over the
partition's edges; a join of the edges that have one successor with those that have one
predecessor finds the nodes that do not branch, and runs of edges over such nodes are
compacted into one record each.  All edges of a run are in the same pieces, so they
have one smallest document.

Verification at the source.  Each record keeps its source coordinates: the smallest document, piece and
place.  Runs are accepted only if the words there and the words of the repeating
document are equal (a join by the source piece).  Whole pieces are accepted only if the SHA-256 of
the source's words is that of the words that the repeating document has in this place, when it is cut.

Joins are by anchor, by (anchor, piece), by (anchor, edge) and by document; no
pair of documents is ever made.

Defined results: null and empty texts have no words and lose none; a text of
fewer than 50 words loses none; copies within one document stay; rows with one id
are judged each by its own words, and windows of the same id never remove each
other; rows with a null id take no part and are kept; ids may have any type with an order; extra
columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_scope
from ._common import materialize

WINDOW, KMER = 50, 16
_U = np.uint64
_BASE1, _BASE2, _BASE3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_CHUNK_BYTES = 1 << 22
_CHUNK_WORDS = 1 << 18
_RUNS_A_TASK = 1000
_powers: dict[tuple[int, bool], np.ndarray] = {}

RESULT_DDL = "kept string, n_words long, n_removed long, starts array<int>, ends array<int>"


def _power(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    key = (int(base), inverse)
    known = _powers.get(key)
    if known is None or len(known) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        step = _U(pow(int(base), -1, 1 << 64)) if inverse else base
        known = np.full(size, step, _U)
        known[0] = 1
        with np.errstate(over="ignore"):
            known = np.cumprod(known)
        _powers[key] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_chunk(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, _U)
    offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    terms = (b[inside].astype(_U) + _U(1)) * _power(_BASE1, int(sizes.max()))[place]
    return _mix(np.add.reduceat(terms, offsets) + sizes.astype(_U) * _BASE2)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words, in chunks that end at blanks."""
    if len(raw) <= _CHUNK_BYTES:
        return _hash_chunk(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK_BYTES)
        while end < len(raw) and raw[end] != 32 and not 9 <= raw[end] <= 13:
            end += 1
        out.append(_hash_chunk(raw[at:end]))
        at = end
    return np.concatenate(out)


class Rolling:
    """Hashes of all runs of words from prefix sums: of words ``a:b`` it is
    ``sum(h[i] * B^(i - a))``, the same wherever the run stands."""

    def __init__(self, hashes: np.ndarray, base: np.uint64) -> None:
        n = len(hashes)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(hashes * _power(base, n), out=self.sums[1:])
        self.back = _power(base, n + 1, inverse=True)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(_U))


def _minimizers(kmers: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` k-mers the place of the least (by its upper
    44 bits, leftmost of equals)."""
    n = len(kmers) - width + 1
    local = np.arange(len(kmers), dtype=_U)
    x = (kmers & ~_U(0xFFFFF)) | local  # places are below 2^20
    pad = (-len(x)) % width
    x = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, _U))).reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _U(0xFFFFF)).astype(np.int64)


def paths_of(hashes: np.ndarray, window: int = WINDOW, kmer: int = KMER):
    """(first window, last window, anchor, path) arrays of a text; long texts in
    chunks of windows, with no effect on the result but that a path may be cut."""
    n = len(hashes) - window + 1
    if n <= 0:
        return None
    parts = []
    for at in range(0, n, _CHUNK_WORDS):
        own = hashes[at : min(len(hashes), at + _CHUNK_WORDS + window - 1)]
        m = len(own) - window + 1
        roll = Rolling(own, _BASE3)
        i = np.arange(len(own) - kmer + 1)
        kmers = roll.of(i, i + kmer)
        place = _minimizers(kmers, window - kmer + 1)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [m])) - 1
        parts.append((first + at, last + at, kmers[place[first]].view(np.int64), roll.of(first, last + window).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _raw(text: pa.StringScalar) -> bytes:
    value = text.as_buffer()
    return value.to_pybytes() if value is not None else b""


def _piece_rows(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, docs, size = [], [], 0

            def made() -> pa.RecordBatch:
                anchor, path, n = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True))
                ids = batch.column("doc_id").take(pa.array(np.repeat([i for i, _ in docs], [k for _, k in docs])))  # noqa: B023
                return pa.RecordBatch.from_arrays([anchor, path, ids, n], names=["anchor", "path", "doc_id", "n"])

            for i, text in enumerate(batch.column("text")):
                found = paths_of(word_hashes(_raw(text)), window, kmer)
                if found is None:
                    continue
                first, last, anchor, path = found
                _, once = np.unique(np.stack((anchor, path)), axis=1, return_index=True) if len(anchor) > 1 else (None, np.zeros(1, np.int64))
                out.append((anchor[once], path[once], (last - first + 1)[once].astype(np.int32)))
                docs.append((i, len(once)))
                size += len(once)
                if size > 200_000:
                    yield made()
                    out, docs, size = [], [], 0
            if out:
                yield made()

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _source_rows(window: int, kmer: int):
    """The wanted pieces of their smallest documents: place, digest of the words, and for
    branching anchors the edges and the words."""
    names = ["anchor", "path", "place", "sha", "edges", "words"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            docs: list[int] = []

            def made() -> pa.RecordBatch:
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs)), *columns], names=["doc_id", *names])  # noqa: B023

            for i, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted"), strict=True)):
                raw = _raw(text)
                hashes = word_hashes(raw)
                found = paths_of(hashes, window, kmer)
                if found is None:
                    continue
                keys = {(w["anchor"], w["path"]): w["branches"] for w in wanted.as_py()}
                words, roll = raw.split(), None
                for a, b, anchor, path in zip(*(x.tolist() for x in found), strict=True):
                    branches = keys.pop((anchor, path), None)
                    if branches is None:
                        continue
                    own, edges = words[a : b + window], None
                    if branches:
                        roll = roll or Rolling(hashes, _BASE2)
                        p = np.arange(a, b + 1)
                        edges = roll.of(p, p + window).view(np.int64)
                    rows.append((anchor, path, a, _digest(own), edges, b" ".join(own).decode("utf-8") if branches else None))
                    docs.append(i)
                if len(rows) > 10_000:
                    yield made()
                    rows, docs = [], []
            if rows:
                yield made()

    return run


def _cut_text(text: pa.StringScalar, losses: list[dict] | None, window: int, kmer: int) -> dict:
    raw = _raw(text)
    words = raw.split()
    n = len(words)
    gone = None
    if losses:
        masks: dict[tuple[int, int], list[tuple]] = {}
        for x in losses:
            masks.setdefault((x["anchor"], x["path"]), []).append((x["lost"], x["n"], x["sha"]))
        found = paths_of(word_hashes(raw), window, kmer)
        if found is not None:
            edge = np.zeros(n + 1, np.int32)
            for a, b, anchor, path in zip(*(x.tolist() for x in found), strict=True):
                for lost, k, sha in masks.get((anchor, path), ()):
                    if lost < 0:
                        if _digest(words[a : b + window]) == sha:
                            edge[a] += 1
                            edge[b + window] -= 1
                    elif a + lost + k - 1 <= b:
                        edge[a + lost] += 1
                        edge[a + lost + k - 1 + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
    if gone is None or not gone.any():
        return {"kept": b" ".join(words).decode("utf-8"), "n_words": n, "n_removed": 0, "starts": [], "ends": []}
    runs = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
    return {"kept": kept.decode("utf-8"), "n_words": n, "n_removed": int(gone.sum()), "starts": runs[::2], "ends": runs[1::2]}


def compacted_runs(sources: DataFrame) -> DataFrame:
    """anchor, path, doc_id, lost (first edge of the run within the piece), n (edges), and the
    run's source: src (smallest document), src_path, src_off."""
    step = F.transform("edges", lambda w, i: F.struct(i.alias("off"), w.alias("edge"), F.get("edges", i - 1).alias("before"), F.get("edges", i + 1).alias("after")))
    edges = sources.where("edges is not null").select("anchor", "path", "doc_id", F.explode(step).alias("e")).select("anchor", "path", "doc_id", "e.*")
    single = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    place = lambda c: F.min_by(c, "doc_id")
    graph = edges.groupBy("anchor", "edge").agg(
        F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), place("path").alias("src_path"), place("off").alias("src_off"), single("before").alias("one_in"), single("after").alias("one_out"), F.min("after").alias("after")
    )
    graph = materialize(graph.where("src < last").select("anchor", "edge", "src", "src_path", "src_off", "one_in", "one_out", "after"))
    # the node between an edge and the next does not branch if each is the other's only one
    follows = graph.where("one_out").select("anchor", F.col("after").alias("edge")).join(graph.where("one_in").select("anchor", "edge"), ["anchor", "edge"]).distinct()
    graph = graph.join(follows.withColumn("follows", F.lit(1)), ["anchor", "edge"], "left").select("anchor", "edge", "src", "src_path", "src_off", F.coalesce("follows", F.lit(0)).alias("follows"))
    walks = edges.select("anchor", "path", "doc_id", "off", "edge").join(graph, ["anchor", "edge"])
    along = Window.partitionBy("anchor", "path", "doc_id").orderBy("off")  # at most 35 edges
    walks = walks.withColumn("run", F.sum(1 - F.col("follows")).over(along))
    first = lambda c: F.min_by(c, "off").alias(c)
    return walks.groupBy("anchor", "path", "doc_id", "run").agg(F.min("off").alias("lost"), (F.max("off") - F.min("off") + 1).alias("n"), first("src"), first("src_path"), first("src_off")).drop("run")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, out: str = "dedup") -> DataFrame:
    """``docs`` with a struct column ``out``: kept (the kept words joined by one
    space), n_words, n_removed, and the removed word ranges (starts, ends)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    usable = texts.where("doc_id is not null and text is not null")
    with scratch_scope(docs.sparkSession) as tables:
        pieces = materialize(usable.mapInArrow(_piece_rows(window, kmer), f"anchor long, path long, doc_id {kind}, n int"))
        anchors = pieces.groupBy("anchor").agg(F.min("path").alias("p0"), F.max("path").alias("p1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1")
        repeated = materialize(pieces.join(anchors.select("anchor", (F.col("p0") < F.col("p1")).alias("branches")), "anchor"))
        tables.pop()  # all pieces are not needed any more, the repeated ones are

    # the smallest document of each piece is its source
    by_piece = repeated.groupBy("anchor", "path", "branches").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), F.first("n").alias("n"))
    by_piece = materialize(by_piece.where("branches or src < last"))
    wanted = by_piece.groupBy(F.col("src").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "path", "branches")).alias("wanted"))
    source_ddl = f"doc_id {kind}, anchor long, path long, place int, sha binary, edges array<long>, words string"
    sources = materialize(usable.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_source_rows(window, kmer), source_ddl))
    # rows of one id may differ in text: of a piece's rows in its source the first place counts
    known = sources.groupBy("anchor", "path").agg(F.min("sha").alias("sha"))
    copied = repeated.join(by_piece.where("src < last").select("anchor", "path", "src"), ["anchor", "path"]).where("doc_id > src")
    whole = copied.join(known, ["anchor", "path"]).select("doc_id", "anchor", "path", F.lit(-1).alias("lost"), "n", "sha")

    runs = materialize(compacted_runs(sources))
    own = sources.where("words is not null").select("doc_id", "anchor", "path", "words").dropDuplicates(["anchor", "path"])
    # a source that many runs name is sent to several tasks
    runs = runs.where("doc_id > src")
    hot = runs.groupBy("anchor", "src_path").agg(F.ceil(F.count("*") / _RUNS_A_TASK).cast("int").alias("salts")).where("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    theirs = own.select("anchor", F.col("path").alias("src_path"), F.col("words").alias("src_words")).join(hot, ["anchor", "src_path"], "left")
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    runs = runs.join(own.select("anchor", "path", "words"), ["anchor", "path"]).join(hot, ["anchor", "src_path"], "left")
    runs = runs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path", "lost"), salts).cast("int")).drop("salts")
    checked = runs.join(theirs, ["anchor", "src_path", "salt"])
    span = F.col("n") + F.lit(window - 1)
    same = F.slice(F.split("words", " "), F.col("lost") + 1, span) == F.slice(F.split("src_words", " "), F.col("src_off") + 1, span)
    parts = checked.where(same).select("doc_id", "anchor", "path", "lost", "n", F.lit(None).cast("binary").alias("sha"))

    losses = whole.unionByName(parts).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "path", "lost", "n", "sha")).alias("_qs_losses")).withColumnRenamed("doc_id", "_qs_lost_id")

    @F.arrow_udf(RESULT_DDL)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
        for text, lost in batches:
            yield pa.array([_cut_text(t, x.as_py(), window, kmer) for t, x in zip(text, lost, strict=True)], kind)

    joined = docs.join(losses, docs[id_col] == F.col("_qs_lost_id"), "left")
    return joined.withColumn(out, cut.asNondeterministic()(F.col(text_col), F.col("_qs_losses"))).drop("_qs_lost_id", "_qs_losses")


def digest(docs: DataFrame) -> DataFrame:
    d = lambda k: F.col(f"dedup.{k}")
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", d("n_words").alias("n_words"), d("n_removed").alias("n_removed"), F.sha2(F.encode(d("kept"), "UTF-8"), 256).alias("kept_sha256"))
