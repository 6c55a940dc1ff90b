"""Near-duplicate classes with Order MinHash and banded alignment.

Words are normalised as in benchmark decontamination.  Two texts are linked if and
only if the alignment of their word sequences is good enough: with ``d`` the least
number of inserted, deleted and replaced words, ``1 - d / max(n, m)`` is 0.8 or more.
Classes are the connected components of the links, named by their smallest id.

1. Texts of equal words are one exact class, which goes on as one *node*, a 64-bit
   hash of its words; ids play no part before the end.
2. Order MinHash: the k-mers of a text are labelled with their occurrence number;
   for each of some hash functions the least ones are taken and hashed **in text
   order** into one bucket key.  k is 5 words.  Edits that leave a similarity of 0.8
   may break every 5-mer of a text of some dozen words, so texts of up to
   80 words are sampled by their 2-mers, those of up to 24 by single words as well
   (:data:`SCALES`; the ranges overlap by more than the ratio of lengths that a link
   allows, so both texts of a link always share a scale).
3. Star: a bucket's hub is its smallest node; each node is aligned with its smallest hub.
4. Every other pair that shares a bucket: buckets of one hub are one *family*.  Families whose
   members are in several components are dealt in blocks of :data:`BLOCK` members; a task compares
   the profiles (counts of words by bins) of all pairs of different components whose lengths allow a link,
   and leaves out those whose profiles differ by more edits than a link has.  Members with pairs that
   are left go, with their texts, to a task that aligns all of these pairs, nearest first; it leaves out
   those that its links have joined already, and returns links only, fewer than it has members.
5. Verification: bounds by common words and 3-mers, then the alignment within a band
   of diagonals, widened until it holds the best path or exceeds the limit.

So a link is missed only if its texts share no bucket, and no chain of links joins them.  Measured
for replaced words at random places: of the links of similarity 0.8 a share of 0.90 to
0.99 by length meets in a bucket, at 0.85 above 0.97, at 0.9 above 0.995.
Profiles compared grow with the square of a family, rows only with the square of its blocks.

Defined results: null and empty texts, and texts without words, are classes of
their own; texts of fewer than 5 words are linked to equal ones only; rows of one id
share a class, whatever their texts; a row with a null id gets the class of
its text among the rows with an id, or null.  Ids may have any type with an order;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .decontaminate import _WORD_BYTES
from .substring_dedup import _BASE2, _BASE3, Rolling, _mix, word_hashes

THRESHOLD = 0.8
#: (k, k-mers a key, keys, least and most words of a text)
SCALES = ((1, 3, 16, 4, 24), (2, 2, 14, 16, 80), (5, 2, 72, 56, None))
_U = np.uint64
_CHUNK = 2048
#: Bins of a profile are 2 ** _BITS; pairs that are looked at together.
_BITS, _AT_ONCE = 8, 1 << 18
#: Members of a bucket that one task compares with those of another such block.
BLOCK = 1024
_MAX = np.iinfo(np.uint64).max
_GOLDEN = _U(0x9E3779B97F4A7C15)


# -- words and keys ------------------------------------------------------------
def words_of(text: str | bytes | None) -> np.ndarray:
    """Hashes of the normalised words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return word_hashes(raw.translate(_WORD_BYTES))


def occurrences(items: np.ndarray) -> np.ndarray:
    """The number of equal items before each one."""
    order = np.argsort(items, kind="stable")
    own = items[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    starts = np.flatnonzero(new)
    out = np.empty(len(items), np.int64)
    out[order] = np.arange(len(own)) - starts[np.cumsum(new) - 1]
    return out


def labelled(items: np.ndarray) -> np.ndarray:
    """Hashes of (item, occurrence number), all distinct."""
    return _mix(items + occurrences(items).astype(_U) * _GOLDEN) if len(items) else items


def kmers_of(words: np.ndarray, k: int) -> np.ndarray:
    if k == 1 or not len(words):
        return words
    i = np.arange(max(1, len(words) - k + 1))
    return Rolling(words, _BASE3).of(i, np.minimum(i + k, len(words)))


def omh_keys(own: np.ndarray, sketches: int, size: int, salt: int = 0) -> np.ndarray:
    """One key for each hash function: its ``size`` least elements in text order."""
    number = np.arange(1, sketches + 1, dtype=_U) + _U(salt << 16)
    seeds, factors = _mix(number * _GOLDEN)[:, None], _mix(number * _BASE2)[:, None] | _U(1)
    size, row = min(size, len(own)), np.arange(sketches)
    best = np.zeros((sketches, 0), _U)
    place = np.zeros((sketches, 0), np.int64)
    for at in range(0, len(own), _CHUNK):
        h = (own[None, at : at + _CHUNK] ^ seeds) * factors
        values, places = [best], [place]
        for _ in range(min(size, h.shape[1])):
            i = h.argmin(axis=1)
            values.append(h[row, i][:, None])
            places.append(i[:, None] + at)
            h[row, i] = _MAX
        v, p = np.hstack(values), np.hstack(places)
        if at or v.shape[1] > size:
            o = np.argsort(v, axis=1, kind="stable")[:, :size]
            v, p = np.take_along_axis(v, o, 1), np.take_along_axis(p, o, 1)
        best, place = v, p
    least = own[np.sort(place, axis=1)]
    key = number
    for j in range(size):
        key = _mix(key * _GOLDEN + least[:, j])
    return key


def node_of(words: np.ndarray) -> int:
    end = np.array([len(words)])
    a, b = (Rolling(words, base).of(np.array([0]), end) for base in (_BASE3, _BASE2))
    return int(_mix(a + _mix(b)).view(np.int64)[0])


def keys_of(words: np.ndarray) -> np.ndarray:
    n = len(words)
    parts = [omh_keys(labelled(kmers_of(words, k)), sketches, size, k) for k, size, sketches, low, high in SCALES if n >= low and (high is None or n <= high)]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def _raw(text: pa.Scalar) -> bytes:
    value = text.as_buffer()
    return value.to_pybytes() if value is not None else b""


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, keys = [], [], []
        for text in batch.column("text"):
            words = words_of(_raw(text))
            nodes.append(node_of(words) if len(words) else None)
            sizes.append(len(words))
            keys.append(keys_of(words))
        made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *made], names=["doc_id", "th", "node", "n", "keys"])


# -- alignment -------------------------------------------------------------------
def _limit(n: int, m: int, threshold: float) -> int:
    return int((1 - threshold) * max(n, m) + 1e-9)


def band_distance(a: list[int], b: list[int], band: int) -> int | None:
    """The edit distance of ``a`` and ``b`` if it is ``band`` or less, from the
    diagonals up to ``band`` off the main one; the column of the matrix is a bit
    vector of differences (Myers 1999), its window moves one row down with each
    column (Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > band:
        return None
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << (i + band)
    mask = (1 << (2 * band + 1)) - 1
    up, down = mask ^ ((1 << band) - 1), 0
    cost, corner = len(a) - len(b), 1 << (band + len(a) - len(b))
    for j, y in enumerate(b):
        same = (place.get(y, 0) >> j) & mask
        free = ((((same & up) + up) ^ up) | same | down) & mask
        if not free & corner:
            cost += 1
            if cost > band:
                return None
        right, left = down | (mask ^ (free | up)), up & free
        free >>= 1
        up, down = left | (mask ^ (free | right)), free & right
    return cost


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two word sequences if it is ``limit`` or less, else None."""
    n = min(len(a), len(b))
    if max(len(a), len(b)) - n > limit:
        return None
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    longest = max(len(a), len(b))
    if not len(a) or not len(b):
        return longest if longest <= limit else None
    for k in (1, 3):  # each edit breaks at most k k-mers
        if longest >= k and longest - k + 1 - len(np.intersect1d(labelled(kmers_of(a, k)), labelled(kmers_of(b, k)), assume_unique=True)) > k * limit:
            return None
    x, y = a.tolist(), b.tolist()
    band = min(limit, max(16, abs(len(x) - len(y))))
    while True:
        found = band_distance(x, y, band)
        if found is not None or band >= limit:
            return found
        band = min(limit, 4 * band)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two texts, as word hashes, are linked."""
    return bool(len(a) and len(b)) and distance(a, b, _limit(len(a), len(b), threshold)) is not None


def _verify_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, words = a, words_of(_raw(ta))
                keep.append(aligned(words, words_of(_raw(tb)), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The linked ones of ``pairs`` (a, b); ``texts``: node, text."""
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.select("a", "b").distinct().join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_verify_rows(threshold), "a long, b long")


# -- the rest of the pairs -----------------------------------------------------------
def profile_of(words: np.ndarray) -> bytes:
    """How many words fall into each of some bins, 255 at most."""
    return np.minimum(np.bincount((_mix(words) >> _U(64 - _BITS)).astype(np.int64), minlength=1 << _BITS), 255).astype(np.uint8).tobytes()


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words_of(_raw(text)) for text in batch.column("text")]
        made = [pa.array([len(w) for w in found], pa.int32()), pa.array([profile_of(w) for w in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *made], names=["node", "n", "profile"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold each group whole; the rows are sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own], axis=0))
        if len(new):
            cut = int(new[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(group: np.ndarray, block: np.ndarray, across: np.ndarray, component: np.ndarray, n: np.ndarray, profile: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of all pairs within groups (of which those ``across`` want pairs of
    different blocks only) that are in different components and may be linked, and the least share
    of edits.  An edit adds one word to a bin, takes one from another, or both, so a
    link's profiles differ by no more than its edits.  Rows are sorted by group and n."""
    at, size = np.arange(len(n)), np.int64(1) << 40
    most = np.searchsorted(group * size + n, group * size + np.minimum((n + 1e-6) / threshold, size - 1).astype(np.int64), side="right")
    each = np.maximum(most - at - 1, 0)
    upto, full, first = np.cumsum(each), profile.sum(axis=1, dtype=np.int64), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _AT_ONCE, side="right")))
        count = each[first:last]
        a = np.repeat(at[first:last], count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        first = last
        wanted = (component[a] != component[b]) & ((block[a] != block[b]) | ~across[a])
        a, b = a[wanted], b[wanted]
        limit = ((1 - threshold) * n[b] + 1e-9).astype(np.int64)
        least = np.empty(len(a), np.int64)
        for k in range(0, len(a), _CHUNK):
            x, y = a[k : k + _CHUNK], b[k : k + _CHUNK]
            common = np.minimum(profile[x], profile[y]).sum(axis=1, dtype=np.int64)
            least[k : k + _CHUNK] = np.maximum(full[x], full[y]) - common
        may = np.maximum(least, n[b] - n[a]) <= limit
        yield a[may], b[may], least[may] / np.maximum(n[b[may]], 1)


def _near_rows(threshold: float):
    """The rows that have a pair which this group decides and which may be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["family", "i", "j"]):
            family, i, j, block, component, n = (rows.column(k).to_numpy() for k in ("family", "i", "j", "block", "component", "n"))
            new = (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.concatenate(([0], np.cumsum(new)))
            profile = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint8).reshape(len(n), -1)
            hubs, near = [frozenset(x) for x in rows.column("hubs").to_pylist()], np.zeros(len(n), np.bool_)
            for a, b, _ in near_pairs(group, block, i != j, component, n.astype(np.int64), profile, threshold):
                for x, y, f in zip(a.tolist(), b.tolist(), family[a].tolist(), strict=True):
                    if not (near[x] and near[y]) and _decides(hubs, f, x, y):
                        near[x] = near[y] = True
            yield from rows.drop_columns(["profile"]).filter(pa.array(near)).combine_chunks().to_batches()

    return run


def _decides(hubs: list[frozenset[int]], family: int, x: int, y: int) -> bool:
    """A pair of several families is left to the first of them."""
    return min(hubs[x] & hubs[y]) == family


def group_links(family: int, block: np.ndarray, across: bool, component: np.ndarray, hubs: list[frozenset[int]], words: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Places of the links of a group that join its components: its pairs are aligned, nearest
    profiles first, but for those that links before have joined.  Rows are sorted by length."""
    zero, n = np.zeros(len(words), np.int64), np.array([len(w) for w in words], np.int64)
    profile = np.stack([np.frombuffer(profile_of(w), np.uint8) for w in words])
    pairs = list(near_pairs(zero, block, np.full(len(n), across), component, n, profile, threshold))
    if not pairs:
        return []
    a, b, share = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(share, kind="stable")
    root = np.unique(component, return_inverse=True)[1].tolist()
    top, found = list(range(len(root))), []

    def top_of(x: int) -> int:
        x = root[x]
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        u, v = top_of(x), top_of(y)
        if u != v and _decides(hubs, family, x, y) and aligned(words[x], words[y], threshold):
            top[u] = v
            found.append((x, y))
    return found


def _link_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["family", "i", "j"]):
            family, i, j, block, node, component = (rows.column(k).to_numpy() for k in ("family", "i", "j", "block", "node", "component"))
            starts = np.flatnonzero((family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            links: list[tuple[int, int]] = []
            for first, last in zip([0, *starts.tolist()], [*starts.tolist(), len(node)], strict=True):
                own = slice(first, last)
                part = rows.slice(first, last - first)
                hubs, words = [frozenset(x) for x in part.column("hubs").to_pylist()], [words_of(_raw(t)) for t in part.column("text")]
                pairs = group_links(int(family[first]), block[own], bool(i[first] != j[first]), component[own], hubs, words, threshold)
                links += [(first + x, first + y) for x, y in pairs]
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]], pa.int64()), pa.array(node[ends[:, 1]], pa.int64())], names=["a", "b"])

    return run


# -- components --------------------------------------------------------------------
def components(links: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) of the nodes in ``links`` (a, b), by
    alternating large and small stars.  Each round is written to the shared
    folder; only a count and a checksum come to the driver.  Raises if the stars
    still change after ``max_rounds``."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, seen = materialize(edges), None
    for _ in range(max_rounds):
        # large star: the larger neighbours of u go to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        seen = now
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _placed(rows: DataFrame, groups: DataFrame, node: str, out: str) -> DataFrame:
    """``rows`` with the group of column ``node`` (itself, if in none)."""
    own = groups.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(own, F.col(node) == F.col("_n"), "left").withColumn(out, F.coalesce("_c", node)).drop("_n", "_c")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id: one row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    sketched = materialize(texts.mapInArrow(_sketch_rows, f"doc_id {kind}, th long, node long, n int, keys array<long>"))
    exact = sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("name"), F.min(F.struct("doc_id", "th")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    exact = materialize(exact)

    buckets = exact.select("node", F.explode("keys").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("bucket", "hub")
    members = materialize(buckets.join(hubs, "bucket"))

    wanted = exact.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("row.doc_id").alias("w_id"), F.col("row.th").alias("th"))
    chosen = texts.join(wanted, (texts.th == wanted.th) & texts.doc_id.eqNullSafe(F.col("w_id"))).select("node", "text")
    own_texts = materialize(chosen.groupBy("node").agg(F.first("text").alias("text")))
    sizes = exact.select("node", "n")

    def sized(pairs: DataFrame) -> DataFrame:
        """a, b: pairs of a hub and a node whose lengths allow a link."""
        rows = pairs.select("hub", "node").distinct().join(sizes, "node").join(sizes.select(F.col("node").alias("hub"), F.col("n").alias("m")), "hub")
        return rows.where(F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9).select(F.col("hub").alias("a"), F.col("node").alias("b"))

    first = verify(sized(members.where("node != hub").groupBy("node").agg(F.min("hub").alias("hub"))), own_texts, threshold)
    of_id = sketched.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same_id = sketched.join(of_id, "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    found = materialize(components(first.unionByName(same_id)))

    family = materialize(members.select(F.col("hub").alias("family"), "node").distinct())
    hubs_of = family.groupBy("node").agg(F.collect_list("family").alias("hubs"))
    profiles = materialize(own_texts.mapInArrow(_profile_rows, "node long, n int, profile binary").join(hubs_of, "node"))

    placed = _placed(family, found, "node", "component")
    mixed = placed.groupBy("family").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = placed.join(mixed.select("family", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "family")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "to")).withColumn("j", F.greatest("block", "to"))
    rows = rows.join(profiles, "node").select("family", "i", "j", "block", "node", "component", "n", "hubs", "profile")

    def by_group(rows: DataFrame) -> DataFrame:
        return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "n")

    near = by_group(rows).mapInArrow(_near_rows(threshold), "family long, i int, j int, block int, node long, component long, n int, hubs array<long>")
    links = by_group(materialize(near).join(own_texts, "node")).mapInArrow(_link_rows(threshold), "a long, b long")
    found = materialize(_merged(found, materialize(links)))

    placed = materialize(_placed(exact.select("node", "name"), found, "node", "component"))
    names = placed.groupBy("component").agg(F.min("name").alias("class_id"))
    named = placed.join(names, "component").select("node", "class_id")
    return sketched.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after further ``links`` between its components."""
    late = _placed(_placed(links, found, "a", "ca"), found, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = materialize(components(late))
    inner = _placed(found, joined, "component", "c").select("node", F.col("c").alias("component"))
    return inner.unionByName(joined.join(inner.select("node"), "node", "left_anti"))
