"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  A bin costs its length plus a fixed
overhead.  Within a shard the pieces go, longest first, each into the open bin
whose room is the least that still holds it.  If there is none, a bin is opened, of
the size that costs least a token: every permitted size is filled on trial with
the largest remaining pieces that fit, and its cost is that of the least size that
holds this content.  In the end each bin is downsized to its contents.  For
comparison each size is also tried as the fixed size of new bins, and the cheapest of
these packings is returned.

Lengths are token counts of the whole texts, by the encoding of ``token_count``, unless
another length is given.  Only ids and lengths are shuffled.  Shards are dealt by a hash of
the id, with their number taken from the row count, so that each holds about ``shard_rows``
rows however large the table is; bins do not cross shards.

Defined results: a document longer than the largest size is cut into pieces of
that size and a rest, none is dropped; null or empty texts have length 0 and get
no piece; repeated rows are packed as often as they occur; an empty table gives
no bins; ids may be null and of any type with an order; columns other than id and
length are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_count import n_tokens

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
def fits_of(sizes: Sequence[int]) -> list[int]:
    """For each content the least size that holds it."""
    sizes, fits = sorted(sizes), [0] * (max(sizes) + 1)
    for s in reversed(sizes):
        fits[: s + 1] = [s] * (s + 1)
    return fits


class _Remaining:
    """How many pieces of each length are still to come; lengths as a bit set."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.there = 0
        for n in self.count:
            self.there |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.there &= ~(1 << n)

    def filled(self, room: int) -> int:
        """What the largest remaining pieces that fit, one after another, make of ``room``."""
        used, there = 0, self.there & ((2 << room) - 1)
        while there:
            n = there.bit_length() - 1
            k = min(self.count[n], (room - used) // n)
            used += k * n
            there &= (1 << min(n, room - used + 1)) - 1
        return used


def best_fit(lengths: Sequence[int], sizes: Sequence[int], open_size: int | None = None, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin number of each length (descending order is the caller's) and the used room
    of each bin.  ``open_size`` is a fixed size for new bins (a longer piece opens the
    least that holds it); by default the size of least cost a token is opened.

    ``room`` is a bit set of the free rooms that occur, so the best fit is one
    shift and one lowest set bit.
    """
    fits = fits_of(sizes)
    left = _Remaining(lengths) if open_size is None else None
    room, by_room, used, where = 0, {}, [], []
    for n in lengths:
        if left:
            left.take(n)
        fit = room >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            same = by_room[r]
            b = same.pop()
            if not same:
                room &= ~(1 << r)
        else:
            b = len(used)
            used.append(0)
            if left:
                trials = [(n + left.filled(s - n), s) for s in sorted(sizes) if s >= n]
                r = min(trials, key=lambda t: ((fits[t[0]] + overhead) / t[0], t[1]))[1]
            else:
                r = max(open_size, fits[n])
        used[b] += n
        if r > n:
            same = by_room.setdefault(r - n, [])
            if not same:
                room |= 1 << (r - n)
            same.append(b)
        where.append(b)
    return where, used


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """The packing of least cost: bin of each length, used room and final size of each bin."""
    fits, best = fits_of(sizes), None
    for s in (None, *sorted(sizes)):
        where, used = best_fit(lengths, sizes, s, overhead)
        final = [fits[u] for u in used]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[0]:
            best = (cost, where, used, final)
    return best[1:]


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    length: Column | None = None,
    text_col: str = "text",
    sizes: Sequence[int] = SIZES,
    overhead: int = OVERHEAD,
    shard_rows: int = 50_000,
    n_rows: int | None = None,
) -> DataFrame:
    """One row per piece: bin_id, capacity, used, doc_id, piece, doc_offset,
    bin_offset, n_tokens.  ``length`` defaults to the token count of the text."""
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    kind = docs.schema[id_col].dataType.simpleString()
    count = F.coalesce((n_tokens(F.col(text_col)) if length is None else length).cast("long"), F.lit(0))
    n_rows = docs.count() if n_rows is None else n_rows
    shards = max(1, -(-n_rows // shard_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), count.alias("n")).where("n > 0")
    # repeated rows are counted first and numbered, so that they spread over shards, too
    equal = rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    rows = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rows = rows.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "copy"), F.lit(shards)).cast("int").alias("shard"))

    def run(part: pa.Table) -> pa.Table:
        shard = part["shard"][0].as_py()
        part = part.sort_by([("n", "descending"), ("doc_id", "ascending")])
        ns = part["n"].to_pylist()
        pieces = sorted((-min(top, n - k), j, k) for j, n in enumerate(ns) for k in range(0, n, top))
        where, used, final = pack([-p[0] for p in pieces], sizes, overhead)
        fill = [0] * len(used)
        places = []
        for (neg, _, _), b in zip(pieces, where, strict=True):
            places.append(fill[b])
            fill[b] -= neg
        ints = lambda x: pa.array(x, pa.int32())
        made = {
            "bin_id": pa.array([f"{shard}-{b}" for b in where]),
            "capacity": ints([final[b] for b in where]),
            "used": ints([used[b] for b in where]),
            "doc_id": part["doc_id"].take(pa.array([j for _, j, _ in pieces], pa.int64())),
            "piece": ints([k // top for _, _, k in pieces]),
            "doc_offset": pa.array([k for _, _, k in pieces], pa.int64()),
            "bin_offset": ints(places),
            "n_tokens": ints([-neg for neg, _, _ in pieces]),
        }
        return pa.table(made)

    return rows.groupBy("shard").applyInArrow(run, f"bin_id string, capacity int, used int, doc_id {kind}, piece int, doc_offset long, bin_offset int, n_tokens int")
