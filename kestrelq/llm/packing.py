"""Best-fit packing of token sequences by bin completion.

Documents are encoded once; only those above the capacity are cut. The plan needs no more than how
many pieces each length has (at most `capacity` numbers, whatever the input's size). The best-fit
plan of the whole list is the first incumbent. Bin completion then makes sequence after sequence:
around the largest remaining length it enumerates undominated fillings by branch and bound, from the
best-fit filling as incumbent, and applies a filling as often as the counts allow. If the plan found
first is above the lower bound, the search goes back over sequences and tries other fillings, and
leaves a branch as soon as its waste exceeds what a plan with one sequence less may waste. So the
plan is never worse than best fit. Pieces take places by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts, written
from .wordpieces import encoder


Fill = dict[int, int]  # pieces of each length
Made = list[tuple[Fill, int]]  # fillings, and how many sequences take them


def best_fit(histogram: dict[int, int], capacity: int) -> Made:
    """Every piece, the longest first, goes where it leaves the least room. Sequences that are filled alike are
    kept as one with their number."""
    open_: dict[int, list[tuple[Fill, int]]] = {capacity: []}
    rooms = [capacity]  # ascending

    def put(fill: Fill, times: int, room: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((fill, times))

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            room = rooms[at]
            if not open_[room] and room < capacity:
                del open_[room], rooms[at]
                continue
            fill, times = open_[room].pop() if open_[room] else ({}, left)
            new = not fill
            k = min(room // n, left)  # the sequence it went to stays the tightest while it still fits
            used = min(times, left // k)
            put(fill | {n: k}, used, room - k * n)
            left -= used * k
            if not new and times > used:
                open_[room].append((fill, times - used))
    return [x for room in rooms for x in open_[room]]


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound: all pieces end to end, or the long ones by themselves with what can't go beside them."""
    lengths = sorted(histogram)
    count = np.array([histogram[n] for n in lengths], object)
    size = np.array(lengths, object) * count
    before, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size)])
    half, end = bisect.bisect_right(lengths, capacity // 2), len(lengths)
    out = -(-int(weight[-1]) // capacity)
    for i in range(half):
        over = max(half, bisect.bisect_right(lengths, capacity - lengths[i]))
        middle = before[over] - before[half]
        room = middle * capacity - (weight[over] - weight[half])
        out = max(out, int(before[end] - before[over] + middle + max(0, -(-(weight[half] - weight[i] - room) // capacity))))
    return out


def _swappable(fill: Fill, largest: int, left: int, lengths: list[int], free) -> bool:
    """Whether a longer piece could take the place of one or two of the filling's: such a filling is dominated."""
    inner = [n for n, k in fill.items() for _ in range(min(2, k - (n == largest)))]
    sums = {*inner, *(x + y for i, x in enumerate(inner) for y in inner[:i])}
    for n in sums:
        at = bisect.bisect_right(lengths, n) if n in fill else bisect.bisect_left(lengths, n)
        while at < len(lengths) and lengths[at] <= n + left:
            if free(lengths[at]) > 0:
                return True
            at += 1
    return False


def fillings(largest: int, lengths: list[int], counts: Fill, capacity: int, nodes: int, most: int = 1) -> list[tuple[int, Fill]]:
    """Up to `most` undominated fillings around one piece of the largest length, as (waste, pieces), the fullest
    first. lengths: those with pieces left, ascending. nodes bounds the search after the best-fit incumbent."""
    room = capacity - largest
    free = lambda n, used: counts[n] - used.get(n, 0)

    # incumbent: best fit, always the longest piece that still goes in
    best: Fill = {largest: 1}
    left = room
    i = bisect.bisect_right(lengths, left)
    while i and left:
        n = lengths[i - 1]
        k = min(free(n, best), left // n)
        if k:
            best[n] = best.get(n, 0) + k
            left -= k * n
        i = min(i - 1, bisect.bisect_right(lengths, left))
    found = [(left, best)]
    if not left and most == 1:
        return found

    # depth first over non-increasing lengths; a node is dropped when even its whole room, or all
    # pieces it may still take, can't beat the incumbent's waste
    sums = np.cumsum([n * counts[n] for n in lengths]).tolist()
    stack = [(bisect.bisect_right(lengths, room), room, {largest: 1})]
    worst = left + (most > 1)
    while stack and worst and nodes:
        i, left, used = stack.pop()
        nodes -= 1
        j = bisect.bisect_right(lengths, left, 0, i)
        if j and lengths[j - 1] == left and free(left, used) > 0:
            # one exact last piece dominates every set of smaller pieces with the same sum
            used, left, j = used | {left: used.get(left, 0) + 1}, 0, 0
        if left < worst and (most == 1 or all(free(n, used) <= 0 for n in lengths[: bisect.bisect_right(lengths, left)])):
            if most == 1:
                found, worst = [(left, used)], left
            elif all(used != f for _, f in found) and not _swappable(used, largest, left, lengths, lambda n: free(n, used)):
                found = sorted([*found, (left, used)], key=lambda x: x[0])[:most]
                worst = found[-1][0] + (len(found) < most) * capacity
        if not j or left - min(left, sums[j - 1]) >= worst:
            continue
        options = []
        for at in range(j - 1, max(-1, j - 9), -1):
            n = lengths[at]
            if free(n, used) > 0:
                options.append((at + 1, left - n, used | {n: used.get(n, 0) + 1}))
        if j - 9 >= 0:  # shorter firsts: the next group of lengths, once the longer ones are searched
            stack.append((j - 8, left, used))
        stack.extend(reversed(options))
    return found


class _Left:
    """Pieces not yet packed."""

    def __init__(self, histogram: dict[int, int]):
        self.counts = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.counts)

    def take(self, fill: Fill, times: int) -> None:
        for n, k in fill.items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                del self.lengths[bisect.bisect_left(self.lengths, n)]

    def put_back(self, fill: Fill, times: int) -> None:
        for n, k in fill.items():
            if not self.counts[n]:
                bisect.insort(self.lengths, n)
            self.counts[n] += k * times

    def times(self, fill: Fill) -> int:
        return min(self.counts[n] // k for n, k in fill.items())


def _search(histogram: dict[int, int], capacity: int, sequences: int, nodes: int, budget: int, most: int) -> tuple[Made | None, int]:
    """A plan with no more than `sequences`, if the search meets one before its budget of steps is spent, and what is
    left of the budget. Depth first over sequences; a branch ends when its waste is above that of such a plan."""
    left = _Left(histogram)
    waste = sequences * capacity - sum(n * c for n, c in histogram.items())
    made: Made = []
    options: list[list[tuple[int, Fill]]] = []
    deeper = True
    while budget > 0:
        if deeper:
            if not left.lengths:
                return made, budget
            budget -= 1
            found = fillings(left.lengths[-1], left.lengths, left.counts, capacity, nodes, most)
            options.append([x for x in reversed(found) if x[0] <= waste])  # the fullest last
        while options and not options[-1]:
            options.pop()
            if not options:
                return None, budget
            fill, times = made.pop()
            left.put_back(fill, times)
            waste += times * (capacity - sum(n * k for n, k in fill.items()))
        lost, fill = options[-1].pop()
        times = left.times(fill) if not lost else min(left.times(fill), waste // lost)
        left.take(fill, times)
        made.append((fill, times))
        waste -= times * lost
        deeper = True
    return None, 0


def plan(histogram: dict[int, int], capacity: int, nodes: int = 400, budget: int = 4000, most: int = 4) -> Made:
    """(pieces of each length, how many sequences take them), in order of making; never more sequences than best
    fit. nodes: steps of the search for one filling; budget: fillings made in the search over sequences, which
    begins where the first plan misses the lower bound; most: fillings tried at one place there."""
    total = lambda made: sum(times for _, times in made)
    histogram = {n: c for n, c in histogram.items() if c > 0}
    if not histogram:
        return []
    least = least_sequences(histogram, capacity)
    best = best_fit(histogram, capacity)
    if total(best) == least:
        return best
    left, made = _Left(histogram), []
    while left.lengths:
        fill = fillings(left.lengths[-1], left.lengths, left.counts, capacity, nodes)[0][1]
        times = left.times(fill)
        left.take(fill, times)
        made.append((fill, times))
    best = min(made, best, key=total)
    while total(best) > least and budget > 0:
        better, budget = _search(histogram, capacity, total(best) - 1, nodes, budget, most)
        if better is None:
            break
        best = better
    return best


def intervals(made: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks where its runs begin, first sequence, pieces in a sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for fill, times in made:
        offset = 0
        for n in sorted(fill, reverse=True):
            k = fill[n]
            runs.setdefault(n, []).append((seen.get(n, 0), first, k, offset))
            seen[n] = seen.get(n, 0) + k * times
            offset += k * n
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, chunk_rank long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, chunk = encoder(tokenizer), TaskContext.get().partitionId()
    tail = np.asarray([end_id], "<u4").tobytes()
    seen: dict[int, int] = {}
    for batch in slices(batches, "text", max_rows=512, max_bytes=1 << 20):
        rows = []
        for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts(batch))):
            ids += tail
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                n = len(part) // 4
                rank = seen.get(n, 0)
                seen[n] = rank + 1
                rows.append((key, piece, at // 4, n, zlib.crc32(part), chunk, rank))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = [x.split()[0] for x in _PIECE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _place(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, edges):
            if not len(rows):
                continue
            n = int(length[rows[0]])
            low, first, many, begin = runs.value[n]
            r = rank[rows]
            at = np.searchsorted(low, r, "right") - 1
            i = r - low[at]
            sequence[rows] = first[at] + i // many[at]
            offset[rows] = begin[at] + i % many[at] * n
        keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text; null text counts as empty) -> doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Repeated rows are packed as often as they occur; an empty table gives no rows."""
    spark = docs.sparkSession
    cut = partial(_pieces, tokenizer=tokenizer, end_id=end_id, capacity=capacity)
    pieces = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECE), "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(intervals(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("chunk_rank"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(partial(_place, runs=runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
