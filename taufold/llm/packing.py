"""Best-fit packing of tokenised documents into sequences of fixed capacity, by bin completion.

Lengths are whole numbers up to the capacity, so the corpus is, for packing, a
histogram of at most ``capacity`` counts whatever its size.  Bin completion works
on that histogram: around the largest length that is left it enumerates the
undominated fillings of the rest and branches over them, bin after bin, backing up
when the bins so far waste more than any better packing may.  Best-fit packings,
with wider and wider searches for a single filling, are the incumbents.  On the first
way down a filling is used as often as its counts allow.
Documents then look up their place by their rank among documents of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taufold.llm.encoding import ChunkEncoder, WordEncoder, worker_encoder
from taufold.sources.stage import stage

CAPACITY = 2048
END_ID = 0
#: Fillings that the widest search compares around one largest length, for an incumbent.
NODES = 8_192
#: Fillings that the branch and bound looks at before it leaves the incumbent as it is; a few hundred prove small sets.
EFFORT = 50_000
#: Rows that are ranked in one window group, on average; longer groups are salted apart.
RANKED_ROWS = 100_000


def pieces(docs: DataFrame, path: str, kind: type[ChunkEncoder], capacity: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut only beyond ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(kind, path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for low, high, ids, offsets in encoder.encode(batch.column(1)):
                raw = memoryview(ids.astype("<u4")).cast("B")
                rows = []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    n = b - a + 1
                    for piece in range(-(-n // capacity)):
                        start = piece * capacity
                        size = min(capacity, n - start)
                        last = start + size == n
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * (a + start + size - last)])
                        rows.append((low + k, piece, start, size, zlib.crc32(end, crc) if last else crc))
                if rows:
                    found = np.array(rows, np.int64)
                    columns = [batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int32))]
                    yield pa.record_batch([*columns, *(pa.array(found[:, c].copy()) for c in (2, 3, 4))], ["id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


class _Fill:
    """Completions of one bin: multisets of the lengths that are left, undominated and of least waste."""

    def __init__(self, counts: list[int], capacity: int):
        self.counts = counts
        self.next_at_most = list(range(capacity + 1))  # with path halving: the largest length <= k that is left

    def largest(self, k: int) -> int:
        jump = self.next_at_most
        while k and not self.counts[k]:
            jump[k] = jump[k - 1] if self.counts[k - 1] or k == 1 else jump[jump[k - 1]]
            k = min(jump[k], k - 1)
        return k

    def best(self, room: int, nodes: int) -> list[int]:
        """Lengths that fill ``room`` with the least waste found.

        The first dive takes as many as fit of the largest length that fits: best
        fit is the first incumbent.  The search then tries all fillings of
        non-increasing lengths.  Those to which a free length could still be added
        are dominated and never compared.  A branch is cut when even a filling
        that uses all its room but the smallest waste possible can't beat the
        incumbent; the search ends at a waste of zero or after ``nodes`` fillings.
        """
        chosen, best, best_waste, left = [], [], room + 1, nodes

        def search(room: int, most: int) -> bool:
            """True when the search is over."""
            nonlocal best, best_waste, left
            length = self.largest(min(room, most))
            if not length:
                if room < best_waste:
                    best, best_waste = chosen.copy(), room
                left -= 1
                return best_waste == 0 or left <= 0
            while length:
                times = min(self.counts[length], room // length)
                self.counts[length] -= times
                chosen.extend([length] * times)
                over = False
                for taken in range(times, 0, -1):
                    over = over or search(room - taken * length, length - 1)
                    chosen.pop()
                    self.counts[length] += 1
                if over:
                    return True
                length = self.largest(length - 1)
                if length and room - length >= best_waste and not self.largest(room - length):
                    return False  # one length and no second: later ones are shorter still
            return False

        search(room, room)
        return best


def _complete(histogram: dict[int, int], capacity: int, nodes: int, bins: int) -> list[tuple[list[int], int]] | None:
    """Bins filled one after the other around the largest length; None once they need ``bins`` bins or more."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    total = sum(k * n for k, n in histogram.items())
    spare = (bins - 1) * capacity - total  # the waste that a better packing may have
    fill, patterns, largest = _Fill(counts, capacity), [], capacity
    while largest:
        if not counts[largest]:
            largest -= 1
            continue
        counts[largest] -= 1
        pattern = [largest, *fill.best(capacity - largest, nodes)]
        counts[largest] += 1
        use: dict[int, int] = {}
        for length in pattern:
            use[length] = use.get(length, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        for k, n in use.items():
            counts[k] -= n * times
        patterns.append((pattern, times))
        # The last bin may be as empty as it likes; before it, every waste counts.
        spare -= (capacity - sum(pattern)) * times
        if spare < 0:
            return None
    return patterns


def _undominated(rest: list[int], counts: list[int], lengths: list[int], spare_room: int) -> bool:
    """Whether no free length can take the place of some of ``rest`` that are no larger together.

    ``lengths`` are the free ones, falling, ``spare_room`` is what the filling
    leaves.  Sums of some of ``rest`` are the bits of a number.
    """
    sums = 1
    for length in rest:
        sums |= sums << length
    held = set(rest)
    for length in lengths:
        if counts[length]:
            low = max(0, length - spare_room)
            window = sums >> low & (1 << (length - low + 1)) - 1
            if length in held:  # the same length for itself is no exchange
                window &= (1 << (length - low)) - 1
            if window:
                return False
    return True


def _fillings(counts: list[int], lengths: list[int], room: int, spare: int, effort: list[int]) -> Iterator[list[int]]:
    """Undominated multisets of free lengths (falling ``lengths``) that leave at most ``spare`` of ``room``.

    ``counts`` are as before at every step of the iteration.  Each filling that
    is looked at takes one from ``effort``; nothing follows when it is used up.
    """
    behind = [0] * (len(lengths) + 1)  # what all later lengths hold together
    for k in range(len(lengths) - 1, -1, -1):
        behind[k] = behind[k + 1] + lengths[k] * counts[lengths[k]]
    # (place in lengths, room left, copies of that length to try next); taken lengths are in ``chosen``.
    chosen: list[tuple[int, int]] = []
    stack = [(0, room, -1)]
    while stack and effort[0] > 0:
        k, left, tries = stack.pop()
        while chosen and chosen[-1][0] >= k:
            place, n = chosen.pop()
            counts[lengths[place]] += n
        if left - behind[k] > spare:
            continue
        while k < len(lengths) and (lengths[k] > left or not counts[lengths[k]]):
            k += 1
        if k == len(lengths):
            effort[0] -= 1
            if left <= spare:
                rest = [lengths[place] for place, n in chosen for _ in range(n)]
                if _undominated(rest, counts, lengths, left):
                    for place, n in chosen:
                        counts[lengths[place]] += n
                    yield rest
                    for place, n in chosen:
                        counts[lengths[place]] -= n
            continue
        n = min(counts[lengths[k]], left // lengths[k]) if tries < 0 else tries
        if n:
            stack.append((k, left, n - 1))
            counts[lengths[k]] -= n
            chosen.append((k, n))
        stack.append((k + 1, left - n * lengths[k], -1))
    for place, n in chosen:
        counts[lengths[place]] += n


def _branch(histogram: dict[int, int], capacity: int, bins: int, effort: list[int]) -> list[tuple[list[int], int]] | None:
    """Patterns with fewer than ``bins`` bins; None when there are none, or when ``effort`` is used up."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    lengths = sorted((k for k, n in histogram.items() if n), reverse=True)
    spare = (bins - 1) * capacity - sum(k * n for k, n in histogram.items())
    path: list[tuple[list[int], int]] = []
    levels: list[Iterator[tuple[list[int], int]]] = []

    def choices(largest: int, spare: int) -> Iterator[tuple[list[int], int]]:
        free = [k for k in lengths if k <= largest and counts[k]]
        counts[largest] -= 1
        for rest in _fillings(counts, free, capacity - largest, spare, effort):
            pattern = [largest, *rest]
            counts[largest] += 1
            most = min(counts[k] // pattern.count(k) for k in set(pattern))
            waste = capacity - sum(pattern)
            if waste:
                most = min(most, spare // waste)
            yield pattern, most
            if most > 1:  # once, and anything else afterwards: no packing is left out
                yield pattern, 1
            counts[largest] -= 1
        counts[largest] += 1

    def change(pattern: list[int], times: int) -> None:
        nonlocal spare
        for k in pattern:
            counts[k] += times
        spare += (capacity - sum(pattern)) * times

    def descend() -> bool:
        """Opens the next level; True when nothing is left to pack."""
        largest = next((k for k in lengths if counts[k]), 0)
        if largest:
            levels.append(choices(largest, spare))
        return not largest

    if spare < 0:
        return None
    if descend():
        return path
    while levels:
        if len(path) == len(levels):
            change(*path.pop())
        chosen = next(levels[-1], None)
        if chosen is None:
            levels.pop()
            continue
        path.append(chosen)
        change(chosen[0], -chosen[1])
        if descend():
            return path
    return None


def bins_at_least(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound: no two lengths over half the capacity share a bin, and lengths near it take whole bins.

    For a threshold t, lengths over ``capacity - t`` need a bin each that nothing
    of t or more fits in, and what else has t or more needs the rest of its own.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    many, size = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    best = -(-int(size[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        alone = int(many[-1] - many[capacity - t])
        half = int(many[capacity - t] - many[capacity // 2])
        room = half * capacity - int(size[capacity - t] - size[capacity // 2])
        small = int(size[capacity // 2] - size[t - 1])
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return best


def bin_completion(histogram: dict[int, int], capacity: int, nodes: int = NODES, effort: int = EFFORT) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one bin, how many such bins) that hold all lengths of the histogram.

    The packing by best fit alone is the first incumbent; wider and wider
    searches around each largest length give better ones.  Branch and bound over
    the fillings of all bins follows until the lower bound is met, no better
    packing exists, or ``effort`` fillings have been looked at: small sets are
    packed in as few bins as possible, for large ones ``completion_gap`` tells
    how many bins could still be saved at most.
    """
    total = sum(k * n for k, n in histogram.items())
    if not total:
        return []
    least = bins_at_least(histogram, capacity)
    best = _complete(histogram, capacity, 1, total + 1)
    width = 8
    while width <= nodes and (bins := sum(n for _, n in best)) > least:
        best = _complete(histogram, capacity, width, bins) or best
        width *= 4
    left = [effort]
    while (bins := sum(n for _, n in best)) > least:
        better = _branch(histogram, capacity, bins, left)
        if better is None:
            break
        best = better
    return best


def completion_gap(patterns: list[tuple[list[int], int]], capacity: int) -> int:
    """Bins of a packing beyond the lower bound for its lengths."""
    histogram: dict[int, int] = {}
    for pattern, times in patterns:
        for length in pattern:
            histogram[length] = histogram.get(length, 0) + times
    return sum(n for _, n in patterns) - (bins_at_least(histogram, capacity) if patterns else 0)


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the documents of a length go, by rank."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = given.get(length, 0)
            out.append((length, rank, times, sequence, offset))
            given[length] = rank + times
            offset += length
        sequence += times
    return out


def pack_documents(
    docs: DataFrame,
    path: str,
    kind: type[ChunkEncoder] = WordEncoder,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    nodes: int = NODES,
    effort: int = EFFORT,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    NULL and empty texts are the end id alone.  Rows with equal or NULL ids are
    documents of their own.  Other columns are not read.  An empty table gives
    an empty result.  A very long text is tokenised whole by one task, alone in
    its slice, and held there as bytes and ids.
    """
    spark = docs.sparkSession
    table = stage(pieces(docs, path, kind, capacity, doc_id, text), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = slots(bin_completion(histogram, capacity, nodes, effort))
    # At most a few entries per length and filling, whatever the corpus: safe to send to every task.
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")

    # One row per length.
    salts = [(k, -(-n // RANKED_ROWS)) for k, n in histogram.items()] or [(0, 1)]
    salts = F.broadcast(spark.createDataFrame(salts, "length long, _salts long"))
    salted = table.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "start"), "_salts")).drop("_salts")
    within = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")) - 1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    within = within.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # Ranks find their entry by equality on (length, entry): entries of a length are numbered by binary search over an array.
    arrays = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("_entries"))
    placed = within.join(F.broadcast(arrays), "length").withColumn(
        "_entry", F.expr("filter(_entries, e -> _rank >= e.first AND _rank < e.first + e.n)[0]")
    )
    return placed.select(
        F.col("id").alias(doc_id),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_entry.sequence") + F.col("_rank") - F.col("_entry.first")).alias("sequence_id"),
        F.col("_entry.offset").alias("offset"),
    )
