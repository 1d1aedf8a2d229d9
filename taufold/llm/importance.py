"""Importance resampling towards a target distribution of hashed word runs, with exact integer weights.

A run's bucket is the CRC-32 of its bytes; a bucket's gain is 1000 times the log
ratio of its smoothed shares in the target and in all documents.  A document's
weight is the mean gain of its runs, summed by bit slices: its bucket counts are
written as bit planes (plane j holds bit j of every bucket's count), the gains as
planes in two's complement, and the sum of counts times gains is the sum over
pairs of planes of popcount(counts AND gains) times a power of two.  Ranks by
weight plus hashed Gumbel noise draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.operators.rank import distributed_rank
from taufold.sources.stage import stage

BUCKETS = 10_000
#: Documents whose bit planes are held together.
PLANE_ROWS = 512
#: Words of more bytes are hashed one by one, shorter ones side by side.
LONG_WORD = 64
START = 0xFFFFFFFF


@lru_cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


@lru_cache
def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 registers after ``data[start:end]``; ``state`` holds the registers before (the fresh one by default)."""
    table = _crc_table()
    sizes = ends - starts
    long = np.flatnonzero(sizes > LONG_WORD)
    order = np.argsort(-np.where(sizes > LONG_WORD, 0, sizes), kind="stable")
    at, sizes_down = starts[order], np.where(sizes > LONG_WORD, 0, sizes)[order]
    crc = np.full(len(starts), START, np.uint32) if state is None else state[order]
    active = np.searchsorted(-sizes_down, -np.arange(1, (sizes_down[0] if len(order) else 0) + 1), "right")
    for step, n in enumerate(active.tolist()):
        low = (crc[:n] ^ data[at[:n] + step]) & np.uint32(255)
        crc[:n] = table[low] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc
    for k in long.tolist():
        before = START if state is None else int(state[k])
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), before ^ START) ^ START
    return out


def run_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, the text of each, and the texts' word counts.

    Words are runs of 0-9, a-z and anything outside ASCII, after lower-casing A-Z.
    """
    low = int(offsets[0])
    text, edges = _lowered()[data[low : int(offsets[-1])]], offsets - low
    _, inside = W.ALNUM.table()
    starts, ends = W.find_spans(inside[text], edges)
    first = np.searchsorted(starts, edges)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(first))
    state = crc_of_spans(text, starts, ends)
    found, owners, at = [state], [doc], np.arange(len(starts))
    for _ in range(1, longest):
        more = at + len(found) < len(starts)
        more[more] = doc[at[more]] == doc[at[more] + len(found)]
        at, state = at[more], state[more]
        space = _crc_table()[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        following = at + len(found)
        state = crc_of_spans(text, starts[following], ends[following], space)
        found.append(state)
        owners.append(doc[at])
    values = np.concatenate(found) ^ np.uint32(START)
    return (values % np.uint32(buckets)).astype(np.int64), np.concatenate(owners), np.diff(first)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the only column of ``texts``; one row per bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(0))
            for low, high in W.text_slices(offsets):
                total += np.bincount(run_buckets(data, offsets[low : high + 1], longest, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of B buckets with counts s of S and t of T."""
    s, t, buckets = source.astype(np.float64), target.astype(np.float64), len(source)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def bit_planes(values: np.ndarray, n_planes: int) -> np.ndarray:
    """(planes, ..., words): bit j of every value, 64 values a word."""
    width = -(-values.shape[-1] // 64) * 64
    out = np.zeros((n_planes, *values.shape[:-1], width // 8), np.uint8)
    for j in range(n_planes):
        packed = np.packbits((values >> j).astype(np.uint8) & np.uint8(1), axis=-1)
        out[j, ..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


class Gains:
    """Gains as bit planes: the last one counts negative, as in two's complement."""

    def __init__(self, gains: np.ndarray):
        bits = int(np.abs(gains).max(initial=0)).bit_length() + 1
        self.planes = bit_planes(gains, bits)
        self.scale = [1 << k for k in range(bits - 1)] + [-(1 << (bits - 1))]
        self.buckets = len(gains)

    def sums(self, bucket: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Sum of the gains of all runs of each text, exactly."""
        out = np.zeros(n_docs, np.int64)
        order = np.argsort(doc, kind="stable")
        bucket, doc = bucket[order], doc[order]
        for low in range(0, n_docs, PLANE_ROWS):
            n = min(PLANE_ROWS, n_docs - low)
            a, b = np.searchsorted(doc, [low, low + n])
            counts = np.bincount((doc[a:b] - low) * self.buckets + bucket[a:b], minlength=n * self.buckets).reshape(n, self.buckets)
            most = counts.max(axis=1)
            for j in range(int(most.max(initial=0)).bit_length()):
                rows = np.flatnonzero(most >> j)  # the others have no bit so high
                plane = bit_planes(counts[rows] >> j, 1)[0]
                for scale, gain in zip(self.scale, self.planes):
                    out[low + rows] += (scale << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
        return out


def weigh(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(row, n_words, n_features, weight, score) of every row of ``docs``; ``row`` holds the columns ``carry``, all by default.

    Every text of both tables is counted.  ``weight`` is the floored mean of the
    gains of a text's runs, 0 without any (a NULL, empty or wordless text);
    ``score`` adds Gumbel noise from the SHA-256 of seed and id, where a NULL id
    counts as empty.  Rows of equal id have equal noise.  Very long texts and
    words are worked on whole, alone in their slice.
    """
    spark = docs.sparkSession
    gains = bucket_gains(
        bucket_counts(docs.select(text), longest, buckets), bucket_counts(target.select(target_text), longest, buckets)
    )
    shared = spark.sparkContext.broadcast(gains)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Gains(shared.value)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(0))
            for low, high in W.text_slices(offsets):
                bucket, doc, words = run_buckets(data, offsets[low : high + 1], longest, buckets)
                features = np.bincount(doc, minlength=high - low)
                weight = np.floor_divide(planes.sums(bucket, doc, high - low), np.maximum(features, 1))
                columns = [batch.column(c).slice(low, high - low) for c in (1, 2)]
                yield pa.record_batch([*columns, *map(pa.array, (words, features, weight))], ["id", "row", "n_words", "n_features", "weight"])

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    source = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), row)
    found = source.mapInArrow(scan, f"id string, row {source.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.select("row", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def draw(weighed: DataFrame, doc_id: str = "doc_id", percent: int = 10, min_words: int = 20) -> DataFrame:
    """``weighed`` with ``rank`` 1, 2, ... of the drawn rows, NULL for all others.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred
    (rounded down) are drawn: the highest scores, equal ones by smaller id, NULL
    ids last.  Rows that are equal in both are ordered as their written table has them.
    """
    held = stage(weighed, "weighed")
    fits = F.col("n_words") >= min_words
    drawn = held.agg(F.coalesce(F.sum(F.when(fits, 1).otherwise(0)), F.lit(0))).first()[0] * percent // 100
    # The hashed row lets the range partitioner split scores that many rows of one id share.
    order = [fits.desc(), F.col("score").desc(), F.col(f"row.{doc_id}").asc_nulls_last(), F.xxhash64("row")]
    ranked = distributed_rank(held, order, rank="_rank")
    return ranked.select(*held.columns, F.when(fits & (F.col("_rank") <= drawn), F.col("_rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", percent: int = 10, **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns, in no particular order."""
    return draw(weigh(docs, target, doc_id=doc_id, **how), doc_id, percent).filter("rank IS NOT NULL").select("row.*")
