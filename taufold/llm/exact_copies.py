"""Exact copies by a sort of the texts' whole content.

1. Splitters.  A bounded sample of keys, weighted by text length, is cut into as
   many equal ranges as there are partitions.  A key is 72 bytes for a text of any
   length: its first normalised bytes, its SHA-256, a hash of the id and the row's
   place in the scan, so a text that a third of all rows hold spans many ranges.
2. Sort.  Each row goes to the partition of its range, and Spark's external sort
   orders a partition by the normalised bytes, then by id.
3. Neighbours.  Equal texts are adjacent; each text is compared in full with the
   one before it.  The first row of a run is the one that stays.
4. Seams.  Only the first and last run of a partition can go on in another one:
   two rows per partition, matched by SHA-256, settle their sizes and ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.sources.stage import stage

#: Leading bytes of a text in its splitter key; the digest, the id's hash and the row's place follow.
HEAD_BYTES = 24
KEY_BYTES = HEAD_BYTES + 32 + 8 + 8
#: Text of one partition; beyond so many partitions they grow instead, and the external sort spills.
PART_BYTES = 32 << 20
MOST_PARTS = 20_000
#: What a row takes besides its text.
ROW_BYTES = 256
#: Sampled keys per partition and in all: the driver holds 80 bytes of each.  The sample decides the balance only.
SAMPLE_PER_PART = 100
SAMPLE_KEYS = 1_000_000


def normalised(column: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, NULL as empty."""
    return pc.ascii_lower(pc.fill_null(column, ""))


def _keys(texts: pa.Array, digests: list[bytes], id_hash: np.ndarray, place: int) -> np.ndarray:
    """Splitter keys of rows of one scan, the first of which is its row ``place``."""
    data, offsets = W.text_bytes(texts)
    n, size = len(texts), np.diff(offsets)
    at = offsets[:-1, None] + np.arange(HEAD_BYTES)
    inside = np.arange(HEAD_BYTES) < size[:, None]
    out = np.zeros((n, KEY_BYTES), np.uint8)
    if len(data):
        out[:, :HEAD_BYTES] = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
    out[:, HEAD_BYTES : HEAD_BYTES + 32] = np.frombuffer(b"".join(digests), np.uint8).reshape(n, 32)
    tail = np.stack([id_hash.view(np.uint64), np.arange(place, place + n, dtype=np.uint64)], axis=1)
    out[:, HEAD_BYTES + 32 :] = tail.astype(">u8").view(np.uint8).reshape(n, 16)
    return out.reshape(-1).view(f"S{KEY_BYTES}")


def _digests(texts: pa.Array) -> list[bytes]:
    data, offsets = W.text_bytes(texts)
    view = memoryview(data)
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, list[bytes], np.ndarray]]:
    """Rows (text, id hash, ...) in slices of about a megabyte, with normalised texts, digests and splitter keys."""
    place = TaskContext.get().partitionId() << 40
    for batch in batches:
        _, offsets = W.text_bytes(batch.column(0))
        for low, high in W.text_slices(offsets):
            part = batch.slice(low, high - low)
            texts = normalised(part.column(0))
            digests = _digests(texts)
            yield part, texts, digests, _keys(texts, digests, part.column(1).to_numpy(), place)
            place += high - low


def splitters(source: DataFrame, rows: int, parts: int) -> np.ndarray:
    """At most ``parts - 1`` ascending keys that cut the texts ``source`` (text, id hash) into ranges of about equal weight."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, _, keys in _scanned(batches):
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            yield pa.record_batch([pa.array(keys.tolist(), pa.binary()), pa.array(size)], ["key", "size"])

    share = min(1.0, min(SAMPLE_PER_PART * parts, SAMPLE_KEYS) / max(rows, 1))
    found = source.sample(share, 11).mapInArrow(sampled, "key binary, size long").toArrow()
    keys = np.array(found.column(0).to_pylist(), f"S{KEY_BYTES}")
    order = np.argsort(keys)
    weight = np.cumsum(found.column(1).to_numpy()[order] + ROW_BYTES)
    if not len(keys):
        return keys
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[order][cuts])


def _content_sorted(docs: DataFrame, doc_id: str, text: str, order: Column, carry: bool) -> DataFrame:
    """(part, text, digest, id[, row]) in partitions by range, each sorted by text and ``order`` of the id."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    id_hash = F.xxhash64(F.col(doc_id).cast("string")).alias("id_hash")
    source = docs.select(F.col(text).cast("string").alias("text"), id_hash, F.col(doc_id).alias("id"), *kept)
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    rows, size = source.agg(F.count("*"), F.coalesce(F.sum(length + ROW_BYTES), F.lit(0))).first()
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, min(MOST_PARTS, -(-size // PART_BYTES)))
    cuts = spark.sparkContext.broadcast(splitters(source.select("text", "id_hash"), rows, parts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, digests, keys in _scanned(batches):
            to = np.searchsorted(cuts.value, keys, "right").astype(np.int32)
            columns = [pa.array(to), texts.cast(pa.binary()), pa.array(digests, pa.binary()), *part.columns[2:]]
            yield pa.record_batch(columns, ["part", "text", "digest", *part.schema.names[2:]])

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    routed = source.mapInArrow(route, f"part int, text binary, digest binary{kinds}")
    return routed.repartitionById(parts, "part").sortWithinPartitions("part", "text", order)


class _Runs:
    """Equal neighbours of sorted rows; a run is given out when the next one begins."""

    def __init__(self, keepers_only: bool):
        self.keepers_only = keepers_only
        self.text = self.part = None
        self.held: list[pa.RecordBatch] = []
        self.more = 0  # rows of the open run that are counted, not held
        self.first = True  # the partition's first run is still open

    def hold(self, rows: pa.RecordBatch) -> None:
        """Copies ids and digests of the open run, or its first row alone: a slice would keep the batch's texts."""
        n = rows.num_rows
        if self.keepers_only:
            n = 0 if self.held else 1
            self.more += rows.num_rows - n
        if n:
            self.held.append(pa.record_batch([c.take(pa.array(np.arange(n))) for c in rows.columns], rows.schema.names))

    def out(self, rows: pa.RecordBatch, starts: np.ndarray, edge: np.ndarray, more: int = 0) -> pa.RecordBatch:
        """Rows (part, digest, id, ...) of whole runs that begin at ``starts``."""
        sizes = np.diff(np.append(starts, rows.num_rows))
        run = np.repeat(np.arange(len(starts)), sizes)
        sizes[-1] += more
        if self.keepers_only:
            at, run = starts, np.arange(len(starts))
        else:
            at = np.arange(rows.num_rows)
        taken = [c.take(pa.array(at)) for c in rows.columns]
        leads = rows.column(2).take(pa.array(starts[run]))
        own = [leads, pa.array(sizes[run]), pa.array(starts[run] == at), pa.array(edge[run])]
        return pa.record_batch([*taken, *own], [*rows.schema.names, "keep_id", "group_size", "lead", "edge"])

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
            yield self.out(rows, np.zeros(1, np.int64), np.array([self.first or last]), self.more)
            self.held, self.more, self.first = [], 0, False

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows (part, text, digest, id, ...) of one part."""
        texts = batch.column(1)
        rows = pa.record_batch([batch.column(c) for c in range(batch.num_columns) if c != 1], [n for n in batch.schema.names if n != "text"])
        part = batch.column(0)[0].as_py()
        if part != self.part:
            yield from self.flush(last=True)
            self.part, self.text, self.first = part, None, True
        new = np.ones(len(texts), bool)
        new[0] = self.text is None or texts[0].as_py() != self.text
        if len(texts) > 1:
            new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        if len(starts):
            if starts[0]:
                self.hold(rows.slice(0, int(starts[0])))
            yield from self.flush(last=False)
            if len(starts) > 1:
                inner = rows.slice(int(starts[0]), int(starts[-1] - starts[0]))
                edge = np.zeros(len(starts) - 1, bool)
                edge[0] = self.first
                yield self.out(inner, starts[:-1] - starts[0], edge)
                self.first = False
            rows = rows.slice(int(starts[-1]))
            self.text = texts[int(starts[-1])].as_py()
        self.hold(rows)


def _neighbours(keepers_only: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(keepers_only)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                yield from runs.take(batch.slice(low, high - low))
        yield from runs.flush(last=True)

    return compare


def _with_seams(runs: DataFrame, order: Column) -> DataFrame:
    """Runs that go on in other partitions get the size, the id and the one kept row of the whole group."""
    ends = runs.filter("edge AND lead").select("part", "digest", "id", "group_size")
    group = Window.partitionBy("digest")
    seams = ends.select(
        F.col("part").alias("_part"),
        F.col("digest").alias("_digest"),
        F.sum("group_size").over(group).alias("_size"),
        F.first("id").over(group.orderBy(order, "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_keep"),
        (F.row_number().over(group.orderBy(order, "part")) == 1).alias("_wins"),
    )
    # Two rows per partition, so at most 2 * MOST_PARTS.
    joined = runs.join(F.broadcast(seams), F.col("edge") & (F.col("part") == F.col("_part")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.withColumns(
        {
            "kept": F.col("lead") & F.coalesce("_wins", F.lit(True)),
            "keep_id": F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep")),
            "group_size": F.coalesce("_size", "group_size"),
        }
    )


def _order(keep: str) -> Column:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    return F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; other columns are not read.

    Texts are equal when they are identical after lower-casing A-Z; NULL is an
    empty text, and empty texts are equal.  Of a group the row with the smallest
    (or largest) id is kept; NULL ids come last, and of rows with that same id
    one is kept.  An empty table gives no rows.  A very long text is one value of
    a sorted row: it is held whole a few times by its task, as text, never more
    than a batch at once.
    """
    order = _order(keep)
    id_type = docs.schema[doc_id].dataType.simpleString()
    ordered = _content_sorted(docs, doc_id, text, order, carry=False)
    kinds = f"part int, digest binary, id {id_type}, keep_id {id_type}, group_size long, lead boolean, edge boolean"
    runs = stage(ordered.mapInArrow(_neighbours(False), kinds), "runs")
    return _with_seams(runs, order).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``find_copies`` keeps, with all their columns."""
    order = _order(keep)
    id_type = docs.schema[doc_id].dataType.simpleString()
    ordered = _content_sorted(docs, doc_id, text, order, carry=True)
    row_type = ordered.schema["row"].dataType.simpleString()
    kinds = f"part int, digest binary, id {id_type}, row {row_type}, keep_id {id_type}, group_size long, lead boolean, edge boolean"
    runs = stage(ordered.mapInArrow(_neighbours(True), kinds), "leads")
    return _with_seams(runs, order).filter("kept").select("row.*")
