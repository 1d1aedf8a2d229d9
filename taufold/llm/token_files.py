"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

A file is a Parquet file whose rows are blocks of about a million ids.  A block
holds its own rank table (the distinct ids, most frequent first), a control
stream with two bits per id (bytes of its rank less one) and a data stream with
the ranks' bytes.  Blocks depend on nothing outside them, so a lost task writes
its blocks again and a reader decodes any block by table lookup.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taufold.llm.encoding import ByteEncoder, ChunkEncoder, worker_encoder

BLOCK_IDS = 1 << 20
END_ID = 0
#: Bytes of the four ranks behind each control byte.
SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rank table, control stream and data stream of some ids."""
    distinct, back, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(distinct), "<u4")
    rank[order] = np.arange(len(distinct))
    ranks = rank[back]
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return distinct[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_ids(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block, as unsigned 32-bit integers."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(table, "<u4")[ranks]


def write_token_files(
    docs: DataFrame,
    out: str,
    path: str,
    kind: type[ChunkEncoder] = ByteEncoder,
    doc_id: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every text, with id 0 behind it, and write the blocks in ascending order of ``doc_id``.

    NULL texts are empty: their only id is the end.  Rows with equal ids are in
    the order of their texts' hashes; NULL ids come first.  A text is never
    split over blocks.  An empty table gives files without blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = worker_encoder(kind, path), TaskContext.get().partitionId()
        names, parts, sizes, held, block = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            table, control, data = encode_ids(ids)
            row = [[shard], [block], [len(ids)], [pa.concat_arrays(names)], [np.concatenate(sizes)], [table], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(names[0].type), pa.list_(pa.int32()), *[pa.binary()] * 3]
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, kinds)], BLOCK_COLUMNS)

        for batch in batches:
            for low, high, ids, offsets in encoder.encode(batch.column(1)):
                ends = offsets[1:] + np.arange(1, high - low + 1)
                full = np.full(int(ends[-1]), END_ID, np.int32)
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep] = ids
                start = 0
                while start < high - low:  # whole texts up to the size of a block
                    done = int(ends[start - 1]) if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, done + block_ids - held, "right")))
                    stop = min(stop, high - low)
                    parts.append(full[done : int(ends[stop - 1])])
                    sizes.append(np.diff(ends[start:stop], prepend=done).astype(np.int32))
                    names.append(batch.column(0).slice(low + start, stop - start))
                    held += len(parts[-1])
                    start = stop
                    if held >= block_ids:
                        yield flush()
                        names, parts, sizes, held, block = [], [], [], 0, block + 1
        if names:
            yield flush()

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"shard int, block int, n_ids long, doc_ids array<{id_type}>, doc_sizes array<int>, ranks binary, control binary, data binary"
    ordered = docs.select(F.col(doc_id), F.col(text), F.xxhash64(text).alias("_tie")).repartitionByRange(doc_id, "_tie")
    ordered = ordered.sortWithinPartitions(doc_id, "_tie").select(doc_id, text)
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(out)


BLOCK_COLUMNS = ["shard", "block", "n_ids", "doc_ids", "doc_sizes", "ranks", "control", "data"]


def read_token_files(spark: SparkSession, out: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it, ``n_tokens`` includes
    the end id, and the checksum is over the ids as little-endian 32-bit integers.
    """
    blocks = spark.read.parquet(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, n = (batch.column(c)[row].as_py() for c in range(3))
                ids = decode_ids(*(batch.column(c)[row].as_buffer() for c in (5, 6, 7)), n)
                sizes = batch.column(4)[row].values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                view = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                k = len(sizes)
                columns = [np.full(k, shard, np.int32), np.full(k, block, np.int32), ends - sizes, sizes, np.array(sums, np.int64)]
                yield pa.record_batch([batch.column(3)[row].values, *map(pa.array, columns)], ["id", "shard", "block", "at", "n", "crc"])

    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    found = blocks.select(*BLOCK_COLUMNS).mapInArrow(decode, f"id {id_type}, shard int, block int, at long, n long, crc long")
    # One row per shard for the window over all of them; blocks are counted within their shard.
    sizes = blocks.select("shard", "block", "n_ids")
    whole = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = whole.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("ahead"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    begins = sizes.withColumn("inner", inner).join(ahead, "shard").select("shard", "block", (F.col("ahead") + F.col("inner")).alias("begin"))
    return found.join(begins, ["shard", "block"]).select(
        F.col("id").alias(doc_id), (F.col("begin") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )
