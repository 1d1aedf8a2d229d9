"""Token counts of whole texts by a two-tier lookup inside the scan.

Tier one is a compact table (chunk hash, number of tokens) of the corpus's
frequent chunks, broadcast to every task.  Chunks it lacks go to tier two, the
worker's cache, which has the library encode what it has not seen.  No chunk is
shuffled but for the tables' own candidates from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.llm.encoding import ChunkEncoder, PieceEncoder, worker_encoder
from taufold.llm.frequent import most_frequent
from taufold.sources.stage import stage

#: Expected rows of the sample that proposes frequent chunks, and entries of the broadcast table (12 bytes each).
#: Both bound memory and time only: any table gives the same counts.
SAMPLE_ROWS = 20_000
TABLE_ENTRIES = 1 << 16


def frequent_chunks(
    docs: DataFrame, text: str, path: str, kind: type[ChunkEncoder], sample_rows: int, entries: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the most frequent chunks of a sample of about ``sample_rows`` rows."""
    share = min(1.0, sample_rows / max(1, docs.count()))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(kind, path)
        keys, sizes, counts = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        for batch in batches:
            for _, _, chunks in encoder.slices(batch.column(0)):
                numbers = encoder.lookup(chunks)
                size = encoder.sizes()[numbers]
                new, where, times = np.unique(chunks.hashes, return_index=True, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sizes_of = np.zeros(len(keys), np.int64)
                sizes_of[back] = np.concatenate([sizes, size[where]])
                counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
                sizes = sizes_of
                if len(keys) > 4 * entries:
                    top = np.sort(np.argpartition(-counts, entries)[:entries])
                    keys, sizes, counts = keys[top], sizes[top], counts[top]
        top = np.argsort(-counts, kind="stable")[:entries]
        yield pa.record_batch([pa.array(keys[top].view(np.int64)), pa.array(sizes[top]), pa.array(counts[top])], ["k", "size", "n"])

    proposed = docs.select(text).sample(share, seed=17).mapInArrow(propose, "k long, size long, n long")
    counted = stage(proposed.groupBy("k", "size").agg(F.sum("n").alias("n")), "frequent-chunks")
    rows = most_frequent(counted, "n", entries).select("k", "size").toArrow()
    return rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.int64)


def count_tokens(
    docs: DataFrame,
    path: str,
    kind: type[ChunkEncoder] = PieceEncoder,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 4096,
    sample_rows: int = SAMPLE_ROWS,
    entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    NULL and empty texts have 0 bytes and tokens.  Rows with equal or NULL ids
    each give their own row; other columns are not read.  An empty table gives
    an empty result.
    """
    keys, sizes = frequent_chunks(docs, text, path, kind, sample_rows, entries)
    shared = docs.sparkSession.sparkContext.broadcast((keys, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(kind, path)
        keys, frequent = shared.value
        table = W.HashTable(max(4, (2 * len(keys)).bit_length()))
        table.add(keys, 0)
        for batch in batches:
            _, offsets = W.text_bytes(batch.column(1))
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for low, high, chunks in encoder.slices(batch.column(1)):
                number = table.find(chunks.hashes)
                known = number >= 0
                tokens = np.zeros(len(number) + 1, np.int64)
                tokens[1:][known] = frequent[number[known]]
                rare = np.flatnonzero(~known)
                if len(rare):
                    found = encoder.lookup(chunks, rare)
                    tokens[1:][rare] = encoder.sizes()[found]
                n_tokens[low:high] = np.diff(np.cumsum(tokens)[chunks.first])
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > limit)],
                [doc_id, "n_bytes", "n_tokens", "over_limit"],
            )

    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(count, f"`{doc_id}` {kind_of_id}, n_bytes long, n_tokens long, over_limit boolean")
