"""Which words of the documents stand in passages of a benchmark?

A prefix-filtered set join.  A window is a run of ``window`` words of an item
(or a whole shorter item); its tokens are its overlapping shingles.  One scan of
the texts keeps, per document, the places of shingles that some window has.
Shingles are then ordered by rarity (documents that have them).  To hold a
window, a document must hold all its shingles, so one necessary prefix token is
enough: the window's rarest shingle.  Its places give alignments; length and
position bounds drop those that leave the text; the others are verified shingle
by shingle over the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.sources.stage import stage

WINDOW = 10
SHINGLE = 5
#: Benchmark words that are broadcast at once; a larger benchmark is joined in blocks of items.
BLOCK_WORDS = 2_000_000


class _Windows:
    """The distinct windows of some items: shingle numbers in order, and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int, alphabet: W.Alphabet):
        keys: dict[tuple[int, int], int] = {}  # (shingle size, hash) -> number
        seen: dict[tuple[int, ...], int] = {}
        self.sizes: list[int] = []  # words in each window
        self.steps: list[int] = []  # words in a shingle of each window
        self.shingles: list[tuple[int, ...]] = []
        owners: list[list[str]] = []
        for name, text in items:
            hashes = W.hash_text((text or "").encode(), alphabet)
            size = min(window, len(hashes))
            if not size:
                continue
            step = min(shingle, size)
            numbers = [keys.setdefault((step, h), len(keys)) for h in W.shingle_hashes(hashes, step).tolist()]
            for at in range(len(hashes) - size + 1):
                content = tuple(numbers[at : at + size - step + 1])
                w = seen.setdefault(content, len(seen))
                if w == len(owners):
                    owners.append([])
                    self.shingles.append(content)
                    self.sizes.append(size)
                    self.steps.append(step)
                if not owners[w] or owners[w][-1] != name:
                    owners[w].append(name)
        self.owners = [sorted(set(o)) for o in owners]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for step in {k for k, _ in keys}:
            own = sorted((h, n) for (k, h), n in keys.items() if k == step)
            self.by_size[step] = (np.array([h for h, _ in own], np.uint64), np.array([n for _, n in own], np.int64))
        self.n_shingles = len(keys)

    def prefixes(self, rarity: dict[int, int]) -> dict[str, np.ndarray]:
        """Windows in the order of their necessary shingle, with that shingle's place in the window."""
        rarest, offset = [], []
        for content in self.shingles:
            at = min(range(len(content)), key=lambda k: (rarity.get(content[k], 0), content[k], k))
            rarest.append(content[at])
            offset.append(at)
        order = np.argsort(np.array(rarest, np.int64), kind="stable")
        longest = max(map(len, self.shingles), default=0)
        grid = np.full((len(self.shingles), longest), -1, np.int64)
        for k, content in enumerate(self.shingles):
            grid[k, : len(content)] = content
        return {
            "shingle": np.array(rarest, np.int64)[order],
            "offset": np.array(offset, np.int64)[order],
            "size": np.array(self.sizes, np.int64)[order],
            "grid": grid[order],
            "window": order,
        }


def _postings(docs: DataFrame, doc_id: str, text: str, windows: _Windows, alphabet: W.Alphabet, rows: bool = False) -> DataFrame:
    """One scan: (id, tie, n_words, places, shingles); the lists hold only shingles of the benchmark.

    With ``rows``, each row of ``docs`` comes along as a struct.
    """
    tables = docs.sparkSession.sparkContext.broadcast(windows.by_size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = []
        for step, (keys, numbers) in sorted(tables.value.items()):
            table = W.HashTable(max(4, (2 * len(keys)).bit_length()))
            table.add(keys, 0)
            lookups.append((step, table, numbers))
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for low, high in W.text_slices(offsets):
                words = W.find_words(data, offsets[low : high + 1], alphabet)
                at, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for step, table, numbers in lookups:
                    found = table.find(W.shingle_hashes(words.hashes, step))
                    hit = np.flatnonzero(found >= 0)
                    hit = hit[np.isin(hit, W.shingle_starts(words, step), assume_unique=True)] if len(hit) else hit
                    at.append(hit)
                    what.append(numbers[found[hit]])
                at, what = np.concatenate(at), np.concatenate(what)
                order = np.lexsort((what, at))
                at, what = at[order], what[order]
                cuts = np.searchsorted(at, words.first)
                at = at - np.repeat(words.first[:-1], np.diff(cuts))
                cuts = pa.array(cuts.astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(2).slice(low, high - low),
                        pa.array(words.counts),
                        pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(what.astype(np.int32))),
                        *(batch.column(c).slice(low, high - low) for c in range(3, batch.num_columns)),
                    ],
                    ["id", "tie", "n_words", "places", "shingles", "row"][: batch.num_columns + 2],
                )

    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tie"), *_rows(docs, rows))
    row = f", row {source.schema['row'].dataType.simpleString()}" if rows else ""
    return source.mapInArrow(scan, f"id {id_type}, tie long, n_words long, places array<int>, shingles array<int>{row}")


def _rows(docs: DataFrame, rows: bool) -> list[F.Column]:
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []


def _verified(places: np.ndarray, shingles: np.ndarray, cuts: np.ndarray, n_words: np.ndarray, p: dict) -> tuple:
    """(document, first word, words, window) of every window that occurs, for documents in a row."""
    doc = np.repeat(np.arange(len(n_words)), np.diff(cuts))
    low, high = (np.searchsorted(p["shingle"], shingles, side) for side in ("left", "right"))
    times = high - low
    posting = np.repeat(np.arange(len(shingles)), times)
    entry = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + low[posting]
    first = places[posting] - p["offset"][entry]
    inside = (first >= 0) & (first + p["size"][entry] <= n_words[doc[posting]])
    posting, entry, first = posting[inside], entry[inside], first[inside]
    span = int(n_words.max(initial=0)) + p["grid"].shape[1] + 1
    width = int(max(shingles.max(initial=0), p["grid"].max(initial=0))) + 1
    have = (doc * span + places) * width + shingles  # ascending: documents, places and shingles are
    base = doc[posting] * span + first
    good = np.ones(len(entry), bool)
    for k in range(p["grid"].shape[1]):
        need = p["grid"][entry, k]
        want = (base + k) * width + need
        at = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
        good &= (need < 0) | (have[at] == want)
    return doc[posting][good], first[good], p["size"][entry[good]], p["window"][entry[good]]


def _hits(table: DataFrame, windows: _Windows) -> DataFrame:
    """(id, tie, n_words, spans, items) of every row of a postings table."""
    counted = table.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    rarity = {r["s"]: r["n"] for r in counted.collect()}  # at most the shingles of one block of the benchmark
    shared = table.sparkSession.sparkContext.broadcast((windows.prefixes(rarity), windows.owners))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, owners = shared.value
        for batch in batches:
            lists = batch.column(3)
            cuts = lists.offsets.to_numpy().astype(np.int64)
            places = lists.values.to_numpy()[cuts[0] : cuts[-1]].astype(np.int64)
            shingles = batch.column(4).values.to_numpy()[cuts[0] : cuts[-1]].astype(np.int64)
            n_words = batch.column(2).to_numpy()
            doc, first, size, window = _verified(places, shingles, cuts - cuts[0], n_words, prefixes)
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            order = np.lexsort((first, doc))
            for d, a, n, w in zip(*(x[order].tolist() for x in (doc, first, size, window))):
                own = spans[d]
                if own and a <= own[-1]:
                    own[-1] = max(own[-1], a + n)
                else:
                    own += [a, a + n]
                items[d].update(owners[w])
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in range(3)),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    *(batch.column(c) for c in range(5, batch.num_columns)),
                ],
                ["id", "tie", "n_words", "spans", "items", "row"][: batch.num_columns],
            )

    id_type = table.schema["id"].dataType.simpleString()
    row = f", row {table.schema['row'].dataType.simpleString()}" if "row" in table.columns else ""
    return table.mapInArrow(verify, f"id {id_type}, tie long, n_words long, spans array<long>, items array<string>{row}")


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size, read one block at a time."""
    held, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    for r in rows.toLocalIterator():
        n = len(r["t"] or "") // 2 + 1
        if held and words + n > block_words:
            yield held
            held, words = [], 0
        held.append((r["i"], r["t"]))
        words += n
    yield held


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    alphabet: W.Alphabet = W.ALNUM,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row.

    ``spans`` lists first word and word behind the last of each hit passage, flat
    and in order; ``items`` the ids, as sorted strings, of items with an occurring
    window.  NULL or wordless texts and items have no words and no hits.  Rows
    with equal or NULL ids each get their own row; items with equal ids count
    once, a NULL item id is the empty string.  Other columns are not read.
    """
    parts = []
    for block in _blocks(benchmark, item_id, item_text, block_words):
        windows = _Windows(block, window, shingle, alphabet)
        parts.append(_hits(stage(_postings(docs, doc_id, text, windows, alphabet), "postings"), windows))
    found = parts[0]
    if len(parts) > 1:
        # Rows of equal id and text have equal results, so they meet under (id, hash of the text) and part again.
        for part in parts[1:]:
            found = found.unionByName(part)
        found = _merged(found, len(parts))
    return found.select(F.col("id").alias(doc_id), "n_words", "spans", "items")


def _merged(found: DataFrame, parts: int) -> DataFrame:
    """Results of several blocks of items, joined: spans that touch or overlap become one."""

    pairs = "transform(sequence(0, size(spans) - 1, 2), k -> struct(spans[k] AS a, spans[k + 1] AS b))"
    listed = found.withColumn("pairs", F.expr(f"if(size(spans) = 0, array(), {pairs})"))
    grouped = listed.groupBy("id", "tie", "n_words").agg(
        F.count("*").alias("n"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("pairs")))).alias("pairs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    joined = """aggregate(pairs, cast(array() AS array<bigint>), (s, p) ->
        if(size(s) > 0 AND p.a <= s[size(s) - 1],
           concat(slice(s, 1, size(s) - 1), array(greatest(s[size(s) - 1], p.b))), concat(s, array(p.a, p.b))))"""
    copies = F.sequence(F.lit(1), (F.col("n") / parts).cast("int"))
    return grouped.withColumn("spans", F.expr(joined)).withColumn("_copy", F.explode(copies))


def hit_words(spans: str = "spans") -> F.Column:
    """Number of words in the hit passages."""
    ends = f"filter({spans}, (x, k) -> k % 2 = 1)"
    starts = f"filter({spans}, (x, k) -> k % 2 = 0)"
    return F.expr(f"aggregate({ends}, 0L, (n, x) -> n + x) - aggregate({starts}, 0L, (n, x) -> n + x)")


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs; NULL and wordless texts stay."""
    for block in _blocks(benchmark, item_id, item_text, BLOCK_WORDS):
        windows = _Windows(block, WINDOW, SHINGLE, W.ALNUM)
        postings = stage(_postings(docs, doc_id, text, windows, W.ALNUM, rows=True), "postings")
        docs = _hits(postings, windows).filter(F.size("spans") == 0).select("row.*")
    return docs
