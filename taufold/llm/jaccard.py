"""Near-duplicate classes of documents: all pairs of shingle sets with a Jaccard similarity of 0.8 or more.

1. Sets.  Documents become sets of hashed word shingles; equal sets are one node.
2. Tiles.  All sets order shingles alike (shingles that many texts share last).
   Two similar sets share one of the first ``n - ceil(0.8 n) + 1`` shingles of
   each, so sets that share such a shingle form a tile.  Within a tile, sets are
   sorted by size, and only sizes within a ratio of 0.8 (a band) are compared.
3. Bounds.  Bits of hashed bitmaps that one set has and the other lacks bound the
   overlap from above; bitmaps grow with the sets.  Only pairs that pass are
   intersected exactly.
4. Classes.  Each set is first compared with the leaders of its largest tile and with
   the sets just before it there, then, among tiles whose sets are in different
   components, again.  This links almost all similar sets; afterwards every pair of a tile whose sets are still
   in different components is compared, so no link between components is missed.
   Shingles that stand in the same sets make one tile, and a large tile is dealt
   out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.llm.components import connected_components, merge_components
from taufold.llm.frequent import most_frequent
from taufold.sources.stage import stage

SHINGLE = 5
#: Similarity of 80 per cent: 100 * overlap >= 80 * union, or 9 * overlap >= 4 * (size + size).
#: Bits of a bitmap per shingle of the set (rounded up to a power of two), and at least; a first test uses the least.
SHINGLE_BITS = 8
LEAST_BITS = 1024
#: Shingles of a task that are counted together when common ones are looked for.
COUNTED = 1 << 22
#: A shingle is common when so many texts are seen to have it; at most so many are broadcast, commonest first.
#: The list decides the order of shingles only: any list gives the same links.
COMMON_TEXTS = 32
COMMON_ENTRIES = 1_000_000
#: Sets that are compared in one tile; larger tiles are dealt out and their leaders compared in the next round.
TILE_SETS = 4_096
#: A set is also compared with so many sets before it in its tile, where they aren't known to be of its component yet.
NEARBY = 64
#: Shingles that so many texts are seen to have are not looked up tile by tile: their sets count as having a partner.
HOT_TEXTS = 1_000_000
#: Sets of one block of a tile; larger tiles are dealt out as pairs of blocks, each a group of its own.
BLOCK_SETS = 4_096
#: Bits of the filter by which the scan for candidates' sets skips other documents; more candidates than it
#: can tell apart make it skip less.
FILTER_BITS = 1 << 26


def distinct_shingles(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts in a row, ascending within each text, and each text's first.

    A text with fewer words has its whole sequence as its only shingle.
    """
    n = len(words.first) - 1
    at = W.shingle_starts(words, size)
    hashes = W.shingle_hashes(words.hashes, size)[at]
    doc = np.searchsorted(words.first, at, "right") - 1
    counts = words.counts
    for few in range(1, size):
        own = np.flatnonzero(counts == few)
        if len(own):
            hashes = np.concatenate([hashes, W.shingle_hashes(words.hashes, few)[words.first[own]]])
            doc = np.concatenate([doc, own])
    order = np.argsort(hashes)
    narrow = np.uint16 if n < 1 << 16 else np.uint32
    order = order[np.argsort(doc[order].astype(narrow), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(n + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set; equal sets have equal ones."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)]) for h in (hashes, W.mix(hashes ^ W.STEP))]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def common_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts share, rarer ones first, and how many texts are seen to have them.

    Tasks report what repeats among their own texts; reports are added up.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(first, len(keys)))
            more = times > 1
            return pa.record_batch([pa.array(keys[first[more]].view(np.int64)), pa.array(times[more])], ["s", "n"])

        for batch in batches:
            data, offsets = W.text_bytes(batch.column(0))
            for low, high in W.text_slices(offsets):
                hashes, _ = distinct_shingles(W.find_words(data, offsets[low : high + 1], W.LOWER), size)
                held.append(hashes)
                n += len(hashes)
                if n >= COUNTED:
                    yield report()
                    held, n = [], 0
        if n:
            yield report()

    counted = docs.select(text).mapInArrow(repeated, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = most_frequent(stage(counted.filter(F.col("n") >= COMMON_TEXTS), "common-shingles"), "n", COMMON_ENTRIES).toArrow()
    shingles, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.lexsort((shingles, n))
    return shingles[order].astype(np.int64).view(np.uint64), n[order]


def shingle_sets(docs: DataFrame, common: np.ndarray, doc_id: str, text: str, size: int) -> DataFrame:
    """(key, id, tie, n, sig_a, sig_b, prefix): one row per document, without the set itself."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.HashTable(max(4, (2 * len(shared.value)).bit_length()))
        table.add(shared.value, 0)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for low, high in W.text_slices(offsets):
                hashes, first = distinct_shingles(W.find_words(data, offsets[low : high + 1], W.LOWER), size)
                n = np.diff(first)
                signs = signatures(hashes, first)
                rank = table.find(hashes)
                doc = np.repeat(np.arange(high - low), n)
                if (rank >= 0).any():  # common shingles go behind the others of their text
                    order = np.lexsort((rank, doc))
                    hashes = hashes[order]
                wanted = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                place = np.arange(len(hashes)) - np.repeat(first[:-1], n)
                prefix = hashes[place < np.repeat(wanted, n)].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(key, key + high - low)),
                        batch.column(0).slice(low, high - low),
                        batch.column(2).slice(low, high - low),
                        pa.array(n.astype(np.int64)),
                        *map(pa.array, signs),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(prefix)),
                    ],
                    ["key", "id", "tie", "n", "sig_a", "sig_b", "prefix"],
                )
                key += high - low

    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id), F.col(text), F.xxhash64(text).alias("_tie"))
    return source.mapInArrow(scan, f"key long, id {id_type}, tie long, n long, sig_a long, sig_b long, prefix array<long>")


def _filter_words(slots: DataFrame) -> np.ndarray:
    """A bit set of the slots: at most FILTER_BITS / 8 bytes, whatever the number of candidates."""
    bits = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    return out.view(np.uint64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Hashed bits of a set; a bitmap of half the width is the two halves put together."""
    width = max(LEAST_BITS, 1 << (SHINGLE_BITS * len(shingles) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles >> np.uint64(20)).astype(np.int64) % width] = True
    return np.packbits(bits).view(np.uint64)


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows, words) in a smaller width."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def candidate_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(tile, node, n, bits, shingles) of the sets of ``wanted`` (node, tile, id, sig_a, sig_b, n), by one more scan of the texts."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(FILTER_BITS)).cast("long")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_words(wanted.select(slot("id").alias("slot"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(1).to_numpy()
            inside = (shared.value[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)
            column = batch.column(0).filter(pa.array(inside.astype(bool)))
            data, offsets = W.text_bytes(column)
            for low, high in W.text_slices(offsets):
                hashes, first = distinct_shingles(W.find_words(data, offsets[low : high + 1], W.LOWER), size)
                sets = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
                binary = [pa.array(x, pa.binary()) for x in ([bitmap(s).tobytes() for s in sets], [s.tobytes() for s in sets])]
                yield pa.record_batch([*map(pa.array, signatures(hashes, first)), *binary], ["sig_a", "sig_b", "bits", "shingles"])

    found = docs.select(F.col(text), slot(doc_id).alias("_slot")).mapInArrow(scan, "sig_a long, sig_b long, bits binary, shingles binary")
    # Several documents of one class may pass the filter; any of them has the class's set.
    found = found.join(wanted.select("sig_a", "sig_b", "node", "tile", "n"), ["sig_a", "sig_b"])
    once = Window.partitionBy("sig_a", "sig_b").orderBy("node")
    return found.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").select("tile", "node", "n", "bits", "shingles")


def _enough(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 9 * overlap >= 4 * (n + m)


def _linked(one: np.ndarray, other: np.ndarray) -> bool:
    """Exact test of two sorted arrays."""
    if len(one) > len(other):
        one, other = other, one
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    return bool(_enough(np.int64((other[at] == one).sum()), len(one), len(other)))


def _may_link(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What one bitmap has and the other lacks is in one set alone: whether the overlap can be large enough."""
    ours = n - np.bitwise_count(bits & ~others).sum(1, dtype=np.int64)
    theirs = m - np.bitwise_count(others & ~bits).sum(1, dtype=np.int64)
    return _enough(np.minimum(ours, theirs), n, m)


class _Leaders:
    """Sets of a tile that no earlier leader of the tile is linked with, smallest first, and the sets that came last."""

    def __init__(self):
        self.keys: list[int] = []
        self.sets: list[np.ndarray] = []
        self.n = np.zeros(64, np.int64)
        #: Bitmaps of each width, with the number of the first leader of that width.
        self.bits: dict[int, tuple[int, np.ndarray]] = {}
        #: What is known of components: a number for each leader and for each of the last sets (0: no set yet).
        self.roots = np.zeros(64, np.int64)
        self.last_roots = np.zeros(NEARBY, np.int64)
        self.last_keys, self.last_n = np.zeros(NEARBY, np.int64), np.zeros(NEARBY, np.int64)
        self.last_bits = np.zeros((NEARBY, LEAST_BITS // 64), np.uint64)
        self.last_sets: list[np.ndarray | None] = [None] * NEARBY
        self.taken = 0

    def _likely(self, low: int, n: int, bits: np.ndarray) -> Iterator[int]:
        """Leaders from ``low`` on that may be linked; sizes in the band differ by one width at most."""
        k = len(self.keys)
        for width, (start, held) in self.bits.items():
            end = min([s for w, (s, _) in self.bits.items() if w > width], default=k)
            a, b = max(low, start), end
            if a < b:
                words = min(width, len(bits))
                own = narrowed(bits[None], words)
                yield from (a + np.flatnonzero(_may_link(self.n[a:b], narrowed(held[a - start : b - start], words), n, own))).tolist()

    def _join(self, root: int, other: int) -> None:
        self.roots[self.roots == other] = root
        self.last_roots[self.last_roots == other] = root

    def take(self, key: int, n: int, bits: np.ndarray, shingles: np.ndarray) -> tuple[list[int], bool]:
        """Sets linked with one that is no smaller than any before; whether it became a leader, as no leader is."""
        k = len(self.keys)
        low = int(np.searchsorted(self.n[:k], -(-4 * n // 5)))  # smaller sets are out of the band
        leaders = [j for j in self._likely(low, n, bits) if _linked(self.sets[j], shingles)]
        found = [self.keys[j] for j in leaders]
        self.taken += 1
        root = self.taken
        for j in leaders:
            self._join(root, int(self.roots[j]))
        found += self._nearby(n, narrowed(bits[None], LEAST_BITS // 64), shingles, root)
        if not leaders:
            start, held = self.bits.get(len(bits), (k, np.zeros((16, len(bits)), np.uint64)))
            if k == len(self.n):
                self.n, self.roots = np.concatenate([self.n, self.n]), np.concatenate([self.roots, self.roots])
            if k - start == len(held):
                held = np.concatenate([held, held])
            held[k - start] = bits
            self.bits[len(bits)] = (start, held)
            self.keys.append(key)
            self.sets.append(shingles)
            self.n[k], self.roots[k] = n, root
            for j in range(low):
                self.sets[j] = None  # out of every later band
        at = self.taken % NEARBY
        self.last_keys[at], self.last_n[at], self.last_roots[at], self.last_sets[at] = key, n, root, shingles
        self.last_bits[at] = narrowed(bits[None], LEAST_BITS // 64)[0]
        return found, not leaders

    def _nearby(self, n: int, narrow: np.ndarray, shingles: np.ndarray, root: int) -> list[int]:
        """Those of the last sets that are linked, one of each component that isn't the set's own."""
        found = []
        near = np.flatnonzero((self.last_roots != root) & (self.last_roots > 0) & (5 * self.last_n >= 4 * n))
        if len(near):
            near = near[_may_link(self.last_n[near], self.last_bits[near], n, narrow)]
        for j in near.tolist():
            if self.last_roots[j] != root and _linked(self.last_sets[j], shingles):
                found.append(int(self.last_keys[j]))
                self._join(root, int(self.last_roots[j]))
        return found


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, deal, node, n, bits, shingles) in order; links (a, b), and (node, NULL) of each leader."""
    current, leaders = None, _Leaders()
    for batch in batches:
        out_a, out_b = [], []
        tiles, deals, nodes, sizes = (batch.column(c).to_pylist() for c in range(4))
        for k, (tile, deal, node, n) in enumerate(zip(tiles, deals, nodes, sizes)):
            if (tile, deal) != current:
                current, leaders = (tile, deal), _Leaders()
            bits, shingles = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (4, 5))
            found, leads = leaders.take(node, n, bits, shingles)
            out_a += found + [node] * leads
            out_b += [node] * len(found) + [None] * leads
        yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def tile_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of sets (tile, node, n, bits, shingles) with the leaders of their tile."""
    links, tiles = [], sets
    while True:
        size = tiles.groupBy("tile").agg(F.count("*").alias("size")).filter(f"size > {TILE_SETS}")
        large = stage(size, "large-tiles")
        deal = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("size", F.lit(1)) / F.lit(TILE_SETS))).cast("long")
        dealt = tiles.join(large, "tile", "left").select("tile", deal.alias("deal"), "node", "n", "bits", "shingles")
        ordered = dealt.repartition("tile", "deal").sortWithinPartitions("tile", "deal", "n", "node")
        found = stage(ordered.mapInArrow(_tile_links, "a long, b long"), "tile-links")
        links.append(found.filter("b IS NOT NULL"))
        if large.isEmpty():
            break
        # Leaders of the parts of a large tile meet in the next round; they are fewer unless nothing was similar.
        leaders = found.filter("b IS NULL").select(F.col("a").alias("node"))
        inside = tiles.join(large.select("tile"), "tile", "left_semi")
        ahead = stage(inside.join(leaders, "node", "left_semi").select(*sets.columns), "leaders")
        if ahead.count() == inside.count():
            break
        tiles = ahead
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def least_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Prefix shingles that two linked sets of these sizes have in common at least.

    Of ``n - ceil(0.8 n) + 1`` prefix shingles no more than ``n - overlap`` are
    not common, and the first common ones lie in both prefixes.
    """
    overlap = (4 * (n + m) + 8) // 9
    return np.maximum(1, overlap - (4 * np.maximum(n, m) + 4) // 5 + 1)


def _runs(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[np.ndarray]:
    """Columns of rows sorted by their first, in pieces that hold all rows of a key.

    A key's rows are held together only while they are next to each other in the
    stream: as many as the largest tile has.
    """
    rest: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy() for c in range(n_columns)])
        cut = int(np.searchsorted(columns[0], columns[0, -1]))
        if cut or (rest and rest[0][0, 0] != columns[0, 0]):
            yield np.concatenate([*rest, columns[:, :cut]], axis=1)
            rest = []
        rest.append(columns[:, cut:])
    if rest:
        yield np.concatenate(rest, axis=1)


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n, place, node) in order; those with a partner of fitting size, the tile's size and the row's weight.

    The weight is one over the least number of prefix shingles that any partner
    of the tile would have to share: over the tiles of a linked set it adds up to 1 or more.
    That number grows with smaller partners' sizes.  With larger ones it falls by 16/45 a step, up to
    rounding: among those it is least at the largest, or at a size that is smaller by 1 or 2.
    """
    for columns in _runs(batches, 4):
        token, n, place, node = columns
        first = np.concatenate([[True], token[1:] != token[:-1]])
        tile = np.cumsum(first) - 1
        sets = np.bincount(tile)[tile]
        span = int(n.max()) * 2 + 2
        key = tile * span + n
        low = np.searchsorted(key, tile * span + (4 * n + 4) // 5)
        high = np.searchsorted(key, tile * span + 5 * n // 4, "right")
        least = least_shared(n, n[low])
        for less in range(3):
            at = np.searchsorted(key, key[high - 1] - less, "right") - 1
            least = np.minimum(least, least_shared(n, n[np.maximum(at, low)]))
        keep = high - low > 1
        out = [token[keep], n[keep], place[keep], node[keep], sets[keep], 1.0 / least[keep]]
        yield pa.record_batch([pa.array(c) for c in out], ["token", "n", "place", "node", "sets", "weight"])


@dataclass
class _Sets:
    """Rows of whole cells, sorted by cell and size; cells are numbered 0, 1, ... within ``keys``."""

    keys: np.ndarray  # (token, low, high) as columns
    block: np.ndarray
    n: np.ndarray
    place: np.ndarray
    node: np.ndarray
    root: np.ndarray
    times: np.ndarray
    first: np.ndarray  # word number of each bitmap
    words: np.ndarray
    pool: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Sets:
        column = lambda name: table.column(name).to_numpy()
        bits = table.column("bits").combine_chunks()
        bits = bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits
        words = pc.binary_length(bits).to_numpy().astype(np.int64) // 8
        start = np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1, bits.offset * 4)
        pool = np.frombuffer(bits.buffers()[2].slice(int(start[0]), int(start[-1] - start[0])).to_pybytes(), np.uint64)
        keys = np.stack([column(k) for k in ("token", "low", "high")])
        return cls(keys, *map(column, ("block", "n", "place", "node", "root", "times")), np.cumsum(words) - words, words, pool)

    def bitmaps(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of rows of one width, in a width of ``words``."""
        own = int(self.words[rows[0]])
        return narrowed(self.pool[self.first[rows][:, None] + np.arange(own)], words)

    def narrow(self) -> np.ndarray:
        out = np.empty((len(self.n), LEAST_BITS // 64), np.uint64)
        for own in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == own)
            for low in range(0, len(rows), 1 << 12):
                out[rows[low : low + (1 << 12)]] = self.bitmaps(rows[low : low + (1 << 12)], out.shape[1])
        return out


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, low, high, n): pairs of different roots that may be linked."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cut = batch.num_rows - int(np.argmin((keys == keys[:, -1:]).all(axis=0)[::-1])) if (keys != keys[:, -1:]).any() else 0
        if cut or (rest and any(rest[0].column(c)[0] != batch.column(c)[0] for c in range(3))):
            yield from _pairs_of(_Sets.of(pa.Table.from_batches([*rest, batch.slice(0, cut)])))
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield from _pairs_of(_Sets.of(pa.Table.from_batches(rest)))


def _pairs_of(sets: _Sets) -> Iterator[pa.RecordBatch]:
    n, place, root, small = sets.n, sets.place, sets.root, sets.narrow()
    cell = np.concatenate([[0], np.cumsum((sets.keys[:, 1:] != sets.keys[:, :-1]).any(axis=0))])
    one_block = sets.keys[1] == sets.keys[2]
    alive = np.arange(len(n))
    back = 1
    while len(alive := alive[alive + back < len(n)]):
        other = alive + back
        near = (cell[alive] == cell[other]) & (5 * n[alive] >= 4 * n[other])
        alive, other = alive[near], other[near]  # rows are sorted: what is out of reach now stays so
        before = np.minimum(place[alive], place[other])
        behind = np.minimum(n[alive] - place[alive], n[other] - place[other])
        keep = (root[alive] != root[other]) & _enough(before + behind, n[alive], n[other])
        keep &= one_block[alive] | (sets.block[alive] != sets.block[other])
        one, two = alive[keep], other[keep]
        found = []
        for low in range(0, len(one), 1 << 14):
            x, y = one[low : low + (1 << 14)], two[low : low + (1 << 14)]
            likely = _may_link(n[x], small[x], n[y], small[y])
            found += _by_full_bitmaps(sets, x[likely], y[likely])
        if found:
            one, two = (np.concatenate(side) for side in zip(*found))
            swap = sets.node[one] > sets.node[two]
            one, two = np.where(swap, two, one), np.where(swap, one, two)
            columns = (sets.node[one], sets.node[two], n[one], n[two], sets.times[one])
            yield pa.record_batch([pa.array(c) for c in columns], ["a", "b", "n", "m", "times"])
        back += 1


def _by_full_bitmaps(sets: _Sets, one: np.ndarray, two: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs that pass the test at the smaller width of the two bitmaps."""
    found = []
    widths = np.stack([sets.words[one], sets.words[two]])
    for a, b in np.unique(widths, axis=1).T.tolist():
        which = np.flatnonzero((widths[0] == a) & (widths[1] == b))
        step = max(1, (1 << 19) // max(a, b))
        for low in range(0, len(which), step):
            x, y = one[which[low : low + step]], two[which[low : low + step]]
            keep = _may_link(sets.n[x], sets.bitmaps(x, min(a, b)), sets.n[y], sets.bitmaps(y, min(a, b)))
            if keep.any():
                found.append((x[keep], y[keep]))
    return found


def _pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, shingles, shingles) that are linked."""
    for batch in batches:
        keep = [_linked(*(np.frombuffer(s.as_py(), np.uint64) for s in pair)) for pair in zip(batch.column(2), batch.column(3))]
        yield pa.record_batch([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])


def _with_roots(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    return tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def second_homes(sets: DataFrame, tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """``sets`` with the largest tile of each that holds more than one component; without those that have none."""
    rooted = _with_roots(tokens, roots)
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    found = rooted.join(mixed.filter("low < high").select("token", "size"), "token")
    homes = found.groupBy("node").agg(F.max(F.struct("size", "token")).alias("home")).select("node", F.col("home.token").alias("tile"))
    return sets.drop("tile").join(homes, "node").select(*sets.columns)


def cross_links(sets: DataFrame, tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """All links (a, b) between sets of one tile whose roots differ.

    Near copies share many prefix shingles, each a tile of the same sets: such
    tiles become one, which counts ``times``.  Equal tiles are told by their
    number of sets and two 64-bit sums of hashes.
    """
    rooted = stage(_with_roots(tokens, roots), "rooted")
    tiles = rooted.groupBy("token").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit("other"))).alias("other"),
    )
    tiles = tiles.filter("low < high").groupBy("size", "one", "other").agg(F.min("token").alias("token"), F.count("*").alias("times"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK_SETS)).cast("long").alias("blocks")
    dealt = rooted.join(tiles.select("token", "times", blocks), "token")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = [F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")]
    rows = dealt.select("token", *cell, "block", "n", "place", "node", "root", "times").join(sets.select("node", "bits"), "node")
    rows = rows.select("token", "low", "high", "block", "n", "place", "node", "root", "times", "bits")
    rows = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "node")
    met = rows.mapInArrow(_tile_pairs, "a long, b long, n long, m long, times long")
    # A pair of a dealt tile meets in one cell: that of its two blocks.
    met = met.groupBy("a", "b", "n", "m").agg(F.sum("times").alias("shared"))
    # The same bound as least_shared: pairs with fewer common prefix shingles can't be linked.
    bound = F.expr("(4 * (n + m) + 8) div 9 - (4 * greatest(n, m) + 4) div 5 + 1")
    pairs = stage(met.filter(F.col("shared") >= bound).select("a", "b"), "pairs")
    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("shingles").alias(name))
    full = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_pair_links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, id, tie, n, component_id, root) of every row; ``key`` is unique, ``tie`` a hash of the text.

    ``n`` is the size of the row's set, ``component_id`` the smallest id that is
    reachable over links, ``root`` the key that stands for the component: components
    may have the same smallest id, or NULL, but never the same root.  NULL, empty and wordless texts have an empty set, are
    linked with nothing and keep their own id, NULL included.  Rows of equal id
    are rows of their own.  Other columns are not read.
    """
    common, seen = common_shingles(docs, text, size)
    rows = stage(shingle_sets(docs, common, doc_id, text, size), "shingle-sets")
    signature = ["sig_a", "sig_b", "n"]
    classes = rows.filter("n > 0").groupBy(*signature).agg(F.min("key").alias("node"), F.min("id").alias("low"))
    classes = stage(classes, "classes")
    firsts = rows.join(classes.select(F.col("node").alias("key")), "key")
    tokens = firsts.select(F.posexplode("prefix").alias("place", "token"), "n", F.col("key").alias("node"))
    tokens = tokens.select("token", "n", F.col("place").cast("long").alias("place"), "node")
    hot = seen >= HOT_TEXTS
    if hot.any():
        # At most COMMON_ENTRIES rows.
        known = pa.table({"token": common[hot].view(np.int64), "sets": seen[hot]})
        known = F.broadcast(docs.sparkSession.createDataFrame(known))
        sure = tokens.join(known, "token").select("token", "n", "place", "node", "sets", F.lit(1.0).alias("weight"))
        tokens = tokens.join(known, "token", "left_anti")
    ordered = tokens.repartition("token").sortWithinPartitions("token", "n", "node")
    shared = ordered.mapInArrow(_shared_tokens, "token long, n long, place long, node long, sets long, weight double")
    shared = stage(shared.unionByName(sure) if hot.any() else shared, "tokens")
    homes = shared.groupBy("node").agg(F.max(F.struct("sets", "token")).alias("home"), F.sum("weight").alias("weight"))
    homes = stage(homes.filter("weight > 0.999999").select("node", F.col("home.token").alias("tile")), "homes")
    wanted = stage(rows.select(F.col("key").alias("node"), "id", *signature).join(homes, "node"), "wanted")
    sets = stage(candidate_sets(docs, wanted, doc_id, text, size), "sets")
    links = stage(tile_links(sets), "links")
    roots = stage(connected_components(links), "roots")
    alive = shared.select("token", "n", "place", "node").join(homes.select("node"), "node", "left_semi")
    for further in (lambda: tile_links(stage(second_homes(sets, alive, roots), "second-homes")), lambda: cross_links(sets, alive, roots)):
        more = stage(further(), "more-links")
        if not more.isEmpty():
            roots = stage(merge_components(roots, more), "roots")
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(rooted.join(lowest, "root").select(*signature, "component_id", "root"), "named")
    found = rows.select("key", "id", "tie", *signature).join(named, signature, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    return found.select("key", "id", "tie", "n", component, F.coalesce("root", "key").alias("root"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id, of equal ones any.

    Rows without words stay.
    """
    found = near_duplicates(docs, doc_id, text, size).withColumn("_lost", F.col("id").isNull())
    leads = found.filter("n > 0").groupBy("root").agg(F.min(F.struct("_lost", "id", "key")).alias("first"))
    stays = found.filter("n > 0").select("key", "id", "tie").join(leads.select(F.col("first.key").alias("key")), "key")
    stays = stays.select("id", "tie", F.lit(True).alias("_one")).unionByName(found.filter("n = 0").select("id", "tie", F.lit(False).alias("_one")))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    keys = stays.select(name("id").alias("_id"), F.col("tie").alias("_tie"), "_one").distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name(doc_id).alias("_id"), F.xxhash64(text).alias("_tie"))
    joined = held.join(keys, ["_id", "_tie"])
    # Rows of equal id and text: one stays, unless they have no words.
    nth = F.row_number().over(Window.partitionBy("_id", "_tie").orderBy("_one"))
    return joined.withColumn("_nth", nth).filter((F.col("_nth") == 1) | ~F.col("_one")).select("row.*")
