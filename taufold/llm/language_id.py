"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds all substrings of some labelled
text.  A new text is parsed from left to right into the longest phrases that the
automaton knows; text of the same language needs few long phrases, text of
another one many short ones.  The language with the fewest phrases, normalised by
the bits that name a place in its training text, wins.

The automata are laid out as one table (state, symbol) -> next state, with the
end of a phrase marked in the lowest bit, so many texts take one step together.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.llm import words as W

#: Training text per language in bytes, and over all languages together; both bound the table (about 1.5 states of 4 bytes a symbol each).
TRAIN_BYTES = 40_000
TRAIN_BYTES_ALL = 800_000
#: Labelled rows per language from which training text is taken, the lowest hash of each of so many salts.
TRAIN_ROWS = 128
#: Longer rows give so many characters from a hashed place on, so one row can't be a language's text alone.
TRAIN_ROW_CHARS = 4_096
SYMBOLS = 64
#: Texts are parsed in stretches of so many symbols, side by side.
STRETCH = 1024


def symbol_table(texts: list[bytes]) -> np.ndarray:
    """Symbols of bytes: 1 for all that is no letter, letters without case, then the commonest bytes beyond ASCII."""
    table = np.ones(256, np.uint8)
    for k in range(26):
        table[65 + k] = table[97 + k] = 2 + k
    seen = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)[128:]
    order = np.argsort(-seen, kind="stable")
    table[128:] = 0
    own = min(SYMBOLS - 28, int((seen > 0).sum()))
    table[128 + order[:own]] = 28 + np.arange(own)
    return table


def symbols(text: np.ndarray, edges: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts in a row, a run of non-letters being one, and the new edges."""
    codes = table[text]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
    keep[edges[edges < len(codes)]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[edges]


def automaton(text: np.ndarray, table: np.ndarray) -> int:
    """Writes the transitions of the suffix automaton of a symbol sequence into the first rows of ``table``; -1 where there is none.

    ``table`` is (states, symbols) int32 with room for twice as many states as
    symbols in ``text``; the number of states is returned.  Rows beyond are not touched.
    """
    width = table.shape[1]
    steps = memoryview(table.reshape(-1))
    none = array("i", [-1]) * width
    link, length = array("i", [-1]), array("i", [0])
    steps[:width] = none
    last = 0
    for symbol in text.tolist():
        state = len(link)
        steps[state * width : (state + 1) * width] = none
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and steps[at * width + symbol] < 0:
            steps[at * width + symbol] = state
            at = link[at]
        if at >= 0:
            following = steps[at * width + symbol]
            if length[following] == length[at] + 1:
                link[state] = following
            else:
                copy = len(link)
                steps[copy * width : (copy + 1) * width] = steps[following * width : (following + 1) * width]
                length.append(length[at] + 1)
                link.append(link[following])
                link[following] = link[state] = copy
                while at >= 0 and steps[at * width + symbol] == following:
                    steps[at * width + symbol] = copy
                    at = link[at]
        last = state
    return len(link)


class CrossParser:
    """The automata of all languages in one table, which they are built in."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.table = symbol_table([samples[k] for k in self.languages])
        raw = [np.frombuffer(samples[name], np.uint8) for name in self.languages]
        codes = [symbols(r, np.array([0, len(r)]), self.table)[0] for r in raw]
        self.width = width = int(self.table.max()) + 1
        # Memory of rows that are never written is never taken.
        steps = np.empty((sum(2 * len(c) + 2 for c in codes), width), np.int32)
        self.roots, self.bits, base = [], [], 0
        for own in codes:
            states = automaton(own, steps[base:])
            start = np.maximum(steps[base], 0)  # behind the end of a phrase; an unknown symbol is a phrase by itself
            for low in range(base, base + states, 1 << 12):
                rows = steps[low : min(low + (1 << 12), base + states)]
                ends = rows < 0
                rows[:] = (np.where(ends, start, rows) + base) * (2 * width) + ends
            self.roots.append(base * width * 2)
            self.bits.append(np.log2(max(2, len(own))))
            base += states
        self.steps = steps[:base].reshape(-1)

    def phrases(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each text: (languages, texts)."""
        sizes = np.diff(edges)
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = edges[:-1][text] + part * STRETCH
        long = np.minimum(STRETCH, edges[1:][text] - first)
        order = np.argsort(-long, kind="stable")
        text, first, long = text[order], first[order], long[order]
        lanes = len(text)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], lanes, 1)
        count = np.ones_like(state)  # the phrase that is open at the end
        active = np.searchsorted(-long, -np.arange(1, (long[0] if lanes else 0) + 1), "right")
        for step, n in enumerate(active.tolist()):
            if state.shape[1] != n:
                state = state[:, :n].copy()
            symbol = codes[first[:n] + step].astype(np.int32)
            state >>= 1
            state += symbol
            state = self.steps.take(state)
            count[:, :n] += state & 1
        out = np.zeros((len(self.languages), len(sizes)), np.int64)
        for k in range(len(self.languages)):
            out[k] = np.bincount(text, count[k], len(sizes))
        return out

    def predict(self, text: np.ndarray, edges: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of texts in a row; ties go to the first name."""
        codes, cuts = symbols(text, edges, self.table)
        cost = self.phrases(codes, cuts) * np.array(self.bits)[:, None]
        letters = _letters(text, edges)
        best = np.argmin(cost, axis=0)
        least = np.take_along_axis(cost, best[None], 0)[0]
        if len(self.languages) > 1:
            second = np.partition(cost, 1, axis=0)[1]
        else:
            second = np.full(len(best), np.inf)
        # 1 for a parse that needs nothing beside the next best language's, 0 for one as long as that.
        score = np.where(letters, 1 - least / np.maximum(second, 1e-9), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())], np.clip(score, 0.0, 1.0)


def _letters(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    lower = text | 0x20
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])[edges]
    found = plain[1:] > plain[:-1]
    for d in np.flatnonzero(~found):
        found[d] = any(c.isalpha() for c in text[edges[d] : edges[d + 1]].tobytes().decode())
    return found


def training_text(rows: DataFrame, key: str, text: str, lang: str) -> dict[str, bytes]:
    """Bounded training text of each language: rows with the lowest hash of their salt, joined in hash order.

    Every labelled row with a text may be chosen, whatever its length: a long
    one gives a stretch of ``TRAIN_ROW_CHARS`` characters.
    """
    usable = rows.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    hashed = usable.select(F.col(lang).cast("string").alias("_lang"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_h"), F.col(text).alias("_text"))
    spare = F.greatest(F.length("_text") - F.lit(TRAIN_ROW_CHARS), F.lit(0))
    place = F.pmod(F.xxhash64("_h"), spare + 1).cast("int") + 1
    hashed = hashed.select("_lang", "_h", F.substring("_text", place, F.lit(TRAIN_ROW_CHARS)).alias("_text"))
    salt = F.pmod("_h", F.lit(TRAIN_ROWS))
    lowest = [r["h"] for r in hashed.groupBy("_lang", salt.alias("salt")).agg(F.min("_h").alias("h")).collect()]
    if not lowest:
        return {}
    chosen = hashed.filter(F.col("_h").isin(lowest)).dropDuplicates(["_lang", "_h"]).orderBy("_lang", "_h").collect()
    room = min(TRAIN_BYTES, TRAIN_BYTES_ALL // len({r["_lang"] for r in chosen}))
    out: dict[str, bytes] = {}
    for r in chosen:
        out[r["_lang"]] = (out.get(r["_lang"], b"") + r["_text"].encode() + b" ")[:room]
    return out


def worker_parser(samples: dict[str, bytes]) -> CrossParser:
    """This worker's parser; it is built once from the broadcast text."""
    return W.resident(("parser", *sorted(samples.items())), lambda: CrossParser(samples))


def identify(docs: DataFrame, samples: dict[str, bytes], text: str = "text") -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with lang_pred and score.

    Texts that are NULL or without a letter are ``und`` with a score of 0, as is
    everything when there is no labelled text.  Scores tell how much shorter the
    best parse is than the second best.  Copies get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_parser(shared.value) if shared.value else None
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for low, high in W.text_slices(offsets):
                own, edges = data[int(offsets[low]) : int(offsets[high])], offsets[low : high + 1] - offsets[low]
                names, score = parser.predict(own, edges) if parser else (["und"] * (high - low), np.zeros(high - low))
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    return source.mapInArrow(scan, f"row {source.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
