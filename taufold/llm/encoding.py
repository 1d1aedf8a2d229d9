"""Token ids of whole texts through a bounded cache of encoded chunks in each Python worker.

A chunk is a piece of text whose borders no token of the vocabulary can cross,
so its ids do not depend on what stands around it.  Chunks repeat: a worker has
the library encode a chunk once and then looks its hash up, many chunks at a
time.  Texts with special strings go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from taufold.llm import words as W

#: Chunks and ids that a worker keeps: 13 MB of table, 8 bytes a chunk and 4 an id.
CACHE_BITS = 20
CACHE_CHUNKS = 650_000
CACHE_IDS = 6_000_000
#: White space outside ASCII, as the vocabularies' own patterns see it.
WIDE_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A simple chunk: at most one space or line break, Latin letters, then ASCII marks other than an apostrophe.
SIMPLE = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


@dataclass
class Chunks:
    """Chunks of some texts in a row; ``first[d]`` is the number of the first one of text d."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


class ChunkEncoder:
    """Ids of texts; subclasses name the library and the borders of chunks."""

    separators = W.SPACES
    keep_space = True
    lower = False
    special: re.Pattern | None = None

    def __init__(self, path: str):
        self.path = path
        self.load()
        codes, self.inside = W.Alphabet(self.lower, self.separators).table()
        self.codes = codes
        self.clear()

    def clear(self) -> None:
        self.table = W.HashTable(CACHE_BITS)
        self.ids = np.zeros(1 << 18, np.int32)
        self.ends = np.zeros(1 << 18, np.int64)
        self.known = self.used = 0

    def _learn(self, found: list) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(found) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.int32, total)
        self.ends[self.known : self.known + len(found)] = self.used + np.cumsum(sizes)
        self.used += total
        self.known += len(found)

    def _chunks(self, text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of texts in a row, and the number of the first chunk of each text."""
        inside = self.inside[text]
        if self.keep_space and len(self.separators) > 1:
            for m in WIDE_SPACES.finditer(text):
                inside[m.start() : m.end()] = False
        starts, ends = W.find_spans(inside, edges)
        if self.keep_space:  # a chunk begins where the last one ended; white space at the end of a text is one more
            sizes = np.diff(edges)
            last = np.searchsorted(starts, edges[1:]) - 1
            last_end = np.where((last >= 0) & (len(ends) > 0), ends[np.maximum(last, 0)] if len(ends) else 0, 0)
            tail = np.flatnonzero((sizes > 0) & (np.maximum(last_end, edges[:-1]) < edges[1:]))
            ends = np.sort(np.concatenate([ends, edges[1:][tail]]))
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        first = np.searchsorted(ends, edges, "right")
        if self.special is not None and (m := [m.start() for m in self.special.finditer(text)]):
            whole = np.unique(np.searchsorted(edges, m, "right") - 1)
            keep = np.ones(len(starts), bool)
            starts, ends = starts.copy(), ends.copy()
            for d in whole:
                keep[first[d] + 1 : first[d + 1]] = False
                starts[first[d]], ends[first[d]] = edges[d], edges[d + 1]
            starts, ends = starts[keep], ends[keep]
            first = np.searchsorted(ends, edges, "right")
        return starts, ends, first

    def hashed_chunks(self, text: np.ndarray, edges: np.ndarray) -> Chunks:
        starts, ends, first = self._chunks(text, edges)
        return Chunks(text, starts, ends, W.mix(self._chunk_hashes(text, starts, ends, first)), first)

    def lookup(self, chunks: Chunks, which: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the chunks, or of those at ``which``; new ones are encoded."""
        if self.known > CACHE_CHUNKS or self.used > CACHE_IDS:
            self.clear()
        hashes = chunks.hashes if which is None else chunks.hashes[which]
        numbers = self.table.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers
        raw = chunks.text.tobytes()
        new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
        while len(self.table.keys) < 3 * (self.known + len(new)) // 2:
            self._grow()
        at = missing[where] if which is None else which[missing[where]]
        self.table.add(new, self.known)
        numbers[missing] = self.known + back
        at_first = np.isin(at, chunks.first[:-1])
        for low in range(0, len(at), 100_000):
            some = at[low : low + 100_000]
            spans = zip(chunks.starts[some].tolist(), chunks.ends[some].tolist())
            self._learn(self.encode_chunks([raw[a:b] for a, b in spans], at_first[low : low + 100_000]))
        return numbers

    def _grow(self) -> None:
        """A single slice may hold more new chunks than the cache is meant for."""
        full = self.table.keys != 0
        keys, numbers = self.table.keys[full], self.table.numbers[full]
        self.table = W.HashTable(int(len(self.table.keys) * 2).bit_length() - 1)
        self.table.add(keys[np.argsort(numbers)], 0)

    def _chunk_hashes(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        return W.span_hashes(self.codes[text], starts, ends)

    def sizes(self) -> np.ndarray:
        """The number of ids of each chunk."""
        return np.diff(self.ends[: self.known], prepend=0)

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, Chunks]]:
        """Rows low:high of a text column and their chunks."""
        data, offsets = W.text_bytes(column)
        for low, high in W.text_slices(offsets):
            at = int(offsets[low])
            yield low, high, self.hashed_chunks(data[at : int(offsets[high])], offsets[low : high + 1] - at)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Rows low:high of a text column, all their ids in a row and the offsets of each row's ids."""
        for low, high, chunks in self.slices(column):
            numbers = self.lookup(chunks)
            sizes = self.sizes()[numbers]
            after = np.cumsum(sizes)
            where = np.arange(int(after[-1]) if len(after) else 0)
            where += np.repeat(self.ends[numbers] - after, sizes)
            yield low, high, self.ids[where], np.concatenate([[0], after])[chunks.first]


class ByteEncoder(ChunkEncoder):
    """A byte-level vocabulary of the tokenizers library whose pattern binds one space to the word behind it.

    White space and the word behind it are a chunk: no token of the pattern ends
    in white space that follows a word.
    """

    def load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(self.path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if added:
            self.special = re.compile(b"|".join(re.escape(a.encode()) for a in added), re.IGNORECASE)
        self.model = self.tokenizer.model
        # The library's own alphabet for bytes, read off one byte at a time where UTF-8 allows it.
        one = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        text = "".join(chr(c) for c in range(0x800))
        shown = "".join(part for part, _ in one.pre_tokenize_str(text))
        self.shown = dict(zip(text.encode(), shown))
        self.parts: dict[str, list] = {}

    def _part(self, text: str) -> list:
        """Ids of a line break or of some marks; there are few."""
        if text not in self.parts:
            if len(self.parts) > 10_000:
                self.parts.clear()
            self.parts[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.parts[text]

    def encode_chunks(self, chunks: list[bytes], is_first: np.ndarray) -> list:
        """A simple chunk's letters go to the library's model as one word, others through its pattern."""
        texts = [c.decode() for c in chunks]
        found, rest = [None] * len(texts), []
        for k, text in enumerate(texts):
            if m := SIMPLE.fullmatch(text):
                before, letters, marks = m.groups()
                found[k] = self._simple(before, letters)
                if marks:
                    found[k] += self._part(marks)
            else:
                rest.append(k)
        for low in range(0, len(rest), 20_000):
            some = rest[low : low + 20_000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)):
                found[k] = e.ids
        return found

    def _simple(self, before: str, letters: str) -> list:
        if before == " ":
            letters = " " + letters
        ids = [t.id for t in self.model.tokenize(letters.encode().decode("latin1").translate(self.shown))]
        return self._part("\n") + ids if before == "\n" else ids


class WordEncoder(ByteEncoder):
    """A lower-casing vocabulary of the tokenizers library that drops white space: words are chunks."""

    keep_space = False
    lower = True

    def _simple(self, before: str, letters: str) -> list:
        return [t.id for t in self.model.tokenize(letters.lower().encode().decode("latin1").translate(self.shown))]


class PieceEncoder(ChunkEncoder):
    """A sentencepiece vocabulary without normaliser, in which no piece has a space behind another character.

    Chunks begin at a space behind another character.  The library puts a space
    before each text: for a chunk it stands for the chunk's own first space, and
    the first chunk of a text gets it besides.
    """

    separators = b" "
    special = re.compile("▁".encode())  # the library's own sign for a space

    def load(self) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=self.path)
        size = self.processor.get_piece_size()
        if any(re.search("[^▁]▁", self.processor.id_to_piece(k)) for k in range(size)):
            raise ValueError(f"{self.path} has pieces with an inner space; its texts can't be cut at spaces")
        probe = " a  b ﬁ "
        if self.processor.decode(self.processor.encode(probe)) != probe:
            raise ValueError(f"{self.path} normalises texts; they can't be cut at spaces")
        self.is_byte = np.array([self.processor.is_byte(k) for k in range(size)])
        self.space = [self.processor.piece_to_id("▁")]

    def _chunk_hashes(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        lead = np.zeros(len(starts), bool)
        lead[first[:-1][first[:-1] < first[1:]]] = True
        return W.span_hashes(self.codes[text], starts, ends, lead, int(self.codes[32]))

    def encode_chunks(self, chunks: list[bytes], is_first: np.ndarray) -> list:
        texts = [c.decode() if f else c[1:].decode() for c, f in zip(chunks, is_first)]
        return [x or self.space for x in self.processor.encode(texts, num_threads=1)]


def worker_encoder(kind: type[ChunkEncoder], path: str) -> ChunkEncoder:
    """This worker's encoder; it outlives a task, so later tasks find its chunks."""
    return W.resident((kind, path), lambda: kind(path))
