"""Quality rules by tokeniser fertility.

A public vocabulary reads every text.  Natural text of one language needs about
the same characters per token; noise, markup and wrong encodings need more
tokens, fall back to bytes or use few different ones.  Three measures per text
are held against bands of its language (of its script where no language is
given): characters per token, share of byte-fallback tokens, token entropy.
Plain word and line counts come from the same scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.llm.encoding import PieceEncoder, worker_encoder
from taufold.sources.stage import stage

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of all words
#: Texts of fewer tokens are not held against an entropy, and their limits are wider by the root of what they lack.
LEAST_TOKENS = 64
#: Longer texts share the band of texts of 2 ** 12 tokens and more; below, bands are by powers of two.
TOP_CLASS = 12
#: A text is rejected when its characters per token and its entropy together fall short of their medians by more
#: than so many interquartile ranges; a range counts as at least this share of the median.
SHORTFALL = 4.0
LEAST_RANGE = 0.02
#: ... or when its byte-fallback share is beyond the upper quartile by more than this.
BYTE_EXCESS = 0.10
#: Bands of fewer different texts are passed over: first for the language's over all sizes, then for those of the script and of all
#: texts.  Where all texts are fewer, their limits are wider by the root of what they lack.
LEAST_TEXTS = 50
ALL_TEXTS = "all"
ALL_SIZES = -1
#: Measures are compared in steps of this size, so that counting gives exact quartiles.
STEP = 0.001
#: Scripts by code point ranges of their letters; anything else is "other".
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}

MEASURES = ("chars_per_token", "byte_share", "entropy")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


def _per_text(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` between consecutive cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[cuts])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def word_counts(text: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of texts in a row."""
    n = len(edges) - 1
    words = W.find_words(text, edges, W.PLAIN)
    _, inside = W.PLAIN.table()
    in_word = inside[text]
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    out = {"n_words": words.counts, "word_chars": _per_text(in_word & ((text & 0xC0) != 0x80), edges), "n_symbols": _per_text(is_symbol[text], edges)}

    starts, ends = W.find_spans(text != 10, edges)
    filled = np.concatenate([[0], np.cumsum(in_word)])
    filled = filled[ends] > filled[starts]
    starts, ends = starts[filled], ends[filled]
    codes, _ = W.PLAIN.table()
    lines = W.mix(W.span_hashes(codes[text], starts, ends))
    doc = np.searchsorted(edges, starts, "right") - 1
    order = np.lexsort((lines, doc))
    again = (lines[order][1:] == lines[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=n)

    at = W.shingle_starts(words, REPEAT_WINDOW)
    doc = np.searchsorted(words.first, at, "right") - 1
    windows = W.shingle_hashes(words.hashes, REPEAT_WINDOW)[at] ^ W.mix(doc.astype(np.uint64))
    twice = at[_repeated(windows)]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover)[:-1] > 0, words.first)
    return out


def token_measures(encoder: PieceEncoder, ids: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback tokens other than white space, and token entropy in bits, of texts in a row."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    by_byte = encoder.is_byte.copy()
    by_byte[[encoder.processor.piece_to_id(f"<0x{b:02X}>") for b in W.SPACES]] = False
    key = np.sort(np.repeat(np.arange(n), sizes) * len(by_byte) + ids)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    weight = np.bincount(key[new] // len(by_byte), times * np.log2(times), n)
    size = np.maximum(sizes, 1)
    return {"n_tokens": sizes, "n_byte_tokens": _per_text(by_byte[ids], offsets), "entropy": np.log2(size) - weight / size}


def script_of(text: str) -> str:
    """The script that has the most letters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    found = {name: int(((codes >= low) & (codes <= high)).sum()) for name, (low, high) in SCRIPTS.items()}
    best = max(found, key=found.get)
    return best if found[best] else "other"


def measure(docs: DataFrame, path: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with its band's name, that of its script, counts and token entropy."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(PieceEncoder, path)
        for batch in batches:
            column, langs = batch.column(1), batch.column(2)
            data, offsets = W.text_bytes(column)
            for low, high, ids, cuts in encoder.encode(column):
                own = data[int(offsets[low]) : int(offsets[high])]
                found = word_counts(own, offsets[low : high + 1] - offsets[low]) | token_measures(encoder, ids, cuts)
                band = langs.slice(low, high - low).to_pylist()
                scripts = [script_of(column[low + k].as_py() or "") for k in range(high - low)]
                band = ["lang " + b if b is not None else "script " + s for b, s in zip(band, scripts)]
                scripts = ["any " + s for s in scripts]
                counts = [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                rows = batch.column(0).slice(low, high - low)
                columns = [rows, pa.array(band, pa.string()), pa.array(scripts, pa.string()), *counts, pa.array(found["entropy"])]
                yield pa.record_batch(columns, ["row", "band", "script", *COUNTS, "entropy"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    schema = f"row {source.schema['row'].dataType.simpleString()}, band string, script string, {', '.join(f'{c} long' for c in COUNTS)}, entropy double"
    return source.mapInArrow(scan, schema)


def with_measures(measured: DataFrame) -> DataFrame:
    size = F.greatest("n_tokens", F.lit(1))
    return (
        measured.withColumn("chars_per_token", F.col("word_chars") / size)
        .withColumn("byte_share", F.col("n_byte_tokens") / size)
        .withColumn("size_class", F.least(F.floor(F.log2(size)), F.lit(TOP_CLASS)).cast("int"))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    )


def bands(measured: DataFrame) -> DataFrame:
    """Quartiles of each measure by (band, size_class), over the different texts that pass the base rules, and their number.

    Bands are those of the languages, of the scripts and of all texts.

    Copies count once, or one text with many copies would be the band.  Values
    are counted by step, so what is sorted is a histogram of bounded length.
    """
    judged = measured.filter(~F.col("base_failed"))
    once = judged.groupBy("band", "script", "size_class", "word_chars", "n_tokens", "entropy", "byte_share", "chars_per_token").agg(F.lit(1).alias("one"))
    once = once.withColumn("band", F.explode(F.array("band", "script", F.lit(ALL_TEXTS))))
    sizes = F.when(F.col("n_tokens") >= LEAST_TOKENS, F.array("size_class", F.lit(ALL_SIZES))).otherwise(F.array("size_class"))
    once = once.withColumn("size_class", F.explode(sizes))
    steps = [f"'{c}', round({c} / {STEP})" for c in MEASURES]
    long = once.select("band", "size_class", F.expr(f"stack({len(MEASURES)}, {', '.join(steps)}) AS (measure, step)"))
    counted = long.groupBy("band", "size_class", "measure", "step").agg(F.count("*").alias("n"))
    group = Window.partitionBy("band", "size_class", "measure")
    ranked = counted.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("total", F.sum("n").over(group))
    at = [F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("step") * STEP)).alias(f"q{k}") for k, share in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return ranked.groupBy("band", "size_class").pivot("measure", list(MEASURES)).agg(*at, F.max("total").alias("n"))


def _shortfall(measure: str) -> Column:
    spread = F.greatest(F.col(f"{measure}_q3") - F.col(f"{measure}_q1"), LEAST_RANGE * F.col(f"{measure}_q2"))
    below = (F.col(f"{measure}_q2") - F.col(measure)) / F.greatest(spread, F.lit(STEP))
    return F.when(below.isNotNull(), F.greatest(F.lit(0.0), below / _width(measure)))


def _width(measure: str) -> Column:
    """How much wider limits are as the band has few texts or the text few tokens."""
    lack = F.greatest(F.lit(1.0), LEAST_TEXTS / F.col(f"{measure}_n")) * F.greatest(F.lit(1.0), LEAST_TOKENS / F.greatest("n_tokens", F.lit(1)))
    return F.sqrt(lack)


def with_bands(measured: DataFrame, table: DataFrame) -> DataFrame:
    """Each measured text with the limits of the first band that has enough texts, or else of all texts."""
    limits = [c for c in table.columns if c not in ("band", "size_class")]
    enough = F.col("chars_per_token_n") >= LEAST_TEXTS
    sized = [c for c in limits if c.startswith("entropy")]  # entropy grows with the size: it is only held against texts of the size
    steps = [(band, size, enough) for band in ("band", "script", None) for size in ("size_class", None)]
    steps += [(None, None, F.lit(True)), (None, "size_class", F.lit(True))]
    joined = measured
    for k, (band, size, wanted) in enumerate(steps):
        rows = table.filter(wanted)
        rows = rows if band else rows.filter(F.col("band") == ALL_TEXTS)
        rows = rows.filter(F.col("size_class") != ALL_SIZES) if size else rows.filter(F.col("size_class") == ALL_SIZES)
        keys = [F.col("band").alias("_band"), F.col("size_class").alias("_size")]
        rows = rows.select(*keys, *[F.col(c).alias(f"_{k}_{c}") for c in limits])
        on = F.col("_band") == (F.col(band) if band else F.lit(ALL_TEXTS))
        rows = rows if band == "band" else F.broadcast(rows)  # scripts are few, languages may be many
        joined = joined.join(rows, on & (F.col("_size") == (F.col(size) if size else F.lit(ALL_SIZES))), "left").drop("_band", "_size")
    tried = lambda c: [k for k, (_, size, _) in enumerate(steps) if size or c not in sized]
    found = {c: F.coalesce(*[F.col(f"_{k}_{c}") for k in tried(c)]) for c in limits}
    return joined.withColumns(found).drop(*[f"_{k}_{c}" for k in range(len(steps)) for c in limits])


def judge(docs: DataFrame, path: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with counts, measures, base_failed and kept.

    NULL and empty texts have no words and fail the base rules.  A NULL language
    is replaced by the script of most letters.  Languages and sizes of few texts
    are judged by their script's or all texts.  An empty table gives an empty
    result; copies and equal ids are rows of their own.
    """
    measured = with_measures(stage(measure(docs, path, text, lang), "measures"))
    joined = with_bands(measured, stage(bands(measured), "bands"))
    entropy = F.when(F.col("n_tokens") >= LEAST_TOKENS, _shortfall("entropy"))
    short = _shortfall("chars_per_token") + F.coalesce(entropy, F.lit(0.0))
    odd = (short > SHORTFALL) | (F.col("byte_share") > F.col("byte_share_q3") + BYTE_EXCESS * _width("byte_share"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
