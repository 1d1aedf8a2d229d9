"""The operators against brute force on a small table with NULLs, empty and long texts, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taufold.llm import chat, decontamination, jaccard, language_id, licenses, lm, packing, quality, token_counts, token_files
from taufold.llm import encoding as E
from taufold.llm import words as W
from taufold.llm.components import connected_components, merge_components
from taufold.llm.frequent import most_frequent
from taufold.llm.queries import vocabulary
from taufold.sources.stage import new_stage_path

rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdeilmnorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
DE = [w + "ß" for w in WORDS[:150]]


def prose(n, words=WORDS):
    return " ".join(rnd.choice(words) for _ in range(n))


def texts():
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[10], far[50], far[90] = "these", "are", "others"
    passage = prose(14)
    return [
        None, "", "  \n\t ", "a", "a b c", "a b c", "A B c", base, base, " ".join(near), " ".join(far), base.upper(),
        passage + " " + prose(40), prose(30) + "\n" + passage.title(), prose(25, DE), prose(60, DE), "<|endoftext|> x <|ENDOFTEXT|>",
        "x  y z\r\n\n  é  ▁ a▁", "同じ 文 \U0001f600\U0001f600", prose(30000), "!!! ### $$$", "line one here\n" * 5, prose(6) + ". Licensed under the Apache License, Version 2.0.",
        "All rights reserved. Released under the MIT License.", "\x1c\x85 ​", "1234567890 " * 40, prose(2047)
    ], passage


TEXTS, PASSAGE = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 5 else 4, t, "de" if t and "ß" in t else ("en" if k % 5 else None), "x", 1) for k, t in enumerate(TEXTS)]
    rows += [(None, "no id here", None, "x", 2), (30, TEXTS[7], "en", "x", 3), (30, TEXTS[7], "en", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string, row int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def shingles(text, size=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_encoders_equal_the_libraries():
    odd = [chr(c) for c in [*range(0x250), *range(0x300, 0x310), *range(0x2000, 0x2070), 0x1680, 0x3000, 0xFEFF, 0x2581, 0x1F600]]
    some = ["".join(rnd.choice(odd) if rnd.random() < 0.5 else rnd.choice(" \n\t a b.'sL1É") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    some += [t for t in TEXTS if t is not None]
    for kind, name in ((E.ByteEncoder, "byte_bpe_50k.json"), (E.WordEncoder, "word_bpe_49k.json"), (E.PieceEncoder, "piece_bpe_32k.model")):
        encoder = kind(vocabulary(name))
        for low, high, ids, offsets in encoder.encode(pa.array(some)):
            for k in range(low, high):
                own = ids[offsets[k - low] : offsets[k - low + 1]].tolist()
                want = encoder.processor.encode(some[k]) if name.endswith("model") else encoder.tokenizer.encode(some[k], add_special_tokens=False).ids
                assert own == want, repr(some[k])


def test_cache_bounds_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(E, "CACHE_CHUNKS", 10)
    monkeypatch.setattr(E, "CACHE_BITS", 4)
    encoder = E.ByteEncoder(vocabulary("byte_bpe_50k.json"))
    for _ in range(2):
        for low, high, ids, offsets in encoder.encode(pa.array([t or "" for t in TEXTS])):
            for k in range(low, high):
                want = encoder.tokenizer.encode(TEXTS[k] or "", add_special_tokens=False).ids
                assert ids[offsets[k - low] : offsets[k - low + 1]].tolist() == want


def test_token_counts(docs, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len(t.encode()), n := len(processor.encode(t)), n > 4096) for i, t in plain(docs)), key=str)
    assert rows_of(token_counts.count_tokens(docs, path)) == want
    assert rows_of(token_counts.count_tokens(docs, path, sample_rows=3, entries=5)) == want
    assert rows_of(token_counts.count_tokens(empty, path)) == []


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_token_files(spark, docs, empty, block):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = new_stage_path(spark, "files")
    token_files.write_token_files(docs, out, path, block_ids=block)
    found = token_files.read_token_files(spark, out).orderBy("start").collect()
    want, start = collections.Counter(), 0
    for i, t in plain(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    for before, r in zip([None, *found], found):
        assert r["start"] == start and (before is None or before["doc_id"] is None or before["doc_id"] <= r["doc_id"])
        start += r["n_tokens"]
    token_files.write_token_files(empty, out + "-empty", path)
    assert token_files.read_token_files(spark, out + "-empty").collect() == []


def test_id_code_round_trip():
    for ids in ([5], [0] * 9, list(range(70_000)) + [3] * 7, [2**31, 1, 2**32 - 1]):
        ids = np.array(ids, np.uint32)
        assert (token_files.decode_ids(*token_files.encode_ids(ids), len(ids)) == ids).all()


def test_packing(docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "RANKED_ROWS", 2)
    found = packing.pack_documents(docs, path).collect()
    want = collections.Counter()
    for i, t in plain(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == want
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in found) // 2048)
    assert packing.pack_documents(empty, path).collect() == []


def fewest_bins(lengths, capacity):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in sorted(set(range(len(bins))), key=lambda b: -bins[b]):
            if bins[b] + lengths[k] <= capacity:
                bins[b] += lengths[k]
                place(k + 1, bins)
                bins[b] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_bin_completion_needs_as_few_bins_as_possible():
    draw = random.Random(12)
    for k in range(1500):
        top = draw.choice([12, 20, 30])
        lengths = sorted((draw.randint(1, top) for _ in range(9)), reverse=True)
        patterns = packing.bin_completion(collections.Counter(lengths), 30)
        assert all(sum(p) <= 30 for p, _ in patterns)
        assert collections.Counter(n for p, times in patterns for n in p * times) == collections.Counter(lengths)
        # Without the searches for better incumbents, branch and bound alone has to find them.
        alone = packing.bin_completion(collections.Counter(lengths), 30, nodes=1)
        few = fewest_bins(lengths, 30)
        assert packing.bins_at_least(collections.Counter(lengths), 30) <= few
        assert sum(times for _, times in patterns) == sum(times for _, times in alone) == few, lengths
    assert sum(t for _, t in packing.bin_completion({1: 5000, 2048: 3}, 2048)) == 6
    assert packing.bin_completion({}, 2048) == [] and packing.completion_gap([], 2048) == 0


def test_bin_completion_of_tight_sets():
    assert sum(t for _, t in packing.bin_completion(collections.Counter([14, 12, 11, 10, 10, 10, 8, 7, 6]), 30)) == 3
    draw = random.Random(4)
    for _ in range(40):  # sets that fill their bins exactly
        lengths = []
        for _ in range(12):
            cuts = sorted(draw.sample(range(1, 100), 3))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
        patterns = packing.bin_completion(collections.Counter(lengths), 100)
        assert collections.Counter(n for p, times in patterns for n in p * times) == collections.Counter(lengths)
        assert packing.completion_gap(patterns, 100) == sum(t for _, t in patterns) - 12 <= 1


def components(docs):
    found = plain(docs)
    sets = [shingles(t) for _, t in found]
    root = list(range(len(found)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(found)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(found):
        if i is not None:
            low[top(k)].append(i)
    return [(i, len(s), min(low[top(k)], default=None)) for k, ((i, _), s) in enumerate(zip(found, sets))]


@pytest.mark.parametrize("tile", [4096, 2])
def test_near_duplicates(docs, empty, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    monkeypatch.setattr(jaccard, "COMMON_TEXTS", 2)
    found = jaccard.near_duplicates(docs).select("id", "n", "component_id")
    assert rows_of(found) == sorted(components(docs), key=str)
    if tile > 2:
        assert jaccard.near_duplicates(empty).collect() == []
        kept = jaccard.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        groups = {c for _, n, c in components(docs) if n}
        assert kept.filter("length(trim(regexp_replace(text, '[\\n\\t]', ''))) > 0 AND doc_id IS NOT NULL").count() == len(groups - {None})


def test_words_of_a_regular_structure_have_hashes_of_their_own():
    one = "ab"
    while len(one) < 4096:
        one += one.translate(str.maketrans("ab", "ba"))
    for size in (1024, 2048, 4096):
        pair = [one[:size], one[:size].translate(str.maketrans("ab", "ba"))]
        for alphabet in (W.PLAIN, W.LOWER, W.ALNUM):
            words = W.find_words(*W.text_bytes(pa.array(pair)), alphabet)
            assert len(words.hashes) == 2 and words.hashes[0] != words.hashes[1]
        for kind, name in ((E.ByteEncoder, "byte_bpe_50k.json"), (E.WordEncoder, "word_bpe_49k.json"), (E.PieceEncoder, "piece_bpe_32k.model")):
            encoder = kind(vocabulary(name))
            for low, high, ids, offsets in encoder.encode(pa.array(pair)):
                for k in range(low, high):
                    want = encoder.processor.encode(pair[k]) if name.endswith("model") else encoder.tokenizer.encode(pair[k], add_special_tokens=False).ids
                    assert ids[offsets[k - low] : offsets[k - low + 1]].tolist() == want


def test_span_hashes_do_not_depend_on_place_and_know_a_lead():
    codes = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64)
    text = np.frombuffer(b" abc abc  x abc", np.uint8)
    starts, ends = np.array([1, 5, 10, 12]), np.array([4, 8, 11, 15])
    plain = W.span_hashes(codes[text], starts, ends)
    assert plain[0] == plain[1] == plain[3] != plain[2]
    led = W.span_hashes(codes[text], starts, ends, np.array([True, False, False, False]), int(codes[32]))
    spaced = W.span_hashes(codes[text], starts - 1, ends)
    assert led[0] == spaced[0] == spaced[3] and (led[1:] == plain[1:]).all()


@pytest.mark.parametrize("few", ["BLOCK_SETS", "HOT_TEXTS"])
def test_near_duplicates_of_dealt_and_hot_tiles(spark, monkeypatch, few):
    draw = random.Random(9)
    monkeypatch.setattr(jaccard, few, 3)
    monkeypatch.setattr(jaccard, "COMMON_TEXTS", 2)
    base = [" ".join(draw.choice(WORDS) for _ in range(n)).split() for n in (60, 400, 150)]
    rows = []
    for k in range(150):
        own = base[k % 3].copy()
        for _ in range(draw.randint(0, len(own) // 30 + 1)):
            own[draw.randrange(len(own))] = draw.choice(WORDS)
        rows.append((k, " ".join(own[: draw.randint(len(own) * 8 // 10, len(own))])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert rows_of(jaccard.near_duplicates(table).select("id", "n", "component_id")) == sorted(components(table), key=str)


def test_pairs_of_a_tile_lose_no_link():
    draw = np.random.default_rng(7)
    sets = []
    for size in (40, 130, 700):
        base = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        for _ in range(30):
            own = base.copy()
            own[draw.random(size) < 0.12] ^= np.uint64(draw.integers(1, 1 << 62))
            sets.append(np.unique(own[: int(size * draw.uniform(0.85, 1))]))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    k = len(sets)
    columns = {"token": np.zeros(k, np.int64), "low": np.zeros(k, np.int64), "high": np.zeros(k, np.int64), "block": np.zeros(k, np.int64), "n": n}
    columns |= {"place": np.zeros(k, np.int64), "node": np.arange(k), "root": np.arange(k), "times": np.ones(k, np.int64)}
    batch = pa.record_batch([*map(pa.array, columns.values()), pa.array([jaccard.bitmap(s).tobytes() for s in sets], pa.binary())], [*columns, "bits"])
    found = {(r["a"], r["b"]) for part in jaccard._tile_pairs(iter([batch.slice(0, 50), batch.slice(50)])) for r in part.to_pylist()}
    links = {(a, b) for b in range(k) for a in range(b) if jaccard._linked(sets[a], sets[b])}
    assert links and links <= found and len(found) < 2 * len(links) + 50


def test_near_duplicates_of_many_edits(spark):
    base = [prose(60).split() for _ in range(4)]
    rows = []
    for k in range(160):
        own = base[k % 4].copy()
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(60)] = rnd.choice(WORDS)
        rows.append((k, " ".join(own[: rnd.randint(45, 60)])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.near_duplicates(table).select("id", "n", "component_id")) == sorted(components(table), key=str)


def test_near_duplicates_link_sizes_between_those_of_a_tile(spark):
    first = lambda w: jaccard.distinct_shingles(W.find_words(*W.text_bytes(pa.array([w])), W.LOWER), 1)[0][0]
    words = sorted((f"w{k}" for k in range(40)), key=first)
    shared, own, others = words[2:14], words[14], words[15:29]  # of 13 and 14 words, 12 in common: 0.8; a set of 15 has their one shared prefix word
    sets = [[*shared, own], [*words[:2], *shared], [shared[0], *others]]
    table = spark.createDataFrame([(k, " ".join(s)) for k, s in enumerate(sets)], "doc_id long, text string")
    found = jaccard.near_duplicates(table, size=1).select("id", "n", "component_id")
    assert rows_of(found) == [(0, 13, 0), (1, 14, 0), (2, 15, 2)]


def test_weights_allow_for_every_size_of_a_tile():
    draw = np.random.default_rng(8)
    for top in (20, 60, 300):
        token = np.sort(draw.integers(0, 12, 200))
        n = draw.integers(1, top, 200)
        n = n[np.lexsort((n, token))]
        batch = pa.record_batch([pa.array(c) for c in (token, n, np.zeros(200, np.int64), np.arange(200))], ["token", "n", "place", "node"])
        found = {row["node"]: row["weight"] for part in jaccard._shared_tokens(iter([batch])) for row in part.to_pylist()}
        for node, weight in found.items():
            fits = n[(token == token[node]) & (5 * n >= 4 * n[node]) & (4 * n <= 5 * n[node])]
            assert weight == 1 / jaccard.least_shared(n[node], fits).min()


def test_near_copies_are_dropped_by_component_not_by_id(spark):
    one, two, three, four = (prose(40) for _ in range(4))
    rows = [(None, one, 1), (None, two, 2), (None, two, 3), (7, three, 4), (7, four, 5), (7, four, 6), (8, three.upper(), 7), (9, four + " more", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = sorted(r["row"] for r in jaccard.drop_near_duplicates(table).collect())
    assert kept[0] == 1 and kept[1] in (2, 3) and kept[2] == 4 and kept[3] in (5, 6) and len(kept) == 4


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, b) for b in range(101, 140)] + [(139, 200), (7, 7)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in [*range(100, 140), 200]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_merged_components_equal_those_of_all_edges(spark):
    draw = random.Random(3)
    first, more = ([(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(n)] for n in (35, 25))
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    merged = rows_of(merge_components(connected_components(frame(first)), frame(more)))
    assert merged == rows_of(connected_components(frame(first + more)))
    assert rows_of(merge_components(connected_components(frame([])), frame(first))) == rows_of(connected_components(frame(first)))


def test_most_frequent(spark):
    table = spark.createDataFrame([(k, 2 ** (k % 6)) for k in range(60)], "k long, n long")
    assert sorted(r["n"] for r in most_frequent(table, "n", 25).collect()) == [16] * 10 + [32] * 10
    assert most_frequent(table, "n", 5).count() == 0 and most_frequent(table, "n", 60).count() == 60


def hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        w = split(item)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 1])
def test_decontamination(spark, docs, empty, block):
    few = docs.filter("doc_id IS NULL OR doc_id <> 19")
    items = [(1, PASSAGE), (2, "a b"), (3, None), (4, "--"), (5, PASSAGE.upper()), (10, "All rights, reserved"), (11, "c"), (12, " ".join(TEXTS[9].split()[55:70]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    found = decontamination.find_contamination(few, bench, block_words=block)
    got = rows_of(found.select("doc_id", "n_words", decontamination.hit_words().alias("h"), "items"))
    names = [(str(i), t) for i, t in items]
    assert got == sorted(((i, *hits(t, names)) for i, t in plain(few)), key=str)
    clean = decontamination.drop_contaminated(few, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not g[2] for g in got)
    assert decontamination.find_contamination(few, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontamination.find_contamination(empty, bench).collect() == []


def test_language_id(spark, docs, empty):
    samples = language_id.training_text(docs, "doc_id", "text", "lang")
    assert set(samples) == {"de", "en"}
    found = language_id.identify(docs, samples).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    assert len(found) == docs.count()
    for r in found:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in samples and 0 <= r["score"] <= 1
    assert all(r["lang_pred"] == "de" for r in found if r["doc_id"] in (14, 15))
    assert language_id.training_text(empty, "doc_id", "text", "lang") == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(empty, samples).collect() == []


def test_language_id_learns_from_long_rows(spark):
    rows = [(k, prose(80), "en") for k in range(20)] + [(k, prose(2000, DE), "de") for k in range(20, 24)]
    table = spark.createDataFrame([*rows, (30, prose(40, DE), None)], "doc_id long, text string, lang string")
    samples = language_id.training_text(table, "doc_id", "text", "lang")
    assert set(samples) == {"de", "en"} and len(samples["de"].decode()) % (language_id.TRAIN_ROW_CHARS + 1) == 0
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(table, samples).select("row.doc_id", "lang_pred").collect()}
    assert all(found[k] == ("en" if k < 20 else "de") for k in found)


def test_cross_parsing_counts_longest_phrases():
    parser = language_id.CrossParser({"x": b"abracadabra", "y": b"zzyzx"})
    text = b"cadabraqabr zyz"
    codes, cuts = language_id.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]), parser.table)
    for k, sample in enumerate((b"abracadabra", b"zzyzx")):
        train = language_id.symbols(np.frombuffer(sample, np.uint8), np.array([0, len(sample)]), parser.table)[0].tobytes()
        own, n, at = codes.tobytes(), 0, 0
        while at < len(own):
            size = 1
            while at + size < len(own) and own[at : at + size + 1] in train:
                size += 1
            at, n = at + size, n + 1
        assert abs(int(parser.phrases(codes, cuts)[k, 0]) - n) <= 1


def test_lm_scores(docs, empty):
    held = language_id.fold("doc_id", 7) == 2
    found = rows_of(lm.score_texts(docs, held))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*t.encode().lower().split(), b"\n"]
    counts = collections.Counter(w for i, t in plain(docs) if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in plain(docs):
        w = tokens(t)
        want.append((i, out(i), len(w), sum(counts[x] > 0 for x in w), n, sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    assert [r[:5] for r in found] == [r[:5] for r in sorted(want, key=str)]
    assert np.allclose([r[5] for r in found], [r[5] for r in sorted(want, key=str)])
    assert all(r[6] < 0 for r in found) and sum(r[6] for r in found) > sum(r[5] for r in found)
    assert lm.score_texts(empty, held).collect() == []
    assert all(r["n_known"] == 0 for r in lm.score_texts(docs.filter("doc_id = 7"), F.lit(True)).collect())


def test_lm_probabilities_add_up_and_gradient_is_exact():
    draw = np.random.default_rng(3)
    side = 16
    weights = draw.normal(size=(lm.SLOTS * side, side))
    features = draw.integers(0, 1 << 60, (40, lm.FEATURES)).astype(np.uint64)
    every = np.arange(side * side)
    for f in features[:3]:
        total = np.exp(lm.log_probabilities(np.tile(f, (side * side, 1)), every, weights)).sum()
        assert abs(total - 1) < 1e-9
    outcome = draw.integers(0, side * side, 40)
    loss = lambda w: -lm.log_probabilities(features, outcome, w).sum()
    for node, chosen in ((np.zeros(40, np.int64), outcome // side), (1 + outcome // side, outcome % side)):
        row, times, step = lm.gradients(weights, lm.slots(features, node, side), chosen)
        assert times.sum() == 40 * (lm.FEATURES + 1)
        for k in (0, len(row) // 2, len(row) - 1):
            moved = weights.copy()
            moved[row[k], 5] += 1e-5
            assert abs((loss(moved) - loss(weights)) / 1e-5 - step[k, 5]) < 1e-3


def test_lm_histories_stay_inside_their_text():
    tokens = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    found = lm.contexts(tokens, np.array([0, 3, 4, 7]))
    alone = [lm.contexts(tokens[a:b], np.array([0, b - a])) for a, b in ((0, 3), (3, 4), (4, 7))]
    assert np.array_equal(found, np.concatenate(alone))


def test_lm_size_grows_with_the_words():
    assert [lm.side_of(n) for n in (0, 65_536, 65_537, 1_000_000, 2_000_000)] == [16, 16, 32, 32, 64]


def test_lm_tasks_follow_the_tokens():
    weights = lm.SLOTS * 32 * 32
    assert [lm.tasks_of(n * lm.ROUNDS * weights, weights, 6) for n in (0, 1, 2, 6, 100)] == [1, 1, 2, 6, 6]
    assert lm.tasks_of(lm.ROUNDS * weights + 1, weights, 6) == 2


@pytest.mark.parametrize("reach", [1.0, 300.0])
def test_lm_update_step_equals_a_plain_one(reach):
    draw = np.random.default_rng(8)
    side, n = 16, 500
    weights = (reach * draw.normal(size=(lm.SLOTS * side, side))).astype(np.float32)
    features = draw.integers(0, 30, (n, lm.FEATURES)).astype(np.uint64)
    outcome = draw.integers(0, side * side, n)
    learner, plain = lm.Learner(weights), weights.astype(np.float64)
    learner.learn(features, outcome)
    group, member = np.divmod(outcome, side)
    squares, met = np.ones(len(weights)), np.zeros(len(weights))
    want = np.zeros(n)
    for node, chosen in ((0 * group, group), (1 + group, member)):
        rows = lm.slots(features, node, side)
        own = weights.astype(np.float64)[rows].sum(axis=1)
        own -= own.max(axis=1, keepdims=True)
        want += own[np.arange(n), chosen] - np.log(np.exp(own).sum(axis=1))
        total = plain[rows].sum(axis=1)
        error = np.exp(total - total.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(n), chosen] -= 1
        step = np.zeros_like(plain)
        np.add.at(step, rows, error[:, None, :])
        np.add.at(met, rows, 1)
        squares += (step * step).max(axis=1)
        plain -= lm.RATE * step / np.sqrt(squares)[:, None]
    assert np.array_equal(learner.times, met)
    assert np.allclose(learner.weights, plain, atol=1e-3 * reach)
    found = lm.log_probabilities(features, outcome, weights)
    assert np.isfinite(found).all() and np.allclose(found, want, rtol=1e-4, atol=1e-4 * reach)


def test_lm_shared_outcome_takes_one_wide_choice_and_a_gate():
    draw = np.random.default_rng(5)
    side, n = 16, 60
    last = side * side - 1
    times = np.append(draw.integers(1, 50, last), 5000)
    weights = lm.start_weights(times, side)
    gate = lm.start_gate(times, weights)
    start = np.exp(lm.log_probabilities(np.zeros((side * side, lm.FEATURES), np.uint64), np.arange(side * side), weights, gate))
    assert np.allclose(start, (times + 1) / (times + 1).sum(), rtol=1e-4)
    features = draw.integers(0, 20, (n, lm.FEATURES)).astype(np.uint64)
    outcome = np.where(draw.random(n) < 0.5, last, draw.integers(last - 40, last + 1, n))
    learner = lm.Learner(weights, gate)
    learner.learn(features, outcome)
    inside, shared = outcome // side == side - 1, outcome == last
    # Rows of the wide weights: one choice of a class for all, one of a word for those that aren't shared.
    assert learner.times.sum() == (n + (~shared).sum()) * (lm.FEATURES + 1)
    rows = lm.slots(features, np.zeros(n, np.int64), side)[inside]
    error = 1 / (1 + np.exp(-gate[rows, 0].sum(1))) - shared[inside]
    step, met = np.zeros(len(gate)), np.zeros(len(gate))
    np.add.at(step, rows, error[:, None])
    np.add.at(met, rows, 1)
    assert np.array_equal(learner.gate.times, met)
    assert np.allclose(learner.gate.weights[:, 0], gate[:, 0] - lm.RATE * step / np.sqrt(1 + step * step), atol=1e-5)
    every = np.arange(side * side)
    for f in features[:3]:
        total = np.exp(lm.log_probabilities(np.tile(f, (side * side, 1)), every, learner.weights, learner.gate.weights)).sum()
        assert abs(total - 1) < 1e-5
    assert lm.log_probabilities(features, outcome, learner.weights, learner.gate.weights).sum() > lm.log_probabilities(features, outcome, weights, gate).sum()


def test_lm_tokens_do_not_depend_on_the_pieces_hashed_at_once(monkeypatch):
    texts = ["", None, "a b " * 30, "c", " ", "word " * 50, "A b\tc"] * 3
    column = pa.array(texts)
    found = []
    for size in (16, 1 << 16):
        monkeypatch.setattr(lm, "HASHED_BYTES", size, raising=False)
        ((low, high, tokens, first),) = lm._token_slices(column)
        assert (low, high) == (0, len(texts)) and first[-1] == len(tokens)
        found.append((tokens, first))
    assert all(np.array_equal(a, b) for a, b in zip(*found))
    tokens, first = found[0]
    for k, t in enumerate(texts):
        assert np.array_equal(tokens[first[k] : first[k + 1]], np.append(W.hash_text((t or "").encode(), W.LOWER), lm.END))


def test_lm_learns_which_word_follows(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[(k + j) % 40] for j in range(200)) for k in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    total = lm.score_texts(docs, F.col("doc_id") % 5 == 0).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.25 * total[1]


def test_chat_round_trip(spark):
    bad = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<|x|> <\\\\|", "", None, "<|im_end|", "a\n<|im_start|>b\n", "\\"]
    rows = [(c, k, r, t, 0) for c in (1, 2, None) for k, (r, t) in enumerate((r, t) for t in bad for r in ("user", "assistant", None, "sys\ntem\\n<|im_end|>"))]
    table = spark.createDataFrame([*rows, (3, None, "assistant", "x", 0), (3, None, "assistant", "x", 0)], "conv_id long, turn long, role string, text string, rendered int")
    formatted = chat.format_turns(table)
    found = {r["conv_id"]: r for r in chat.read_back(formatted, ["turn", "rendered"]).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t, _ in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert found[conv]["n_turns"] == len(own) and found[conv]["loss_chars"] == len(loss)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert found[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text = "".join(r["rendered"] for r in formatted.filter(F.col("conv_id").eqNullSafe(conv)).orderBy("turn").collect())
        assert [t[:2] for t in chat.parse(text)] == own and len(text) == found[conv]["formatted_chars"]
    assert found[3]["n_turns"] == 2
    assert chat.read_back(chat.format_turns(table.limit(0)), ["turn"]).collect() == []


def test_quality(docs, empty):
    found = quality.judge(docs, vocabulary("piece_bpe_32k.model")).select("row.doc_id", "row.text", "row.n_tokens", *quality.COUNTS[:5], "base_failed", "kept")
    assert found.count() == docs.count()
    for r in found.collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r)[3:8] == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(empty, vocabulary("piece_bpe_32k.model")).collect() == []


def test_quality_bands_reject_noise(spark):
    draw = random.Random(9)
    clean = [(k, " ".join(draw.choice(WORDS) for _ in range(150)), "en") for k in range(200)]
    copies = [(k, clean[0][1], "en") for k in range(1000, 1400)]
    noise = [(k, " ".join("".join(draw.choice("qxzjkvw#") for _ in range(6)) for _ in range(150)), "en") for k in range(300, 305)]
    found = quality.judge(spark.createDataFrame(clean + copies + noise, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model"))
    kept = {r["doc_id"]: r["kept"] for r in found.select("row.doc_id", "kept").collect()}
    assert all(kept[k] for k, _, _ in clean) and not any(kept[k] for k, _, _ in noise)


def test_quality_judges_rare_languages_small_tables_and_short_texts(spark):
    draw = random.Random(9)
    clean = [(k, " ".join(draw.choice(WORDS) for _ in range(150)), "en") for k in range(200)]
    bytes_only = [chr(draw.randrange(0x1400, 0x1600)) for _ in range(40)]
    garbage = lambda n: " ".join("".join(draw.choice(bytes_only) for _ in range(6)) for _ in range(n))
    noise = lambda n: " ".join("".join(draw.choice("qxzjkvw#") for _ in range(6)) for _ in range(n))
    odd = [(300, noise(150), "xx"), (301, garbage(150), "xx"), (302, garbage(12), "en"), (303, garbage(12), None)]
    rare = [(400, " ".join(draw.choice(WORDS) for _ in range(150)), "yy"), (401, " ".join(draw.choice(WORDS) for _ in range(14)), "en")]
    for good in (clean, clean[:20]):
        found = quality.judge(spark.createDataFrame(good + odd + rare, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model"))
        kept = {r["doc_id"]: r["kept"] for r in found.select("row.doc_id", "kept").collect()}
        assert all(kept[k] for k, _, _ in good + rare) and not any(kept[k] for k, _, _ in odd)


def test_license_scan(docs, empty):
    found = licenses.scan_licenses(docs).collect()
    by = collections.defaultdict(set)
    for r in found:
        by[r["doc_id"]].add(r["license"])
        text = dict(plain(docs))[r["doc_id"]].encode()
        assert text[r["start_byte"] : r["end_byte"]].decode().split()[0].lower() in ("licensed", "all", "released")
    assert by == {22: {"apache-2.0-notice"}, 23: {"all-rights-reserved", "mit-notice"}}
    assert licenses.scan_licenses(empty).collect() == []
    assert licenses.scan_licenses(docs, {"none": "", "dots": "..."}).collect() == []


def test_license_scan_finds_edited_texts(spark):
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        if len(w) < 20:
            continue
        del w[7]
        w[12] = "other"
        w.insert(16, "new")
        rows.append((k, prose(50) + " " + " ".join(w) + " " + prose(30)))
        want[k] = name
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in found} == want
    assert all(r["coverage"] > 0.85 and 45 <= r["start_word"] <= 55 for r in found)


def test_license_scan_gives_a_row_for_each_repeated_notice(spark):
    short = [name for name, text in licenses.TEMPLATES.items() if len(text.split()) < 13]
    rows = [(k, "\n".join([licenses.TEMPLATES[name]] * 40 + ["so it is"] + [licenses.TEMPLATES[name]] * 5)) for k, name in enumerate(short)]
    found = collections.Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {(k, name): 45 for k, name in enumerate(short)}


def test_license_scan_measures_a_text_that_is_cut(spark):
    whole = licenses.TEMPLATES["mit"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE'
    found = licenses.scan_licenses(spark.createDataFrame([(1, whole)], "doc_id long, text string")).collect()
    assert len(found) == 1 and 0.7 <= found[0]["coverage"] < 0.9 and found[0]["end_byte"] == len(whole)


def test_pipeline_stages_keep_columns_and_drop_what_they_decide(spark, docs, tmp_path):
    import corpus_pipeline

    source = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    source.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, apply in corpus_pipeline.STAGES:
        after = apply(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == source.columns
        path = f"{tmp_path}/{len(seen)}.parquet"
        after.write.parquet(path)
        now = spark.read.parquet(path)
        seen.append({r[0] for r in now.select("doc_id").collect()})
    assert 7 in seen[1] and not seen[0] & {0, 1, 2, 3, 4}
    assert not seen[2] & {8, 9, 11} and 7 in seen[2]
    assert not seen[3] & {12, 13} and seen[4] == seen[3]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == now.count()
