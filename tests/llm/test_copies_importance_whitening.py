"""Exact copies, importance resampling and whitening against plain versions, with NULLs, ties, repeats, empty and very long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taufold.llm import exact_copies, importance, whitening

rnd = random.Random(3)
LONG = "word é " * 40_000
BASE = "The same Text, again and Again."
SCHEMA = "doc_id long, text string, row string, part int, rank string, digest int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "a", "A", "É", "é", "x" * 24 + "1", "x" * 24 + "2", LONG, LONG.upper().replace("É", "é"), "Z" * 3_000_000, "!!", "one two"]
    rows = [(k, t, "r", 1, "x", 0) for k, t in enumerate(texts)]
    rows += [(100 + k, BASE if k % 2 else BASE.upper(), "r", k, "x", 0) for k in range(600)]
    rows += [(7, BASE, "r", 1, "x", 0), (7, BASE, "r", 1, "x", 0), (None, BASE, "r", 2, "x", 0), (None, "lone", None, None, None, None), (None, "lone", "r", 2, "x", 0)]
    rows += [(900 + k, " ".join(rnd.choice(["red", "green", "Blue", "grün", "x1"]) for _ in range(k % 60)), "s", k, "y", k) for k in range(400)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "green grün x1"), (2, None), (3, "Blue green")], "item_id long, text string")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_by_brute_force(docs, keep, monkeypatch):
    # Small partitions, so groups of copies cross many seams.
    monkeypatch.setattr(exact_copies, "PART_BYTES", 1 << 14)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[lowered(r.text)].append(r.doc_id)
    pick = max if keep == "largest" else min
    wanted = collections.Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: i != best):
            wanted[(i, best, len(ids), i == best and stays, sha)] += 1
            stays = stays and i != best
    found = exact_copies.find_copies(docs, keep=keep)
    assert collections.Counter(tuple(r) for r in found.collect()) == wanted
    left = exact_copies.drop_copies(docs, keep=keep)
    assert left.columns == docs.columns
    assert sorted(lowered(r.text) for r in left.collect()) == sorted(groups)


def test_copies_of_one_text_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact_copies, "PART_BYTES", 1 << 12)
    same = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("all alike").alias("text"))
    ordered = exact_copies._content_sorted(same, "doc_id", "text", F.col("id").asc(), carry=False)
    sizes = [r["count"] for r in ordered.groupBy("part").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 300
    found = exact_copies.find_copies(same).agg(F.sum(F.col("kept").cast("int")), F.min("group_size"), F.max("keep_id")).first()
    assert tuple(found) == (1, 2_000, 0)


def test_copies_empty_and_wrong_choice(docs):
    none = docs.filter("doc_id < 0")
    assert exact_copies.find_copies(none).collect() == [] and exact_copies.drop_copies(none).collect() == []
    with pytest.raises(ValueError):
        exact_copies.find_copies(docs, keep="first")


def runs_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 100)])
def test_importance_by_brute_force(docs, target, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    rows = [(r.doc_id, *runs_of(r.text, longest)) for r in docs.collect()]
    s = collections.Counter(bucket(f) for _, _, fs in rows for f in fs)
    t = collections.Counter(bucket(f) for r in target.collect() for f in runs_of(r.text, longest)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    wanted = []
    for i, words, fs in rows:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        wanted.append((i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((w for w in wanted if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0]))
    drawn = order[: len(order) * 10 // 100]
    found = importance.draw(importance.weigh(docs, target, longest=longest, buckets=buckets)).select("row.doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    key = lambda w: tuple((v is None, v or 0) for v in w)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(wanted, key=key)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [tuple(r)[:5] for r in ranked] == drawn
    kept = importance.resample(docs, target, longest=longest, buckets=buckets)
    assert kept.columns == docs.columns and kept.count() == len(drawn)


def test_importance_of_empty_tables(docs, target):
    none = docs.filter("doc_id < 0")
    assert importance.draw(importance.weigh(none, target)).collect() == []
    assert importance.draw(importance.weigh(docs, target.filter("item_id < 0"))).count() == docs.count()


def test_bit_sliced_sums_are_exact():
    random_state = np.random.default_rng(1)
    gains = random_state.integers(-9_000, 9_000, 10_000)
    doc = random_state.integers(0, 1_300, 60_000)
    bucket = np.minimum(random_state.zipf(1.3, 60_000) - 1, 9_999)
    plain = np.bincount(doc, gains[bucket].astype(float), 1_300).astype(int)
    assert (importance.Gains(gains).sums(bucket, doc, 1_300) == plain).all()


def test_crc_of_long_and_short_spans():
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(5_000)), np.uint8)
    starts = np.array([0, 3, 3, 10, 4_000])
    ends = np.array([3, 3, 70, 3_000, 4_064])
    found = importance.crc_of_spans(data, starts, ends) ^ np.uint32(importance.START)
    assert found.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


VECTORS = "vec_id long, embedding array<float>, row string, whitened int"


def vector_rows(n=300, d=16):
    random_state = np.random.default_rng(5)
    mixed = random_state.standard_normal((n, d)) @ random_state.standard_normal((d, d)) * 0.1
    rows = [(k, [float(v) for v in row], "r", k) for k, row in enumerate(mixed)]
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0], []]
    return rows + [(1_000 + k, v, "r", 0) for k, v in enumerate(bad)] + [(None, rows[0][1], None, None), rows[3], rows[3]], d


def test_whitening_by_eigh(spark):
    rows, d = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    usable = [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.floor(1024 * np.array([r[1] for r in usable], np.float32).astype(float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    apart = x - sums / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    fitted = whitening.fit(table)
    assert fitted.n == n and (fitted.sums == sums).all()
    np.testing.assert_allclose(fitted.values, values, rtol=1e-12)
    np.testing.assert_allclose(np.abs((fitted.vectors * vectors).sum(axis=0)), 1, atol=1e-12)
    assert whitening.identity_error(table, fitted) < 1e-10
    found = whitening.whiten(table, fitted).select("row.vec_id", "row.row", "deviation", F.col("whitened")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in usable)
    by_id = {r.vec_id: r for r in found}
    for k in (0, 3, 299, None):
        own = x[[r[0] for r in usable].index(k)]
        assert by_id[k].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, sums))
        wanted = (own - sums / n) @ (vectors * np.sign((fitted.vectors * vectors).sum(axis=0))) / np.sqrt(values)
        np.testing.assert_allclose(by_id[k].whitened, wanted, atol=1e-9)


def test_whitening_without_rows_or_variance(spark):
    none = spark.createDataFrame([(1, None, "r", 1), (2, [], "r", 1)], VECTORS)
    fitted = whitening.fit(none)
    assert whitening.identity_error(none, fitted) is None
    assert whitening.whiten(none.filter("vec_id < 0"), fitted).collect() == []
    same = spark.createDataFrame([(k, [1.0, 2.0], "r", 1) for k in range(5)], VECTORS)
    fitted = whitening.fit(same)
    assert [tuple(r) for r in whitening.whiten(same, fitted).select("deviation", F.size("whitened")).collect()] == [(0, 0)] * 5
    line = spark.createDataFrame([(k, [k / 8, k / 4, 0.0], "r", 1) for k in range(50)], VECTORS)
    fitted = whitening.fit(line)
    assert len(fitted.values) == 1 and abs(fitted.values[0] / fitted.trace - 1) < 1e-12 and whitening.identity_error(line, fitted) < 1e-10


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1], [1, 1, 1, 1], [3, 3, 1, 1, 0, 0], [1e6, 1, 1e-6], [1, 1 - 1e-13, 1 - 2e-13, 0.5], [7], [0, 0], list(range(64)), [1e9] + [1] * 30],
)
def test_divide_and_conquer_of_clustered_spectra(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    a = (q * np.array(values, float)) @ q.T
    found, vectors = whitening.leading_components((a + a.T) / 2, d)
    if not any(values):
        assert len(found) in (0, d)
        return
    np.testing.assert_allclose(found, np.sort(values)[::-1], atol=1e-13 * max(values))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * found, atol=4e-13 * max(values))


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a += a.T
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    np.testing.assert_allclose(u, (vectors * np.sign(values)) @ vectors.T, atol=1e-12)


def test_deviation_beyond_a_long():
    fitted = whitening.Whitener(10**7, np.zeros(2, np.int64), np.zeros((2, 0)), np.zeros(0), 0.0)
    assert fitted.deviation(np.array([[100, 7], [10**6, 0], [2, 1]])) == [(100**2 + 7**2) * 10**14, None, 5 * 10**14]
