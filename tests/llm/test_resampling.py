import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from clickfold.llm import gramtable, queries, resampling
from tests.llm import brute

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def expected(docs, bench, min_words=20):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, bench)):
        for x in texts:
            for f in features(x)[1]:
                counts[bucket(f)] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (ss + 10000) / ((a + 1) * (tt + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        n, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    rest = [r for r in rows if r[4] < min_words]
    drawn = 5 * len(fit) // 100
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted([(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in rest], key=key)


def got(df):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key)


@pytest.fixture(scope="module")
def odd():
    rows = [(r[0], r[1]) for r in brute.odd_documents(150)]
    rng = random.Random(3)
    rows += [(900, "É" * 400 + " " + "a" * 33 + " " + "b" * 127), (901, " ".join(f"w{rng.randint(0, 40000)}" for _ in range(150_000)))]
    rows += [(902, "same text again " * 9)] * 3 + [(None, "no id here " * 12), (None, None)]
    return rows


def test_equal_to_brute_force_on_odd_documents(spark, odd):
    bench = ["the cat sat on a mat", None, "", "der hund lief " * 5, "x"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in odd], "doc_id long, text string, rank int, bucket int, __row int").repartition(3)
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    assert got(resampling.resample(docs, target)) == expected(odd, bench)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "d " * 30)], "doc_id long, text string")
    assert got(resampling.resample(none, some)) == []
    assert got(resampling.resample(some, none)) == expected([(1, "a b c " * 10), (2, "d " * 30)], [])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    bench = [r["text"] for r in queries.table(spark, sf, "benchmark").collect()]
    out = queries.QUERIES["op12_resampling"](spark, sf)
    assert {f.dataType.simpleString() for f in out.schema.fields} == {"bigint"}
    assert got(out) == expected(docs, bench)


def test_array_hash_is_xxhash64():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdé9", k=rng.randint(1, 40))) + " " + "y" * rng.randint(1, 90) for _ in range(300)]
    for chunk in gramtable.chunks(enumerate(texts), 3):
        assert gramtable.xxh64(chunk).tolist() == [xxhash.xxh64_intdigest(chunk.gram(i)) for i in range(len(chunk.start))]


def test_array_crc_is_crc32():
    (chunk,) = gramtable.chunks(enumerate(["the cat sat " * 9, "é" * 60 + " x", ""]), 3)
    some = np.arange(len(chunk.start))[::-1]
    assert gramtable.crc32(chunk, some).tolist() == [zlib.crc32(chunk.gram(i)) for i in some]
    assert gramtable.crc32(chunk, some[:0]).tolist() == []


def test_equal_hashes_keep_different_grams_apart(monkeypatch):
    monkeypatch.setattr(gramtable, "xxh64", lambda chunk: np.full(len(chunk.start), (1 << 12) - 2, np.uint64))
    table = gramTable = gramtable.GramTable(10000, bits=12)  # probing also wraps around
    texts = [" ".join(f"w{i % 90}" for i in range(200)), "aaaaaaaa aaaaaaab aaaaaaaaa aaaaaaaa\x00aaaaaaaa"]
    (chunk,) = gramtable.chunks(enumerate(texts), 3)
    slots = table.slots(chunk)
    names = {}
    for i, s in enumerate(slots.tolist()):
        assert names.setdefault(s, chunk.gram(i)) == chunk.gram(i)
    assert len(names) == len({chunk.gram(i) for i in range(len(slots))}) == gramTable.used
    assert all(table.bucket[s] == zlib.crc32(g) % 10000 for s, g in names.items())


def test_small_table_is_emptied_and_grows_without_losing_counts():
    texts = [" ".join(f"w{i * k % 997}" for i in range(3000)) for k in range(1, 6)]
    want = np.zeros(100, np.int64)
    for x in texts:
        for f in features(x)[1]:
            want[zlib.crc32(f.encode()) % 100] += 1
    table = gramtable.GramTable(100, bits=4)
    for x in texts:
        for _, slots, _ in gramtable.bucket_batches([(0, x)], table, 3):
            np.add.at(table.count, slots, 1)
    assert table.flush().tolist() == want.tolist()
