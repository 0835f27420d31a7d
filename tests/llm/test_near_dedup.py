import math
import random

import numpy as np
import pytest

from clickfold.llm import ann, common, embeddedup, queries, simhash
from tests.llm import brute


def edges_frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7), (5000, 5000)]
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    want = brute.components(nodes, [e for e in edges if e[0] != e[1]])
    got = {r["node"]: r["component"] for r in common.connected_components(edges_frame(spark, edges)).collect()}
    assert got == want
    assert common.connected_components(edges_frame(spark, [])).collect() == []


def test_join_labels():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    labels = np.arange(500)
    common.join_labels(labels, u, v)
    want = brute.components(list(range(500)), list(zip(u.tolist(), v.tolist(), strict=True)))
    assert labels.tolist() == [want[i] for i in range(500)]


# --- SimHash -----------------------------------------------------------------


@pytest.mark.parametrize("key_bytes", [2, 3, 4])
def test_position_sets_catch_any_four_positions(key_bytes):
    import itertools

    sets = [set(s) for s in simhash.position_sets(key_bytes)]
    assert len(sets) == {2: 7, 3: 20, 4: 70}[key_bytes]
    assert all(any(s <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))


def test_fingerprint_of_odd_and_long_texts():
    for text in [None, "", "  ", "one", "One TWO three", "a b c d", "É é A\u00a0B c d e", "x y " * 70000, *[r[1] for r in brute.odd_documents()][::9]]:
        assert simhash.fingerprint(text, 4) == (brute.simhash(text) if len(text or "") < 10000 else simhash.fingerprint(text.upper(), 4))


def test_simhash_components(spark, tmp_path):
    rows = brute.odd_documents(200)
    long_ = " ".join(f"w{i}" for i in range(900))
    rows += [(3000 + i, long_.replace(f"w{7 * i} ", "changed "), None, None, None, 0) for i in range(25)]
    spark.createDataFrame(rows, brute.SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_dedup(spark, str(tmp_path)).collect()}
    assert got == brute.simhash_components(rows)


@pytest.mark.parametrize("key_bytes,block", [(2, 2048), (3, 2048), (4, 2048), (2, 16)])
def test_simhash_links_of_planted_fingerprints(spark, monkeypatch, key_bytes, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 300)
    rng = random.Random(key_bytes)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            flips = rng.sample(range(64), rng.randint(1, 5))
            fps.add(base ^ sum(1 << f for f in flips))
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    want = brute.components([signed(f) for f in fps], [(signed(a), signed(b)) for a, b in edges])
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.links(frame, key_bytes=key_bytes)
    got = {signed(f): signed(f) for f in fps} | {r["node"]: r["component"] for r in common.connected_components(found).collect()}
    assert got == want


@pytest.mark.parametrize("tally", [1, 500, 1 << 20])
def test_tally_of_positional_bytes(monkeypatch, tally):
    monkeypatch.setattr(simhash, "TALLY", tally)
    rng = np.random.default_rng(tally)
    bytes_ = rng.integers(0, 5, (150, 8)).astype(np.uint8)
    bytes_[:20] = bytes_[0]
    bytes_[5, 3] ^= 1
    group = np.sort(rng.integers(0, 9, 150))
    shared = {
        (i, j): sum(a == b for a, b in zip(bytes_[i].tolist(), bytes_[j].tolist(), strict=True))
        for i in range(150) for j in range(i + 1, 150) if group[i] == group[j]
    }
    for least in (1, 4, 6, 8):
        got = [(i, j) for a, b in simhash.tallied(bytes_.reshape(-1).view(np.uint64), group, least) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == {pair for pair, n in shared.items() if n >= least}
    none = np.empty(0, np.uint64)
    assert list(simhash.tallied(none, none.astype(int), 4)) == []


def test_simhash_null_ids_and_empty(spark):
    rows = [(None, "a b c d e", None, None, None, 0), (4, "a b c d e", None, None, None, 0), (9, "A B C D E", None, None, None, 0), (9, "zzz", None, None, None, 1)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out) == [(0, 4), (4, 4), (9, 4), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], brute.SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), max_bits=5)


def test_keep_first_keeps_one_row_per_group(spark):
    a, b, c, d = "a b c d e", "one two three four five six", "zzz yyy xxx", "lone text of its own"
    rows = [(3, a), (3, a), (3, a), (None, a), (5, a.upper())]  # repeated rows and a row without an id
    rows += [(None, b), (None, b), (None, b)]  # a group without any id
    rows += [(3, c), (2, c), (2, c), (7, d), (None, "")]  # id 3 is kept above; here its text belongs to 2
    frame = spark.createDataFrame([(i, t, None, None, None, 0) for i, t in rows], brute.SCHEMA).repartition(4)
    out = simhash.keep_first(frame)
    assert out.schema == frame.schema
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()))
    assert got == sorted([(3, a), (0, b), (2, c), (7, d), (0, "")])
    assert simhash.keep_first(frame.limit(0)).collect() == []


# --- embeddings ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n_links long"


def odd_vectors(n=300, d=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[50:90] = base[0] + rng.normal(size=(40, d)) * 0.12  # around the threshold
    base[90:120] = base[1]
    base[120:140] = base[2] * rng.uniform(0.1, 30, size=(20, 1))
    rows = [(i, [float(np.float32(x)) for x in v], 0, 1) for i, v in enumerate(base)]
    odd = [None, [], [0.0] * d, [math.nan] + [1.0] * (d - 1), [math.inf] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * (d - 1), [1e-38] * d, [3e38] * d, [1.0] * d]
    rows += [(1000 + i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, 0, 1) for i, v in enumerate(odd)]
    return rows + [(None, rows[1][1], 0, 1), (1, rows[1][1], 7, 1)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def links_of(rows, t=0.95):
    good = {i: np.array(v, np.float64) for i, v, _, _ in rows if i is not None and usable(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    good = {i: v / np.sqrt(v @ v) for i, v in good.items()}
    edges = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= t]
    ids = [i for i, *_ in rows if i is not None]
    comp = brute.components(ids, edges)
    return {i: (sum(i in e for e in edges), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("block,strip,exact", [(4096, 256, None), (40, 7, None), (64, 256, 10)])
def test_embedding_dedup(spark, monkeypatch, tmp_path, block, strip, exact):
    monkeypatch.setattr(embeddedup, "BLOCK", block)
    rows = odd_vectors()
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op4_embedding_dedup(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = links_of(rows)
    for r in out:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == want[r["vec_id"]], r["vec_id"]
    assert sum(w[0] for w in want.values()) > 100


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    x = embeddedup.unit(rng.normal(size=(400, 17)) * rng.uniform(1e-30, 1e30, size=(400, 1)))
    codes, scale, err = embeddedup.quantise(x)
    approx = embeddedup.products(codes.astype(np.float32), codes.astype(np.float32)) * scale[:, None] * scale[None]
    bound = err[:, None] + (1 + err[:, None]) * err[None]
    assert (np.abs(approx - x @ x.T) <= bound).all()


def test_products_of_many_dimensions_are_exact():
    rng = np.random.default_rng(2)
    a = rng.integers(-127, 128, size=(5, 2500)).astype(np.float32)
    a[0] = 127
    assert (embeddedup.products(a, a) == a.astype(np.int64) @ a.astype(np.int64).T).all()


def test_strips_agree_with_one_product():
    rng = np.random.default_rng(4)
    x = embeddedup.unit(rng.normal(size=(3, 8))[rng.integers(0, 3, 200)] + rng.normal(size=(200, 8)) * 0.15)
    side = embeddedup.Side(np.arange(200), np.ones(200, int), x)
    i, j = embeddedup.strip_links(side, slice(20, 170), side, 0.95)
    want = np.argwhere(x[20:170] @ x.T >= 0.95) + [20, 0]
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def exact_neighbours(rows, k=20):
    best = {}
    for i, v, *_ in rows:
        if i is not None and usable(v) and len(v) == 24:
            best[i] = min(best.get(i, v), v)
    ids = np.array(sorted(best))
    x = np.array([best[i] for i in ids], np.float64)
    out = {}
    for a, q in enumerate(ids):
        if q % 20 == 0:
            s = (x * x[a]).sum(axis=1)
            s[a] = -np.inf
            order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found_neighbours(out):
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("shard,block", [(8192, 1024), (20, 4)])
def test_nearest_neighbours_with_every_cell_seen(spark, monkeypatch, tmp_path, shard, block):
    """Recall 1 asked of a sample that is the whole table: exact results."""
    monkeypatch.setattr(ann, "SHARD_ROWS", shard)
    monkeypatch.setattr(ann, "LEAST_SHARD_ROWS", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    monkeypatch.setattr(ann, "CENTROIDS", 5)
    monkeypatch.setattr(ann.Index, "share_for", lambda *a: 1.0)
    rows = odd_vectors()
    out = ann.search(spark.createDataFrame(rows, VECTORS), ann.F.col("id") % 20 == 0).collect()
    got, want = found_neighbours(out), exact_neighbours(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], rel=1e-12)
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_nearest_neighbours_of_every_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i < 100 else 4).tolist(), 0, 0) for i in range(160)]
    out = ann.search(spark.createDataFrame(rows, VECTORS), ann.F.col("id") % 20 == 0, target_recall=1.0).collect()
    lengths = {i: len(v) for i, v, _, _ in rows}
    assert {r["query_id"] for r in out} == set(range(0, 160, 20))
    assert all(lengths[r["query_id"]] == lengths[r["vec_id"]] for r in out)


def test_nearest_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = found_neighbours(queries.op6_nearest_neighbours(spark, sf).collect())
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow().to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], np.float64)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q]).sum(axis=1)
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        assert len(got[q]) == 20
        hits += len(want & {i for i, _ in got[q]})
        total += 20
        for i, score in got[q]:
            assert score == pytest.approx(s[ids == i][0], rel=1e-12)
    assert hits >= 0.93 * total


def test_walk_visits_pairs_by_summed_distance():
    rng = np.random.default_rng(5)
    index = ann.Index(rng.normal(size=(300, 6)), 5.0)
    counts = np.ones(index.n_cells, int)
    near = index.near(rng.normal(size=(1, 6)))
    cells = index.walk((near[0][0], near[1][0]), counts.tolist(), index.n_cells)
    sums = (near[0][0][:, None] + near[1][0][None]).ravel()
    assert sorted(cells) == list(range(index.n_cells))
    assert (np.diff(sums[cells]) >= -1e-12).all()


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, 0), (20, [0.0, 2.0], 0, 0), (3, [1.0, 1.0], 0, 0)]
    out = ann.search(spark.createDataFrame(rows, VECTORS), ann.F.col("id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert ann.search(spark.createDataFrame(rows[:1], VECTORS), ann.F.col("id") % 20 == 0).collect() == []
    empty = spark.createDataFrame([], VECTORS)
    assert ann.search(empty, ann.F.col("id") % 20 == 0).collect() == []
    assert embeddedup.near_duplicates(empty).collect() == []
