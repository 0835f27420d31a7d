import math
import random
import time

import pytest

from clickfold.llm import queries, toxicity
from pyspark.sql import functions as F
from tests.llm import brute

BAD = ["idiot", "scum", "trash"]


def plain_segments(values):
    """All maximal scoring segments by their definition: the best segment
    (shortest first), then the same to its left and to its right."""
    best = None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    right = [(s, a + j + 1, b + j + 1) for s, a, b in plain_segments(values[j + 1 :])]
    return plain_segments(values[:i]) + [(total, i, j)] + right


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_their_definition(seed):
    rng = random.Random(seed)
    drift = rng.choice([0.01, 0.3, 1.0])
    words = [rng.choice([None, None, rng.uniform(-3, 3)]) for _ in range(rng.randint(0, 40))]
    items = [(i, s) for i, s in enumerate(words) if s is not None]
    got = toxicity.maximal_segments(items, drift)
    want = plain_segments([(s or 0.0) - drift for s in words])
    assert [(items[a][0], items[b][0]) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])


def test_lambda_solves_its_equation():
    scored, drift = [(0.01, 4.0), (0.05, -1.0)], 0.1
    x = toxicity.karlin_root(scored, drift)
    mean = 0.94 * math.exp(-x * drift) + sum(p * math.exp(x * (s - drift)) for p, s in scored)
    assert x > 0 and mean == pytest.approx(1.0, abs=1e-6)
    assert toxicity.karlin_root([], 0.1) == 1.0


def test_surprise_grows_with_scores_and_falls_with_length():
    one = toxicity.surprise([8.0], 100, 1.0, 0.01)
    assert toxicity.surprise([9.0], 100, 1.0, 0.01) > one > toxicity.surprise([8.0], 10_000, 1.0, 0.01)
    assert toxicity.surprise([8.0, 8.0], 100, 1.0, 0.01) > one
    assert toxicity.surprise([], 100, 1.0, 0.01) == 0.0
    # one passage: the extreme-value law itself, with the weight for r = 1
    assert one == pytest.approx(-math.log(1 - math.exp(-0.01 * 100 * math.exp(-8.0))) - math.log(2))


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    vocab = [a + b for a in "ba ke li mo nu ra so ti".split() for b in "da fe go hu ja po ru ze".split()]
    rows, marks = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 200))
        toxic = int(i % 6 == 0)
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = [w for _ in range(3) for w in (rng.choice(BAD).title(), rng.choice(vocab) + ",")]
        rows.append((i, " ".join(words), 1, 1.0))
        marks.append((i, toxic))
    return rows, marks


@pytest.fixture(scope="module")
def learned(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score double")
    odd_marks = [(3, 1), (3, None), (None, 1), (5, 7), (99_999, 1)]
    labels = spark.createDataFrame([m for m in marks if m[0] % 4] + odd_marks, "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels), dict(marks)


def test_unseen_documents_are_told_apart(learned):
    docs, _, model, marks = learned
    wrong = [r["doc_id"] for r in toxicity.score(docs, model).collect() if r["doc_id"] % 4 == 0 and (r["score"] >= 0.5) != bool(marks[r["doc_id"]])]
    assert len(wrong) <= 2


def test_passages_hold_the_toxic_words(learned):
    docs, _, model, marks = learned
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        found = " ".join(texts[r["doc_id"]][p["start"] : p["end"]] for p in r["passages"])
        if marks[r["doc_id"]]:
            assert all(w in found for w in texts[r["doc_id"]].split() if w.lower() in BAD)
        assert all(0 <= p["start"] < p["end"] and p["p"] <= 0.05 for p in r["passages"])


def test_odd_texts(spark, learned):
    _, _, model, _ = learned
    texts = [None, "", " \n", "123 !?", "İİ idiot scum trash İ", "IDIOT, scum. trash; idiot", "clean"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "idiot scum trash", 0), (5, texts[5], 0)], "doc_id long, text string, passages int")
    rows = {}
    for r in toxicity.score(docs, model).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[0][0]["score"] == rows[1][0]["score"] == rows[3][0]["score"] < 0.5 and not rows[0][0]["passages"]
    assert texts[4][rows[4][0]["passages"][0]["start"] : rows[4][0]["passages"][0]["end"]] == "idiot scum trash"
    assert [r["score"] for r in rows[5]] == [rows[5][0]["score"]] * 2 and rows[None][0]["score"] >= 0.5
    assert {len(r) for i, r in rows.items() if i != 5} == {1}


def test_very_long_text_is_scanned_whole_and_in_linear_time(learned):
    _, _, model, _ = learned
    text = "bada kefe ligo " * 400_000 + "idiot scum trash idiot scum"
    start = time.monotonic()
    score, passages = model.score(text)
    assert score > model.score("bada kefe ligo " * 400_000)[0] and text[passages[-1]["start"] :] == "idiot scum trash idiot scum"
    many = "idiot bada scum " * 300_000
    assert model.score(many)[0] >= 0.5
    assert time.monotonic() - start < 60


def test_pieces_cut_between_words(monkeypatch, learned):
    _, _, model, _ = learned
    text = "idiot kefe, " * 50 + "bada " * 300
    whole = toxicity.evidence(text, model.weights)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.evidence(text, model.weights) == whole


def test_nothing_to_learn_from(spark, learned):
    docs, labels, _, _ = learned
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    ones = labels.where("toxic = 1")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
    blank = docs.withColumn("text", F.lit("..."))
    assert {r["score"] for r in toxicity.score(blank, toxicity.fit(blank, labels)).collect()} == {0.0}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op11_toxicity"](spark, sf).collect()
    marks = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    # held-out accuracy: as in README
    clean = [r["predicted"] for r in rows if r["held_out"] and marks.get(r["doc_id"]) == 0]
    toxic = [r["predicted"] for r in rows if r["held_out"] and marks.get(r["doc_id"]) == 1]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.6 * len(toxic)


def test_odd_documents_of_the_other_tests(spark, learned):
    _, _, model, _ = learned
    docs = spark.createDataFrame(brute.odd_documents(40), brute.SCHEMA)
    assert toxicity.score(docs, model).count() == docs.count()
