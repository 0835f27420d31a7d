import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickfold.llm import bpe, langid, linededup, mixing, queries
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return brute.odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_dir(docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty_dir(docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    docs.limit(0).write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["op1_language_id", "op2_line_dedup", "op7_mixing", "op8_bpe"])
def test_empty_table(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


def test_language_id(spark, odd_dir, rows):
    out = {r["doc_id"]: r for r in queries.op1_language_id(spark, odd_dir).collect()}
    by_id = {r[0]: r for r in rows}
    assert set(out) == set(by_id)
    for i, r in out.items():
        text = by_id[i][1]
        assert r["held_out"] == brute.held_out(i)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    judged = [(out[i]["lang_pred"], r[2]) for i, r in by_id.items() if r[2] and brute.held_out(i) and i < 120]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged) and len(judged) > 10


def test_language_id_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.op1_language_id(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_language_id_ignores_labels_of_the_rows_it_predicts(spark, docs):
    model = langid.fit(langid.training_rows(docs))
    a = langid.predict(docs, model).collect()
    b = langid.predict(docs.drop("lang", "source"), model).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_language_backoff_uses_longest_known_grams():
    model = langid.Model(["a", "b"], {0: [("a", "hello", 3)], 3: [("a", "abc", 9), ("b", "xyz", 9)], 1: [("b", "a", 5)]})
    scorer = langid.Scorer(model)
    assert scorer.predict("hello")[0] == "a"
    assert scorer.predict("abcabc")[0] == "a"  # length 3 decides before length 1
    assert scorer.predict("aq")[0] == "b"
    assert scorer.predict("12 -- ²")[0] == "und"
    assert langid.Scorer(langid.Model([], {})).predict("hello") == ("und", 0.0)


def test_language_scores_equal_brute_force(spark, docs, rows):
    want = brute.language_scorer([(t, lang) for i, t, lang, *_ in rows if t is not None and lang is not None and not brute.held_out(i)])
    model = langid.fit(langid.training_rows(docs))
    scorer = langid.Scorer(model)
    texts = [r[1] for r in rows] + ["zzz qqq the straßen mangent", "unknownish wordlets", "語"]
    for text in texts:
        label, score = scorer.predict(text)
        shares = want(text)
        assert (label, score) == ("und", 0.0) if not shares else score == pytest.approx(max(shares.values()), rel=1e-9)
        assert not shares or shares[label] == pytest.approx(max(shares.values()), rel=1e-9)


def test_language_tables_are_bounded_per_label_only(spark):
    """Rare labels among many are learned, each with words of its own."""
    rows = [(1000 * k + i, f"word{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)} same common", f"l{k:03}") for k in range(600) for i in range(2 if k % 2 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.labels) == 600
    scorer = langid.Scorer(model)
    assert [scorer.predict(t)[0] for _, t, _ in rows] == [lang for _, _, lang in rows]
    few = langid.fit(docs, words_per_label=1, grams_per_label=1)
    assert len(few.labels) == 600 and all(np.bincount(x, minlength=600).max() <= 1 for x in few.seen_in.values())


@pytest.mark.parametrize("slice_, gains", [(3, 4_000_000), (8192, 1), (1, 2)])
def test_language_slices_and_forgetting(monkeypatch, docs, slice_, gains):
    model = langid.fit(langid.training_rows(docs))
    texts = ["the cat der hund " * 50 + "le garçon xyzzy", "old town", "über die straße und plugh"]
    want = [langid.Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(langid, "SLICE", slice_)
    monkeypatch.setattr(langid, "CACHE_GAINS", gains)
    scorer = langid.Scorer(model)
    for t, (label, score) in zip(texts * 2, want * 2, strict=True):
        assert scorer.predict(t) == (label, pytest.approx(score))


def test_language_of_a_very_long_text(docs, rows):
    """Many slices and more distinct words than are kept."""
    model = langid.fit(langid.training_rows(docs))
    want = brute.language_scorer([(t, lang) for i, t, lang, *_ in rows if t is not None and lang is not None and not brute.held_out(i)])
    letters = "abcdefghij"
    text = " ".join("".join(letters[int(c)] for c in f"{i * 7919 % 250_000:06}") if i % 3 else "der hund lief" for i in range(400_000))
    shares = want(text)
    assert langid.Scorer(model).predict(text)[0] == max(shares, key=shares.get)


def test_language_cache_limit(monkeypatch):
    model = langid.Model(["a", "b"], {0: [("a", "w", 3)], 1: [("b", "x", 5), ("a", "y", 5)]})
    want = langid.Scorer(model).predict("xx xy yy w xxx xxy")
    monkeypatch.setattr(langid, "CACHE_ROWS", 2)
    small = langid.Scorer(model)
    for _ in range(3):
        assert small.predict("xx xy yy w xxx xxy") == pytest.approx(want)


def test_line_dedup(spark, odd_dir, rows):
    want = brute.line_dedup(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op2_line_dedup(spark, odd_dir).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 50


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_line_dedup_hot_line_over_many_partitions(spark, partitions):
    rows = [(i, "everybody has this line\n" * (1 + i % 3) + f"own {i} line here", None, None, None, 0) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, brute.SCHEMA)
        got = {r["doc_id"]: brute.sha(r["text"]) for r in linededup.dedup_lines(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: v[2] for k, v in brute.line_dedup(rows).items()}


def test_line_dedup_null_and_repeated_ids(spark):
    a, b = "a line of some length", "another line of length"
    rows = [(None, a, None, None, None, 0), (5, a, None, None, None, 1), (5, a, None, None, None, 2), (5, b, None, None, None, 3), (9, f"{b}\n{a}", None, None, None, 4)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    got = sorted((r["doc_id"] or 0, r["score"], r["text"]) for r in out)
    assert got == [(0, 0, a), (5, 1, a), (5, 2, a), (5, 3, b), (9, 4, "")]


def test_mixing(spark, odd_dir, rows):
    sizes, target = brute.targets(rows)
    out = {r["doc_id"]: r for r in queries.op7_mixing(spark, odd_dir).collect()}
    taken = dict.fromkeys(sizes, 0)
    largest = dict.fromkeys(sizes, 0)
    for r in rows:
        o, n = out[r[0]], len(brute.WORDS.findall(r[1] or ""))
        assert (o["size"], o["source_size"]) == (n, sizes[r[3]])
        assert o["target"] == pytest.approx(target[r[3]])
        assert o["taken"] == n * o["copies"] <= 2 * n
        taken[r[3]] += o["taken"]
        largest[r[3]] = max(largest[r[3]], n)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in queries.op7_mixing(spark, odd_dir).collect()}
    assert again == {i: o["taken"] for i, o in out.items()}


def test_mixing_take_repeats_rows(spark, docs):
    sized, plan = mixing.plan_mix(docs)
    want = {(r["doc_id"]): r["copies"] for r in mixing.mixed(sized, plan).collect()}
    out = mixing.take(docs, plan)
    assert out.columns == docs.columns
    got = dict.fromkeys(want, 0)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert got == want


def test_mixing_larger_budget_is_a_superset(spark, docs):
    less, more = (
        {r["doc_id"]: r["copies"] for r in mixing.mixed(*mixing.plan_mix(docs, share=share)).collect()} for share in (0.6, 0.9)
    )
    assert all(less[i] <= more[i] for i in less)


def test_mixing_without_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.mixed(*mixing.plan_mix(docs)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed(*mixing.plan_mix(docs)).collect())) == want


def test_bpe_equals_library(spark, odd_dir, rows):
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    out = {r["doc_id"]: r for r in queries.op8_bpe(spark, odd_dir).collect()}
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        o = out[r[0]]
        assert o["n_tokens"] == len(ids), r[1]
        assert o["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert o["decoded_sha256"] == brute.sha(lib.decode(ids, skip_special_tokens=False))


def test_bpe_random_texts():
    import random

    lib = Tokenizer.from_file(PATH)
    own = bpe.Codec(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    alphabet = "abcdefgHIJ ÄöüßΣσς́̇İıﬁ'’st-_.,!?0123456789\t\n\r\x0b\x0c\x1c\x1f\x85\xa0​  漢字かな🙂👍🏽ก<|endoftext|>"
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>a"])
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), np.int32).tolist() == ids, repr(text)
        assert own.decode(np.array(ids, np.int32)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_decode_alone_equals_decode_beside_encode(spark, docs):
    both = bpe.encode(docs, PATH, decoded_col="decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, bpe.decode(bpe.encode(docs, PATH), PATH).collect()))


def test_bpe_decode_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [256, 99999999, -1, 320])], "doc_id long, ids array<int>")
    want = Tokenizer.from_file(PATH).decode([256, 320], skip_special_tokens=False)
    assert [r["decoded"] for r in bpe.decode(rows, PATH).orderBy("doc_id").collect()] == ["", "", want]


def test_bpe_scan_and_heap_agree():
    import random

    own = bpe.Codec(open(PATH, encoding="utf-8").read())
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choices("aeinrstthou", k=rng.randint(2, 200)))
        parts = [own.inner[ord(c)] for c in word[:-1]] + [own.last[ord(word[-1])]]
        assert own.merge_scan(list(parts)) == own.merge_heap(list(parts))


def test_bpe_clears_its_bounded_cache(monkeypatch):
    own = bpe.Codec(open(PATH, encoding="utf-8").read())
    want = own.encode("some words that repeat some words")
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1)
    assert bpe.Codec(open(PATH, encoding="utf-8").read()).encode("some words that repeat some words") == want


def test_null_ids_and_repeated_rows(spark, tmp_path):
    """Rows without an id, and repeated rows, each give a row of their own."""
    rows = [(None, "the cat sat on the mat", "en", None, None, 1), (None, None, None, None, None, 2), (3, "der hund", "de", "s", 1, 3), (3, "der hund", "de", "s", 1, 3)]
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_language_id", "op2_line_dedup", "op3_secret_scan", "op5_simhash_dedup", "op7_mixing", "op8_bpe"):
        out = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r["doc_id"] or 0 for r in out) == [0, 0, 3, 3], name
        assert len({tuple(r) for r in out if r["doc_id"] == 3}) == 1, name
