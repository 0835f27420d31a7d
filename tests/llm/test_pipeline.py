import pytest

import corpus_pipeline
from clickfold.llm import queries
from clickfold.llm.sql import SQL
from oracle.compare import compare, duckdb_for
from tests.llm import brute

STAGES = dict(corpus_pipeline.STAGES)
# extra columns named like the operators' own outputs and helpers
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, component_id int, fp string, line_dedup int, copies int, lang_pred string, ver int, id int, size int, hash int"


@pytest.fixture(scope="module")
def rows():
    long_ = " ".join(f"w{i}" for i in range(900))
    near = [(3000 + i, long_.replace(f"w{7 * i} ", "changed "), "en", "hot", 0, 0) for i in range(12)]
    return brute.odd_documents(150) + near


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(*r[:5], 1, "f", 2, 3, "zz", 4, 5, 6, 7) for r in rows]
    return spark.createDataFrame(data, CLASHING).repartition(3)


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_stage_keeps_the_columns_of_documents(spark, docs):
    for name in ("language_id", "line_dedup", "simhash_dedup", "mixing"):
        out = STAGES[name](spark, docs, "")
        assert out.schema.simpleString() == docs.schema.simpleString(), name


def test_language_stage_drops_only_texts_without_letters(spark, docs, rows):
    out = sorted(r["doc_id"] for r in STAGES["language_id"](spark, docs, "").collect())
    assert out == sorted(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_language_stage_drops_texts_without_a_likely_language(spark):
    texts = ["the cat sat on the mat and the rain fell"] * 8 + ["der hund lief über die straße und bellte"] * 8 + ["le garçon mange une pomme verte"] * 8
    langs = ["en"] * 8 + ["de"] * 8 + ["fr"] * 8
    more = ["漢字漢字", "the cat", "漢字 und der hund", "12", "漢 字"]
    rows = [(i, t, x, None, None, 0) for i, (t, x) in enumerate(zip(texts, langs, strict=True))]
    rows += [(100 + i, t, None, None, None, 0) for i, t in enumerate(more)]
    out = STAGES["language_id"](spark, spark.createDataFrame(rows, brute.SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] >= 100) == [101, 102] and len(out) == 26


def test_language_stage_without_any_label_keeps_texts_with_letters(spark):
    texts = ["clean text", "другой текст", "123 !?", "", None]
    docs = spark.createDataFrame([(i, t, None, None, None, 0) for i, t in enumerate(texts)], brute.SCHEMA)
    assert sorted(r["doc_id"] for r in STAGES["language_id"](spark, docs, "").collect()) == [0, 1]


def test_line_stage(spark, docs, rows):
    want = brute.line_dedup(rows)
    out = STAGES["line_dedup"](spark, docs, "").collect()
    assert len(out) == len(rows)
    for r in out:
        assert brute.sha(r["text"] or "") == want[r["doc_id"]][2]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert (r["line_dedup"], r["component_id"], r["lang_pred"]) == (2, 1, "zz")


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs, rows):
    comp = brute.simhash_components(rows)
    out = sorted(r["doc_id"] for r in STAGES["simhash_dedup"](spark, docs, "").collect())
    assert out == sorted(i for i, (_, c) in comp.items() if c == i)
    assert len(out) < len(rows) - 20


def test_near_dedup_stage_writes_no_text(spark, docs, tmp_path):
    from clickfold.sources import files
    from clickfold.sources.tables import scratch_scope

    docs.write.parquet(f"{tmp_path}/documents")
    read = spark.read.parquet(f"{tmp_path}/documents").where("doc_id <> 3")
    with scratch_scope(spark, keep=True) as written:
        out = STAGES["simhash_dedup"](spark, read, "").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in STAGES["simhash_dedup"](spark, docs.where("doc_id <> 3"), "").collect())
    left = [p for p in written if files.exists(spark, p)]
    assert left and not any("text" in spark.read.parquet(p).columns for p in left)


def test_near_dedup_stage_without_a_broadcast(spark, docs, rows, monkeypatch):
    from clickfold.llm import simhash

    want = sorted(r["doc_id"] for r in STAGES["simhash_dedup"](spark, docs, "").collect())
    monkeypatch.setattr(simhash, "BROADCAST_PAGES", -1)
    assert sorted(r["doc_id"] for r in STAGES["simhash_dedup"](spark, docs, "").collect()) == want


def test_mixing_takes_wordless_documents_at_most_twice(spark):
    rows = [(i, " " if i % 3 else "one word more", None, "small", None, 0) for i in range(60)]
    rows += [(100 + i, "many words here " * 40, None, "large", None, 0) for i in range(60)]
    times: dict = {}
    for r in STAGES["mixing"](spark, spark.createDataFrame(rows, brute.SCHEMA), "").collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2


def test_mixing_stage_nears_the_targets(spark, docs, rows):
    sizes, target = brute.targets(rows)
    taken = dict.fromkeys(sizes, 0)
    times: dict = {}
    for r in STAGES["mixing"](spark, docs, "").collect():
        taken[r["source"]] += len(brute.WORDS.findall(r["text"] or ""))
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    largest = {s: max(len(brute.WORDS.findall(r[1] or "")) for r in rows if r[3] == s) for s in sizes}
    assert max(times.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_whole_run_equals_the_stages_one_by_one(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, step, str(tmp_path)).write.parquet(path)
        step = spark.read.parquet(path)
    last = STAGES["bpe"](spark, step, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, last)) and len(out) > 50


def test_empty_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.fixture(scope="module")
def con():
    return duckdb_for("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_operators_match_their_sql(spark, con, name):
    r = compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, SQL[name])
    assert r.ok, r
