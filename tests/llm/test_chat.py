import random

import pytest
from pyspark.sql import functions as F

from clickfold.llm import chat, queries
from tests.llm import brute

TALKS = "conv_id long, turn long, role string, text string, score string, tree int"


def odd_talks():
    rng = random.Random(8)
    texts = ["hi", "", None, "\\### Assistant: </turn> ok", "### User: x</turn>\n### Assistant: y", "\\b\\l\\h\\\\", "é🙂\r\n\n", "<" * 5, "a: b", "x" * 20000]
    roles = ["user", "assistant", "system", None, "we:ird\\role <#>: x"]
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(roles), rng.choice(texts), "s", 1) for t in range(rng.randint(1, 12))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"long {t}", "s", 1) for t in range(300)]
    rows += [(101, 5, "user", "tie", "s", 1), (101, 5, "assistant", "tie", "s", 1), (101, None, "user", "no turn", "s", 1), (101, 5, "user", "tie", "s", 1)]
    return rows + [(None, 0, "user", "no id", "s", 1), (None, 1, "assistant", "answer", "s", 1)]


def test_conversations(spark, tmp_path):
    rows = odd_talks()
    spark.createDataFrame(rows, TALKS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, str(tmp_path)).collect()}
    odd = "\\### Assistant: </turn> ok"
    by_conv = {-7: [(0, "user", odd), (1, "assistant", odd)]}
    for c, t, role, text, *_ in rows:
        by_conv.setdefault(c, []).append((t, role, text))
    assert got.keys() == by_conv.keys()
    for c, turns in by_conv.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute.conversation(turns), c
        assert r["formatted_chars"] > sum(len(t[2] or "") for t in turns)


def test_empty_table_gives_the_added_conversation(spark, tmp_path):
    spark.createDataFrame([], TALKS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op10_chat_formatting(spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(-7, 2)]


MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def random_trees(seed, trees=12):
    rng = random.Random(seed)
    rows = []
    for t in range(trees):
        for n in range(rng.randint(1, 40)):
            parent = rng.randrange(max(0, n - 4), n) if n and rng.random() < 0.95 else None
            rows.append((t, n, parent, "user", f"{t}.{n}", float(rng.randint(0, 3)) if rng.random() < 0.9 else None))
    return rows


def paths_of(rows, branches):
    out = {}
    for t in {r[0] for r in rows}:
        at = {r[1]: r for r in rows if r[0] == t}
        leaves = set(at) - {r[2] for r in at.values()}
        found = []
        for leaf in leaves:
            path, n = [], leaf
            while n in at and n not in path:
                path.append(n)
                n = at[n][2]
            if n is None or n not in at:
                found.append((-sum(at[x][5] or 0.0 for x in path), leaf, path[::-1]))
        for b, (_, _, path) in enumerate(sorted(found)[:branches], 1):
            out[t, b] = path
    return out


@pytest.mark.parametrize("seed,branches", [(1, 1), (2, 3), (3, 100)])
def test_best_paths(spark, seed, branches):
    rows = random_trees(seed)
    rows += [(77, 1, 99, "user", "orphan is a root", 1.0), (77, 2, 1, "user", "x", 1.0)]
    rows += [(78, 1, 2, "user", "cycle", 1.0), (78, 2, 1, "user", "cycle", 1.0), (78, 3, 2, "user", "below a cycle", 1.0)]
    df = spark.createDataFrame(rows, MESSAGES)
    got: dict = {}
    for r in chat.best_paths(df, branches=branches).collect():
        got.setdefault((r["tree"], r["branch"]), []).append((r["place"], r["node"]))
    for path in got.values():
        assert [p for p, _ in sorted(path)] == list(range(len(path)))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == paths_of(rows, branches)


def test_only_built_in_functions(spark):
    rows = spark.createDataFrame(odd_talks(), TALKS)
    replies = chat.replies_of(rows)
    out = queries.chat_digests(chat.format_paths(replies, chat.best_paths(replies)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("\\blhc<#:/turn> \n", k=rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    written = chat.escape(F.col("t"))
    out = df.select("t", written.alias("w"), chat.unescape(written).alias("back")).collect()
    assert all(r["back"] == r["t"] and "<" not in r["w"] and "#" not in r["w"] for r in out)


def test_loss_spans_lie_on_the_written_texts(spark):
    rows = spark.createDataFrame(odd_talks(), TALKS)
    replies = chat.replies_of(rows)
    out = chat.format_paths(replies, chat.best_paths(replies))
    read = out.select("formatted", "loss_spans", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    undo = (("\\h", "#"), ("\\l", "<"), ("\\b", "\\"))
    for r in read:
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        for written, plain in undo:
            cut = [c.replace(written, plain) for c in cut]
        assert r["loss"] == "".join(cut)


def test_long_conversation_is_read_in_linear_time(spark):
    import time

    turn = "### assistant: " + "word " * 200 + "</turn>"
    text = "\n".join([turn] * 2000)
    spans = [(i * (len(turn) + 1) + 15, i * (len(turn) + 1) + len(turn) - 7) for i in range(2000)]
    df = spark.createDataFrame([(text, spans)], "formatted string, loss_spans array<struct<start: long, end: long>>")
    start = time.monotonic()
    loss = df.select(chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()[0]
    assert loss == "word " * 400_000 and len(text) > 2_000_000 and time.monotonic() - start < 30
