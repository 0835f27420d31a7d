"""Toxicity by maximum-scoring segments over token log-odds.

A word's score is its log-odds between toxic and clean texts with an
informative Dirichlet prior (the pooled word frequencies, `prior_words`
strong; Monroe et al. 2008), drawn towards zero by `z` standard errors. A text
counts a word once, however often it repeats it. Words that this leaves below
`least` score nothing. Every word also costs a small drift, so that clean text
has a negative mean score.

A text's passages are its maximal scoring segments, all found in one linear
scan (Ruzzo and Tompa 1999). Their scores follow an extreme-value law on clean
text (Karlin and Altschul 1990): lambda is the root of the clean distribution,
K is fitted on clean training texts. The r best passages of a text count
together by the sum statistic (Karlin and Altschul 1993), with the r that is
least likely by chance; a logistic curve of log(1 - log p) gives the score.

Fitting reads at most about `rows_per_label` texts of each label: those whose
id hashes under the label's share, so the draw is the same on every run. K and
the curve are fitted on texts scored by models that did not see them (FOLDS
folds by text). Equal texts of one label count once. Prediction reads whole
texts of all documents.

Defined cases: null, empty and letterless texts have no passages and the score
of a text without evidence. A document with both labels is toxic; labels other
than 0 and 1, null ids, and labels without a document are ignored. With
labels of one kind only (or none) nothing is learned: every text scores 0, or
1 if all labels are toxic. Rows are independent; repeated rows get equal
answers, and other columns of the input stay out of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import scratch

WORD = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[\W\d_]")
FOLDS = 4
PIECE = 1 << 20
PASSAGES = "array<struct<start: long, end: long, score: double, p: double>>"


def lowered(text: str) -> str:
    """Lower case, position by position (letters that grow are left alone)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of about PIECE characters, cut between words."""
    at = 0
    while len(text) - at > PIECE and (m := BREAK.search(text, at + PIECE)):
        yield at, text[at : m.start()]
        at = m.start()
    yield at, text[at:] if at else text


def maximal_segments(items: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """(score, first, last) of all maximal scoring segments, in text order.

    `items` are (word number, score) of the words with a score of their own;
    every word costs `drift`. first and last are indices into `items`.
    """
    # open candidates: total before, total after, first, last, nearest earlier one with a smaller total before
    found: list[tuple[float, float, int, int, int]] = []
    total, seen = 0.0, 0
    for i, (place, score) in enumerate(items):
        total -= drift * (place - seen)
        seen = place + 1
        before, total = total, total + score - drift
        if score <= drift:
            continue
        after, first = total, i
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= before:
                at = found[at][4]
            if at < 0 or found[at][1] >= after:
                found.append((before, after, first, i, at))
                break
            before, _, first, _, earlier = found[at]
            del found[at:]
            at = earlier
    return [(after - before, first, last) for before, after, first, last, _ in found]


def karlin_root(scored: list[tuple[float, float]], drift: float) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1 over clean words, given
    (share of clean words, score) of the words with a score of their own."""
    if not any(s > drift for _, s in scored):
        return 1.0

    def excess(x: float) -> float:
        return math.log1p(sum(p * math.expm1(x * s) for p, s in scored)) - x * drift

    high = 1.0
    while excess(high) <= 0:
        high *= 2
    low = high
    while excess(low) >= 0 and low > 1e-9:
        low /= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def surprise(scores: list[float], n: int, rate: float, k: float) -> float:
    """-log of the chance that clean text of n words holds passages as good as
    the best r of these, for the r that makes it smallest (weight 2^-r)."""
    base = math.log(max(k * n, 1e-300))
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += rate * s - base
        if total <= 0:
            break
        if r == 1:
            log_p = math.log(-math.expm1(-math.exp(-total))) if total < 30 else -total
        else:
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        best = max(best, -log_p - r * math.log(2))
    return best


@dataclass
class Weights:
    """Word scores of one fold's model (or of all folds)."""

    words: dict[str, float]
    drift: float
    rate: float  # Karlin's lambda


@dataclass
class Model:
    weights: Weights | None = None
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0
    constant: float = 0.0  # the score where nothing could be learned
    alpha: float = field(default=0.05)

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        if self.weights is None:
            return self.constant, []
        w = self.weights
        n, segments, spans = evidence(text, w)
        x = self.intercept + self.slope * math.log1p(surprise([s for s, _, _ in segments], n, w.rate, self.k))
        passages = []
        for s, first, last in segments:
            p = -math.expm1(-self.k * n * math.exp(-w.rate * s))
            if p <= self.alpha:
                passages.append({"start": spans[first][0], "end": spans[last][1], "score": s, "p": p})
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0, passages


def evidence(text: str | None, w: Weights) -> tuple[int, list[tuple[float, int, int]], list[tuple[int, int]]]:
    """Number of words, maximal segments, and spans of the scored words."""
    items: list[tuple[int, float]] = []
    spans: list[tuple[int, int]] = []
    n = 0
    known = w.words
    for offset, piece in pieces(lowered(text or "")):
        words = WORD.findall(piece)
        if not known.keys().isdisjoint(words):
            for i, m in enumerate(WORD.finditer(piece)):
                if (s := known.get(m.group())) is not None:
                    items.append((n + i, s))
                    spans.append((offset + m.start(), offset + m.end()))
        n += len(words)
    return n, maximal_segments(items, w.drift), spans


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_label: int = 20_000,
    prior_words: float = 5000.0,
    z: float = 1.96,
    least: float = 0.5,
    alpha: float = 0.05,
) -> Model:
    """Learn from the documents that `labels` marks. Passages of later texts
    are reported if clean text holds one as good with a chance of `alpha`."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(constant=float(1 in sizes), alpha=alpha)
    shares = {x: min(1.0, rows_per_label / n) for x, n in sizes.items()}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    picked = marked.where(draw < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]))
    # at most about 2 * rows_per_label ids and labels, whatever the tables hold
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    train = texts.join(F.broadcast(picked), F.col("doc") == F.col("id")).select("label", "text")
    train = train.dropDuplicates(["label", "text"]).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    train = scratch(train, "toxicity-training")
    models = _weights(train, prior_words, z, least)
    if models is None:
        return Model(constant=0.0, alpha=alpha)
    return _calibrated(train, models, shares, alpha)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[int, int], Counter] = {}
        for label, text, fold in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = {w for _, piece in pieces(lowered(text)) for w in WORD.findall(piece)}
            found.setdefault((label, fold), Counter()).update(words)
        cell = [label * FOLDS + fold for (label, fold), words in found.items() for _ in words]
        word = [w for words in found.values() for w in words]
        n = [c for words in found.values() for c in words.values()]
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["cell", "word", "n"])


def _weights(train: DataFrame, prior: float, z: float, least: float) -> list[Weights] | None:
    """Weights without fold 0, 1, ... and, last, of all folds."""
    counts = train.select("label", "text", "fold").mapInArrow(_count_words, "cell int, word string, n long")
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    counts = scratch(counts.groupBy("word").agg(*cells), "toxicity-words")
    totals = counts.agg(*[F.coalesce(F.sum(f"c{c}"), F.lit(0)) for c in range(2 * FOLDS)]).first()
    kept_of = [[f for f in range(FOLDS) if f != m] for m in range(FOLDS + 1)]

    def total(m: int, label: int) -> int:
        return sum(totals[label * FOLDS + f] for f in kept_of[m])

    if not total(FOLDS, 0) or not total(FOLDS, 1):
        return None
    columns: list[Column] = []
    for m, folds in enumerate(kept_of):
        n0, n1 = float(total(m, 0)), float(total(m, 1))
        y0, y1 = (sum(F.col(f"c{label * FOLDS + f}") for f in folds).cast("double") for label in (0, 1))
        a = (y0 + y1) * (prior / max(n0 + n1, 1.0))
        odds = F.log((y1 + a) / (n1 + prior - y1 - a)) - F.log((y0 + a) / (n0 + prior - y0 - a))
        sure = F.abs(odds) - z * F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        score = F.when((a > 0) & (sure >= least), sure * F.signum(odds))
        columns += [score.alias(f"s{m}"), ((y0 + a) / (n0 + prior)).alias(f"p{m}"), ((y1 + a) / (n1 + prior)).alias(f"q{m}")]
    scored = counts.select("word", *columns).where(" or ".join(f"s{m} is not null" for m in range(FOLDS + 1)))
    rows = scored.collect()  # significant words of a bounded sample of texts
    out = []
    for m in range(FOLDS + 1):
        mine = [r for r in rows if r[f"s{m}"] is not None]
        scored_words = [(r[f"p{m}"], r[f"s{m}"]) for r in mine]
        share = sum(r[f"q{m}"] - r[f"p{m}"] for r in mine if r[f"s{m}"] > 0)
        # clean text then loses -log(1 - share) a word, as with exact log-odds
        drift = max(sum(p * s for p, s in scored_words), 0.0) - math.log1p(-min(max(share, 1e-4), 0.5))
        out.append(Weights({r["word"]: r[f"s{m}"] for r in mine}, drift, karlin_root(scored_words, drift)))
    return out


def _calibrated(train: DataFrame, models: list[Weights], shares: dict[int, float], alpha: float) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, segments = [], []
            for text, fold in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, found, _ = evidence(text, models[fold])
                n.append(words)
                segments.append(sorted((models[fold].rate * s for s, _, _ in found), reverse=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(segments, pa.list_(pa.float64()))], names=["label", "n", "segments"]
            )

    rows = train.select("label", "text", "fold").mapInArrow(run, "label int, n long, segments array<double>")
    rows = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[1], r[2]))  # a bounded sample
    clean = [(n, s[0] if s else 0.0) for label, n, s in rows if label == 0 and n]
    k = len(clean) / sum(n * math.exp(-best) for n, best in clean) if clean else 1.0
    x = np.log1p([surprise(s, n, 1.0, k) for _, n, s in rows])
    y = np.array([label for label, _, _ in rows], float)
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    intercept, slope = logistic(x, y, weight)
    return Model(models[FOLDS], k, intercept, slope, 0.0, alpha)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one variable (Newton steps, weak ridge)."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    b = np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (y - p)) - ridge @ b
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hess, grad)
        b = b + step * min(1.0, 4 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), max(float(b[1]), 0.0)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) for every row of `docs`; only the text decides.
    Passages are code-point spans of the text with their score and chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], kind)],
                names=["id", "score", "passages"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double, passages {PASSAGES}").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Held-out mark; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
