"""Language identification: word-first backoff.

A word seen in training scores by its log frequency in each language. An
unseen word falls back to its character n-grams: the longest length n at
which any of its n-grams was seen decides, by the mean log frequency of the
seen n-grams of that length. Scores of all words of a text are added; the
softmax of the sums gives the language and its score.

All labels are learned. Training is bounded per label by documented
parameters (`rows_per_label`, `words_per_label`, `grams_per_label`); counting
runs on Spark and only the bounded tables reach the driver. Prediction reads
whole texts.

Defined cases: a null text or one without a letter gives `und` with score 0;
so does every text if nothing could be learned. Ties go to the smaller label.
Rows are independent, so repeated rows get equal answers; other columns of
the input are kept out of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)
#: Added to every count.
SMOOTH = 0.5
#: Words, and labels with gains, whose scores a worker keeps; words of a text that are scored at once.
CACHE_ROWS, CACHE_GAINS = 200_000, 4_000_000
SLICE = 8192


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def hash64(item: str) -> int:
    """Items are told apart by 64-bit hashes (a billion of them meet by chance with a probability of 3 %)."""
    return xxhash.xxh3_64_intdigest(item.encode("utf-8", "surrogatepass"))


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word between boundary marks; single characters unmarked."""
    s = word if n == 1 else f" {word} "
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(label, Counter()).update(words_of(text))
        label, kind, item, n = [], [], [], []
        for name, words in found.items():
            grams: dict[int, Counter] = {k: Counter() for k in LENGTHS}
            for w, c in words.items():
                for k in LENGTHS:
                    for g in grams_of(w, k):
                        grams[k][g] += c
            for k, counts in ((0, words), *grams.items()):
                label += [name] * len(counts)
                kind += [k] * len(counts)
                item += counts.keys()
                n += counts.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.string()), pa.array(kind, pa.int32()), pa.array(item, pa.string()), pa.array(n, pa.int64())],
            names=["label", "kind", "item", "n"],
        )


class Model:
    """Labels, and for each kind (0: words, n: n-grams) the items' sorted
    64-bit hashes with the labels that each was seen in.

    An item seen n times in a label scores log((n + 0.5) / total) there and
    log(0.5 / total) in the labels without it, so only the difference
    log((n + 0.5) / 0.5) is kept per (item, label): memory follows the counts
    learned, 8 bytes per item and 12 per count, not items times labels."""

    def __init__(self, labels: list[str], tables: dict[int, list[tuple[str, str, int]]]):
        self.labels = sorted(labels)
        at = {x: i for i, x in enumerate(self.labels)}
        self.keys: dict[int, np.ndarray] = {}
        self.starts: dict[int, np.ndarray] = {}
        self.seen_in: dict[int, np.ndarray] = {}
        self.gains: dict[int, np.ndarray] = {}
        self.base = np.zeros((1 + max(LENGTHS), len(self.labels)))
        for kind in (0, *LENGTHS):
            entries = tables.get(kind, [])
            keys = np.array([hash64(item) for _, item, _ in entries], np.uint64)
            label = np.array([at[x] for x, _, _ in entries], np.int32)
            n = np.array([c for _, _, c in entries], np.float64)
            order = np.lexsort((label, keys))
            self.keys[kind], first = np.unique(keys[order], return_index=True)
            self.starts[kind] = np.append(first, len(keys))
            self.seen_in[kind], self.gains[kind] = label[order], np.log((n[order] + SMOOTH) / SMOOTH)
            total = np.bincount(label, n, len(self.labels)) + SMOOTH * (len(self.keys[kind]) + 1)
            self.base[kind] = np.log(SMOOTH / total)

    def look_up(self, kind: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each item its number in the table of this kind and whether the table has it."""
        keys = np.array([hash64(x) for x in items], np.uint64)
        table = self.keys[kind]
        if not len(table):
            return np.zeros(len(items), int), np.zeros(len(items), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def with_room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of at least twice its length if it is too short."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class Scorer:
    """Predicts with a model; keeps what words score until there are
    CACHE_ROWS of them or CACHE_GAINS labels and gains, then starts anew."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.used = 0  # of the gains
        self.kinds, self.starts = np.zeros(1024, np.int64), np.zeros(1025, np.int64)
        self.seen_in, self.gains = np.zeros(4096, np.int32), np.zeros(4096)

    def learn(self, words: list[str]) -> None:
        """Takes up all the given words: each with the kind that scores it
        (its own row, else its longest known n-grams; -1 if none is known)
        and the labels and gains over that kind's base."""
        if len(self.rows) >= CACHE_ROWS or self.used >= CACHE_GAINS:
            self.forget()
        left = [w for w in dict.fromkeys(words) if w not in self.rows]
        for kind in (0, *LENGTHS):
            if not left:
                return
            items = [[w] if kind == 0 else grams_of(w, kind) for w in left]
            at, known = self.model.look_up(kind, [x for own in items for x in own])
            word, at = np.repeat(np.arange(len(left)), [len(own) for own in items])[known], at[known]
            hits = np.bincount(word, minlength=len(left))
            starts = self.model.starts[kind][at]
            lengths = self.model.starts[kind][at + 1] - starts
            entries, owner = ranges(starts, lengths), np.repeat(word, lengths)
            self.add([w for w, n in zip(left, hits, strict=True) if n], kind, np.bincount(owner, minlength=len(left))[hits > 0],
                     self.model.seen_in[kind][entries], self.model.gains[kind][entries] / hits[owner])
            left = [w for w, n in zip(left, hits, strict=True) if not n]
        self.add(left, -1, np.zeros(len(left), int), np.empty(0, np.int32), np.empty(0))

    def add(self, words: list[str], kind: int, lengths: np.ndarray, labels: np.ndarray, gains: np.ndarray) -> None:
        row, rows, end = len(self.rows), len(self.rows) + len(words), self.used + len(gains)
        self.kinds, self.starts = with_room(self.kinds, rows), with_room(self.starts, rows + 1)
        self.seen_in, self.gains = with_room(self.seen_in, end), with_room(self.gains, end)
        self.kinds[row:rows], self.starts[row + 1 : rows + 1] = kind, self.used + np.cumsum(lengths)
        self.seen_in[self.used : end], self.gains[self.used : end] = labels, gains
        self.rows.update(zip(words, range(row, rows), strict=True))
        self.used = end

    def total(self, words: list[str]) -> np.ndarray:
        found = [self.rows.get(w, -1) for w in words]
        if min(found) < 0:
            self.learn(words)
            found = [self.rows[w] for w in words]
        rows = np.array(found)
        at = ranges(self.starts[rows], self.starts[rows + 1] - self.starts[rows])
        kinds = np.bincount(self.kinds[rows] + 1, minlength=len(self.model.base) + 1)[1:]
        return kinds @ self.model.base + np.bincount(self.seen_in[at], self.gains[at], len(self.model.labels))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.model.labels or not has_letter(text):
            return UNKNOWN, 0.0
        words = words_of(text)
        total = np.zeros(len(self.model.labels))
        for at in range(0, len(words), SLICE):
            total += self.total(words[at : at + SLICE])
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.model.labels[best], float(odds[best] / odds.sum())


def fit(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rows_per_label: int = 3000,
    words_per_label: int = 25_000,
    grams_per_label: int = 15_000,
) -> Model:
    """Learn from the rows with a text and a label.

    At most about `rows_per_label` rows of each label are read: those whose
    hash of (id, text) falls under the label's share, so the sample is
    balanced and the same on every run. Of every label the
    `words_per_label` most frequent words are kept and, per length, the
    `grams_per_label` most frequent n-grams; ties go to the smaller item.
    A model of 200 labels so takes 0.4 GB per worker at most.
    """
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")
    ).where("text is not null and label is not null")
    shares = {
        r["label"]: min(1.0, rows_per_label / r["n"])
        for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    }
    if not shares:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("label")]
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1_000_000
    counted = (
        rows.where(draw < share)
        .select("label", "text")
        .mapInArrow(_count_items, "label string, kind int, item string, n long")
        .groupBy("label", "kind", "item")
        .agg(F.sum("n").alias("n"))
    )
    tables = {}
    top = F.row_number().over(Window.partitionBy("label", "kind").orderBy(F.desc("n"), "item"))
    most = F.when(F.col("kind") == 0, F.lit(words_per_label)).otherwise(F.lit(grams_per_label))
    kept = counted.withColumn("rank", top).where(F.col("rank") <= most)
    for r in kept.select("kind", "label", "item", "n").toLocalIterator():
        tables.setdefault(r["kind"], []).append((r["label"], r["item"], r["n"]))
    return Model(list(shares), tables)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of `docs`; only the text decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", lead: float = 0.1) -> DataFrame:
    """`docs` without the rows that the model calls `und` or for which no
    language stands out: the score must exceed an even guess (1 by the number
    of labels) by `lead` of what is left to 1. Texts in a script that no
    training text uses go, as all languages are equally likely for them. All
    columns stay. If the model has learned nothing, only texts without a
    letter go."""
    even = 1 / max(1, len(model.labels))
    least = even + lead * (1 - even)

    @F.arrow_udf(BooleanType())
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for part in texts:
            if model.labels:
                found = (scorer.predict(t.as_py()) for t in part)
                yield pa.array([label != UNKNOWN and score >= least for label, score in found], pa.bool_())
            else:
                yield pa.array([has_letter(t.as_py()) for t in part], pa.bool_())

    return docs.where(known(F.col(text_col)))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out quarter (crc32 of the id)."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    """Held-out mark; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
