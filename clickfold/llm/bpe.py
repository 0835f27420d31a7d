"""BPE encoding and decoding with a published vocabulary with word ends.

The vocabulary file's own steps are followed: marked strings (special
tokens) are cut out first, the rest is NFC-normalised, white space becomes
one space, letters are lower-cased, words are taken by the file's pattern
and mapped to byte characters. Each word is merged on contiguous arrays:
one of part boundaries and one of the ranks of adjacent pairs. The smallest
rank is found by a scan, its boundary deleted, the two neighbouring ranks
refreshed, until no pair has a rank. Words of more than LONG parts, where
repeated scans would be quadratic, use a heap of the same ranks instead.
Words repeat, so each task keeps a bounded table of finished words.

Defined cases: null text encodes as the empty one (no ids, empty decoded
text). An id outside the vocabulary is skipped by decode. Repeated rows get
equal ids; other columns stay out of the result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LONG = 128
SLICE = 256  # documents held as Python objects at a time
CACHE_WORDS = 100_000  # words in each of two tables
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NONE = 1 << 60


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, otherwise
    the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text). Ids travel
    as packed 32-bit integers (bytes)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.tokens = np.array([tokens.get(i) for i in range(max(tokens) + 1)], object)
        # left id and right id in one integer -> rank and merged id in one integer
        self.merges = {ids[a] << ID_BITS | ids[b]: rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None
        chars = byte_characters()
        self.inner = [ids.get(c) for c in chars]
        self.last = [ids.get(c + suffix) for c in chars]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_scan(self, parts: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << ID_BITS | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merged = least & ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << ID_BITS | merged, NONE)
            if i < len(ranks):
                ranks[i] = get(merged << ID_BITS | parts[i + 1], NONE)
        return parts

    def merge_heap(self, parts: list[int]) -> list[int]:
        """Same merges in the same order (rank, then place) for long words."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (m := get(parts[i] << ID_BITS | parts[j])) is not None:
                heapq.heappush(heap, (m, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = m & ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """Ids of a word that is not in the younger table; it is put there.
        A full table becomes the older one, so frequent words stay."""
        found = self.older.get(word)
        if found is None:
            raw, inner = word.encode(), self.inner
            parts = [inner[b] for b in raw]
            parts[-1] = self.last[raw[-1]]
            if None in parts:
                parts = [p for p in parts if p is not None]
            found = array("i", self.merge_scan(parts) if len(parts) <= LONG else self.merge_heap(parts)).tobytes()
        if len(word) <= LONG:
            if len(self.cache) >= CACHE_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[word] = found
        return found

    def plain(self, text: str) -> list[str]:
        """Words of a text without special tokens. White space only separates
        words, so turning its runs into single spaces would change nothing."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letters one by one: no word-final form of sigma
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        return self.words.findall(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = []
        pieces = self.marks.split(text) if self.marks else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(array("i", [self.special[piece]]).tobytes())
                continue
            words = self.plain(piece)
            found = list(map(self.cache.get, words))
            if None in found:
                word, get = self.word, self.cache.get
                found = [f if f is not None else (get(w) or word(w)) for f, w in zip(found, words)]
            out += found
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by one space, as a vocabulary without a decoder step
        does; ids without a token are skipped."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        found = self.tokens[ids].tolist()
        return " ".join(found if None not in found else [t for t in found if t is not None])


_codecs: dict[int, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def encode(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None
) -> DataFrame:
    """(id, ids array<int>) of every whole text and, if `decoded_col` is
    given, the text that its ids decode to (in the same worker: the vocabulary
    is held once per task). The vocabulary file is read on the driver (fixed
    size) and travels with the task."""
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                coded = [own.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, coded)]) // 4
                flat = np.frombuffer(b"".join(coded), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                columns = {"id": part.column(0), "ids": lists}
                if decoded_col is not None:
                    columns["decoded"] = decode_lists(own, lists)
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if decoded_col is None:
        return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnsRenamed({"id": id_col, "decoded": decoded_col})


def decode_lists(own: Codec, ids: pa.ListArray) -> pa.Array:
    """Texts of the id lists; a null list has equal offsets and gives ''.
    Nothing is turned into Python integers."""
    ends, flat = ids.offsets.to_numpy().tolist(), ids.values.to_numpy(zero_copy_only=False)
    texts = (
        pa.array([own.decode(flat[a:b]) for a, b in zip(ends[at : at + SLICE], ends[at + 1 : at + 1 + SLICE])], pa.string())
        for at in range(0, len(ids), SLICE)
    )
    return pa.concat_arrays([pa.array([], pa.string()), *texts])


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` plus the decoded text of its id lists (null list: empty text)."""
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()

    @F.arrow_udf(StringType())
    def run(ids: pa.Array) -> pa.Array:
        return decode_lists(codec(vocabulary), ids)

    return encoded.withColumn(out_col, run(F.col(ids_col)))
