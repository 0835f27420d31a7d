"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

The fixed patterns give the base spans (assign, access, hex). Novelty adds
`novel` spans: a run of 8 or more token characters with a sensitive word in
it or near it on either side is compressed together with the text around it
by a compressor primed with identifiers common in code; the extra bytes it
costs over the surrounding text alone are its novelty. Sensitive context
holds for all tokens that follow each other with only blanks, line ends,
quotes, dots or backslashes between, so for the lines of a key and the parts
of a bearer token. A string whose marginal bytes per byte reach `min_novelty`
cannot be rebuilt from code and identifiers and is reported, unless a base
span covers part of it, or it is ordinary: a date, a number of 10 digits at
most, a name or path put together from words, or a string without a digit most
of whose letter trigrams occur in words of the dictionary or of the same text.
Copies of a string do not explain each other: it is measured without them,
save for earlier ones outside sensitive context, which make it part of the
code.

Defined cases: null text is the empty text. Spans are in code points, end
exclusive, ordered by start, then assign, access, hex, novel. Whole texts
are scanned. Repeated rows get equal spans; other columns stay out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run fails as a whole, a longer one matches as a whole
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: `name=` ahead of a value, and what may stand between tokens of one value.
NAME = re.compile(r"(?:[A-Za-z][A-Za-z0-9_-]*=+)+(?=[A-Za-z0-9+/_-]{8})")
GAP = re.compile(r"""[\s"'`.\\]*""")
#: Whole words or ends of them, so that neither "secretary" nor "author" counts.
SENSITIVE = re.compile(
    r"(?:passw(?:or)?d?|pwd|secret|token|api.?key|credential|auth(?:orization|entication)?|bearer|private|signature|access.?key)s?(?!(?-i:[a-z]))",
    re.IGNORECASE | re.ASCII,
)
SENSITIVE_WORDS = ("passw", "pwd", "secret", "token", "api", "credential", "auth", "bearer", "private", "signature", "access")
#: Copies of the candidate itself in the text after it, and a sensitive word that stands right ahead of one of them.
COPY = "\udc00"
AFTER = re.compile(rf"""(?:{SENSITIVE.pattern})(?!\w*["']?[\x20:=]*["']?{COPY})""", re.IGNORECASE | re.ASCII)
#: Characters on either side of a candidate in which a sensitive word counts, and characters of text on either side that it is measured against.
NEAR, AROUND = 48, 256
#: What source code and configuration are full of, as the compressor's dictionary.
IDENTIFIERS = (
    "abstract access account action address admin application argument array assert async authorization await base base64 "
    "boolean buffer bucket build bytes callback certificate char class client collection column command config connection "
    "const constructor container content context controller cookie create credentials database date default define delete "
    "description development directory document domain double element email endpoint environment error event example "
    "exception execute expires export extends factory false field file filter final float format function generate get "
    "handler hash header hostname http https identifier implements import index initialize input instance integer "
    "interface internal javascript json key language length library list local location login manager message method "
    "middleware model module name namespace network number object option order output package parameter parent parse "
    "password path payload permission placeholder policy private process production profile project property protected "
    "protocol provider public query queue reference refresh register release remote repository request require resource "
    "response result return role route sample schema script secret security select sequence server service session "
    "settings signature source static status storage stream string struct style subscription super switch system table "
    "target template test this thread throw timeout timestamp title token transaction true type undefined update upload "
    "username uuid validate value variable version void website window workspace 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "-----BEGIN RSA PRIVATE KEY----- -----BEGIN CERTIFICATE----- -----END PRIVATE KEY----- -----END CERTIFICATE-----"
)
#: Dates with or without a time, ranges of years and short numbers.
NUMERIC = re.compile(r"(?:19|20)\d\d[-/][01]?\d[-/][0-3]?\d(?:T[0-2]\d)?|(?:19|20)\d\d[01]\d[0-3]\d(?:T\d{4,6}Z?)?|(?:19|20)\d\d-(?:19|20)?\d\d|\d{1,10}")
#: What names and paths are put together from: words in one case or with a capital, and numbers.
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
VOWELS = frozenset("aeiouy")
#: Words that stand alone, in lower case.
PLAIN = re.compile(r"(?<![\w+/=])[a-z]{3,}(?![\w+/=])")


def trigrams(word: str) -> set[str]:
    return {word[i : i + 3] for i in range(len(word) - 2)}


def words_by_trigram(words: set[str]) -> Counter[str]:
    return Counter(g for w in words for g in trigrams(w))


KNOWN = frozenset(words_by_trigram({w for w in PLAIN.findall(IDENTIFIERS) if len(w) < 26}))


def is_word(own: str, words: set[str], holding: Counter[str]) -> bool:
    """Whether a token without a digit is made like words: most of its letter
    trigrams occur in the dictionary or in other words of the text."""
    parts = [x.lower() for x in re.findall("[A-Za-z]+", own)]
    mine = [x[i : i + 3] for x in parts for i in range(len(x) - 2)]
    in_own = words_by_trigram(words & set(parts))
    return not parts or sum(g in KNOWN or holding[g] > in_own[g] for g in mine) > 0.6 * len(mine)


def is_ordinary(own: str) -> bool:
    """Whether a token is a date or short number, or a name or path of
    several pieces: most of its characters stand in pieces of 4 or more
    letters that can be spoken, and its numbers have 4 digits at most."""
    if NUMERIC.fullmatch(own):
        return True
    pieces = PIECE.findall(own)
    spoken = sum(len(x) for x in pieces if len(x) >= 4 and x.isalpha() and can_be_spoken(x.lower()))
    return len(pieces) > 1 and spoken > 0.5 * sum(map(len, pieces)) and all(len(x) <= 4 for x in pieces if x.isdigit())


def can_be_spoken(word: str) -> bool:
    """Vowels and consonants alternate as in words: no four consonants and no
    three vowels in a row, and a known trigram among its own."""
    row, last = 0, None
    for c in word:
        kind = c in VOWELS
        row = row + 1 if kind == last else 1
        last = kind
        if row > (2 if kind else 3):
            return False
    return not VOWELS.isdisjoint(word) and not KNOWN.isdisjoint(trigrams(word))


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns; `low` is the text in lower case."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Novelty:
    def __init__(self, min_novelty: float):
        self.min_novelty = min_novelty
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False)

    def score(self, text: str, start: int, end: int, blank_before: bool = False, run: tuple[int, int] | None = None) -> float:
        """Marginal compressed bytes of text[start:end] per byte of it, against
        the text around it without its later copies, or without any; if it
        stands in a `run` of tokens, at least those against the text around
        the run, as parts of one value do not explain each other."""
        own = text[start:end]
        first, last = run or (start, end)
        far = AROUND + len(own)
        before, after = text[max(0, first - far) : first], text[last : last + far].replace(own, "")
        if blank_before:
            before = before.replace(own, "")
        around, added = (before[-AROUND:] + after[:AROUND]).encode(), own.encode()
        compress = self.compressor.compress
        found = (len(compress(around + added)) - len(compress(around))) / len(added)
        return found if run is None or run == (start, end) else max(found, self.score(text, start, end, blank_before))

    def spans(self, text: str, low: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not any(w in low for w in SENSITIVE_WORDS):
            return []
        out = []
        words = None
        plain: dict[str, int] = {}  # end of the last copy outside sensitive context
        for run in token_runs(text):
            sensitive = any(in_sensitive_context(text, s, e) for s, e in run)
            whole: dict[int, float] = {}  # novelty of dotted values, by start
            values = dotted(text, run) if sensitive else run
            for (s, e), (a, b) in zip(run, values, strict=True):
                own = text[s:e]
                if not sensitive:
                    plain[own] = e
                    continue
                if any(s < b and a < e for a, _, b in taken) or is_ordinary(own):
                    continue
                around = run[0][0], run[-1][1]
                if self.score(text, s, e, plain.get(own, -AROUND - 1) < s - AROUND, around) < self.min_novelty:
                    if (a, b) == (s, e) or own in plain:
                        continue
                    if a not in whole:
                        whole[a] = self.score(text, a, b, True, around)
                    if whole[a] < self.min_novelty:
                        continue
                if not any(c.isdigit() for c in own):
                    if words is None:
                        words = set(PLAIN.findall(low))
                        holding = words_by_trigram(words)
                    if is_word(own, words, holding):
                        continue
                out.append((s, 3, e))
        return out


def token_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens (start, end) in runs with nothing but GAP between them."""
    run: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if run and not GAP.fullmatch(text, run[-1][1], s):
            yield run
            run = []
        if name := NAME.match(text, s, e):
            s = name.end()
        run.append((s, e))
    if run:
        yield run


def dotted(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each token of a run the value of parts with a single dot between
    them that holds it."""
    starts = [0, *(i for i in range(1, len(run)) if text[run[i - 1][1] : run[i][0]] != "."), len(run)]
    return [(run[i][0], run[j - 1][1]) for i, j in zip(starts, starts[1:]) for _ in range(i, j)]


def in_sensitive_context(text: str, start: int, end: int) -> bool:
    """Whether a sensitive word begins in the token or near it on either side;
    one that leads to another copy of the token counts for that copy only."""
    if SENSITIVE.search(text, max(0, start - NEAR), end):
        return True
    own = text[start:end]
    return bool(AFTER.search(text[end : end + NEAR + AROUND].replace(own, COPY)[:NEAR]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_novelty: float = 0.7) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every whole text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(min_novelty)
        for batch in batches:
            lists = []
            for t in batch.column(1):
                text = t.as_py() or ""
                low = text.lower()
                found = base_spans(text, low)
                found += novelty.spans(text, low, found)
                lists.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(span))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)
