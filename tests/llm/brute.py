"""Plain-Python versions of the contracts, and small odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

WORDS = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_documents(n: int = 120, seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, extra): nulls, empty and long
    texts, copies, repeated lines, odd white space, a hot source."""
    rng = random.Random(seed)
    vocab = {
        "en": "the cat sat on a mat while rain fell over old town houses".split(),
        "de": "der hund lief über die straße und bellte laut am morgen".split(),
        "fr": "le garçon mange une pomme près de la fenêtre été hiver".split(),
    }
    hot = "This very common line is everywhere  "
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        lines = [" ".join(rng.choices(vocab[lang], k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice([hot, "\t" + hot.upper(), hot.lower() + "\r"]))
        rows.append((i, "\n".join(lines), lang if i % 5 else None, "hot" if i % 3 else f"s{i % 4}", len(lines), i))
    for k, i in enumerate(range(n, n + 20)):
        rows.append((i, rows[7][1], "en", "hot", 0, k))
    odd = [None, "", " ", "\n", "\n\n", "12345 !!", "ß", "a" * 3000, "x " * 4000, "Ünïcode Σίσυφος ΟΔΟΣ \x1c \x85   z",
           "token <|endoftext|> <|startoftext|>x 's 'LL don't", "ﬁ é İ 漢字 🙂🙂 힣", "0123456789\n 0123456789 \n012345678"]
    for k, text in enumerate(odd):
        rows.append((n + 100 + k, text, None if k % 2 else "en", None if k % 3 else "hot", None, k))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int"


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def line_dedup(rows: list[tuple]) -> dict[int, tuple]:
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders: dict[str, set] = {}
    split = {r[0]: (r[1] or "").split("\n") for r in rows}
    for doc, lines in split.items():
        for line in lines:
            holders.setdefault(line.strip(blanks).translate(lower), set()).add(doc)
    out = {}
    for doc, lines in split.items():
        kept = []
        for line in lines:
            key = line.strip(blanks).translate(lower)
            if len(key) < 10 or len(holders[key]) < 2 or min(holders[key]) == doc:
                kept.append(line)
        out[doc] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def targets(rows: list[tuple]) -> dict:
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORDS.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            return sizes, target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return sizes, target


def spans(text: str | None) -> list[tuple]:
    """Base secret spans (kind, start, end) by the contract's own patterns."""
    text = text or ""
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 16:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m.group()) >= 32:
            out.append((m.start(), 2, "hex", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def components(nodes: list, edges: list[tuple]) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def simhash(text: str | None, k: int = 4) -> int:
    import xxhash

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = WORDS.findall((text or "").translate(lower))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows: list[tuple]) -> dict[int, tuple]:
    fps = {r[0]: simhash(r[1]) for r in rows}
    ids = sorted(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    comp = components(ids, edges)
    return {i: (f"{fps[i]:016x}", comp[i]) for i in ids}


def conversation(rows: list[tuple]) -> tuple:
    """rows: (turn, role, text) of one conversation."""
    first = lambda x: (x is not None, x if x is not None else 0)
    rows = sorted(rows, key=lambda r: (first(r[0]), (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or "")))
    turns = "".join(f"{r[1] or ''}\n{r[2] or ''}\n" for r in rows)
    loss = "".join(r[2] or "" for r in rows if r[1] == "assistant")
    return len(rows), sha(turns), len(loss), sha(loss)


def language_scorer(labelled: list[tuple[str, str]]):
    """Word-first backoff by plain dictionaries, all counts kept: text -> {label: share}, or {} for a text without letters."""
    import math
    from collections import Counter

    letters = re.compile(r"[^\W\d_]+")

    def grams(word: str, n: int) -> list[str]:
        padded = word if n == 1 else f" {word} "
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    labels = sorted({label for _, label in labelled})
    counts = {(k, label): Counter() for k in range(6) for label in labels}
    for text, label in labelled:
        for word in letters.findall(text.lower()):
            counts[0, label][word] += 1
            for k in range(1, 6):
                counts[k, label].update(grams(word, k))
    items = {k: set().union(*(counts[k, label] for label in labels)) for k in range(6)}
    total = {key: sum(c.values()) + 0.5 * (len(items[key[0]]) + 1) for key, c in counts.items()}

    def log_frequency(k: int, item: str, label: str) -> float:
        return math.log((counts[k, label][item] + 0.5) / total[k, label])

    def word_score(word: str, label: str) -> float:
        if word in items[0]:
            return log_frequency(0, word, label)
        for k in (5, 4, 3, 2, 1):
            known = [g for g in grams(word, k) if g in items[k]]
            if known:
                return sum(log_frequency(k, g, label) for g in known) / len(known)
        return 0.0

    def shares(text: str | None) -> dict[str, float]:
        if not any(map(str.isalpha, text or "")):
            return {}
        sums = {label: sum(word_score(w, label) for w in letters.findall(text.lower())) for label in labels}
        odds = {label: math.exp(s - max(sums.values())) for label, s in sums.items()}
        return {label: x / sum(odds.values()) for label, x in odds.items()}

    return shares
