"""What the operators must give, computed the plain way on small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, item ids) per row."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for at in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[at : at + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if (key := tuple(words[at : at + size])) in windows:
                    found |= windows[key]
                    hit |= set(range(at, at + size))
        out.append((doc, len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text):
    """(start, kind number, end) of the base rules."""
    out = []
    for number, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def fingerprint(text, shingle=4) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(ids, prints, radius=4):
    """The least id each row reaches; rows may share an id."""
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(least.get(root(i), own), own)
    return [least.get(root(i)) for i in range(len(ids))]


def removed(texts, length):
    """(n_bytes, n_removed, n_spans, kept bytes) per text."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out
