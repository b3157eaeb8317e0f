"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(x: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x)


def substring_dedup(rows, length=35):
    """rows: (doc_id, text). (doc_id, n_words, n_removed, kept_sha256) of each."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def near_dedup(rows, percent=85, k=5):
    """(doc_id, n_shingles, component_id, kept)."""
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)]


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontamination(rows, items, window=13):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = ITEM_WORD.findall(lower(t or ""))
        for a in range(max(0, len(w) - window) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w = ITEM_WORD.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit[a : a + n] = [True] * n
                    found |= windows[x]
        n = sum(hit)
        out.append((d, len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    return out


def quality_measures(rows):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        repeat = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)))
    return out


def pii_base(rows):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256), straight from the contract's patterns."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, x):
        digits = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(x if x < 10 else x - 9 for x in twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    out = []
    for d, t in rows:
        spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if good(k, m[0])]
        n = Counter(k for _, _, k, _ in spans)
        out.append((d, *[n[k] for k in kinds], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))))
    return out
