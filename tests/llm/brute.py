"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=35):
    """rows: list of (id, text) -> multiset of (id, n_words, n_removed, kept_sha256)."""
    split = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[j : j + window]) for _, w in split for j in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_groups(rows, n=5, percent=75):
    """rows with distinct ids -> {id: (n_shingles, component)}."""
    sets = {i: shingles(t, n) for i, t in rows}
    where, shared, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        shared.update((a, b) for a in ids for b in ids if a < b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    return (*counts, sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed
