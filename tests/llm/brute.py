"""Plain versions of the text operators, for comparison."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text, k=3):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    """Index of the first member of each index's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def without_repeats(texts, window=35):
    """(words, removed, kept text) of each text."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def targets(sizes, most=3):
    """Target of each source from its size."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[n] for n in capped)
        free = sum(weight[n] for n in names if n not in capped)
        out = {n: most * sizes[n] if n in capped else left * weight[n] / free for n in names}
        more = {n for n in names if n not in capped and out[n] > most * sizes[n]}
        if not more:
            return out
        capped |= more


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else float(a == b)


def nearest(ids, vectors, query, k=5):
    ok = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if query not in ok:
        return []
    v = np.array([vectors[i] for i in ok], dtype=float)
    q = np.array(vectors[query], dtype=float)
    score = v @ q / (np.sqrt((v * v).sum(1)) * np.sqrt(q @ q))
    order = sorted((-round(s, 12), ids[i]) for s, i in zip(score, ok, strict=True) if ids[i] != ids[query])
    return [i for _, i in order[:k]]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    """The damage of conversation rows (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        c, t = (" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                      "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    starts = "".join(r[:1] or " " for _, r, _ in rows)
    illegal = sum(starts[i:i + 2] not in ("su", "ua", "au") for i in range(len(starts) - 1))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for (_, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        extra, after = 3 if fault == "truncated" else 0, best
        best = {s: (after[s][0] + 4, "D" + after[s][1]) for s in legal}
        if fault not in ("blank", "duplicate"):
            for s in legal:
                x = role[:1]
                ways = [best[s]]
                if x and x in legal[s]:
                    ways.append((after[x][0] + extra, "K" + after[x][1]))
                for to in set(legal[s]) & set("ua"):
                    ways.append((after[to][0] + extra + 3, "R" + after[to][1]))
                best[s] = min(ways)
        for _ in range(3):
            best = {s: min([best[s], *((best[to][0] + 3, "I" + best[to][1]) for to in set(legal[s]) & set("ua"))])
                    for s in legal}
    cost, audit = best[""]
    lines, state, left = [], "", iter(rows)
    for letter in audit:
        to = next(iter(set(legal[state]) & set("ua")))
        name = {"u": "user", "a": "assistant"}[to]
        if letter == "I":
            lines.append(f"{name}:")
            state = to
            continue
        _, role, text = next(left)
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = role[:1]
        elif letter == "R":
            lines.append(f"{name}:{text}")
            state = to
    counts = Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def whitened(rows, k=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} of (vec_id, vector) rows, one row per id."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    whole = {i: tuple(int(np.floor(256 * float(c))) for c in v) for i, v in rows}
    fit = np.array(sorted(set(whole.values())), dtype=np.int64)
    n, total = len(fit), fit.sum(axis=0)
    cov = (fit - total / n).T @ (fit - total / n) / n
    e, basis = np.linalg.eigh(cov)
    e, basis = e[::-1], basis[:, ::-1]
    return {(i, c + 1): (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total, strict=True)),
                         float((np.array(x) - total / n) @ basis[:, c] / np.sqrt(e[c])), float(e[c] / np.trace(cov)))
            for i, x in whole.items() for c in range(k)}


def shingle_set(text, k=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_classes(rows, percent=80):
    """Counter of (doc_id, n_shingles, component_id) of (doc_id, text) rows, ids not null."""
    found = [shingle_set(t) for _, t in rows]
    up, holders = list(range(len(rows))), {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(found):
        both = Counter(j for g in s for j in holders.get(g, ()))
        for j, o in both.items():
            if 100 * o >= percent * (len(s) + len(found[j]) - o):
                up[root(i)] = root(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(found[i]), least[root(i)]) for i, (d, _) in enumerate(rows))
