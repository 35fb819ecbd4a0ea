"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def space_words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = space_words(text, True)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def near(docs, width=3, percent=85):
    """{doc_id: (n_shingles, component)} of unique, non-null ids."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(docs, min_docs=3, min_chars=20):
    """[(doc_id, n_lines, n_dropped, kept text)] per row; rows are documents, a null id ranks lowest."""
    rank = lambda i: (i is not None, i or 0)
    keys = lambda t: [x.strip(BLANKS).translate(LOWER) for x in (t or "").split("\n")]
    holders = defaultdict(list)
    for i, t in docs:
        for k in set(keys(t)):
            if len(k) >= min_chars:
                holders[k].append(rank(i))
    drop = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x, k in zip(ls, keys(t)) if not (k in drop and rank(i) != drop[k])]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def repetition(text):
    """The base counts and shares of one text."""
    text = text or ""
    w = space_words(text)
    n, total = len(w), sum(map(len, w))
    out = {"n_words": n, "word_chars": total, "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, repeated, chars, worded = set(), 0, 0, 0
    for line in text.split("\n"):
        own = space_words(line)
        if own:
            worded += 1
            if line in seen:
                repeated, chars = repeated + 1, chars + sum(map(len, own))
            seen.add(line)
    out |= {"n_dup_lines": repeated, "dup_line_share": repeated / max(worded, 1), "dup_line_char_share": chars / max(total, 1)}
    for k in range(2, 11):
        grams = [tuple(w[j : j + k]) for j in range(n - k + 1)]
        count = Counter(grams)
        if k <= 4:
            out[f"top_{k}_share"] = min(1, max([c * sum(map(len, g)) for g, c in count.items() if c > 1] or [0]) / max(total, 1))
        inside = {p for j, g in enumerate(grams) if count[g] > 1 for p in range(j, j + k)}
        if k == 3:
            out["n_repeat_words"] = len(inside)
        if k >= 5:
            out[f"dup_{k}_share"] = sum(len(w[p]) for p in inside) / max(total, 1)
    return out


def contamination(text, items, width=13):
    """(n_words, n_hit, sorted item ids, contaminated); items are (id, text)."""
    w = alnum_words(text)
    hit, found = set(), set()
    for item, other in items:
        o = alnum_words(other)
        size = min(len(o), width)
        grams = {tuple(o[j : j + size]) for j in range(len(o) - size + 1)} if o else set()
        for j in range(len(w) - size + 1 if o else 0):
            if tuple(w[j : j + size]) in grams:
                hit.update(range(j, j + size))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def targets(sizes, weights=(5, 2, 1)):
    """{source: target} by the contract's rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in held)
        open_ = [s for s in order if s not in held]
        fair = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if fair[s] >= 2 * sizes[s]}
        if not over:
            return fair | {s: float(2 * sizes[s]) for s in held}
        held |= over


def taken(docs, goals, seed=17):
    """{(doc_id, source, size): sorted takes} by laying each source's shuffled documents out twice."""
    by = defaultdict(list)
    for i, text, s in docs:
        key = str(seed) if i is None else f"{seed}:{i}"
        by[s].append((hashlib.md5(key.encode()).hexdigest(), i is not None, i or 0, len(space_words(text)), i))
    out = defaultdict(list)
    for s, rows in by.items():
        at, whole = 0, sum(r[3] for r in rows)
        goal = min(int(goals[s] + 0.5), 2 * whole)
        for _, _, _, size, i in sorted(rows, key=lambda r: r[:4]):
            got = sum(max(0, min(goal - at - k * whole, size)) for k in (0, 1))
            out[(i, s, size)].append(got)
            at += size
    return {k: sorted(v) for k, v in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whitened(vectors, components=16):
    """(n, deviations, whitened, explained) of whole-number vectors by numpy's own eigenvectors."""
    import numpy as np

    x = np.array(vectors, np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ q / np.sqrt(values), values / np.trace(cov)


def audit(docs, labels):
    """Rows of the filter audit: docs are (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    from itertools import permutations

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, part in docs:
        t = t or ""
        w = space_words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        seen.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {s[0] for s in seen}:
            left = [s for s in seen if s[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                fall = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                only = sum(s[1] == {f} for s in seen if s[0] == part)
                out[part, order, step] = (len(left), len(fall), sum(f in s[1] for s in gone), only, sum(s[2] for s in fall), sum(s[3] for s in fall))
                total[part, f] += len(fall)
                gone += fall
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


class KatzPlain:
    """Katz backoff over pairs, word by word."""

    def __init__(self, texts, k=5):
        self.rows = [[*space_words(t, True), "\n"] for t in texts]
        self.word = Counter(w for r in self.rows for w in r)
        self.pair = Counter((a, b) for r in self.rows for a, b in zip(["\0", *r], r))
        self.total, self.size = sum(self.word.values()), len(self.word)
        self.after = defaultdict(dict)
        for (a, b), c in self.pair.items():
            self.after[a][b] = c
        self.d1, self.d2 = self.cuts(self.word, k), self.cuts(self.pair, k)
        free = sum(c - self.cut(c, self.d1) for c in self.word.values())
        self.whole = self.total + (free == 0)
        self.unknown = 1 - sum(self.cut(c, self.d1) for c in self.word.values()) / self.whole if self.total else 1.0

    @staticmethod
    def cuts(counter, k):
        n = Counter(counter.values())
        for top in range(k, 0, -1):
            if all(n[r] for r in range(1, top + 2)):
                a = (top + 1) * n[top + 1] / n[1]
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, top + 1)} if a < 1 else {1: 0}
                if all(0 < x <= 1 for x in d.values()) and d[1] < 1:
                    return d
        return {}

    @staticmethod
    def cut(c, d):
        return c * d.get(c, 1)

    def one(self, w):
        return self.cut(self.word[w], self.d1) / self.whole if w in self.word else self.unknown

    def prob(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.one(w)
        few = any(c in self.d2 for c in seen.values())
        whole = sum(seen.values()) + (not few)
        if w in seen:
            return self.cut(seen[w], self.d2) / whole
        left = 1 - sum(self.cut(c, self.d2) for c in seen.values()) / whole
        return left / (1 - sum(self.one(x) for x in seen)) * self.one(w)

    def score(self, text):
        import math

        r = [*space_words(text, True), "\n"]
        base = sum(math.log10((self.word[w] + 1) / (self.total + self.size + 1)) for w in r)
        return len(r), sum(w in self.word for w in r), base, sum(math.log10(self.prob(a, b)) for a, b in zip(["\0", *r], r))
