"""Plain second versions of what has no SQL: quality scores, toxicity fit, license alignment, secret candidates."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import licenses, quality, secrets, toxicity, trees

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- 3 quality ---------------------------------------------------------------------------------

def plain_statistics(text):
    data = (text or "").encode()
    kinds = [quality.CLASSES[k] for k in (quality.CLASS_OF[b] for b in data)]
    letter = lambda b: chr(b).isalpha() if b < 0x80 else True
    words = WORD.findall(data)
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    mean = sum(map(len, words)) / n
    triples = Counter(zip(low, low[1:], low[2:]))
    inside = {i + k for i, t in enumerate(zip(low, low[1:], low[2:])) if triples[t] > 1 for k in range(3)}
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    m = max(len(lines), 1)
    return [*[kinds.count(c) / max(len(data), 1) for c in quality.CLASSES], math.log1p(len(words)), mean,
            math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0)), sum(len(w) <= 3 for w in words) / n,
            sum(not any(map(letter, w)) for w in words) / n, sum(letter(w[-1]) for w in words) / n, len(set(low)) / n, len(inside) / n,
            math.log1p(len(lines)), len(words) / m, sum(WORD.findall(x)[-1][-1:] in b".?" for x in lines) / m, (len(lines) - len(set(lines))) / m]


def walk(forest, tree, row, node=0, level=0):
    if level == forest.depth:
        return forest.value[tree][node]
    if row[forest.feature[tree][node]] <= forest.threshold[tree][node]:
        return walk(forest, tree, row, 2 * node + 1, level + 1)
    return walk(forest, tree, row, 2 * node + 2, level + 1)


def test_forest_sums_match_a_walk_of_each_tree():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 6, (400, 5)).astype(float)  # many ties at the thresholds
    y = ((x[:, 0] > 2) ^ (x[:, 3] < 2)).astype(float)
    for forest in (trees.boost(x, y, trees=7, depth=3)[0], trees.random_forest(x, y, trees=5, depth=4)):
        want = [sum(walk(forest, t, row) for t in range(len(forest.value))) for row in x]
        assert np.allclose(forest.sums(x), want, rtol=0, atol=1e-12)


def test_quality_scores_match_plain_statistics_and_walks(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t\n"), (-4, "one\nOne\none\nÄß 日本 x?\r\n" * 3), (-5, "word " * 30_000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(rows, model).collect()
    assert len(got) == rows.count()
    for r in got:
        x = plain_statistics(r.text)
        margin = model.start + sum(walk(model.forest, t, x) for t in range(len(model.forest.value)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9), r.doc_id


# --- 10 toxicity -------------------------------------------------------------------------------

def plain_nnpu(positive, unlabelled, prior):
    """Weights by word and the constant, by loops over texts."""
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = (Counter(int(w) for s in sets for w in s) for sets in (positive, unlabelled))
    ratio = {}
    for w in sorted(in_p.keys() | in_u.keys()):
        if max(in_p[w], in_u[w]) >= toxicity.MIN_TEXTS:
            share = (in_p[w] + in_u[w]) / (n_p + n_u)
            z = (in_p[w] / n_p - in_u[w] / n_u) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
            if abs(z) >= toxicity.MIN_Z:
                ratio[w] = math.log((in_p[w] + 0.5) / (n_p + 1)) - math.log((in_u[w] + 0.5) / (n_u + 1))
    names = [*ratio, None]
    value, first, second = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    texts = [(s, True) for s in positive] + [(s, False) for s in unlabelled]
    for step in range(1, toxicity.STEPS + 1):
        s = [1 / (1 + math.exp(-(value[None] + sum(value[int(w)] * ratio[int(w)] for w in t if int(w) in ratio)))) for t, _ in texts]
        negative = sum(s[n_p:]) / n_u - prior * sum(s[:n_p]) / n_p
        gradient = {w: toxicity.SHRINK * value[w] for w in ratio} | {None: 0.0}
        for (t, confirmed), p in zip(texts, s):
            slope = p * (1 - p)
            if negative >= 0:  # d/df of prior * l(f) on confirmed texts, and of the negative part
                g = -2 * prior * slope / n_p if confirmed else slope / n_u
            else:  # away from overfitting: up the negative part
                g = prior * slope / n_p if confirmed else -slope / n_u
            gradient[None] += g
            for w in map(int, t):
                if w in ratio:
                    gradient[w] += g * ratio[w]
        for w in names:
            first[w] = 0.9 * first[w] + 0.1 * gradient[w]
            second[w] = 0.999 * second[w] + 0.001 * gradient[w] ** 2
            value[w] -= toxicity.RATE * (first[w] / (1 - 0.9**step)) / (math.sqrt(second[w] / (1 - 0.999**step)) + 1e-8)
    return {w: value[w] * ratio[w] for w in ratio}, value[None]


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_toxicity_fit_matches_plain_loops(prior, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    draw = random.Random(3)
    sets = [[np.array(sorted({draw.randrange(60) if draw.random() < 0.5 else 100 + draw.randrange(20) + 30 * bad for _ in range(25)}), np.uint32)
             for _ in range(many)] for bad, many in ((1, 40), (0, 90))]
    model = toxicity.fit_nnpu(*sets, prior)
    weights, constant = plain_nnpu(*sets, prior)
    assert len(weights) > 10 and sorted(weights) == model.used.tolist()
    assert model.constant == pytest.approx(constant, abs=1e-6)
    assert np.allclose(model.weights, [weights[w] for w in sorted(weights)], rtol=0, atol=1e-6)
    for s in sets[0] + sets[1]:
        score = model.scores(s, np.array([0, len(s)]))[0]
        assert score == pytest.approx(1 / (1 + math.exp(-constant - sum(weights.get(int(w), 0) for w in s))), abs=1e-6)


# --- 9 licenses --------------------------------------------------------------------------------

def cheapest(want, words, cost):
    """The least cost over every stretch and every choice of what of ``want`` is held there, in order."""
    best = sum(cost)
    for k in range(1, len(want) + 1):
        for held in itertools.combinations(range(len(want)), k):
            for there in itertools.combinations(range(len(words)), k):
                if all(want[i] == words[j] for i, j in zip(held, there)):
                    best = min(best, sum(c for i, c in enumerate(cost) if i not in held) + there[-1] - there[0] + 1 - k)
    return best


def test_alignment_is_the_cheapest_of_every_stretch():
    draw = random.Random(11)
    for _ in range(150):
        want, words = ([draw.choice("abcd") for _ in range(draw.randrange(1, n))] for n in (6, 9))
        cost = [draw.choice([1, 2, 5]) for _ in want]
        held, there = licenses.align(want, words, cost)
        assert held == sorted(set(held)) and there == sorted(set(there)) and [want[i] for i in held] == [words[j] for j in there]
        paid = sum(c for i, c in enumerate(cost) if i not in held) + (there[-1] - there[0] + 1 - len(there) if there else 0)
        assert paid == cheapest(want, words, cost), (want, words, cost)


# --- 5 secrets ---------------------------------------------------------------------------------

def plain_dictionary(texts):
    pairs, pieces = np.zeros(secrets.PAIR_SLOTS, np.int64), np.zeros(secrets.PIECE_SLOTS, np.int64)
    for n, table in ((2, pairs), (4, pieces)):
        grams = Counter(low[i : i + n] for t in texts if t for low in [t.lower()] for i in range(len(low) - n + 1))
        for gram, many in grams.items():
            if gram.isalpha():
                table[secrets._grams(gram, n, len(table))[0]] += many
    return secrets.Dictionary(pairs, pieces)


def plain_runs(text):
    """Stretches of a key's characters, one character at a time."""
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    out, begin = [], None
    for i, c in enumerate(text + "\n"):
        if c in allowed:
            begin = i if begin is None else begin
        elif begin is not None:
            run = text[begin:i]
            mixed = any(c.isdigit() for c in run) or re.search("[a-z][A-Z]|[A-Z][A-Z]+[a-z]", run[1:])
            if i - begin >= secrets.SHORTEST and mixed:
                out.append((begin, i))
            begin = None
    return out


def test_secret_candidates_and_features_match_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    odd = [(-1, None, None), (-2, None, ""), (-3, "s", "Ä" * 40 + " Zx9" + "q" * 20), (-4, "s", "abcdefghijklmnopqrstuvwxyz " * 4), (-5, "s", "aB3" * 30_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = {r.doc_id: r for r in docs.collect()}
    words = secrets.fit_dictionary(docs)
    plain = plain_dictionary([r.text for r in texts.values()])
    assert np.array_equal(words.pairs, plain.pairs) and np.array_equal(words.pieces, plain.pieces) and np.array_equal(words.known, plain.known)
    got = {}
    for r in secrets._featured(docs, words).collect():
        got.setdefault(r.doc_id, {})[(r.begin, r.until)] = r.x
    assert set(got[-3]) == set(plain_runs(texts[-3].text)) and set(got[-5]) == {(0, 90_000)} and -4 not in got
    bare = 0
    for doc, r in texts.items():
        found = got.get(doc, {})
        low = (r.text or "").lower()
        if r.text and not any(p in low for p in secrets.NAME_PARTS) and not any(p in r.text for p in secrets.FORMAT_PARTS) and "=" not in r.text:
            assert set(found) == set(plain_runs(r.text)), doc  # no name, no format: runs alone
            bare += 1
        for (a, b), x in found.items():
            run = r.text[a:b]
            share = lambda test: sum(map(test, run)) / len(run)
            seen = [run.lower()[i : i + 4] for i in range(len(run) - 3)]
            known = sum(p.isalpha() and bool(plain.known[secrets._grams(p, 4, secrets.PIECE_SLOTS)[0]]) for p in seen)
            want = {"length": len(run), "digits": share(str.isdigit), "upper": share(str.isupper), "lower": share(str.islower), "hex": share(lambda c: c in "0123456789abcdefABCDEF"),
                    "distinct": len(set(run)) / len(run), "covered": known / max(len(run) - 3, 1), "slashes": run.count("/"),
                    "entropy": -sum(run.count(c) / len(run) * math.log2(run.count(c) / len(run)) for c in set(run))}
            assert {k: x[secrets.FEATURES.index(k)] for k in want} == pytest.approx(want), (doc, a, b)
    assert bare > 20
