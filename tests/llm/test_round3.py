import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import filter_audit, katz, whitening

from . import brute

SF = "/root/testdata/sf0.001"


def fold(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds


# --- 11 whitening ----------------------------------------------------------------------------------

def agree(rows, vectors, ids, components=16):
    """Rows of the digest against numpy, up to each component's sign."""
    n, deviation, z, share = brute.whitened(vectors, components)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == set(ids)
    k = z.shape[1]
    table = np.array([[r.whitened for r in sorted(got[i], key=lambda r: r.component)[:k]] for i in ids])
    sign = np.sign((table * z).sum(axis=0))
    assert np.allclose(table * sign, z, atol=1e-7)
    for i, d in zip(ids, deviation):
        assert {r.deviation for r in got[i]} == {d} and {r.n for r in got[i]} == {n}
    assert np.allclose([r.explained for r in sorted(got[ids[0]], key=lambda r: r.component)[:k]], share, rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in rows)


def test_whitening_matches_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = table.collect()
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r.embedding] for r in data]
    rows = whitening.whitening_digest(table).collect()
    assert len(rows) == 16 * len(data) and {r.component for r in rows} == set(range(1, 17))
    agree(rows, x, [r.vec_id for r in data])


def test_whitening_odd_vectors(spark):
    draw = random.Random(3)
    good = [(i, [draw.uniform(-3, 3) * (j + 1) for j in range(5)]) for i in range(60)]
    same = [(1000 + i, good[0][1]) for i in range(200)]
    odd = [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [float("nan")] * 5), (5, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (6, [1.0, 2.0])]
    odd = [(2000 + i, v) for i, v in odd]
    table = spark.createDataFrame([(i, v, "kept", 7) for i, v in good + same + odd], "vec_id long, embedding array<double>, whitened string, `__x` int").repartition(7)
    rows = whitening.whitening_digest(table).collect()
    kept = good + same
    agree(rows, [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept], [i for i, _ in kept], 5)
    wide, fit = whitening.whiten(table.drop("whitened", "__x"), components=2)
    assert wide.columns == ["vec_id", "embedding", "whitened"] and {len(r.whitened) for r in wide.collect()} == {2} and fit.n == 60
    again, _ = whitening.whiten(table.drop("whitened", "__x").where("vec_id < 3"), fit)
    assert again.count() == 3
    for few in (table.limit(0), table.where("vec_id >= 1000 and vec_id < 2000"), table.where("vec_id >= 2000").where("vec_id < 2006")):
        assert whitening.whitening_digest(few).count() == 0
    line = spark.createDataFrame([(None, [float(i), 2.0 * i]) for i in range(9)] + [(1, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whitening_digest(line).collect()} == {1}


@pytest.mark.parametrize("kind", ["random", "repeated", "diagonal", "block", "zero", "one"])
def test_leading_components(kind):
    draw = np.random.default_rng(5)
    a = draw.normal(size=(90, 30))
    m = {"random": a.T @ a, "repeated": np.eye(30) * 3, "diagonal": np.diag(np.arange(30.0)), "block": np.kron(np.array([[2.0, 1], [1, 2]]), np.eye(15)),
         "zero": np.zeros((4, 4)), "one": np.array([[2.5]])}[kind]
    values, q = whitening.leading_components(m, 12)
    want = np.linalg.eigvalsh(m)[::-1][:12]
    size = max(abs(want).max(), 1e-300)
    assert np.allclose(values, want, atol=1e-13 * size)
    assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-12) and np.abs(m @ q - q * values).max() <= 1e-12 * size


def test_deviation_is_exact_or_an_error():
    fit = whitening.Whitening(3, [2, 5], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1 << 29, 3], [-(1 << 29), 0], [7, 7]])
    assert fit.deviation(x).tolist() == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, (2, 5))) for r in x]
    with pytest.raises(OverflowError):
        fit.deviation(np.array([[1 << 40, 0]]))


# --- 12 filter audit -------------------------------------------------------------------------------

def as_rows(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_filter_audit_matches_one_by_one(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = brute.audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert as_rows(filter_audit.filter_digest(docs, labels)) == want


def test_filter_audit_odd_rows(spark):
    draw = random.Random(11)
    some = lambda n, pool: " ".join(draw.choice(pool) for _ in range(n))
    pool = [f"w{i}" for i in range(400)]
    texts = ["", None, " ", "\n\t", "A" * 50, "#", some(99, pool), " " + some(100, pool) + "\n", some(150, pool[:5]), some(120, pool) + " $", some(5000, pool), "É Á " * 60, "Abc def " * 80, some(130, ["Up", "UP", "low"])]
    rows = [(draw.randrange(40), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(400)] + [(None, t, "en") for t in texts[:4]] + [(5, texts[7], "en")] * 3 + [(99, texts[7], "en")] * 50
    marks = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(30)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, failed string, n int, part int").repartition(5)
    labels = spark.createDataFrame([(*m, 0) for m in marks], "doc_id long, quality int, toxic int, good int")
    assert as_rows(filter_audit.filter_digest(docs, labels)) == brute.audit(rows, marks)
    assert filter_audit.filter_digest(docs.limit(0), labels).count() == 0
    assert as_rows(filter_audit.filter_digest(docs, labels.limit(0))) == brute.audit(rows, [])


def test_audit_of_other_filters(spark):
    failures = spark.createDataFrame([("p", 1, True, False, 4), ("p", 3, False, False, 2), ("p", 0, False, True, 5)], "part string, failed int, good boolean, toxic boolean, n long")
    got = {(r.filter_order, r.filter): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(failures, "xy").collect()}
    assert got == {("xy", "x"): (5, 6, 0, 10), ("xy", "y"): (5, 0, 2, 2), ("yx", "y"): (9, 2, 0, 2), ("yx", "x"): (5, 4, 2, 10)}


# --- 13 language model -----------------------------------------------------------------------------

def scored(model, rows):
    """Rows of the scores against the plain model."""
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in model), key=lambda x: x[:5])
    assert len(got) == len(rows)
    return got


def against_plain(spark_rows, rows):
    plain = brute.KatzPlain([t for i, t in rows if fold(i, 7) != 2])
    want = sorted(((i is not None, i or 0, *plain.score(t)) for i, t in rows), key=lambda x: (x[:4], round(x[4], 6)))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in spark_rows), key=lambda x: (x[:4], round(x[4], 6)))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert all(r.held_out == (fold(r.doc_id, 7) == 2) and r.train_tokens == plain.total for r in spark_rows)
    return plain


def test_katz_matches_plain(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(katz, "BLOCK_BYTES", 50_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = katz.katz_digest(docs.repartition(3)).collect()
    plain = against_plain(got, rows)
    words = [*plain.word, "never seen"]
    for h in ["\0", "never seen", *list(plain.after)[:12]]:
        assert abs(sum(plain.prob(h, w) for w in words) - 1) < 1e-9
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_katz_odd_rows(spark, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 700)
    texts = ["", None, " \n ", "a", "A b", "a b a b", "É é", "x " * 3000, "new words only here", " ".join(draw.choice("abcdefgh") for _ in range(60))]
    rows = [(draw.randrange(60), draw.choice(texts)) for _ in range(150)] + [(None, t) for t in texts[:6]] + [(9, "a b")] * 4
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, block int, held string").repartition(6)
    against_plain(katz.katz_digest(docs).collect(), rows)
    assert katz.katz_digest(docs.limit(0)).count() == 0
    out = next(i for i in range(100) if fold(i, 7) == 2)
    alone = spark.createDataFrame([(out, "no training at all")], "doc_id long, text string")
    only = katz.katz_digest(alone).collect()[0]
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score, only.score) == (5, 0, 0, 0.0, 0.0)


def test_katz_hot_words_go_by_pairs(spark, monkeypatch):
    """One word and one pair hold most tokens; many partitions; other folds and id types."""
    monkeypatch.setattr(katz, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(katz, "PAIRS_PER_PARTITION", 50)
    draw = random.Random(2)
    rows = [(f"d{i}", " ".join(w for _ in range(40) for w in ("the", draw.choice(["same", "same", f"w{draw.randrange(300)}"])))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    model = katz.katz_scores(docs, F.col("doc_id").endswith("7"))
    plain = brute.KatzPlain([t for i, t in rows if not i.endswith("7")])
    got = {r.doc_id: r for r in model.scores.collect()}
    for i, t in rows:
        assert np.allclose((got[i].base_score, got[i].score), plain.score(t)[2:], rtol=1e-9)
    assert model.vocabulary.orderBy("number").first().word == "the" and model.pairs.count() > 8
    name = {r.number: r.word for r in model.vocabulary.collect()} | {model.words.size: "\0"}
    assert {(name[r.h], name[r.w]): r.r for r in katz.pair_rows(model.pairs).collect()} == plain.pair
    model.staging.remove()


def test_discounts():
    assert katz.discounts([0, 0, 0, 0, 0, 0]).tolist() == [0.0] and katz.discounts([10, 0, 5]).tolist() == [0.0]
    d = katz.discounts([1000, 400, 200, 120, 80, 50])
    assert len(d) == 6 and all(0 < x <= 1 for x in d[1:])


# --- 9 licenses, by compression --------------------------------------------------------------------

def plain_align(want, words, cost):
    """The cheapest alignment of ``want`` with any stretch of ``words``, by trying every stretch."""
    best = None
    for a in range(len(words) + 1):
        for b in range(a, len(words) + 1):
            stretch = words[a:b]
            table = [[0] * (len(stretch) + 1) for _ in range(len(want) + 1)]
            for i in range(len(want) + 1):
                for j in range(len(stretch) + 1):
                    if i or j:
                        options = []
                        if i:
                            options.append(table[i - 1][j] + cost[i - 1])
                        if j:
                            options.append(table[i][j - 1] + 1)
                        if i and j and want[i - 1] == stretch[j - 1]:
                            options.append(table[i - 1][j - 1])
                        table[i][j] = min(options)
            value = table[-1][-1]
            best = value if best is None else min(best, value)
    return best


def test_alignment_is_the_cheapest():
    from tallyspark.llm import licenses

    draw = random.Random(12)
    for _ in range(150):
        want = [draw.choice("abcd") for _ in range(draw.randrange(1, 6))]
        words = [draw.choice("abcde") for _ in range(draw.randrange(1, 9))]
        cost = [draw.choice([2, 5]) for _ in want]
        held, there = licenses.align(want, words, cost)
        assert [want[i] for i in held] == [words[j] for j in there] and held == sorted(held) and there == sorted(there)
        between = there[-1] - there[0] + 1 - len(there) if there else 0
        assert sum(c for i, c in enumerate(cost) if i not in held) + between == plain_align(want, words, cost)


def test_reductions_rank_the_templates(spark, monkeypatch):
    from tallyspark.llm import licenses

    draw = random.Random(5)
    filler = " ".join(draw.choice(["tree", "river", "stone", "cloud", "paper"]) for _ in range(60))
    cases = {1: ("This part is GPLv3 code", "GPL-3.0"), 2: ("It is MIT-licensed code", "MIT"), 3: ("licensed under the EUPL", "EUPL-1.2"), 4: ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0"),
             5: ("GNU GPL v2 or later", "GPL-2.0"), 6: ("Released under the MIT License.", "MIT"), 7: (licenses.TEMPLATES["Apache-2.0"], "Apache-2.0")}
    rows = [(i, f"{filler} {t} {filler}") for i, (t, _) in cases.items()] + [(50, f"{filler} a copyright question {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.license_blocks(docs).collect()
    for i, (text, name) in cases.items():
        assert {r.license for r in got if r.doc_id == i and r.confirmed} == {name}, (text, [r for r in got if r.doc_id == i])
    assert [(r.license, r.confirmed) for r in got if r.doc_id == 50 and r.license is None] or all(r.reduction > 0 and not r.confirmed for r in got if r.doc_id == 50)

    scanner = licenses.Scanner(licenses.TEMPLATES)
    words = licenses._words("permission to copy this software under the terms of some license text is hereby granted to nobody")
    nearest = scanner.judge(words)
    gains = scanner.gains(words)
    assert nearest[0][0] == scanner.templates[max(range(len(gains)), key=lambda k: gains[k])][0] and nearest[0][1] == max(gains) > 0
    both = licenses._words(" ".join([licenses.TEMPLATES["MPL-2.0"], licenses.TEMPLATES["ISC"]]))
    order = [r[1] for r in scanner.judge(both)]
    assert order == sorted(order, reverse=True) and len(order) == 2
    monkeypatch.setattr(scanner, "gains", lambda words: [0.0] * len(scanner.templates))  # a compressor that sees nothing
    assert scanner.judge(words) == [(None, 0.0, [], [], False, [])]


# --- 7 mixing, through its schedule ----------------------------------------------------------------

def test_every_prefix_of_the_schedule_holds_the_weights(spark):
    from tallyspark.llm import mixing

    quotas = [900, 300, 150, 40, 0, 1]
    shares = spark.createDataFrame(list(enumerate(quotas)), "source_no long, quota long")
    slots = sorted(mixing.schedule(spark, shares, chunk=64).collect(), key=lambda r: r.slot)
    assert sorted((r.source_no, r.rank) for r in slots) == [(i, k) for i, q in enumerate(quotas) for k in range(q)]
    seen, total = [0] * len(quotas), sum(quotas)
    for n, r in enumerate(slots, 1):
        assert r.rank == seen[r.source_no]
        seen[r.source_no] += 1
        assert all(abs(seen[i] - n * q / total) <= 2 + np.log2(total) / 2 for i, q in enumerate(quotas)), (n, seen)


def test_mix_keeps_columns_of_any_name(spark):
    from tallyspark.llm import mixing

    rows = [(i, " ".join(["w"] * (i % 700)), ["a", "b", None][i % 3], i, f"q{i}", 0.5, "n", "r") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, goal long, quota string, weight double, source_no string, rank string")
    mixed, slots, pieces = mixing.mix(docs)
    got = {r.doc_id: r for r in mixed.collect()}
    assert all((got[i].goal, got[i].quota, got[i].weight, got[i].source_no, got[i]["rank"]) == (i, f"q{i}", 0.5, "n", "r") for i in range(120))
    number = {(r.source_no, r.rank): r.slot for r in slots.collect()}
    of = {}
    for r in pieces.collect():
        of.setdefault(r.doc_id, []).append(number[r.source_no, r.rank])
    import hashlib

    for i, r in got.items():
        s = sorted(of.get(i, []))
        assert (r.n_slots, r.first_slot) == (len(s), s[0] if s else None)
        assert r.slots_md5 == (hashlib.md5(",".join(map(str, s)).encode()).hexdigest() if s else None)
    assert set(mixing.with_texts(docs).columns) >= {"goal", "quota", "weight", "source_no", "rank", "text", "slots_md5"}


# --- 8 decontamination of large and odd test sets --------------------------------------------------

def test_items_that_share_a_passage_cost_its_occurrences(spark):
    from tallyspark.llm import decontaminate
    import pyarrow as pa

    draw = random.Random(9)
    preamble = " ".join(f"common{k}" for k in range(20))
    items = [(i, (preamble + " " if i % 3 == 0 else "") + " ".join(f"w{draw.randrange(10**6)}" for _ in range(15))) for i in range(600)]
    tests = decontaminate.TestSet([i for i, _ in items], [t for _, t in items], 13)
    part = next(decontaminate.slices(pa.array([f"{preamble} " * 50])))
    count, word, window = decontaminate.match_slice(part, tests)
    assert len(word) == 50 * 8  # not times the 200 items
    docs = spark.createDataFrame([(1, f"x {preamble} y " * 50, {"k": [1]}, (2, "s")), (1, f"x {preamble} y " * 50, {"k": [1]}, (2, "s")), (2, "nothing here", None, None), (3, items[1][1], {}, None), (None, items[3][1], {}, None)],
                                 "doc_id long, text string, extra map<string,array<int>>, `__key` struct<a:int,b:string>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute.contamination(t, items) for i, t in [(1, f"x {preamble} y " * 50), (2, "nothing here"), (3, items[1][1]), (None, items[3][1])]}
    for block in (2_000_000, 2_000, 500):
        got = decontaminate.find_matches(docs, bench, block_words=block)
        rows = got.collect()
        assert len(rows) == 5 and {r.doc_id: (r.n_words, r.n_hit, list(r.items), r.contaminated) for r in rows} == want
        assert all(r.extra == {"k": [1]} and r["__key"].a == 2 for r in rows if r.doc_id == 1)
        assert {len(r.matches) for r in rows if r.doc_id == 1} == {50 * 200}
        fewer = decontaminate.find_matches(docs, bench, block_words=block, matches=False).collect()
        assert all(r.matches is None for r in fewer) and {r.doc_id: r.n_hit for r in fewer} == {i: w[1] for i, w in want.items()}


def test_pipeline_stage_with_a_test_set_of_two_blocks(spark, monkeypatch):
    import corpus_pipeline
    from tallyspark.llm import decontaminate

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect())
    plain = decontaminate.find_matches
    monkeypatch.setattr(decontaminate, "find_matches", lambda d, b, w=13, **k: plain(d, b, w, block_words=4_000, **k))
    out = corpus_pipeline.drop_contaminated(spark, docs.withColumn("__key", F.lit(1)), SF)
    assert sorted(r.doc_id for r in out.collect()) == one
