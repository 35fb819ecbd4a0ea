import math

import pyarrow as pa

import corpus_pipeline
from tallyspark.llm import quality, tokens
from tallyspark.llm.staging import Staging

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_score(model, text):
    """One text through the trees, node by node."""
    x = quality.statistics(next(tokens.slices(pa.array([text or ""]))))[0] if text else [0.0] * len(quality.FEATURES)
    margin = model.start
    for feature, threshold, value in zip(model.forest.feature, model.forest.threshold, model.forest.value):
        node = 0
        for _ in range(model.forest.depth):
            node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
        margin += value[node]
    return 1 / (1 + math.exp(-margin))


def test_every_stage_matches_brute_force_on_its_own_input(spark):
    staging = Staging(spark, "pipeline-test")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = staging.table(name, stage(spark, docs, SF))
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {i for i, r in before.items() if plain_score(model, r.text) >= 0.5}
            assert set(after) == want and 0.5 * len(before) < len(want) < len(before)
        elif name == "line_dedup":
            want = {i: text for i, _, _, text in brute.lines([(r.doc_id, r.text) for r in before.values()])}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            groups = brute.near([(r.doc_id, r.text) for r in before.values()], 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if c == i} and len(after) < len(before)
        elif name == "decontaminate":
            assert set(after) == {i for i, r in before.items() if not brute.contamination(r.text, items)[3]} and len(after) < len(before)
        else:
            rows = [(r.doc_id, r.text, r.source) for r in before.values()]
            sizes = {}
            for _, t, s in rows:
                sizes[s] = sizes.get(s, 0) + len(brute.space_words(t))
            goals = brute.targets(sizes)
            want = {k[0]: v[0] for k, v in brute.taken(rows, goals).items() if v[0] > 0}
            got, words = {}, {}
            for r in out.collect():
                n = len(brute.space_words(r.text))
                assert n == r.until - r.begin and brute.space_words(r.text) == brute.space_words(before[r.doc_id].text)[r.begin : r.until]
                assert (r.source, r.lang, r.n_chars) == (before[r.doc_id].source, before[r.doc_id].lang, len(r.text))
                got[r.doc_id] = got.get(r.doc_id, 0) + n
                words[r.source] = words.get(r.source, 0) + n
            assert got == want and words == {s: min(int(g + 0.5), 2 * sizes[s]) for s, g in goals.items()}
            assert out.columns == [*COLUMNS, "slot", "at", "begin", "until"]
        if name != "mix":
            assert out.columns == COLUMNS
            assert name == "line_dedup" or all(r == before[i] for i, r in after.items())
        docs = out
    last = sorted(map(str, docs.collect()))
    assert last == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_odd_documents_pass_every_stage(spark):
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "no id at all", "en", "a", 3), (4, "x " * 5000, "en", "b", 1), (4, "x " * 5000, "en", "b", 1), (5, "one line\n" * 40, "en", None, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert out.columns[:5] == COLUMNS, name
            assert len(got) <= docs.count() or name == "mix"  # a row per stretch there
            assert {r.doc_id for r in got} <= {1, 2, None, 4, 5}
        assert stage is corpus_pipeline.mix_sources
        assert corpus_pipeline.keep_quality(spark, docs, SF).count() <= docs.count()
