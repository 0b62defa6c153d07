"""The corpus pipeline, stage by stage, on a small table."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import brute_lines, brute_sets, roots

from helpers import EDGES, documents, texts

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = documents(spark, [(900, None), (901, ""), (902, "123 !!")])
    docs = docs.unionByName(odd).withColumn("size", F.lit(1))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "minhash_dedup", "source_mixing", "packing"]

    told = steps["language_id"](spark, docs, SF)
    assert told.columns == corpus_pipeline.COLUMNS
    gone = docs.join(told, "doc_id", "left_anti")
    assert {900, 901, 902} <= {r.doc_id for r in gone.collect()} and gone.count() <= 3 + 0.02 * docs.count()

    told = told.cache()
    rows = [(r.doc_id, r.text) for r in told.collect()]
    lined = steps["line_dedup"](spark, told, SF).cache()
    own = [(r.doc_id, r.text) for r in lined.collect()]
    assert Counter(own) == Counter((i, t) for i, _, _, t in brute_lines(rows))
    assert lined.where("n_chars <> char_length(text)").count() == 0

    sets = {i: brute_sets(t) for i, t in own}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = {i for i, root in roots(edges, sets).items() if i == root}
    single = steps["minhash_dedup"](spark, lined, SF).cache()
    assert {r.doc_id for r in single.collect()} == want and single.columns == corpus_pipeline.COLUMNS

    mixed = steps["source_mixing"](spark, single, SF).cache()
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    assert mixed.join(single, "doc_id", "left_anti").count() == 0

    packed = steps["packing"](spark, mixed, SF)
    pieces = {r.doc_id: (r.tokens, r.own) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.max("doc_tokens").alias("own")).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert pieces == {i: (pieces[i][1] * n, pieces[i][1]) for i, n in times.items()}


def test_near_duplicates_from_four_fifths_on(spark):
    """Of 100 words, two scattered ones changed leave 86 of 106 shingles, three 81 of 111."""
    rows = []
    for i in range(6):
        own = [f"w{i}x{k}" for k in range(100)]
        rows.append((10 * i, " ".join(own)))
        own[20] = own[70] = "changed"
        rows.append((10 * i + 1, " ".join(own)))
        own[45] = "changed"
        rows.append((10 * i + 5, " ".join(own[:70] + [f"v{i}"] + own[71:])))
    sets = {i: brute_sets(t) for i, t in rows}
    shares = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert any(0.8 <= s < 0.85 for s in shares.values())
    found = roots([e for e, s in shares.items() if s >= 0.8], sets)
    got = corpus_pipeline.minhash_dedup(spark, documents(spark, rows), SF)
    assert {r.doc_id for r in got.collect()} == {i for i, root in found.items() if i == root}


def test_empty_and_odd_tables(spark):
    rows = [*EDGES, *[(i, t, "en", "a", 1) for i, t in enumerate(texts(4, 12, 5, 60))]]
    for docs in (documents(spark, rows), documents(spark, rows).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
            docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_documents_left_without_a_word_add_nothing_to_the_mix(spark):
    lines = [f"line {i} with words enough to be compared by their key" for i in range(6)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(lines[:3])), (4, "\n".join([*lines, "one line of its own here"]))]
    docs = documents(spark, [(i, t, "en", "a", len(t)) for i, t in rows])
    lined = corpus_pipeline.line_dedup(spark, docs, SF)
    left = {r.doc_id: r.text for r in lined.collect()}
    assert {i for i, t in left.items() if t.strip()} == {1, 4} and set(left) == {1, 2, 3, 4}
    mixed = corpus_pipeline.source_mixing(spark, corpus_pipeline.minhash_dedup(spark, lined, SF), SF)
    assert {r.doc_id for r in mixed.collect()} <= {1, 4} and mixed.columns == corpus_pipeline.COLUMNS
    assert mixed.count() > 0
