"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from test_operators import DOCS, table, texts, words  # noqa: F401


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_classifiers(spark, name):
    import importlib

    op = importlib.import_module(f"ledgerlake.llm.{name}")
    rng = random.Random(5)
    label = {"toxicity": "toxic", "quality": "quality"}[name]
    rows = [(i, words(rng, 20) + (". you vile scoundrel" if i % 2 else ""), "en", "s", 1, 1, 0.5, 7) for i in range(80)]
    odd = [(900, "vile scoundrel. " + words(rng, 150_000), None, None, None, None, None, None), (901, rows[1][1], None, None, None, None, None, None), (901, rows[1][1], None, None, None, None, None, None), (None, rows[1][1], None, None, None, None, None, None)]
    docs = spark.createDataFrame([*rows, *odd], DOCS).withColumnsRenamed({"source": "label", "lang": "_text"}).withColumn(label, F.lit(3))
    known = spark.createDataFrame([(i, i % 2, "x") for i in range(80)] + [(i, i % 2, "x") for i in range(10)], f"doc_id long, {label} int, text string")
    got = op.score(docs, op.fit(docs, known)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (901, None)}) == 1
    empty = docs.limit(0)
    assert op.score(empty, op.fit(empty, known)).count() == 0
    assert {0 <= r.score <= 1 for r in op.score(docs, op.fit(empty, known)).collect()} == {True}


def test_language_id(spark):
    from ledgerlake.llm.langid import fit, identified_rows, identify

    rows = [(1, "blorg snirf", "aa"), (1, "blorg snirf", "aa"), (2, "alita oreno", "bb"), (None, "blorg", None), (3, "ulima", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("zz"))
    got = identify(docs, fit(docs)).collect()
    assert len(got) == 5 and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    empty = docs.limit(0)
    assert identify(empty, fit(empty)).count() == 0 and identified_rows(empty, fit(docs)).count() == 0
    assert identified_rows(docs, fit(docs)).columns == docs.columns


def test_ambiguous_languages_can_be_left_out(spark):
    from ledgerlake.llm.langid import fit, identified_rows, identify

    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("blorg snirf", "aa"), ("alita oreno", "bb")] * 20)] + [(100, "q", None), (101, "5", None)], "doc_id long, text string, lang string")
    model = fit(docs)
    unsure = {r.doc_id for r in identify(docs, model).where("ambiguous").collect()}
    assert unsure == {100}
    assert {r.doc_id for r in identified_rows(docs, model, ambiguous=False).collect()} == set(range(40))


def test_sampling_is_bounded_by_class_and_skips_long_texts(spark):
    from ledgerlake.llm.sampling import stratified

    rng = random.Random(6)
    rows = [(i, words(rng, 50), "a" if i % 10 else "b") for i in range(400)] + [(1000, "x " * 50_000, "a"), (1001, "x " * 50_000, "b"), (7, None, "b"), (7, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got, counts = stratified(docs, "label", 1000, most_bytes=20_000)
    again, _ = stratified(docs.repartition(7), "label", 1000, most_bytes=20_000)
    assert got == again and counts == {"a": 361, "b": 43}
    for k in "ab":
        size = sum(len(t) for t, y in got if y == k)
        assert 5000 < size <= 10_000
    assert all(len(t) <= 10_000 // 16 for t, _ in got)


def test_mixing(spark):
    from ledgerlake.llm.mixing import mix_sources

    docs = spark.createDataFrame([(None, "a b c", None, 1), (None, "a b c", None, 2), (1, "x " * 30_000, "s", 3), (2, None, "s", 4)], "doc_id long, text string, source string, size long")
    docs = docs.withColumns({"h": F.lit(1), "target": F.lit(2), "_h": F.lit(3), "_shard": F.lit(4), "copies": F.lit(5)})
    got = mix_sources(docs, keep=("size", "target")).collect()
    assert len(got) == 4 and sorted(r._keep_size for r in got) == [1, 2, 3, 4] and {r._keep_target for r in got} == {2}
    assert sorted(r.size for r in got) == [0, 3, 3, 30_000]


def test_url_filter_repeated_pages_and_null_html(spark):
    from ledgerlake.llm.urlfilter import filter_urls

    link = '<link rel="canonical" href="http://bad.net/">'
    pages = spark.createDataFrame([(1, "http://a.org/", None), (1, "http://a.org/", link), (1, "http://a.org/", None), (None, None, link), (2, "", "")], "page_id long, url string, html string")
    got = filter_urls(pages.withColumns({"rule": F.lit(1), "node": F.lit(2), "root": F.lit(3)}), [("block", "net", "/")]).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "block")] * 3 + [("2", "allow"), ("None", "allow")]


@pytest.mark.parametrize("parts", [1, 2, 5, 13])
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_suffix_dedup_repeated_rows_and_copies(spark, parts, threshold):
    from ledgerlake.llm.suffixdedup import dedup_substrings

    rng = random.Random(14)
    a, b = words(rng, 120), words(rng, 60)
    rows = [(i, a) for i in (5, 1, 9, 1, 7, 9)] + [(2, b + " " + a[100:400])] * 2 + [(i, b + str(i)) for i in range(20, 60)] + [(None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.xxhash64("doc_id", "text"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted((-1 if r.doc_id is None else r.doc_id, [tuple(x) for x in r.spans]) for r in dedup_substrings(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    whole, part = [(0, len(a))], [(len(b) + 1, len(b) + 301)]
    assert got == [(-1, []), (1, whole), (1, whole), (2, part), (2, part), (5, whole), (7, whole), (9, whole), (9, whole), *((i, [(0, len(b) + (i % 10 > 0))]) for i in range(20, 60))]


def test_decontamination_of_clashing_columns_and_copies(spark):
    from ledgerlake.llm.decontaminate import clean_rows, decontaminate

    rng = random.Random(15)
    item, other = words(rng, 40), words(rng, 40)
    rows = [(i, item if i % 3 == 0 else other + f" {i}") for i in range(30)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"t1": F.lit(1), "_t1": F.lit(2), "size": F.lit(3), "i": F.lit(4), "items": F.lit(5)})
    bench = spark.createDataFrame([(1, item), (2, words(rng, 3)), (None, None)], "item_id long, text string")
    for size in (1 << 20, 10):
        kept = clean_rows(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and kept.count() == 22 and kept.where("doc_id % 3 = 0").count() == 0
        assert decontaminate(docs, bench, block_bytes=size).where("n_hit = 40").count() == 10


def test_pipeline(spark, tmp_path, texts):  # noqa: F811
    import corpus_pipeline as cp

    docs = table(spark, texts, [(None, texts[8], "en", "s", None, 1, 0.1, 1), (8, texts[8], "en", "s", 1, 1, 0.1, 1), (5, "five other words " * 9, None, None, None, None, None, None)])
    docs = docs.withColumns({"_dedup": F.lit(1), "_gone": F.lit(2), "_row": F.lit(3), "_h": F.lit(4)})
    spark.createDataFrame([(1, texts[7])], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    held = docs
    for _, stage in cp.STAGES[:4]:
        held = stage(spark, held, f"{tmp_path}/a").cache()
        assert held.columns == docs.columns
    ids = [r.doc_id for r in held.collect()]
    assert ids.count(8) == 1 and ids.count(None) == 1 and ids.count(5) == 1 and 7 not in ids
    cp.STAGES[4][1](spark, held, f"{tmp_path}/a").collect()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    plain.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0


def test_strips_packed_by_ranges_give_counts_and_pairs():
    import itertools
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from ledgerlake.llm import neardup as nd

    rng = np.random.RandomState(7)
    own = {n: rng.choice(2000, rng.randint(0, 12), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in range(300)}
    for name in (int, lambda n: f"n{n:03}"):
        batches = [pa.record_batch({"node": pa.array([name(n) for n in part]), "e": pa.array([np.sort(own[n]).astype(">u8").tobytes() for n in part], pa.binary())}) for part in np.array_split(np.arange(300), 7)]
        kind = batches[0].schema.field("node").type
        rows = sorted(pa.Table.from_batches(nd.strips(batches, 5, 2)).to_pylist(), key=lambda r: r["part"])
        schema = pa.schema([("part", pa.int64()), ("x", pa.list_(pa.int64())), ("node", pa.list_(kind)), ("often", pa.list_(pa.int64()))])
        held, nd.MANY = nd.MANY, 50
        try:
            found = pa.Table.from_batches(nd.one_range(pa.Table.from_pylist(rows, schema).to_batches(), kind, 3, 2)).to_pylist()
        finally:
            nd.MANY = held
        by = {}
        for n, x in own.items():
            for v in x.tolist():
                by.setdefault(v, []).append(name(n))
        few = [sorted(v) for v in by.values() if len(v) <= 2]
        assert len({(r["a"], r["b"]) for r in found if r["slot"] is None}) > 5
        assert {(r["a"], r["b"]) for r in found if r["slot"] is None} == {p for v in few for p in itertools.combinations(v, 2)}
        counted = sorted((r for r in found if r["slot"] is not None), key=lambda r: r["slot"])
        listed = pa.schema([("slot", pa.int64()), ("nodes", pa.list_(kind)), ("counts", pa.list_(pa.int64()))])
        total = pa.Table.from_batches(nd.added(pa.Table.from_pylist(counted, listed).to_batches(), kind)).to_pylist()
        assert {r["node"]: r["own"] for r in total} == Counter(n for v in few for n in v)
        assert len(total) == len({r["node"] for r in total})
