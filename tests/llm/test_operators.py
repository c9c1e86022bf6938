"""The ten operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, _id long"


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 0.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, n) for n in (3, 4, 5, 12, 13, 40, 80, 120, 200, 3000)]
    near = base[8].split()
    near[50] = "changed"
    lines = ["\n".join(words(rng, 6) for _ in range(8)) for _ in range(4)]
    shared = "\n".join(lines[0].split("\n")[2:6])
    return [*base, None, "", "   ", "...", base[7], base[7], " ".join(near), *lines, lines[1] + "\n" + shared, shared + "\nend", base[6] + " " + base[6]]


def test_line_dedup_matches_brute_force(spark, texts):
    from ledgerlake.llm.linededup import dedup_lines

    docs = table(spark, texts)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert dedup_lines(docs).columns == [*docs.columns, "_dedup"]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        if t is None:
            want[i] = None
            continue
        l = t.split("\n")
        gone = set()
        for p in range(len(l) - 2):
            w = tuple(l[p : p + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(l) if k not in gone)
    assert {i: r.text for i, r in got.items()} == want
    assert any(r._dedup.n_removed for r in got.values())


def test_line_dedup_repeated_rows_and_empty_table(spark):
    from ledgerlake.llm.linededup import dedup_lines

    same = (1, "a\nb\nc", "en", "s", 5, 1, 0.1, 1)
    docs = spark.createDataFrame([same, same, (None, "a\nb\nc\nd", None, None, None, None, None, None)], DOCS)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in dedup_lines(docs).collect())
    assert got == [(-1, "a\nb\nc\nd"), (1, ""), (1, "")]
    assert dedup_lines(docs.limit(0)).count() == 0


def grams(text, window=13):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    return w


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_matches_brute_force(spark, texts, block_bytes):
    from ledgerlake.llm.decontaminate import decontaminate

    t9 = texts[9].split()
    items = [(5, " ".join(t9[100:130]).upper()), (10, texts[0]), (2, ""), (3, None), (7, " ".join(t9[500:513])), (None, "zz yy"), (5, " ".join(t9[100:130])), (8, texts[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate(docs, bench, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        w = grams(t)
        hit, found = set(), set()
        for k, x in items:
            v = grams(x)
            size = min(13, len(v))
            wins = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)} if size else set()
            for j in range(len(w) - size + 1):
                if size and tuple(w[j : j + size]) in wins:
                    hit |= set(range(j, j + size))
                    found.add("" if k is None else str(k))
        assert got[i] == (len(w), len(hit), sorted(found)), i
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_judges_each_row_on_its_own_with_several_blocks(spark):
    from ledgerlake.llm.decontaminate import decontaminate

    rng = random.Random(12)
    a, b, c = (words(rng, 20) for _ in range(3))
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (1, b), (1, c), (None, a), (None, c), (2, a + " " + b)], "doc_id long, text string").coalesce(1)
    one, two = (sorted(map(str, decontaminate(docs, bench, block_bytes=size).collect())) for size in (1 << 20, 10))
    assert len(one) == 6 and one == two


def test_mixing(spark, texts):
    from ledgerlake.llm.mixing import apportion, mix_sources
    from ledgerlake.llm.mixing import targets as table_of_targets

    def targets(sizes):
        held = spark.createDataFrame(list(sizes.items()), "source string, size long")
        return {r.source: r.target for r in table_of_targets(held).collect()}

    docs = table(spark, [*texts, *texts])
    got = mix_sources(docs, shard_words=3000, block_words=16).collect()
    assert len(got) == 2 * len(texts)
    again = mix_sources(docs.repartition(5), shard_words=3000, block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    for taken, target in by.values():
        assert abs(taken - target) <= 0.05 * target + 60
    assert mix_sources(docs.limit(0)).count() == 0
    assert targets({"a": 10, "b": 0, None: 90}) == {"a": 30.0, "b": 0.0, None: 70.0}
    votes = np.array([53, 24, 23])
    slow = [0, 0, 0]
    for _ in range(11):
        k = max(range(3), key=lambda j: votes[j] / (2 * slow[j] + 1))
        slow[k] += 1
    assert list(apportion(votes, 11)) == slow


def slow_mix(spark, docs, shard_words, block_words, seed=17, least_blocks=64):
    """(id, text, source) -> sorted words taken of its rows: the mix word by word in plain Python."""
    from ledgerlake.llm.kernels import mix as finalizer

    rows = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("h"), F.xxhash64(F.lit(seed), "source").alias("home")).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    order = [*sorted(s for s in size if s is not None), *([None] if None in size else [])]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = {}, sum(size.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 3 * size[s]}
        goal |= {s: 3.0 * size[s] for s in full} if full else {s: unit * weight[s] for s in open_}
        left -= sum(3 * size[s] for s in full)
        open_ = open_ - full if full else set()
    shards = max(1, -(-sum(size.values()) // shard_words))
    streams = {}
    for r in sorted(rows, key=lambda r: r.h):
        own = min(shards, max(1, size[r.source] // (block_words * least_blocks)))
        shard = (r.home % shards + r.h % own) % shards
        streams.setdefault(shard, {}).setdefault(r.source, []).extend([(r.doc_id, r.text, r.source)] * len((r.text or "").split()))
    taken = {}
    for shard, held in streams.items():
        held = {s: x for s, x in sorted(held.items(), key=lambda p: (p[0] is None, p[0] or "")) if x}
        n = {s: max(-(-len(x) // block_words), min(len(x), least_blocks)) for s, x in held.items()}
        votes = {s: n[s] * (goal[s] / size[s]) for s in held}
        seats = dict.fromkeys(held, 0)
        for _ in range(int(round(sum(votes.values())))):
            best = max(held, key=lambda s: votes[s] / (2 * seats[s] + 1))
            seats[best] += 1
        for s, x in held.items():
            quota = min(seats[s], 3 * n[s])
            with np.errstate(over="ignore"):
                rank = np.argsort(finalizer(np.arange(n[s], dtype=np.uint64) + np.uint64(zlib.crc32(f"{seed}/{shard}/{s}".encode()))), kind="stable")
            times = {b: quota // n[s] for b in range(n[s])}
            for b in rank[: quota % n[s]]:
                times[b] += 1
            at = 0
            for b in range(n[s]):
                to = at + len(x) // n[s] + (b < len(x) % n[s])
                for w in x[at:to]:
                    taken[w] = taken.get(w, 0) + times[b]
                at = to
    return taken, goal


def test_mixing_matches_brute_force(spark, texts):
    from ledgerlake.llm import mixing

    rng = random.Random(21)
    rare = [(1000 + i, w, "en", "rare", 1, 1, 0.0, 1) for i, w in enumerate(words(rng, 18).split())]
    same = [(None, "again and again", "en", "dup", 1, 1, 0.0, 1)] * 40 + [(None, None, None, None, None, None, None, None)] * 5
    big = [(2000 + i, words(rng, 300), "en", "big", 1, 1, 0.0, 1) for i in range(60)]
    docs = table(spark, texts, [*rare, *same, *big])
    want, goal = slow_mix(spark, docs, 1500, 8)
    plain = mixing.mix_sources(docs, shard_words=1500, block_words=8, keep=("text",)).collect()
    got, taken = {}, {}
    for r in plain:
        got.setdefault((r.doc_id, r._keep_text, r.source), []).append(r.taken)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - goal[r.source]) < 1e-6
    assert len(plain) == docs.count()
    assert all(sum(x) == want.get(k, 0) and max(x) - min(x) <= 1 for k, x in got.items())
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 1 for s in goal)
    held, mixing.SOURCE_BYTES = mixing.SOURCE_BYTES, 0
    try:
        salted = mixing.mix_sources(docs, shard_words=1500, block_words=8, keep=("text",)).collect()
    finally:
        mixing.SOURCE_BYTES = held
    assert sorted(map(str, salted)) == sorted(map(str, plain))


def test_url_filter_components(spark):
    from ledgerlake.llm.urlfilter import filter_urls

    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [
        (1, "http://Plain.org/x?q=1#f", None, 1),
        (2, "http://bad.net/x", "<p>", 1),
        (3, "https://alias.org/y", link("http://bad.net/x"), 1),
        (4, "http://far.org/z", '<META http-equiv="refresh" content="0; url=//alias.org/y">', 1),
        (5, "http://m.example.net/en/q", link("/en/other"), 1),
        (6, None, None, None),
        (7, "no scheme", link("rel"), 1),
        (8, "http://both.org/a", link("http://bad.net/x"), 1),
        (9, "http://sub.ok.org/fr/a", link("http://both2.org/"), 1),
        (10, "http://both2.org/", link("http://bad2.net/"), 1),
        (2, "http://bad.net/x", "<p>", 1),
        (11, "http://redirected.org/", None, 1),
    ]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host long")
    redirects = spark.createDataFrame([("http://redirected.org/", "http://x.net/"), (None, "http://y.net/")], "from_url string, to_url string")
    got = {r.page_id: r for r in filter_urls(df, rules, redirects).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == {
        1: (None, "allow"), 2: ("net/", "block"), 3: (None, "block"), 4: (None, "block"), 5: ("example.net/en/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"),
        9: ("org/fr/", "allow"), 10: (None, "allow"), 11: (None, "block"),
    }
    assert (got[1].host, got[1].path) == ("plain.org", "/x") and (got[6].host, got[6].path) == ("", "")
    assert filter_urls(df.limit(0), rules).count() == 0


def test_url_filter_takes_all_links_of_a_page(spark):
    from ledgerlake.llm.urlfilter import filter_urls

    canonical = '<link rel="canonical" href="http://{}/">'
    refresh = '<meta http-equiv="refresh" content="0; url=http://{}/">'
    pages = [
        (1, "http://a.org/", canonical.format("x.org") + canonical.format("bad.net")),
        (2, "http://b.org/", refresh.format("y.org") + refresh.format("bad.net")),
        (3, "http://c.org/", canonical.format("z.org")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in filter_urls(df, [("block", "net", "/")]).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_components_of_long_chain_and_hub(spark):
    from ledgerlake.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{x: 1000 for x in range(1000, 1100)}}


def test_suffix_dedup_matches_brute_force(spark, texts):
    from ledgerlake.llm.suffixdedup import dedup_substrings

    rng = random.Random(9)
    long = words(rng, 4000)
    more = [long, "x" * 350, long[5000:9000] + "é" * 80, "é" * 120 + words(rng, 30), long[100:250] + long[100:250], texts[7], "ab" * 49, "ab" * 50, "ab" * 51]
    docs = table(spark, [*texts, *more])
    docs = docs.unionByName(docs.where("doc_id = 8"))
    got = {}
    for r in dedup_substrings(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, [tuple(x) for x in r.spans], r.kept_sha256))
    assert len(got[8]) == 2
    seen = set()
    for i, t in enumerate([*texts, *more]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs, at = [], 0
        for flag, part in itertools.groupby(cover):
            n = len(list(part))
            if flag:
                runs.append((at, at + n))
            at += n
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        assert all(g == (len(b), runs, hashlib.sha256(kept).hexdigest()) for g in got[i]), i
    assert dedup_substrings(docs.limit(0)).count() == 0


def test_suffix_dedup_repeated_rows_in_one_partition(spark):
    from ledgerlake.llm.suffixdedup import dedup_substrings

    rng = random.Random(10)
    a, b = words(rng, 120), words(rng, 60)
    docs = spark.createDataFrame([(1, a), (1, a), (2, b + " " + a[100:400]), (2, b + " " + a[100:400])], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, [tuple(x) for x in r.spans]) for r in dedup_substrings(docs).collect())
    gone = [(len(b) + 1, len(b) + 301)]
    assert got == [(1, []), (1, []), (2, gone), (2, gone)]


def test_suffix_dedup_deals_hot_anchors_by_suffix(spark):
    import pyarrow as pa

    from ledgerlake.llm import suffixdedup as sd

    rng = random.Random(11)
    shared = words(rng, 60)
    texts = [words(rng, 40) + " " + shared + " " + words(rng, 10) for _ in range(300)]
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(7)
    plain, split = (sorted(map(str, sd.dedup_substrings(docs, most=most).collect())) for most in (1 << 20, 40))
    assert plain == split and sum("spans=[[" in x for x in split) == 299
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text")
    hot = sd.hot_anchors(rows, 100, 40)
    data = sd.string_buffers(pa.array(texts))
    assert len(hot) and set(hot.tolist()) <= {h for h, n in Counter(sd.anchors(*data)[0].tolist()).items() if n >= 40}
    seen, most = Counter(), Counter()
    for i, t in enumerate(texts):
        h, pos, _, _, _ = sd.anchors(*sd.string_buffers(pa.array([t])))
        own = pa.record_batch({"id": pa.array([i]), "t": pa.array([0]), "text": pa.array([t])})
        (z,) = sd.packed([own])
        z = pa.RecordBatch.from_arrays([*z.columns, pa.array([pos.tolist()], pa.list_(pa.int32()))], names=["id", "t", "z", "pos"])
        for keys, held in ((seen, np.zeros(0, np.uint64)), (most, hot)):
            for b in sd.stretches([z], 100, held):
                keys.update({(k, s) for k, s in zip(b["key"].to_pylist(), b["s"].to_pylist(), strict=True)})

    def kinds(keys):
        """The most different texts that share a key."""
        return max(Counter(k for k, _ in keys).values())

    assert kinds(seen) >= 200 and kinds(most) < 40


def test_suffix_dedup_keeps_all_rows_over_2_gb():
    import pyarrow as pa

    from ledgerlake.llm.suffixdedup import split_last_key

    raw = pa.py_buffer(np.zeros(1_100_000_000, np.uint8))
    held = []
    for k in (1, 2):
        s = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, 1_100_000_000], np.int32)), raw])
        held.append(pa.record_batch({"key": pa.array([k]), "s": s, "id": pa.array([k]), "t": pa.array([k]), "lo": pa.array([0]), "hi": pa.array([0])}))
    done, rest = split_last_key(held)
    assert done["key"].to_pylist() == [1] and [b["key"].to_pylist() for b in rest] == [[2]]


def test_suffix_sort():
    from ledgerlake.llm.suffixes import sort_suffixes

    rng = np.random.RandomState(1)
    for _ in range(60):
        data = rng.randint(97, 99, 400).astype(np.uint8)
        data[200:] = data[:200]
        depth = int(rng.randint(1, 80))
        starts = rng.permutation(len(data) - depth + 1)
        order, group = sort_suffixes(data, starts, depth, shallow=int(rng.choice([8, 16, 32])))
        got = [data[i : i + depth].tobytes() for i in starts[order]]
        assert got == sorted(got)
        assert all((group[i] == group[i - 1]) == (got[i] == got[i - 1]) for i in range(1, len(got)))


def test_topk_matches_brute_force(spark):
    from ledgerlake.llm.topk import search

    rng = np.random.RandomState(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 16)]) for i in range(600)]
    rows[300] = (300, rows[7][1])
    rows += [(7000, [1e30] * 16), (9001, None), (9100, [1.0, None] * 8), (9200, [float("nan")] * 16), (9300, [1.0, 2.0]), (9301, [2.0, 1.0]), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in search(df, F.col("vec_id") % 100 == 0, k=10, block=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, x in whole:
        if q % 100:
            continue
        scores = [(min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for i, y in whole if i != q and len(y) == len(x)]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:10]
        assert sorted(got.get(q, [])) == [(k + 1, i, s) for k, (s, i) in enumerate(best)], q
    assert search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def near_classes(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = grams(t)
        sets[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = sum((sets[a] & sets[b]).values())
        every = sum(sets[a].values()) + sum(sets[b].values()) - both
        if both and both >= 0.8 * every:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_match_brute_force(spark, texts):
    from ledgerlake.llm.neardup import near_duplicates

    rng = random.Random(4)
    base = words(rng, 150).split()
    group = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(150)] = rng.choice(WORDS)
        group.append(" ".join(own))
    every = [*texts, *group, *group[:20]]
    docs = table(spark, every)
    got = {r.doc_id: (r.cluster_id, r.cluster_size) for r in near_duplicates(docs).collect()}
    want = near_classes(every)
    sizes = Counter(want.values())
    assert got == {i: (c, sizes[c]) for i, c in want.items()}
    odd = spark.createDataFrame([(1, words(rng, 50)), (1, words(rng, 50)), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.cluster_id)) for r in near_duplicates(odd).collect()) == [("1", "1"), ("1", "1"), ("2", "2"), ("None", "None")]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    import pyarrow as pa

    from ledgerlake.llm import neardup as nd

    rng = random.Random(5)
    a = words(rng, 300)
    b = " ".join(a.split()[:200]) + " " + words(rng, 100)
    u, row, _, _ = nd.elements(pa.array([a, b, "one", "one two three four five " * 40]))
    sig = nd.darts(u, row, 4, 960)
    ends = np.searchsorted(row, np.arange(5))
    own = [set(u[x:y].tolist()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
    true = len(own[0] & own[1]) / len(own[0] | own[1])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.06
    assert (sig[2] != 0).all() and (sig[0] == sig[3]).mean() < 0.02


def test_dart_signatures_take_real_weights():
    from ledgerlake.llm.neardup import darts

    rng = np.random.RandomState(3)
    g = rng.randint(1, 1 << 62, 40).astype(np.uint64)
    w = rng.uniform(0.05, 3.0, (2, 40))
    sig = darts(np.concatenate([g, g]), np.repeat([0, 1], 40), 2, 2000, w.reshape(-1))
    true = np.minimum(w[0], w[1]).sum() / np.maximum(w[0], w[1]).sum()
    assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - true) < 0.04
    whole = np.ceil(w[0])
    assert (darts(g, np.zeros(40, int), 1, 200, whole) == darts(g, np.zeros(40, int), 1, 200, whole + 0.0)).all()


def test_topk_prunes_pairs_and_keeps_ties_of_very_low_scores(spark):
    from ledgerlake.llm.topk import Queries, search

    far = [-1e6] * 4
    rows = [(100, [1e6 / 1024] * 4), (5, [x / 1024 for x in far]), (3, [x / 1024 for x in far])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r.vec_id, r.score) for r in search(df, F.col("vec_id") == 100, k=1).collect()] == [(3, -4 * 10**12)]
    again = spark.createDataFrame([(100, [None, 1.0]), (100, [float("nan"), 1.0]), (100, [1.0, 1.0]), (7, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in search(again, F.col("vec_id") == 100).collect()] == [(100, 7)]
    rng = np.random.RandomState(4)
    centres = rng.normal(0, 100, (40, 32))
    x = np.floor(centres[rng.randint(0, 40, 4000)] + rng.normal(0, 4, (4000, 32)))
    q = Queries(np.arange(50), x[:50], 5)
    for at in range(0, 4000, 500):
        q.offer(np.arange(at, at + 500), x[at : at + 500])
    assert q.compared < 0.2 * q.pairs
    for r in range(50):
        exact = [(int(-(x[r] @ x[j])), j) for j in range(4000) if j != r]
        assert [(int(-s), int(v)) for v, s in zip(*q.best[r], strict=True)] == sorted(exact)[:5]


LANGS = {"aa": ["blorg", "snirf", "klept", "vron"], "bb": ["alita", "oreno", "ulima", "eposo"], "cc": ["tschk", "hwrrp", "mngzz", "pfltz"]}


def test_language_id(spark):
    from ledgerlake.llm.langid import codewords, fit, identified_rows, identify

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(LANGS[l]) for _ in range(rng.randint(1, 30))), l) for i, l in enumerate(list(LANGS) * 60)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    odd = spark.createDataFrame([(1000, None, "aa", 1.0), (1001, "", None, 1.0), (1002, "123 !?", None, 1.0), (1003, "日本", None, 1.0), (1004, "blorg " * 30000, None, 1.0)], docs.schema)
    model = fit(docs.where("doc_id % 4 <> 2").unionByName(odd))
    got = {r.doc_id: r for r in identify(docs.unionByName(odd), model).collect()}
    held = [i for i, _, _ in rows if i % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und" and got[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identified_rows(odd, model).count() == 2
    empty = fit(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}
    for n in (2, 3, 5, 6, 20):
        code = codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_toxicity_locates_sentences(spark):
    from ledgerlake.llm.toxicity import fit, score

    rng = random.Random(7)
    rows = []
    for i in range(300):
        sentences = [words(rng, 8) for _ in range(rng.randint(1, 12))]
        bad = i % 3 == 0
        if bad:
            sentences.insert(rng.randrange(len(sentences)), "you vile scoundrel " + words(rng, 3))
        rows.append((i, ". ".join(sentences) + ".", int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 9) for i, _, y in rows if i % 4 != 2] + [(None, 1, 9), (5, None, 9)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in score(docs, fit(docs, labels)).collect()}
    right = [(got[i].score >= 0.3) == bool(y) for i, _, y in rows if i % 4 == 2]
    assert np.mean(right) > 0.95
    for i, t, y in rows:
        if y and got[i].offending:
            o = max(got[i].offending, key=lambda x: x.score)
            assert "scoundrel" in t.encode()[o.start : o.end].decode()
    assert got[900].score == got[901].score < 0.3
    assert {r.score for r in score(docs, fit(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_of_a_row_does_not_depend_on_its_neighbour():
    import pyarrow as pa

    from ledgerlake.llm.toxicity import Bags

    one = Bags(pa.array(["bad"])).ids
    assert (Bags(pa.array(["bad", "bad", "bad"])).ids == one).all()
    assert (Bags(pa.array(["so bad", "bad bad"])).ids[[1, 2]] == one).all() and not Bags(pa.array(["bad bad"])).ids[1].any()


def test_quality_held_out(spark):
    from ledgerlake.llm.quality import fit, score

    rng = random.Random(8)
    rows = []
    for i in range(240):
        good = i % 2
        t = ". ".join(words(rng, 10) for _ in range(rng.randint(2, 20)))
        rows.append((i, t if good else t.upper().replace(" ", "!! "), good))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, " \n ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3 != 1], "doc_id long, quality int")
    got = {r.doc_id: r for r in score(docs, fit(docs, labels)).collect()}
    assert np.mean([(got[i].score >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 1]) > 0.95
    assert 0 <= got[900].score <= 1 and 0 <= got[901].score <= 1
    assert {r.score for r in score(docs, fit(docs, labels.limit(0))).collect()} == {0.5}


def test_pipeline_stages(spark, tmp_path, texts):
    import corpus_pipeline as cp

    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[9].split()[:600]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, kept = docs, []
    for _, stage in cp.STAGES:
        held = stage(spark, held, str(tmp_path)).cache()
        kept.append({r.doc_id for r in held.collect()})
    assert kept[0] == {i for i, t in enumerate(texts) if t and any(x.isalpha() for x in t)}
    assert kept[1] <= kept[0] and 14 in kept[1] and 14 not in kept[2] and 16 not in kept[2] and 9 in kept[2] and 9 not in kept[3]
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == kept[4] <= kept[3]
