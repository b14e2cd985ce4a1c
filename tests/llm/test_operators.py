"""Each operator against brute force and on odd tables: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import bpe, cap_filters, chat, language, line_dedup, mixing, ngram_join, quality, sharding, toxicity
from callweave.llm._support import Scratch, components

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, node string, score string, _id int, h1 string"


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 0, 1, "x", "y", "z", 2, "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(60)) for _ in range(12)]
    rows = [(i, b, "en", f"s{i % 3}") for i, b in enumerate(base)]
    rows += [(20 + i, b.replace("alpha", "ALPHA", 1), "en", None) for i, b in enumerate(base[:4])]
    rows += [(30, None, None, None), (31, "", "en", ""), (32, " \n\t ", "de", "s0"), (33, "one", "de", "s1"), (33, "one", "de", "s1"), (None, "no id at all", None, "s2")]
    rows += [(40, "wordé \U0001f600 " * 6000, "fr", "s0"), (41, "same\nline\n" * 3, "en", "s0"), (42, base[0], "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return documents(spark, odd_rows).cache()


def size_of(text):
    return len((text or "").encode().split())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_sharding(spark, odd, odd_rows):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == len(odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    slots, shard_of = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_smallest_capacity(spark):
    rng = random.Random(6)
    for n, shards in ((1, 4), (40, 7), (200, 8)):
        sizes = [rng.choice([1, 5, 30, 400]) for _ in range(n)]
        ends = np.cumsum(sizes)

        def fits(c, sizes=sizes, shards=shards):
            used, room = 1, c
            for s in sizes:
                if s > c:
                    return False
                if s > room:
                    used, room = used + 1, c
                room -= s
            return used <= shards

        prefix = spark.createDataFrame([(int(e),) for e in ends], "end long")
        got, cuts = sharding.smallest_capacity(prefix, int(ends[-1]), max(sizes), shards)
        assert got == next(c for c in range(1, int(ends[-1]) + 1) if fits(c))
        assert cuts[-1] == ends[-1] and max(np.diff([0, *cuts])) <= got


def test_mixing(spark, odd, odd_rows):
    rows = mixing.mix_sources(odd).collect()
    sizes = defaultdict(int)
    for _, t, _, s in odd_rows:
        sizes[s] += size_of(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in rows:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, size_of(t)) for i, t, *_ in odd_rows)
    longest = {s: max(size_of(t) for _, t, _, x in odd_rows if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order if sizes[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(odd.repartition(3)).collect()))
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    copies = Counter()
    for r in rows:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.take_copies(odd).collect()) == Counter({k: v for k, v in copies.items() if v})


def test_line_runs_of_several_sessions(spark, tmp_path):
    rng, total, root = random.Random(9), Counter(), f"file://{tmp_path}/runs"
    for batch in range(7):
        counts = Counter(rng.randrange(40) for _ in range(60))
        rows = [(i, -i, n) for i, n in counts.items()]
        runs = line_dedup.LineRuns(spark, root, 12, buckets=3 + batch % 2)  # opened again for every batch
        common = {r.h1 for r in runs.common().collect()}
        assert common == {i for i, n in total.items() if n >= 12}
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n long"))
        total += counts
        assert len(runs.runs) <= 3 and len(list((tmp_path / "runs").glob("level*"))) == len(runs.runs)
        runs.close()
    assert not spark.catalog.listTables()


def test_batches_meet_runs_by_merge_joins_without_moving_them(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", 2, buckets=4)
    runs.add(spark.range(50).selectExpr("id AS h1", "id AS h2", "1L AS n"))
    counts = spark.range(30, 80).selectExpr("id AS h1", "id AS h2", "1L AS n").repartition(4, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    met = counts.join(runs._read(runs.runs[0]).where("n >= 2"), ["h1", "h2"], "left_anti")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 1
    runs.close()


def test_line_dedup_writes_few_files(spark, monkeypatch):
    """Fewer than the table has partitions: a file may cost the start of a process."""
    files, saved = [], line_dedup.Scratch.save

    def save(self, df):
        out = saved(self, df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(line_dedup.Scratch, "save", save)
    docs = documents(spark, [(i, f"everywhere\nonly {i}", None, None) for i in range(60)]).repartition(30)
    for known in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", known)
        files.clear()
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_common_lines(docs).collect()) == [(i, f"only {i}", 2, 1) for i in range(60)]
        assert sum(files) < 30
    buckets = line_dedup.LineRuns(spark, f"{line_dedup.Scratch(spark, 'lines').root}/runs", 2, buckets=line_dedup.LEAST_BUCKETS).buckets
    assert buckets <= 2


def test_line_dedup_without_broadcast(spark, odd, monkeypatch):
    both = []
    for most in (10**6, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        rows = odd.union(odd).union(documents(spark, [(70 + i, f"same line\nown {i}\nsame line", None, None) for i in range(12)]))
        both.append(Counter(map(str, line_dedup.drop_common_lines(rows, keep=("lang", "source")).collect())))
    assert both[0] == both[1] and any("n_dropped=2" in r for r in both[0])


def test_line_dedup(spark, odd, odd_rows):
    rng = random.Random(2)
    more = [(100 + i, "\n".join(rng.choice(["Shared A ", "shared a", "other", f"own {i}", "", "  "]) for _ in range(5)), None, None) for i in range(30)]
    every = odd_rows + more
    holders = Counter(k for _, t, *_ in every for k in {line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")})
    gone = {k for k, n in holders.items() if k and n >= 10}
    assert b"shared a" in gone

    def kept(t):
        lines = (t or "").encode().split(b"\n")
        stay = [x for x in lines if line_dedup.line_key(x) not in gone]
        return b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)

    rows = line_dedup.drop_common_lines(documents(spark, every)).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows) == Counter((i, *kept(t)) for i, t, *_ in every)
    assert line_dedup.drop_common_lines(odd.limit(0)).count() == 0


def brute_components(rows, words, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, odd_rows, words, percent):
    rng = random.Random(words)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = list(odd_rows)
    for i in range(60):  # near copies about the threshold, some with a passage in common that most lack
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(90)] = f"x{rng.randrange(10_000)}"
        if i % 3 == 0:
            text[40:46] = ["another", "passage", "that", "some", "do", "share"]
        rows.append((200 + i, " ".join(text[: rng.randrange(80, 91)]), None, None))
    for i in range(12):
        rows.append((300 + i, " ".join(base[: i + 1]), None, None))
    got = ngram_join.jaccard_components(documents(spark, rows), words, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, words, percent)
    kept = ngram_join.keep_one_each(documents(spark, rows), words, percent)
    expected = {c for i, n, c in brute_components(rows, words, percent) if n and i is not None}
    assert sorted(r.doc_id for r in kept.where("text rlike '[^ \t\n]' and doc_id is not null").collect()) == sorted(expected)


@pytest.mark.parametrize("chunk", [5])
def test_groups_larger_than_a_task(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(80):  # copies of one text with own words, copies of copies, and texts that share a passage only
        text = list(base if i % 4 else base[:45] + [f"o{i}x{k}" for k in range(45)])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(90)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(text), None, None))
        if i % 10 == 1:
            rows.append((100 + i, " ".join([*text[:88], f"q{i}", f"r{i}"]), None, None))
    got = ngram_join.jaccard_components(documents(spark, rows), 3, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 80)


def test_sketches_bound_differences():
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 9000)).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(1, 800)).astype(np.uint64))))
        if rng.random() < 0.3:  # many elements in one part of the domain
            x, y = (np.unique(np.concatenate((v, rng.integers(0, 2**40, 700).astype(np.uint64)))) for v in (x, y))
        apart, total = ngram_join.sets_apart(x.tobytes(), y.tobytes())
        assert (apart, total) == (len(np.setxor1d(x, y)), len(x) + len(y))
        bound, of = ngram_join.sketches_apart(ngram_join.sketch(x), ngram_join.sketch(y))
        assert of == total and bound <= apart
        sets += [x, y]
    sketches, n = [ngram_join.sketch(x) for x in sets], np.array([len(x) for x in sets])
    detail, i, j = np.array([len(x) - 4 for x in sketches]), *np.triu_indices(len(sets), 1)
    assert len(set(detail)) > 2
    for percent in (50, 80):
        keep = ngram_join.refined(sketches, detail, n, i, j, percent)
        for k in rng.choice(len(i), 800, replace=False):
            bound, total = ngram_join.sketches_apart(sketches[i[k]], sketches[j[k]])
            assert keep[k] == (bound * (100 + percent) <= total * (100 - percent)) or min(detail[i[k]], detail[j[k]]) == 1 << ngram_join.CELL_BITS


def test_names_that_two_sets_share_are_not_used(spark, monkeypatch, tmp_path):
    rows = documents(spark, [(i, f"one two three four w{i % 3}", None, None) for i in range(6)])
    node, scratch = ngram_join._node, Scratch(spark, "t")
    monkeypatch.setattr(ngram_join, "_node", lambda x, seed=0: (7, node(x)[1]) if not seed else node(x, seed))
    sets, seed = ngram_join._named_sets(rows.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("_bytes")), 5, scratch)
    assert sets.select("node").distinct().count() == 3 and (seed == 1 or sets.where("node = 7").count() == 0)


def test_one_of_each_component_stays(spark):
    text = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, text("a"), "s0", None), (None, text("a"), "s1", None), (None, text("b"), None, None), (None, text("c"), None, None)]
    rows += [(1, text("d"), None, None), (1, text("e"), None, None), (1, text("e", 29), None, None), (2, text("e"), None, None), (2, text("f"), None, None)]
    rows += [(None, text("f"), None, None), (3, text("f", 29), None, None), (None, None, None, None), (4, " ", None, None)]
    kept = ngram_join.keep_one_each(documents(spark, rows)).collect()
    got = Counter((r.doc_id, (r.text or " ")[0]) for r in kept)
    assert got == Counter([(None, "a"), (None, "b"), (None, "c"), (1, "d"), (1, "e"), (2, "f"), (None, " "), (4, " ")])


def test_signatures_meet(spark):
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 11, 40, 300):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for percent in (80, 90):
            for extra in range(0, size // 4 + 1):
                y = np.unique(np.concatenate((x[extra:], rng.integers(0, 2**63, extra).astype(np.uint64))))
                common = len(np.intersect1d(x, y))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    assert set(ngram_join.signatures(x, percent)) & set(ngram_join.signatures(y, percent))


@pytest.mark.parametrize("percent", [90, 67, 50, 34, 20])
def test_sets_of_far_sizes_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for small in range(1, 120):
        x = np.unique(rng.integers(0, 2**64, small * 100 // percent, np.uint64))
        one, two = (set(ngram_join.signatures(v, percent).tolist()) for v in (np.sort(rng.permutation(x)[:small]), x))
        assert one & two


def test_empty_ngram_join(spark, odd):
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "small"), [(4096, 48), (40, 8), (7, 2)])
def test_cap_filters(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(cap_filters, "CHUNK", chunk)
    monkeypatch.setattr(cap_filters, "SMALL", small)
    rng = np.random.default_rng(3)
    crowd = rng.standard_normal(24)
    rows = [(i, (crowd + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.25])).tolist(), 0) for i in range(110)]
    for i in range(40):
        v = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((len(rows), (v + rng.standard_normal(24) * 0.04).tolist(), int(i % 3)))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, rows[0][1], None), (904, None, 0), (905, [0.0] * 24, 0), (906, [float("nan")] * 24, 0), (907, [], 0), (908, [1.0, None], 0), (909, [1.0, 2.0], 0), (910, [2.0, 4.0], 0), (911, [float("inf")] * 24, 0)]
    rows += [(912, [3.0, 1.0, 2.0], 5), (913, [3.0, 1.0, 2.01], 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, root string, n int")
    good = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, g), (j, y, h) = good[a], good[b]
            if g == h and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(df).collect()}
    assert got == {r[0]: (links[r[0]], find(r[0])) for r in rows}
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


def test_cap_filters_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 0.01], 0), (3, [0.6, 0.8], 0), (3, None, 0)]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter([(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 1, 1), (None, 2, 1), (3, 0, 3), (3, 0, 3)])


@pytest.mark.parametrize("vectors", [256_000, 10**6, 10**8])
def test_recall_of_finer_filters(vectors):
    rng = np.random.default_rng(vectors % 1000)
    codewords = math.ceil((vectors / cap_filters.VECTORS_A_FILTER) ** (1 / cap_filters.BLOCKS))
    x, z = (rng.standard_normal((1000, 64)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    one, two = (set(zip(*(c.tolist() for c in cap_filters.filters_of(v, codewords)), strict=True)) for v in (x, y))
    assert len({i for i, _ in one & two}) >= 990


def test_list_decoding_finds_every_direction():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((30, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, cuts, words, bound = cap_filters.code(12, 0, 40)
    turned = v @ q
    total = np.zeros((30, 1))
    for a, b, w in zip(cuts[:-1], cuts[1:], words, strict=True):
        total = (total[:, :, None] + (turned[:, a:b] @ w.T)[:, None, :]).reshape(30, -1)
    r, f = cap_filters.list_decode(v, 12, 0, 40)
    for i in range(30):
        above = set(np.flatnonzero(total[i] >= bound).tolist())
        found = set(f[r == i].tolist())
        assert found == above if len(above) >= cap_filters.LEAST_FILTERS else len(found) == cap_filters.LEAST_FILTERS


def test_quality(spark, odd, odd_rows):
    rows = {}
    for r in quality.judge(odd, spark.createDataFrame([(i, int(i < 8)) for i in range(12)], "doc_id long, quality int")).collect():
        rows.setdefault(r.doc_id, r)
    for i, t, *_ in odd_rows:
        t = t or ""
        words = t.encode().split()
        seen, again = set(), 0
        for line in t.split("\n"):
            again += line in seen
            if line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if count[w] > 1 for d in range(3)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), again, len(covered))
        assert r.base_failed == (len(words) < 50 or 2 * len(covered) > len(words))
        assert not (r.base_failed and r.kept)
    assert quality.judge(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality_parts_good_from_junk(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "river", "runs", "under", "old", "stone"]) + rng.choice("abcde") + str(rng.randrange(99)) for _ in range(70)) for _ in range(60)]
    junk = [" ".join(rng.choice(["BUY", "CHEAP", "$$$", "CLICK!!"]) + str(rng.randrange(99)) for _ in range(70)) for _ in range(60)]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(good + junk)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 2], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] == (i < 60) for i in range(120))


def test_quality_uses_all_labels(spark, monkeypatch):
    # few documents, named by more labels than a sample would hold
    words = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(70)) for i in range(40)]
    docs = documents(spark, [(i * 1000, t, None, None) for i, t in enumerate(words)])
    labels = spark.range(40_000).selectExpr("id AS doc_id", "1 AS quality")
    monkeypatch.setattr(quality, "SENT_LABELS", 50, raising=False)
    seen = []
    count = quality.corpus_counts
    monkeypatch.setattr(quality, "corpus_counts", lambda rows, *a: seen.append(count(rows, *a)) or seen[-1])
    trusted = labels.where("pmod(xxhash64('half', doc_id), 2) = 0").join(docs, "doc_id").select("text")
    quality.judge(docs, labels)
    assert seen[0].sum() == count(trusted).sum() > 0


def test_quality_threshold():
    assert quality.threshold([], [], []) == float("-inf")
    assert quality.threshold([1.0, 2.0, 3.0, 4.0], [0, 0, 5, 5], [3, 4, 0, 1]) == 2.5
    assert quality.threshold([1.0, 2.0], [0, 4], [0, 0]) == 1.5
    assert quality.threshold([1.0], [4], [2]) < 1


def test_language(spark, odd_rows):
    rng = random.Random(9)
    stems = {"aa": ["kar", "lun", "mip"], "bb": ["oso", "uvi", "ezu"]}
    rows = [(i, " ".join("".join(rng.choice(stems[g]) for _ in range(3)) for _ in range(30)), g, None) for i, g in enumerate(["aa", "bb"] * 40)]
    rows += [(900, None, "aa", None), (901, "", "aa", None), (902, "12 ... !!", "aa", None), (903, "karlun " * 9000, None, None), (None, "karlunmip", None, None), (904, "karlunmip lunkar mipkar ósouvi", None, None)]
    got = {r.doc_id: r for r in language.identify(documents(spark, rows)).collect()}
    assert all(got[i].lang_pred == g for i, _, g, _ in rows[:80])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(documents(spark, [(1, "x y", None, None)])).collect()} == {"und"}
    assert language.identify(documents(spark, rows).limit(0)).count() == 0


def _plain_features(word):
    """Features of one word, an n-gram at a time."""
    def hashed(kind, *parts):
        h = kind
        for p in parts:
            h = (h ^ p) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        return h >> 64 - language.BITS

    p = [ord(c) for c in word]
    x = [1, *p, 1]
    ends = [f for k in range(1, min(3, len(p)) + 1) for f in (hashed(2 * k, *p[:k]), hashed(2 * k + 1, *p[::-1][:k]))]
    if len(p) > 32:
        mixed = [(c ^ i << 21) * 0x9E3779B97F4A7C15 % 2**64 for i, c in enumerate(p, 1)]
        p = [sum((h ^ h >> 29) * 0xBF58476D1CE4E5B9 for h in mixed) % 2**64]
    return Counter(ends + [hashed(10, *p)] + [hashed(7 + n - 1, *x[i : i + n]) for n in (2, 3) for i in range(len(x) - n + 1)])


def test_features_of_whole_words(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé日") for _ in range(n)) for n in (1, 2, 3, 31, 32, 33, 64, 64, 65, 66, 300)]
    for most in (language.MOST_POINTS, 64):  # in one piece, and in windows
        monkeypatch.setattr(language, "MOST_POINTS", most)
        got = [Counter() for _ in words]
        for at, ids in language.feature_ids(words):
            for i, row in zip(at, ids.tolist(), strict=True):
                got[i].update(row)
        assert got == [_plain_features(w) for w in words]


def test_language_of_unspaced_texts(spark):
    rng = random.Random(9)
    stems = {"aa": ["kar", "lun", "mip"], "bb": ["oso", "uvi", "ezu"]}
    words = lambda g, n: ["".join(rng.choice(stems[g]) for _ in range(3)) for _ in range(n)]
    rows = [(i, " ".join(words(g, 30)), g, None) for i, g in enumerate(["aa", "bb"] * 40)]
    rows += [(900 + i, gap.join(words("bb", 2) + words("aa", 40) + words("bb", 2)), None, None) for i, gap in enumerate(["", "\u00a0", "\u3000"])]
    got = {r.doc_id: r.lang_pred for r in language.identify(documents(spark, rows)).collect()}
    assert [got[900 + i] for i in range(3)] == ["aa"] * 3


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(0)
    e, a, pi = rng.normal(size=(83, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.zeros(83, bool)
    starts[[0, 1, 9, 40]] = True
    cuts, expected = [*np.flatnonzero(starts), 83], []
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        x = e[p:q]
        alpha, beta = [pi + x[0]], [np.zeros(3)]
        for t in range(1, len(x)):
            alpha.append(np.log(np.exp(alpha[-1][:, None] + a).sum(0)) + x[t])
            beta.append(np.log(np.exp(a + (x[-t] + beta[-1])[None, :]).sum(1)))
        g = np.exp(np.array(alpha) + np.array(beta[::-1]))
        expected.append(g / g.sum(1, keepdims=True))
    assert np.allclose(language.marginals(e, starts, a, pi), np.concatenate(expected))


def test_subsequence_kernel():
    """The kernel by enumeration, and the machine's table against its sum over landmarks."""
    from itertools import combinations

    def features(unit):
        out = defaultdict(float)
        for at in combinations(range(len(unit)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.MOST_SPAN:
                out["".join(unit[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
        return out

    def kernel(u, v):
        x, y = features(u), features(v)
        return sum(w * y[k] for k, w in x.items() if k in y) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))

    rng = random.Random(12)
    words = [toxicity.unit_of("".join(rng.choice("abcdé1") for _ in range(rng.randint(2, 14))).encode()) for _ in range(40)]
    words += [w for w in toxicity.broken(words[0])]
    marks = sorted(set(words[:9]))
    columns, phi, white = toxicity._landmark_space(marks)
    found = toxicity._kernel_rows(words, columns, phi)
    assert found == pytest.approx(np.array([[kernel(u, v) for v in marks] for u in words]), abs=1e-5)
    assert white.T @ np.array([[kernel(u, v) for v in marks] for u in marks]) @ white == pytest.approx(np.eye(white.shape[1]), abs=1e-4)
    weights = np.array([rng.uniform(-1, 1) for _ in marks])
    table = np.zeros(toxicity.SYMBOLS**toxicity.ORDER, np.float32)
    table[columns] = phi[:-1] @ weights
    assert toxicity.values(words, table, 0.25) == pytest.approx(found @ weights + 0.25, abs=1e-4)


def test_every_insult_is_learned():
    rng = random.Random(13)
    plain = lambda n: [rng.choice("ba ko mi re tu lo sa ne".split()) + rng.choice("ba ko mi re tu lo".split()) for _ in range(n)]
    insults = ["grumpf", "zwix", "plotz", "scumm", "vrelk", "dornt"]
    texts, toxic = [], []
    for i in range(240):
        words = plain(40)
        if i % 3 == 0:
            for place in rng.sample(range(40), 4):
                words[place] = rng.choice(insults)
        texts.append(" ".join(words).encode())
        toxic.append(int(i % 3 == 0))
    table, bias, weights, offset = toxicity.train(texts, toxic)
    assert min(toxicity.values([toxicity.unit_of(w.encode()) for w in insults], table, bias)) > 0 > max(toxicity.values([toxicity.unit_of(w.encode()) for w in plain(50)], table, bias))


def test_toxicity(spark):
    rng = random.Random(10)
    plain = lambda n: ["".join(rng.choice(["ba", "ko", "mi", "re", "tu", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        words = plain(40)
        if i % 4 == 0:
            words[rng.randrange(40)] = words[rng.randrange(40)] = rng.choice(["zwixxer", "grumpfh", "quarvle"])
        rows.append((i, " ".join(words), None, None))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "zwi-xxer and g*rumpfh quarvlle", None, None), (903, " ".join(plain(20000)), None, None), (None, "z w i x x e r", None, None)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(documents(spark, rows), known).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == t for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]) >= 0.95
    assert got[900].predicted == got[901].predicted == got[903].predicted == 0
    assert got[902].predicted == 1
    none = toxicity.score_documents(documents(spark, rows), known.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score_documents(documents(spark, rows).limit(0), known).count() == 0


def test_runs_of_letters_with_any_gaps():
    runs = lambda text: [t.decode() for t in toxicity.tokens_of(text.encode())][len(text.encode().split()) :]
    assert runs("z w \u00ef x x e r") == ["zw\u00efxxer"]
    assert runs("so z w i\u0308 x x e r go") == ["zwi\u0308xxer", "sozwi\u0308xxergo"]
    assert runs("the zw ix\txe r then") == ["zwixxer"]
    assert runs("z  w\ti\nx\u00a0x e\u3000r") == ["zwixxer"]
    assert runs("\u00f6 \u00e9 \u00fc und 1 2 3 a b") == ["\u00f6\u00e9\u00fc"]


def test_narrow_pattern():
    """Python's own matcher cuts texts as the regex module does."""
    import random
    import re

    import regex

    own, whole = re.compile(bpe.narrow_pattern(P.PATTERN)).findall, regex.compile(P.PATTERN).findall
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    assert own(every) == whole(every)
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice([rng.choice(every), rng.choice(" \n\t\x1c\x85\u3000's're a1\u00d1")]) for _ in range(40))
        assert own(text) == whole(text)
    assert bpe.narrow_pattern(r"(?i:a)|\bx") is None
    encoder = bpe.Encoder({bytes([i]): i for i in range(256)}, P.PATTERN)
    assert encoder.pieces("a \U0001d400b 1") == whole("a \U0001d400b 1")


def test_workers_let_go():
    """A process keeps what one operator asked for last, nothing else."""
    import weakref

    from callweave.llm import _support

    class Large:
        pass

    first = weakref.ref(_support.kept_in_worker("first", Large))
    assert _support.kept_in_worker("first", Large) is first()
    second = weakref.ref(_support.kept_in_worker("second", Large))
    assert first() is None and second() is not None
    _support.let_go()
    assert second() is None


def test_bpe(spark, odd, odd_rows):
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_texts(odd, RANKS, P.PATTERN, decode=True)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect()) == Counter((i, tuple(own.encode_ordinary(t or "")), t or "") for i, t, *_ in odd_rows)
    back = bpe.decode_ids(coded.select("doc_id", "ids"), RANKS)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, *_ in odd_rows)
    one = bpe.digests(coded).where("doc_id = 33").first()
    assert one.ids_sha256 == hashlib.sha256(" ".join(map(str, own.encode_ordinary("one"))).encode()).hexdigest()
    assert bpe.encode_texts(odd.limit(0), RANKS, P.PATTERN).count() == 0
    rng = random.Random(0)
    machine = bpe.Transducer(ranks)
    for _ in range(3000):
        piece = bytes(rng.randrange(256) for _ in range(rng.randint(1, 9))) if rng.random() < 0.5 else "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 14))).encode()
        assert list(machine.encode(piece)) == own._encode_single_piece(piece)
        ids = own._encode_single_piece(piece)
        assert "".join(bpe.Decoder(machine.bytes_of).stream(ids)) == piece.decode("utf-8", "replace")


def test_bpe_memory():
    """A state of the machine takes few bytes, and a share of memory changes no id."""
    import tracemalloc

    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(4, 14))).encode() for _ in range(4000)]
    machine = bpe.Transducer(ranks)
    tracemalloc.start()
    try:
        ids = [machine.encode(x) for x in pieces]
        assert tracemalloc.get_traced_memory()[0] < 700 * len(machine.states)
    finally:
        tracemalloc.stop()
    small = bpe.Encoder(ranks, P.PATTERN, memory=0.001)
    assert [tuple(small.encode(x.decode())) for x in pieces] == ids
    assert len(small.transducer.states) < 1000 < len(machine.states) and len(small.memory) <= 251


CONVERSATIONS = "conv_id long, turn long, role string, text string, formatted string, at int"


def test_chat(spark):
    rng = random.Random(12)
    bits = ["hello", "\\", "<|im_end|>", "</s>", "[INST]", "<", "[", "\n", '"', "é", "<|im_start|>assistant\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", 'odd "role"\nx', None]), rng.choice(["".join(rng.choice(bits) for _ in range(6)), None, ""])) for c in (1, 2, None) for t in range(9)]
    rows += [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (5, None, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)
    formatted = chat.format_conversations(df)
    expected = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)
        said = "".join(x for _, r, x in turns if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        expected[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(formatted).collect()} == expected
    for r in formatted.collect():
        assert r.formatted.count("<|im_end|>") == expected[r.conv_id][0]  # those of the template alone
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_white_space_subscripts_and_wrong_kinds():
    show = lambda source, **v: "".join(t for t, _ in chat.compile_template(source)(**v))
    assert show("a  {%- if 1 == 1 -%}  b  {%- endif %}  c {#- x -#} d {{- 'e' -}} f") == "ab  cdef"
    assert show("{% for m in messages %}[{{ m['role'] }}|{{ m[\"text\"] }}]{% endfor %}", messages=[{"role": "r", "text": "t -"}]) == "[r|t -]"
    for source in ("{{ 1 + 'a' }}", "{{ m['role' }}", "{{ m[role] }}", "{{ 1 < 'a' }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(source)
    with pytest.raises(chat.TemplateError):
        show("{{ x + 'a' }}", x=1)


def test_template_language():
    def text(source, **variables):
        return "".join(t for t, _ in chat.compile_template(source)(**variables))

    assert text("{% if 1 + 1 == 2 and not false %}a{% else %}b{% endif %}") == "a"
    assert chat.fold(chat.parse("x{{ 'a' + 'b' | upper }}{% if 1 > 2 %}gone{% endif %}y{# note #}")) == (chat.Output(chat.Const("xaBy")),)
    assert text("{% for m in ms %}{{ loop.index }}{{ m.t | trim }}{% endfor %}", ms=[{"t": " p "}, {"t": "q"}]) == "1p2q"
    assert text("{% set x = 'v' %}{{ x }}{% if x == 'w' %}1{% elif x == 'v' %}2{% endif %}") == "v2"
    assert list(chat.compile_template("a{% generation %}b{% endgeneration %}")()) == [("a", False), ("b", True)]
    for bad in ("{% if x %}", "{{ x | eval }}", "{{ (1 }}", "{% include 'x' %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        text("{{ m.__class__ }}", m="x")
