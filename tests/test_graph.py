import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callweave.cli import Args, main
from callweave.operators import edges as E
from callweave.operators import greedy
from callweave.operators import report as R
from callweave.operators import stages as S
from callweave.operators.greedy import greedy_match
from callweave.plans.engine import match_graphs
from callweave.schema import FUNCTIONS, MATCH, Options, widened
from callweave.sources.callgraph import normalise, parse_graph, read_graph

L = widened(0.8)


def graph(spark, *functions):
    """Functions as (name, callees, callers)."""
    return spark.createDataFrame([(i, n, n, list(a), list(b)) for i, (n, a, b) in enumerate(functions)], FUNCTIONS)


def match_of(spark, *pairs):
    return spark.createDataFrame([(a, b, "given", 1.0) for a, b in pairs], MATCH)


def pairs(df):
    return sorted((r.g2_idx, r.g1_idx) for r in df.collect())


def test_exact_duplicates(spark):
    g1 = graph(spark, ("a", [], []), ("a", [], []), ("FUN_1", [], []))
    g2 = graph(spark, ("a", [], []), ("a", [], []), ("FUN_1", [], []))
    assert pairs(S.exact_match(g1, g2)) == [(0, 1)]
    assert pairs(S.exact_match(graph(spark), g2)) == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_candidates_of_common_heads(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7, raising=False)
    rng = random.Random(12)
    names = [rng.choice(("large_ring_", "old_rod_", "cold_rod_", "small_widget_", "a_name_space_of_some_length_")) + str(rng.randrange(10**5)) for _ in range(120)]

    def edited(name):
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice(("", "x", "3" + name[at])) + name[at + 1 :]
        return name

    others = [edited(rng.choice(names)) for _ in range(120)]
    found = S.similar_candidates(graph(spark, *((n, [], []) for n in names)), graph(spark, *((n, [], []) for n in others)), L)
    # distances are taken where names meet: what only shares a head goes no further
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("levenshtein" in line for line in plan.splitlines() if "Join Inner" in line) == 2
    expected = {(i, j) for i, b in enumerate(others) for j, a in enumerate(names) if 1 - edit_distance(a, b) / max(len(a), len(b)) >= L}
    assert set(pairs(found)) == expected and found.count() == len(expected)


def test_similar_threshold(spark):
    g1 = graph(spark, ("abcde", [], []), ("abcdefghij", [], []))
    g2 = graph(spark, ("abcdx", [], []), ("abcdefghix", [], []))
    assert pairs(S.similar_match(g1, g2, match_of(spark), L)) == [(1, 1)]
    with pytest.raises(ValueError):
        Options(threshold=0).least  # noqa: B018


def test_similar_candidates_are_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) for _ in range(70)]
    left, right = words[:35], words[35:]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    g1, g2 = graph(spark, *((w, [], []) for w in left)), graph(spark, *((w, [], []) for w in right))
    for least in (0.3, 0.5, L):
        expected = set()
        for i, a in enumerate(right):
            for j, b in enumerate(left):
                x, y = a.encode(), b.encode()
                if x and y:
                    long = max(len(x), len(y))
                    if 1 - (long - min(len(x), len(y))) / long >= least and 1 - distance(x, y) / long >= least:
                        expected.add((i, j))
        assert set(pairs(S.similar_candidates(g1, g2, least))) == expected


def test_greedy_is_sequential(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.8, 0.9, 1.0]), rng.randrange(12), rng.randrange(12)) for _ in range(60)]
    used2, used1, expected = set(), set(), []
    for s, a, b in sorted(set(rows), key=lambda r: (-r[0], r[1], r[2])):
        if a not in used2 and b not in used1:
            used2.add(a)
            used1.add(b)
            expected.append((a, b))
    assert pairs(greedy_match(spark.createDataFrame(rows, "score double, g2_idx long, g1_idx long"))) == sorted(expected)
    assert pairs(greedy_match(spark.createDataFrame([], "score double, g2_idx long, g1_idx long"))) == []


def test_structural_single_used_is_lost(spark):
    # the only candidate of FUN_1 is used already
    g1 = graph(spark, ("k", ["x"], []), ("x", [], ["k"]))
    g2 = graph(spark, ("k", ["FUN_1"], []), ("FUN_1", [], ["k"]), ("x", [], []))
    m = match_of(spark, (0, 0), (2, 1))
    assert pairs(S.structural_match(g1, g2, m)) == []


def test_structural_two_one_used(spark):
    g1 = graph(spark, ("k", ["x", "y"], []), ("x", [], ["k"]), ("y", [], ["k"]))
    g2 = graph(spark, ("k", ["FUN_1"], []), ("FUN_1", [], ["k"]), ("x", [], []))
    assert pairs(S.structural_match(g1, g2, match_of(spark, (0, 0), (2, 1)))) == [(1, 2)]


def test_structural_contested(spark):
    g1 = graph(spark, ("k", ["x"], []), ("x", [], ["k"]))
    g2 = graph(spark, ("k", ["FUN_1", "FUN_2"], []), ("FUN_1", [], ["k"]), ("FUN_2", [], ["k"]))
    assert pairs(S.structural_match(g1, g2, match_of(spark, (0, 0)))) == [(1, 1)]


def test_structural_rounds(spark):
    g1 = graph(spark, ("k", ["x"], []), ("x", ["y"], ["k"]), ("y", [], ["x"]))
    g2 = graph(spark, ("k", ["FUN_1"], []), ("FUN_1", ["FUN_2"], ["k"]), ("FUN_2", [], ["FUN_1"]))
    m = match_of(spark, (0, 0))
    assert pairs(S.structural_match(g1, g2, m)) == [(1, 1)]
    assert pairs(S.structural_match(g1, g2, m, max_rounds=None)) == [(1, 1), (2, 2)]


def test_inline(spark):
    g1 = graph(spark, ("a", ["b"], []), ("b", ["c"], ["a"]), ("c", [], ["b"]))
    g2 = graph(spark, ("FUN_a", ["c"], []), ("c", [], ["FUN_a"]))
    m = match_of(spark, (1, 2))
    assert pairs(S.inline_match(g1, g2, m, 0.4)) == [(0, 0)]
    scores = {(r.g2_idx, r.g1_idx): r.score for r in S.inline_candidates(g1, g2, m, 0.01).collect()}
    assert scores == {(0, 0): 1.0, (0, 1): 0.5}  # b has callers, FUN_a none: half


def test_reach_on_a_cycle(spark):
    g1 = graph(spark, ("a", ["b", "gone"], ["b"]), ("b", ["a"], ["a"]))
    found = {(r.idx, r.name) for r in S.reach(g1, 3).where("dir = 'callee'").collect()}
    assert found == {(0, "b"), (0, "a"), (1, "a"), (1, "b")}


def test_counts_of_open_neighbours(spark):
    g1 = graph(spark, ("a", ["b", "b", "gone"], []), ("b", [], []))
    g2 = graph(spark, ("a", ["b", "b", "gone"], []), ("b", [], []))
    m = match_of(spark, (0, 0))
    assert {(r.idx, r.n) for r in S.unknown_neighbours(g2, m).collect()} == {(0, 3)}
    assert {(r.idx, r.n) for r in S.unmatched_neighbours(g1, m).collect()} == {(0, 2)}


def test_translation_takes_the_first_match(spark):
    g1, g2 = graph(spark, ("x", [], []), ("y", [], [])), graph(spark, ("d", [], []), ("d", [], []))
    assert [(r.nbr_name, r.t) for r in E.translation(match_of(spark, (0, 1), (1, 0)), g1, g2).collect()] == [("d", "y")]


def test_find_target(spark):
    g1 = graph(spark, ("k", ["x"], []), ("x", [], ["k"]), ("nearly_alike", [], []))
    g2 = graph(spark, ("k", ["FUN_1"], []), ("FUN_1", [], ["k"]), ("nearly_alikf", [], []))
    m = match_of(spark, (0, 0))
    assert [(r.g1_idx, r.score) for r in S.find_target(g1, g2, m, "FUN_1", L).collect()] == [(1, 1.0)]
    assert [r.g1_idx for r in S.find_target(g1, g2, m, "nearly_alikf", L).collect()] == [2]
    assert S.find_target(g1, g2, m, "nobody", L).collect() == []


def test_reader_shapes(spark, tmp_path):
    items = [{"name": "a", "called_names": ["b", "b"]}, {"caller_names": None}, {"name": "b", "address": "1"}]
    for root in (items, {"functions": items, "language": "x"}, {"2": items[2], "0": items[0], "1": items[1]}):
        path = tmp_path / "g.json"
        path.write_text(json.dumps(root))
        rows = [(r.name, r.callees, r.callers) for r in read_graph(spark, str(path)).orderBy("idx").collect()]
        assert rows == [("a", ["b", "b"], []), ("", [], []), ("b", [], [])]
    with pytest.raises(Exception, match="JSON root"):
        parse_graph(spark.createDataFrame([("3",)], "value string")).collect()
    assert parse_graph(spark.createDataFrame([("[]",)], "value string")).count() == 0
    with pytest.raises(FileNotFoundError):
        read_graph(spark, str(tmp_path / "none.json"))


def test_reader_of_odd_documents(spark):
    of = lambda *texts: [(r.name, r.callees) for r in parse_graph(spark.createDataFrame([(t,) for t in texts], "value string")).orderBy("idx").collect()]
    assert of('{"functions": null}') == of('{"functions": null, "language": "x"}') == of("{}") == of('{"functions": []}') == []
    assert of(' [{"name": null, "called_names": [null, "\u00e9"]}]') == [("", ["", "é"])]
    assert of(json.dumps({f"{i:03}": {"name": f"n{i}"} for i in reversed(range(300))})) == [(f"n{i}", []) for i in range(300)]
    for text in ('[{"name": 5}]', '[{"called_names": [{}]}]', '{"functions": [{"name": true}]}', '"text"', '[{"name": "a"'):
        with pytest.raises(Exception, match="a text, not|JSON root|MALFORMED|malformed"):
            of(text)


def test_tables_of_functions(spark, tmp_path):
    rows = [(1, "b", None, ["a", None]), (0, None, ["b"], [])]
    table = spark.createDataFrame(rows, "idx long, name string, called_names array<string>, caller_names array<string>")
    table.write.parquet(str(tmp_path / "g.parquet"))
    table.write.json(str(tmp_path / "g.jsonl"))
    for name in ("g.parquet", "g.jsonl"):
        got = [(r.idx, r.name, r.base_name, r.callees, r.callers) for r in read_graph(spark, str(tmp_path / name)).orderBy("idx").collect()]
        assert got == [(0, "", "", ["b"], []), (1, "b", "b", [], ["a", ""])]
    spark.createDataFrame([(None, "x")], "idx long, name string").write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(Exception, match="without idx"):
        read_graph(spark, str(tmp_path / "bad.parquet")).collect()


def test_overlap_scores(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(14)]
    sets = lambda n: {(i, d): set(rng.sample(names, rng.randrange(9))) for i in range(n) for d in ("callee", "caller")}
    a, b = sets(25), sets(25)
    rows = lambda s: spark.createDataFrame([(i, d, x) for (i, d), v in s.items() for x in v], "idx long, dir string, name string")
    for least in (0.3, 0.5, L, 1.0):
        expected = {}
        for v in range(25):
            for u in range(25):
                both = [(a[v, d], b[u, d]) for d in ("callee", "caller") if a[v, d] or b[u, d]]
                if any(x & y for x, y in both):
                    score = sum(len(x & y) / min(len(x), len(y)) if x and y else 0.0 for x, y in both) / len(both)
                    if score >= least:
                        expected[v, u] = pytest.approx(score)
        assert {(r.v, r.u): r.score for r in S.overlap_scores(rows(a), rows(b), least).collect()} == expected


def test_normalise(spark):
    g = graph(spark, ("_ZN11CWorldQueryC2Ev", ["std::x", "SE3::f", "GLWorker::g"], []), ("std::gone", [], []), ("SI3::h", [], ["A::A"]))
    rows = [(r.name, r.base_name, r.callees, r.callers) for r in normalise(g).orderBy("idx").collect()]
    assert rows == [("CWorldQuery_constructor", "_ZN11CWorldQueryC2Ev", ["SE2_f"], []), ("SI2_h", "SI3::h", [], ["A_constructor"])]


def test_report(spark, tmp_path):
    g1 = graph(spark, ("C::f", [], []), ("g", [], []), ("FUN_9", [], []))
    g2 = graph(spark, ("FUN_2", [], []), ("FUN_1", [], []), ("FUN_3", [], []))
    rows = R.report(match_of(spark, (0, 0), (1, 1), (2, 2)), g1, g2)
    assert sorted((r.address, r.known_name) for r in rows.collect()) == [("1", "g"), ("2", "C::f")]
    for _ in range(2):  # a report is one file, and a later one takes its place
        R.write_report(rows, str(tmp_path / "out.txt"))
        assert (tmp_path / "out.txt").read_text() == "- 1 g\n- 2 C::f\n"
    R.write_report(rows, str(tmp_path / "less.txt"), noise=("C::",))
    assert (tmp_path / "less.txt").read_text() == "- 1 g\n"
    R.write_grouped(rows, str(tmp_path / "grouped.txt"))
    assert (tmp_path / "grouped.txt").read_text() == "[C]\n- 2 C::f\n\n[unnamed namespace]\n- 1 g\n\n"
    assert not list(tmp_path.glob("*parts*"))
    assert [r.line for r in R.post_filter(R.lines(rows), noise=("C::",)).collect()] == ["- 1 g"]


def test_arguments():
    a = Args(["--base=x=y", "-o", "out", "word", "--flag", "--n=0.7abc", "--i", "12z", "--b", "No", "-o", "last", "--m", "-3"])
    assert (a.get("base"), a.get("o"), a.get_bool("flag"), a.get_float("n"), a.get_int("i")) == ("x=y", "last", True, 0.7, 12)
    assert (a.get_bool("b", True), a.get("m"), a.get_float("none", 0.8), a.has("word"), a.get_int("m", 5)) == (False, "", 0.8, False, 5)


def test_command_line(spark, tmp_path):
    ref = [{"name": "k", "called_names": ["Q::x"], "caller_names": []}, {"name": "Q::x", "called_names": [], "caller_names": ["k"]}]
    base = [{"name": "k", "called_names": ["FUN_77"], "caller_names": []}, {"name": "FUN_77", "called_names": [], "caller_names": ["k"]}]
    for name, items in (("ref", ref), ("base", base)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"functions": items}))
    argv = ["--base", str(tmp_path / "base.json"), "--ref", str(tmp_path / "ref.json"), "-o", str(tmp_path / "out"), "--checkInline", "--group", str(tmp_path / "grp"), "--filtered", str(tmp_path / "filtered")]
    assert main(argv, spark) == 0
    assert (tmp_path / "out").read_text() == "- 77 Q::x\n"
    assert (tmp_path / "filtered").read_text() == "- 77 Q::x\n"
    assert main(["--base", "nowhere.json", "--ref", "nowhere.json"], spark) == 1


def test_engine_on_empty_graphs(spark):
    metrics = {}
    assert match_graphs(graph(spark), graph(spark), Options(inline=True), metrics).count() == 0
    assert metrics == {"exact": 0, "similar": 0, "structural": 0, "inline": 0}


def test_functions_of_equal_requirements_share_candidates(spark):
    """40 functions that require one name and 41 that have it are not 1640 rows on the way; results are brute force's."""
    rng = random.Random(3)
    hubs = [(i, f"hub{i}") for i in range(6)]

    def rows_of(first, last):
        rows = [(i, n, [], []) for i, n in hubs]
        rows += [(i, f"FUN_{first}{i}", ["hub0"], []) for i in range(100, last)]
        return rows + [(i, f"FUN_{first}{i}", rng.sample([n for _, n in hubs[1:]], rng.randint(0, 3)) * rng.randint(1, 2), rng.sample(["hub5", "FUN_y"], rng.randint(0, 2))) for i in range(200, 230)]

    schema = "idx long, name string, callees array<string>, callers array<string>"
    one, two = rows_of("a", 141), rows_of("b", 140)
    g1, g2 = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    match = match_of(spark, *((i, i) for i, _ in hubs), (100, 100))
    required = E.required_neighbours(match, g1, g2, E.unmatched(g2, match, "g2_idx"))
    found, members = S._candidate_classes(required, g1)
    assert found.where("c = 101").count() == 41 and members.where("c = 101").count() == 39

    names = {n for _, n in hubs} | {"FUN_b100"}
    known = lambda ns: {"FUN_a100" if n == "FUN_b100" else n for n in ns if n in names}
    need = {i: (known(a), known(b)) for i, _, a, b in two if i > 100 and (known(a) or known(b))}
    have = {i: (set(a), set(b)) for i, _, a, b in one}
    pairs = {(v, u) for v, (a, b) in need.items() for u, (x, y) in have.items() if a <= x and b <= y}
    assert Counter(map(tuple, S.structural_candidates(required, g1).collect())) == Counter(pairs)
    used = match.select(F.col("g1_idx").alias("u"))
    taken = {i for i, _ in hubs} | {100}
    assert {tuple(r) for r in S.structural_candidates(required, g1, used).collect()} == {(v, u) for v, u in pairs if u not in taken}
    names1 = {n for _, n, _, _ in one} - {n for i, n, _, _ in one if i in taken}
    size = lambda g: {i: (len(a), len(b)) for i, _, a, b in g}
    s1, s2 = size(one), size(two)
    open1 = {i: sum(n in names1 for n in a + b) for i, _, a, b in one}
    open2 = {i: sum(n not in names for n in a + b) for i, _, a, b in two}
    cost = {(v, u): abs(s2[v][0] - s1[u][0]) + abs(s2[v][1] - s1[u][1]) + abs(open2[v] - open1[u]) for v, u in pairs if u not in taken}
    assert {(r.v, r.u): r.cost for r in S.ambiguity_cost(S.structural_candidates(required, g1), g1, g2, match).collect()} == cost
    best = {}
    for v in need:
        us = [u for w, u in pairs if w == v]
        free = sorted((cost[v, u], u) for u in us if (v, u) in cost)
        u = us[0] if len(us) == 1 else free[0][1] if free and [c for c, _ in free].count(free[0][0]) == 1 else None
        if u is not None and u not in taken:
            best[u] = min(v, best.get(u, v))
    assert {r.g1_idx: r.g2_idx for r in S.structural_match(g1, g2, match).collect()} == best


def tied_graphs(spark, n):
    """Functions that one hub calls and none can tell apart, and a matched tree beside them."""
    tree = [("hub", ["root"], ["top"]), ("top", ["hub"], []), ("root", [f"leaf{i}" for i in range(50)], ["hub"]), *((f"leaf{i}", [], ["root"]) for i in range(50))]
    g1 = graph(spark, *((f"known{i}", [], ["hub"]) for i in range(n)), *tree)
    g2 = graph(spark, *((f"FUN_{i}", [], ["hub"]) for i in range(n)), *tree)
    return g1, g2, match_of(spark, *((i, i) for i in range(n, n + 53)))


@pytest.fixture
def rows_cut(monkeypatch):
    """Rows that are written to the checkpoint folder."""
    from callweave.session import cut

    rows = []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    for module in (S, greedy):
        monkeypatch.setattr(module, "cut", counted)
    return rows


def test_inline_of_many_ties(spark, rows_cut):
    n = 60
    g1, g2, m = tied_graphs(spark, n)
    assert pairs(S.inline_match(g1, g2, m, L)) == [(i, i) for i in range(n)]
    assert max(rows_cut) <= 2 * (n + 53)  # neither all pairs nor what matched functions reach
    assert len(rows_cut) < n  # nor a round for each


def test_overlap_of_many_ties(spark, rows_cut):
    n = 60
    g1, g2, m = tied_graphs(spark, n)
    assert pairs(S.inline_candidates(g1, g2, m, 0.5)) == [(i, j) for i in range(n) for j in range(n)]
    assert max(rows_cut) <= 2 * (n + 53)


def test_overlap_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 7)
    rows = lambda n: spark.createDataFrame([(i, "caller", f"n{i % 3}") for i in range(n)], "idx long, dir string, name string")
    got = sorted((r.v, r.u, r.score) for r in S.overlap_scores(rows(50), rows(31), 0.5).collect())
    assert got == [(v, u, 1.0) for v in range(50) for u in range(31) if v % 3 == u % 3]


def test_reach_of_some(spark):
    rng = random.Random(3)
    names = [f"f{i % 25}" for i in range(30)]  # some names stand for two functions
    g = graph(spark, *((x, rng.sample(names, 3), rng.sample(names, 2)) for x in names))
    m = match_of(spark, *((i, i) for i in range(0, 30, 2)))
    some = g.where("idx % 7 = 1").select("idx")
    for walk in (lambda of: S.reach(g, 3, of), lambda of: S.translated_reach(g, g, m, 3, of)):
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(walk(some)) == rows(walk(None).where("idx % 7 = 1")) != []


def test_greedy_of_classes_is_greedy(spark):
    rng = random.Random(12)
    for n in (0, 3, 8):
        vs, us = [(v, rng.randrange(n)) for v in range(5 * n)], [(u, rng.randrange(n)) for u in range(4 * n)]
        scores = [(c, d, rng.choice((0.8, 0.9, 1.0))) for c in range(n) for d in range(n) if rng.random() < 0.5]
        tables = [spark.createDataFrame(x, s) for x, s in ((scores, "c long, d long, score double"), (vs, "v long, c long"), (us, "u long, d long"))]
        every = sorted((-s, v, u) for c, d, s in scores for v, vc in vs if vc == c for u, ud in us if ud == d)
        expected, used2, used1 = [], set(), set()
        for s, v, u in every:
            if v not in used2 and u not in used1:
                expected.append((-s, v, u))
                used2.add(v)
                used1.add(u)
        assert sorted(map(tuple, greedy.greedy_class_match(*tables).collect())) == sorted(expected)
