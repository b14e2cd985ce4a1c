"""Queries over the derived graph pair, and what DuckDB is to make of the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import demangle as DM
from callweave.functions import names
from callweave.functions.demangle import demangle
from callweave.functions.names import NameFilter
from callweave.functions.wordlists import IGNORED_PARTS, NOISE, OPERATORS, RULES
from callweave.operators import edges as E
from callweave.operators import report as R
from callweave.operators import stages as S
from callweave.operators.greedy import greedy_match
from callweave.schema import widened
from callweave.session import cut
from callweave.sources import fixtures
from callweave.sources.callgraph import distinct_strings, function_record, normalise, parse_graph

LEAST = widened(0.8)
#: A least score of reach that gives candidates on the derived pair.
REACH_LEAST = widened(0.5)
_kept: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Let go of the parts that a session keeps: later queries compute them anew."""
    _kept.clear()


class Pair:
    """The derived graphs of a folder and their match, each part computed once a session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.key = spark, (spark.sparkContext.applicationId, sf_dir)
        self.sf_dir = sf_dir

    def part(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (*self.key, name)
        if key not in _kept:
            _kept[key] = cut(make())
        return _kept[key]

    @property
    def g1(self) -> DataFrame:
        return self.part("g1", lambda: fixtures.derived_graphs(self.spark, self.sf_dir)[0])

    @property
    def g2(self) -> DataFrame:
        return self.part("g2", lambda: fixtures.derived_graphs(self.spark, self.sf_dir)[1])

    @property
    def exact(self) -> DataFrame:
        return self.part("exact", lambda: S.exact_match(self.g1, self.g2))

    @property
    def named(self) -> DataFrame:
        """Equal and similar names."""
        return self.part("named", lambda: self.exact.unionAll(S.similar_match(self.g1, self.g2, self.exact, LEAST)))

    @property
    def structural(self) -> DataFrame:
        return self.part("structural", lambda: S.structural_match(self.g1, self.g2, self.named))

    @property
    def match(self) -> DataFrame:
        return self.named.unionAll(self.structural)


def _open_required(p: Pair) -> DataFrame:
    return E.required_neighbours(p.named, p.g1, p.g2, E.unmatched(p.g2, p.named, "g2_idx"))


def _candidates(p: Pair) -> DataFrame:
    return S.structural_candidates(_open_required(p), p.g1)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to rewrite, made of part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.expr("concat('NTempest::', replace(p_name, ' ', '::'), '<', p_brand, ',', p_type, '>::_SErr', p_size, case when p_partkey % 3 = 0 then '::operator+=' when p_partkey % 3 = 1 then '::operator[]x' else '' end)").alias("name"))


_TEXTS_SQL = "SELECT p_partkey, concat('NTempest::', replace(p_name, ' ', '::'), '<', p_brand, ',', p_type, '>::_SErr', p_size, case when p_partkey % 3 = 0 then '::operator+=' when p_partkey % 3 = 1 then '::operator[]x' else '' end) AS name FROM part"


def graph_functions(spark, d):
    p = Pair(spark, d)
    one = lambda g, tag: g.select(F.lit(tag).alias("graph"), "idx", "name", "base_name", F.size("callees").cast("long").alias("n_callees"), F.size("callers").cast("long").alias("n_callers"))
    return one(p.g1, "g1").unionAll(one(p.g2, "g2"))


def graph_edges(spark, d):
    p = Pair(spark, d)
    one = lambda g, tag: E.edges(g).groupBy("idx", "dir", "nbr_name").agg(F.count("*").alias("n")).select(F.lit(tag).alias("graph"), "idx", "dir", "nbr_name", "n")
    return one(p.g1, "g1").unionAll(one(p.g2, "g2"))


def filter_partial(spark, d):
    f = names.NameFilter(partial=(*IGNORED_PARTS, "blue", "green::"))
    return Pair(spark, d).g1.select("idx", f.matches(F.col("base_name")).alias("ignored"))


def filter_exact(spark, d):
    f = names.NameFilter(exact=("ASIA", "FRANCE"), partial=())
    return Pair(spark, d).g1.where(f.matches(F.col("base_name"))).select("idx", "base_name")


def unknown_predicate(spark, d):
    return Pair(spark, d).g2.select("idx", names.is_unknown(F.col("name")).alias("unknown"))


def strip_fun_prefix(spark, d):
    return Pair(spark, d).g2.select("idx", names.without_prefix(F.col("name")).alias("address"))


def literal_rules(spark, d):
    rules = names.rule_set([r for r in RULES if not r[0]], operators=False)
    return _texts(spark, d).select("p_partkey", rules.apply(F.col("name")).alias("rewritten"))


def regex_rules_template(spark, d):
    rules = names.rule_set([RULES[22]], operators=False)
    return _texts(spark, d).select("p_partkey", rules.apply(F.col("name")).alias("rewritten"))


def ctor_dtor_rules(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    first = F.substring_index("p_name", " ", 1)
    name = F.concat(first, F.when(F.col("p_partkey") % 2 == 0, F.lit("::")).otherwise(F.lit("::~")), first)
    rules = names.rule_set([RULES[23], RULES[24]], operators=False)
    return part.select("p_partkey", rules.apply(name).alias("rewritten"))


def operator_names(spark, d):
    return _texts(spark, d).select("p_partkey", names.operator_words(F.col("name")).alias("rewritten"))


def full_rules(spark, d):
    rules = names.rule_set()
    return _texts(spark, d).select("p_partkey", rules.apply(F.col("name")).alias("rewritten"))


def demangle_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    word = F.substring_index("p_name", " ", 1)
    mangled = F.concat(F.lit("_ZN"), F.length(word).cast("string"), word, F.lit("3getEv"))
    return part.select("p_partkey", demangle(mangled).alias("readable"))


def name_similarity(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    pairs = part.select("p_partkey", F.explode(F.array(F.col("p_type"), F.concat("p_name", F.lit("X")), F.reverse("p_name"))).alias("y"), F.col("p_name").alias("x"))
    return pairs.select("p_partkey", "y", names.name_similarity(F.col("x"), F.col("y"), LEAST).alias("score"))


def _calls(spark, d) -> DataFrame:
    """Nations as functions: a name, for even keys twice the same callee, and the region as caller."""
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    own = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat("n_name", F.lit("_a")), F.concat("n_name", F.lit("_a"))))
    item = F.struct(F.col("n_name").alias("name"), own.alias("called_names"), F.array("r_name").alias("caller_names"), F.col("n_nationkey").alias("address"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", item.alias("item"))


def _read(document: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return parse_graph(document).select("idx", "name", "base_name", joined("callees"), joined("callers"))


def read_list(spark, d):
    items = _calls(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "item"))), lambda x: x["item"]).alias("functions"))
    return _read(items.select(F.to_json("functions").alias("value")))


def read_object(spark, d):
    items = _calls(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "item"))), lambda x: x["item"]).alias("functions"))
    return _read(items.select(F.to_json(F.struct(F.lit("x86").alias("language"), "functions")).alias("value")))


def read_map(spark, d):
    items = _calls(spark, d).agg(F.map_from_entries(F.collect_list(F.struct(F.col("item.name"), "item"))).alias("functions"))
    return _read(items.select(F.to_json("functions").alias("value")))


def normalised_graph(spark, d):
    kept = NameFilter(exact=("ASIA",), partial=("CHINA",))
    rules = names.rule_set([(False, "A", "4"), (True, "([EI])([^EI])", "$2$1")], operators=False)
    out = normalise(_items_as_graph(spark, d), rules, kept)
    return out.select("idx", "name", "base_name", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


def _items_as_graph(spark, d) -> DataFrame:
    items = _calls(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "item"))), lambda x: x["item"]).alias("functions"))
    return parse_graph(items.select(F.to_json("functions").alias("value")))


def qualified_names(spark, d):
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    supplier = spark.read.parquet(f"{d}/supplier.parquet")
    both = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    spaces = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("r_name", "n_name"))
    return both.select("s_suppkey", names.qualified_name(spaces, F.col("s_name")).alias("name"))


def referenced_strings(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return distinct_strings(line.select(F.col("l_suppkey").alias("func"), F.col("l_partkey").alias("address"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("value")))


def renamed_predicate(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet")
    source = F.element_at(F.array(*map(F.lit, ("USER_DEFINED", "IMPORTED", "ANALYSIS", "DEFAULT"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("FUN_", "thunk_", ""))), (F.col("c_custkey") % 3 + 1).cast("int")), "c_name")
    return customer.select("c_custkey", names.is_renamed(source, name).alias("renamed"))


def function_records(spark, d):
    supplier = spark.read.parquet(f"{d}/supplier.parquet")
    record = function_record(F.col("s_name"), address=F.hex("s_suppkey"), nation=F.col("s_nationkey"))
    return supplier.select("s_suppkey", record.alias("r")).select("s_suppkey", "r.name", "r.address", "r.nation")


def custom_rule(spark, d):
    rules = names.RuleSet().literal("::", ".").column_fn(lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))).regex("([aeiou])", "<$1>")
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", rules.apply(F.replace("p_name", F.lit(" "), F.lit("::"))).alias("rewritten"))


def stripped_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.substring_index("p_name", " ", 1), F.lit("::get"))
    full = F.concat(F.lit("std::pair<int, A (*)(long)> "), name, F.lit("(int, void (*)(char)) const &"))
    cut_ = part.select("p_partkey", full.alias("full")).withColumn("no_arguments", DM.strip_arguments(F.col("full")))
    qualified = cut_.withColumn("no_qualifiers", DM.strip_qualifiers(F.concat("no_arguments", F.lit(" const volatile &"))))
    return qualified.withColumn("bare", DM.strip_return_type(F.col("no_qualifiers")))


def exact_match(spark, d):
    return Pair(spark, d).exact


def similar_candidates(spark, d):
    p = Pair(spark, d)
    open2 = E.unmatched(p.g2.where(~names.is_unknown(F.col("name"))), p.exact, "g2_idx")
    return S.similar_candidates(E.unmatched(p.g1, p.exact, "g1_idx"), open2, LEAST)


def greedy_similar(spark, d):
    return greedy_match(similar_candidates(spark, d))


def required_neighbors(spark, d):
    p = Pair(spark, d)
    return E.required_neighbours(p.named, p.g1, p.g2)


def neighbor_indices(spark, d):
    return E.neighbour_indices(Pair(spark, d).g2)


def structural_candidates(spark, d):
    return _candidates(Pair(spark, d))


def ambiguity_cost(spark, d):
    p = Pair(spark, d)
    free = S.structural_candidates(_open_required(p), p.g1, used=p.named.select(F.col("g1_idx").alias("u")))
    return S.ambiguity_cost(free, p.g1, p.g2, p.named)


def structural_match(spark, d):
    return Pair(spark, d).structural


def structural_score(spark, d):
    """Of every g2 function with the g1 function of its place and with the next one."""
    p = Pair(spark, d)
    pairs = p.g2.select(F.col("idx").alias("v"), F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("u"))
    return S.structural_score(pairs, p.g1, p.g2, p.named)


def reach_k(spark, d):
    return S.reach(Pair(spark, d).g1, 3)


def reach_translated(spark, d):
    p = Pair(spark, d)
    return S.translated_reach(p.g2, p.g1, p.match, 3)


def overlap_score(spark, d):
    p = Pair(spark, d)
    return S.inline_candidates(p.g1, p.g2, p.match, REACH_LEAST, 3)


def inline_match(spark, d):
    p = Pair(spark, d)
    return p.part("inline", lambda: S.inline_match(p.g1, p.g2, p.match, LEAST, 3))


def find_target(spark, d):
    p = Pair(spark, d)
    return S.find_target(p.g1, p.g2, p.named, "FUN_00000007", LEAST)


def find_target_by_name(spark, d):
    """Nothing is matched yet, so names alone can tell."""
    p = Pair(spark, d)
    return S.find_target(p.g1, p.g2, p.exact.limit(0), "Supplier_000000003x", LEAST)


def report(spark, d):
    p = Pair(spark, d)
    return R.lines(R.report(p.match, p.g1, p.g2))


def report_grouped(spark, d):
    p = Pair(spark, d)
    return R.grouped(R.report(p.match, p.g1, p.g2))


def post_filter(spark, d):
    return R.post_filter(report(spark, d), noise=(*NOISE, "blue"))


def match_counts(spark, d):
    return Pair(spark, d).match.groupBy("stage").agg(F.count("*").alias("n"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _greedy(name: str, candidates: str) -> str:
    """CTEs that take candidates in order, carrying what is used."""
    return f"""
{name}_r AS (SELECT row_number() OVER (ORDER BY score DESC, g2_idx, g1_idx) AS rn, score, g2_idx, g1_idx FROM {candidates}),
{name}_s AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS u2, CAST([] AS BIGINT[]) AS u1, false AS ok
  UNION ALL SELECT r.rn, CASE WHEN f THEN list_append(u2, r.g2_idx) ELSE u2 END, CASE WHEN f THEN list_append(u1, r.g1_idx) ELSE u1 END, f
  FROM (SELECT r.*, s.u2, s.u1, NOT list_contains(s.u2, r.g2_idx) AND NOT list_contains(s.u1, r.g1_idx) AS f FROM {name}_s s JOIN {name}_r r ON r.rn = s.rn + 1) r),
{name} AS (SELECT r.g2_idx, r.g1_idx, r.score FROM {name}_s s JOIN {name}_r r ON r.rn = s.rn WHERE s.ok)"""


_plain = {t: t for t in (*fixtures.TABLES, "n", "e", "g1")}
_L = "CAST(CAST(0.8 AS FLOAT) AS DOUBLE)"
_SIM = "CASE WHEN 1.0 - CAST(abs(length(x) - length(y)) AS DOUBLE) / greatest(length(x), length(y)) < {l} THEN 0.0 ELSE 1.0 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) END"
_SIM_L = _SIM.format(l=_L)


def _steps(name: str, first: str, step: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT idx, dir, nm, pt, CAST(1 AS BIGINT) AS k FROM ({first}) UNION SELECT r.idx, r.dir, s.nm, s.pt, k + 1 FROM {name} r JOIN ({step}) s ON s.dir = r.dir AND s.idx = r.pt WHERE k < 3)"


def _overlap(least: str) -> str:
    return f"""(SELECT c.v AS g2_idx, c.u AS g1_idx, score FROM (
  SELECT v, u, (CASE WHEN va > 0 AND ua > 0 THEN ca / CAST(least(va, ua) AS DOUBLE) ELSE 0.0 END * p1 + CASE WHEN vb > 0 AND ub > 0 THEN cb / CAST(least(vb, ub) AS DOUBLE) ELSE 0.0 END * p2) / (p1 + p2) AS score FROM (
    SELECT x.v, x.u, ca, cb, coalesce(s2.a, 0) AS va, coalesce(s2.b, 0) AS vb, coalesce(s1.a, 0) AS ua, coalesce(s1.b, 0) AS ub,
      CASE WHEN coalesce(s2.a, 0) > 0 OR coalesce(s1.a, 0) > 0 THEN 1 ELSE 0 END AS p1, CASE WHEN coalesce(s2.b, 0) > 0 OR coalesce(s1.b, 0) > 0 THEN 1 ELSE 0 END AS p2
    FROM (SELECT a.idx AS v, b.idx AS u, count(*) FILTER (WHERE a.dir = 'callee') AS ca, count(*) FILTER (WHERE a.dir = 'caller') AS cb
          FROM t2 a JOIN r1 b ON a.dir = b.dir AND a.name = b.name WHERE a.idx NOT IN (SELECT g2_idx FROM m) AND b.idx NOT IN (SELECT g1_idx FROM m) GROUP BY 1, 2) x
    JOIN (SELECT idx, count(*) FILTER (WHERE dir = 'callee') AS a, count(*) FILTER (WHERE dir = 'caller') AS b FROM t2 GROUP BY 1) s2 ON s2.idx = x.v
    JOIN (SELECT idx, count(*) FILTER (WHERE dir = 'callee') AS a, count(*) FILTER (WHERE dir = 'caller') AS b FROM r1 GROUP BY 1) s1 ON s1.idx = x.u)) c WHERE score >= {least})"""


_CTES = f"""WITH RECURSIVE n AS MATERIALIZED ({fixtures.NODES.format(**_plain)}),
e AS MATERIALIZED ({fixtures.CALLS.format(**_plain)}),
g1 AS MATERIALIZED ({fixtures.G1.format(**_plain)}),
g2 AS MATERIALIZED ({fixtures.G2.format(**_plain)}),
e2 AS MATERIALIZED ({fixtures.G2_CALLS.format(**_plain)}),
d1 AS MATERIALIZED (SELECT src AS idx, 'callee' AS dir, g1.name AS nbr FROM e JOIN g1 ON g1.idx = dst UNION ALL SELECT dst, 'caller', g1.name FROM e JOIN g1 ON g1.idx = src),
d2 AS MATERIALIZED (SELECT src AS idx, 'callee' AS dir, g2.name AS nbr FROM e2 JOIN g2 ON g2.idx = dst UNION ALL SELECT dst, 'caller', g2.name FROM e2 JOIN g2 ON g2.idx = src),
l1 AS MATERIALIZED (SELECT name, max(idx) AS idx FROM g1 GROUP BY name),
m1 AS MATERIALIZED (SELECT min(g2.idx) AS g2_idx, l1.idx AS g1_idx FROM g2 JOIN l1 ON l1.name = g2.name WHERE NOT starts_with(g2.name, 'FUN_') GROUP BY l1.idx),
c2 AS MATERIALIZED (SELECT * FROM (SELECT a.idx AS g2_idx, b.idx AS g1_idx, {_SIM_L.replace("length(x)", "length(a.name)").replace("length(y)", "length(b.name)").replace("levenshtein(x, y)", "levenshtein(a.name, b.name)")} AS score FROM g2 a, g1 b
  WHERE NOT starts_with(a.name, 'FUN_') AND a.idx NOT IN (SELECT g2_idx FROM m1) AND b.idx NOT IN (SELECT g1_idx FROM m1)) WHERE score >= {_L}),
{_greedy("m2", "c2")},
mn AS MATERIALIZED (SELECT g2_idx, g1_idx FROM m1 UNION ALL SELECT g2_idx, g1_idx FROM m2),
tr AS MATERIALIZED (SELECT g2.name AS nbr, arg_min(g1.name, g2_idx) AS t FROM mn JOIN g2 ON g2.idx = g2_idx JOIN g1 ON g1.idx = g1_idx GROUP BY 1),
rq AS MATERIALIZED (SELECT DISTINCT d2.idx AS v, dir, t FROM d2 JOIN tr ON tr.nbr = d2.nbr),
c3 AS MATERIALIZED (SELECT v, u FROM (SELECT rq.v, h.idx AS u, count(*) AS c FROM rq JOIN (SELECT DISTINCT idx, dir, nbr FROM d1) h ON h.dir = rq.dir AND h.nbr = rq.t WHERE rq.v NOT IN (SELECT g2_idx FROM mn) GROUP BY 1, 2) x
  JOIN (SELECT v AS w, count(*) AS need FROM rq GROUP BY 1) y ON y.w = x.v WHERE c = need),
a2 AS (SELECT idx, count(*) AS o FROM d2 WHERE nbr NOT IN (SELECT g2.name FROM mn JOIN g2 ON g2.idx = g2_idx) GROUP BY 1),
a3 AS (SELECT d1.idx, count(*) AS o FROM d1 JOIN l1 ON l1.name = d1.nbr WHERE l1.idx NOT IN (SELECT g1_idx FROM mn) GROUP BY 1),
z1 AS (SELECT g1.idx, count(*) FILTER (WHERE dir = 'callee') AS x, count(*) FILTER (WHERE dir = 'caller') AS y FROM g1 LEFT JOIN d1 ON d1.idx = g1.idx GROUP BY 1),
z2 AS (SELECT g2.idx, count(*) FILTER (WHERE dir = 'callee') AS x, count(*) FILTER (WHERE dir = 'caller') AS y FROM g2 LEFT JOIN d2 ON d2.idx = g2.idx GROUP BY 1),
cost AS MATERIALIZED (SELECT v, u, CAST(abs(z2.x - z1.x) + abs(z2.y - z1.y) + abs(coalesce(a2.o, 0) - coalesce(a3.o, 0)) AS BIGINT) AS cost FROM c3 JOIN z2 ON z2.idx = v JOIN z1 ON z1.idx = u
  LEFT JOIN a2 ON a2.idx = v LEFT JOIN a3 ON a3.idx = u WHERE u NOT IN (SELECT g1_idx FROM mn)),
pr AS (SELECT v, u FROM (SELECT v, min(u) AS u, count(*) AS k FROM c3 GROUP BY v) WHERE k = 1
  UNION ALL SELECT v, u FROM (SELECT v, u, rank() OVER (PARTITION BY v ORDER BY cost) AS r, count(*) OVER (PARTITION BY v, cost) AS k FROM cost WHERE v IN (SELECT v FROM c3 GROUP BY v HAVING count(*) > 1)) WHERE r = 1 AND k = 1),
m3 AS MATERIALIZED (SELECT min(v) AS g2_idx, u AS g1_idx FROM pr WHERE u NOT IN (SELECT g1_idx FROM mn) GROUP BY u),
m AS MATERIALIZED (SELECT * FROM mn UNION ALL SELECT * FROM m3),
{_steps("w1", "SELECT d1.idx, dir, nbr AS nm, l1.idx AS pt FROM d1 JOIN l1 ON l1.name = nbr", "SELECT d1.idx, dir, nbr AS nm, l1.idx AS pt FROM d1 JOIN l1 ON l1.name = nbr")},
r1 AS MATERIALIZED (SELECT DISTINCT idx, dir, nm AS name FROM w1),
{_steps("w2", "SELECT d2.idx, dir, nbr AS nm, g2.idx AS pt FROM d2 JOIN g2 ON g2.name = nbr", "SELECT d2.idx, dir, nbr AS nm, g2.idx AS pt FROM d2 JOIN g2 ON g2.name = nbr")},
t2 AS MATERIALIZED (SELECT DISTINCT w2.idx, dir, g1.name FROM w2 JOIN m ON m.g2_idx = w2.pt JOIN g1 ON g1.idx = m.g1_idx),
o4 AS MATERIALIZED {_overlap(_L)},
{_greedy("m4", "o4")},
rep AS MATERIALIZED (SELECT substr(g2.name, 5) AS address, g1.base_name AS known_name FROM m JOIN g2 ON g2.idx = g2_idx JOIN g1 ON g1.idx = g1_idx WHERE starts_with(g2.name, 'FUN_') AND NOT starts_with(g1.base_name, 'FUN_'))
"""


def _nested(rules, c: str) -> str:
    return reduce(lambda x, r: f"replace({x}, {_q(r[1])}, {_q(r[2])})", rules, c)


_READ = """SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS idx, n_name AS name, n_name AS base_name,
  CASE WHEN n_nationkey % 2 = 0 THEN n_name || '_a,' || n_name || '_a' ELSE '' END AS callees, r_name AS callers FROM nation JOIN region ON n_regionkey = r_regionkey"""
_SWAPPED = "regexp_replace(replace({}, 'A', '4'), '([EI])([^EI])', '\\2\\1', 'g')"
#: The rules run before and after demangling, which leaves these names as they are.
_NORMAL = _SWAPPED.format(_SWAPPED.format("{}"))
_NORMALISED = f"""SELECT idx, {_NORMAL.format("name")} AS name, base_name, CASE WHEN callees = '' THEN '' ELSE {_NORMAL.format("name || '_a'")} || ',' || {_NORMAL.format("name || '_a'")} END AS callees,
  {_NORMAL.format("callers")} AS callers FROM ({_READ.format(order="n_nationkey")}) WHERE name <> 'ASIA' AND NOT contains(name, 'CHINA')"""
_OP_CASE = "CASE " + " ".join(f"WHEN starts_with(rest, {_q(s)}) THEN head || '_{w}'" for s, w in OPERATORS) + " ELSE name END"
_any = lambda c, parts: " OR ".join(f"contains({c}, {_q(p)})" for p in parts)

#: name: (query, its SQL or None)
_ALL: dict[str, tuple[Callable, str | None]] = {
    "graph_functions": (graph_functions, _CTES + "SELECT 'g1' AS graph, g1.idx, name, base_name, x AS n_callees, y AS n_callers FROM g1 JOIN z1 ON z1.idx = g1.idx UNION ALL SELECT 'g2', g2.idx, name, name, x, y FROM g2 JOIN z2 ON z2.idx = g2.idx"),
    "graph_edges": (graph_edges, _CTES + "SELECT 'g1' AS graph, idx, dir, nbr AS nbr_name, count(*) AS n FROM d1 GROUP BY ALL UNION ALL SELECT 'g2', idx, dir, nbr, count(*) FROM d2 GROUP BY ALL"),
    "filter_partial": (filter_partial, _CTES + f"SELECT idx, {_any('base_name', (*IGNORED_PARTS, 'blue', 'green::'))} AS ignored FROM g1"),
    "filter_exact": (filter_exact, _CTES + "SELECT idx, base_name FROM g1 WHERE base_name IN ('ASIA', 'FRANCE')"),
    "unknown_predicate": (unknown_predicate, _CTES + "SELECT idx, starts_with(name, 'FUN_') AS unknown FROM g2"),
    "strip_fun_prefix": (strip_fun_prefix, _CTES + "SELECT idx, CASE WHEN starts_with(name, 'FUN_') THEN substr(name, 5) ELSE name END AS address FROM g2"),
    "literal_rules": (literal_rules, f"SELECT p_partkey, {_nested([r for r in RULES if not r[0]], 'name')} AS rewritten FROM ({_TEXTS_SQL})"),
    "regex_rules_template": (regex_rules_template, rf"SELECT p_partkey, regexp_replace(name, '(\w+)<([^,>]+)[^>]*>', '\1__\2', 'g') AS rewritten FROM ({_TEXTS_SQL})"),
    "ctor_dtor_rules": (ctor_dtor_rules, "SELECT p_partkey, split_part(p_name, ' ', 1) || '::' || CASE WHEN p_partkey % 2 = 0 THEN 'constructor' ELSE 'destructor' END AS rewritten FROM part"),
    "operator_names": (operator_names, f"SELECT p_partkey, {_OP_CASE} AS rewritten FROM (SELECT *, CASE WHEN instr(name, 'operator') > 0 THEN substr(name, instr(name, 'operator') + 8) END AS rest, substr(name, 1, instr(name, 'operator') + 7) AS head FROM ({_TEXTS_SQL}))"),
    "full_rules": (full_rules, None),
    "demangle": (demangle_names, "SELECT p_partkey, split_part(p_name, ' ', 1) || '::get' AS readable FROM part"),
    "name_similarity": (name_similarity, f"SELECT p_partkey, y, {_SIM_L} AS score FROM (SELECT p_partkey, p_name AS x, unnest([p_type, p_name || 'X', reverse(p_name)]) AS y FROM part)"),
    "read_list": (read_list, _READ.format(order="n_nationkey")),
    "read_object": (read_object, _READ.format(order="n_nationkey")),
    "read_map": (read_map, _READ.format(order="n_name")),
    "normalised_graph": (normalised_graph, _NORMALISED),
    "qualified_names": (qualified_names, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE r_name || '::' || n_name || '::' || s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "referenced_strings": (referenced_strings, "SELECT DISTINCT l_suppkey AS func, l_partkey AS address, 's' || CAST(l_partkey AS VARCHAR) AS value FROM lineitem"),
    "renamed_predicate": (renamed_predicate, "SELECT c_custkey, c_custkey % 4 IN (0, 1) OR (c_custkey % 4 = 2 AND c_custkey % 3 = 2) AS renamed FROM customer"),
    "function_records": (function_records, "SELECT s_suppkey, s_name AS name, upper(to_hex(s_suppkey)) AS address, s_nationkey AS nation FROM supplier"),
    "custom_rule": (custom_rule, r"SELECT p_partkey, regexp_replace(upper(substr(x, 1, 1)) || substr(x, 2), '([aeiou])', '<\1>', 'g') AS rewritten FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS x FROM part)"),
    "stripped_names": (stripped_names, "SELECT p_partkey, 'std::pair<int, A (*)(long)> ' || x || '(int, void (*)(char)) const &' AS full, 'std::pair<int, A (*)(long)> ' || x AS no_arguments, 'std::pair<int, A (*)(long)> ' || x AS no_qualifiers, x AS bare FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || '::get' AS x FROM part)"),
    "exact_match": (exact_match, _CTES + "SELECT g2_idx, g1_idx, 'exact' AS stage, CAST(1 AS DOUBLE) AS score FROM m1"),
    "similar_candidates": (similar_candidates, _CTES + "SELECT g2_idx, g1_idx, score FROM c2"),
    "greedy_match": (greedy_similar, _CTES + "SELECT score, g2_idx, g1_idx FROM m2"),
    "required_neighbors": (required_neighbors, _CTES + "SELECT v, dir, t FROM rq"),
    "neighbor_indices": (neighbor_indices, _CTES + "SELECT DISTINCT d2.idx, g2.idx AS nbr_idx FROM d2 JOIN g2 ON g2.name = d2.nbr"),
    "structural_candidates": (structural_candidates, _CTES + "SELECT v, u FROM c3"),
    "ambiguity_cost": (ambiguity_cost, _CTES + "SELECT v, u, cost FROM cost"),
    "structural_match": (structural_match, _CTES + "SELECT g2_idx, g1_idx, 'structural' AS stage, CAST(1 AS DOUBLE) AS score FROM m3"),
    "structural_score": (structural_score, _CTES + "SELECT p.v, p.u, CASE WHEN count(rq.t) > 0 THEN count(h.idx) / CAST(count(rq.t) AS DOUBLE) ELSE 0.0 END AS score FROM (SELECT idx AS v, idx AS u FROM g2 UNION ALL SELECT idx, idx + 1 FROM g2) p LEFT JOIN rq ON rq.v = p.v LEFT JOIN (SELECT DISTINCT idx, dir, nbr FROM d1) h ON h.idx = p.u AND h.dir = rq.dir AND h.nbr = rq.t GROUP BY p.v, p.u"),
    "reach_k": (reach_k, _CTES + "SELECT idx, dir, name FROM r1"),
    "reach_translated": (reach_translated, _CTES + "SELECT idx, dir, name FROM t2"),
    "overlap_score": (overlap_score, _CTES + "SELECT g2_idx, g1_idx, score FROM " + _overlap("0.5")),
    "inline_match": (inline_match, _CTES + "SELECT g2_idx, g1_idx, 'inline' AS stage, score FROM m4"),
    "find_target": (find_target, _CTES + "SELECT u AS g1_idx, CAST(1 AS DOUBLE) AS score FROM c3 JOIN g2 ON g2.idx = v WHERE g2.name = 'FUN_00000007' AND u NOT IN (SELECT g1_idx FROM mn)"),
    "find_target_by_name": (find_target_by_name, _CTES + f"SELECT g1_idx, score FROM (SELECT idx AS g1_idx, {_SIM_L} AS score FROM (SELECT idx, 'Supplier_000000003x' AS x, name AS y FROM g1)) WHERE score >= {_L}"),
    "report": (report, _CTES + "SELECT address, known_name, '- ' || address || ' ' || known_name AS line FROM rep"),
    "report_grouped": (report_grouped, _CTES + "SELECT CASE WHEN contains(known_name, '::') THEN split_part(known_name, '::', 1) ELSE 'unnamed namespace' END AS grp, count(*) AS n, string_agg('- ' || address || ' ' || known_name, chr(10) ORDER BY address, known_name) AS body FROM rep GROUP BY 1"),
    "post_filter": (post_filter, _CTES + f"SELECT * FROM (SELECT address, known_name, '- ' || address || ' ' || known_name AS line FROM rep) WHERE NOT ({_any('line', (*NOISE, 'blue'))})"),
    "match_counts": (match_counts, _CTES + "SELECT 'exact' AS stage, count(*) AS n FROM m1 UNION ALL SELECT 'similar', count(*) FROM m2 UNION ALL SELECT 'structural', count(*) FROM m3"),
}

QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items() if s}
