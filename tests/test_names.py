import goldens
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callweave.functions import demangle as D
from callweave.functions import names as N
from callweave.schema import widened


def one_column(spark, values):
    return spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "c": values}))


def applied(spark, values, column):
    return [r.out for r in one_column(spark, values).select("i", column.alias("out")).orderBy("i").collect()]


def test_transform_cases(spark):
    inputs, expected = zip(*goldens.TRANSFORM, strict=True)
    assert applied(spark, list(inputs), N.rule_set(goldens.RULES).apply(F.col("c"))) == list(expected)
    assert applied(spark, list(inputs), N.rule_set().apply(F.col("c"))) == list(expected)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("cab::c", "cab_constructor"), ("unsigned long long", "uint64 long"), ("A::operator*=", "A_operator_assign"), ("A::operator->", "A_operator_sub"), ("a____b", "a__b"), ("plain", "plain"), ("", "")],
)
def test_rules_by_order(spark, given, expected):
    rules = N.rule_set() if given != "a____b" else N.RuleSet().literal("__", "_")
    assert applied(spark, [given], rules.apply(F.col("c"))) == [expected]


def test_empty_literal_is_refused():
    with pytest.raises(ValueError):
        N.RuleSet().literal("", "x")


def test_filter_cases(spark):
    inputs, expected = zip(*goldens.FILTER, strict=True)
    f = N.NameFilter(partial=("GLWorker", "std::", "TSSimpleArray"))
    assert applied(spark, list(inputs), f.matches(F.col("c"))) == list(expected)
    assert applied(spark, ["ab", "abc"], N.NameFilter(exact=("ab",), partial=()).matches(F.col("c"))) == [True, False]


def test_demangle_cases(spark):
    inputs, expected = zip(*goldens.DEMANGLE, strict=True)
    assert applied(spark, [*inputs, None], D.demangle(F.col("c"))) == [*expected, None]


def test_demangle_without_runtime_raises(monkeypatch):
    def missing(name):
        raise OSError(name)

    D._runtime.cache_clear()
    D.demangled.cache_clear()
    monkeypatch.setattr(D.ctypes, "CDLL", missing)
    with pytest.raises(RuntimeError, match="no C\\+\\+ runtime"):
        D.demangled("_ZN3Foo3getEv")


@pytest.mark.parametrize(("given", "expected"), [("x", "long"), ("_ZN3FoocvbEv", "bool"), ("_ZNK3Foo7isconstEv", "Foo::is"), ("main", "main"), ("_ZNbroken", "_ZNbroken")])
def test_demangle_oddities(given, expected):
    assert D.demangled(given) == expected


def test_similarity(spark):
    pairs = spark.createDataFrame([("abcde", "abcdx"), ("", ""), ("a", "a"), ("é", "e"), ("abcd", "ab")], "a string, b string")
    found = [r.s for r in pairs.select(N.name_similarity(F.col("a"), F.col("b"), widened(0.5)).alias("s")).collect()]
    assert found == pytest.approx([0.8, 0.0, 1.0, 0.0, 0.5])
    assert 0.8 < widened(0.8) < 0.80000002


def test_small_columns(spark):
    row = one_column(spark, ["FUN_FUN_1"]).select(N.is_unknown(F.col("c")).alias("u"), N.without_prefix(F.col("c")).alias("p")).first()
    assert (row.u, row.p) == (True, "FUN_1")
    assert applied(spark, ["A::B::c", "c", "::c"], N.class_of(F.col("c"))) == ["A", "unnamed namespace", ""]
    assert applied(spark, ["f"], N.qualified_name(F.array(F.lit("a"), F.lit("b")), F.col("c"))) == ["a::b::f"]
    renamed = spark.createDataFrame([("USER_DEFINED", "FUN_1"), ("ANALYSIS", "FUN_1"), ("ANALYSIS", "x"), ("DEFAULT", "x")], "s string, n string")
    assert [r.r for r in renamed.select(N.is_renamed(F.col("s"), F.col("n")).alias("r")).collect()] == [True, False, True, False]
