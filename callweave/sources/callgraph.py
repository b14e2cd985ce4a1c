"""Call graphs from JSON: a list of functions with the names that they call and are called by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.demangle import demangle
from callweave.functions.names import NameFilter, RuleSet, rule_set
from callweave.session import cut

#: Names keep their kind of value until it is known to be a text.
_ITEM = T.StructType([T.StructField("name", T.VariantType()), T.StructField("called_names", T.ArrayType(T.VariantType())), T.StructField("caller_names", T.ArrayType(T.VariantType()))])
_STRICT = {"mode": "FAILFAST"}


def _items(document: DataFrame) -> DataFrame:
    """pos, item of every function: of a root list, of ``functions``, or of a map's values in key order."""
    value = F.col("value")
    root = F.substring(F.regexp_replace(value, r"^\s+", ""), 1, 1)
    unclear = F.raise_error(F.lit("JSON root must be an array or object"))
    # a map is parsed once, whatever number of keys it has
    parsed = document.select("value", root.alias("root"), F.when(root == "{", F.from_json(value, T.MapType(T.StringType(), T.StringType()), _STRICT)).alias("keys"))
    listed = F.from_json(value, T.ArrayType(_ITEM), _STRICT)
    held = F.from_json(value, T.StructType([T.StructField("functions", T.ArrayType(_ITEM))]), _STRICT)["functions"]
    keyed = F.transform(F.array_sort(F.map_entries("keys")), lambda e: F.from_json(e["value"], _ITEM, _STRICT))
    in_object = F.when(F.map_contains_key("keys", "functions"), held).otherwise(keyed)
    items = F.when(F.col("root") == "[", listed).when(F.col("root") == "{", in_object).otherwise(unclear.cast(T.ArrayType(_ITEM)))
    return parsed.select(F.posexplode(items).alias("pos", "item"))


def _text(value: Column) -> Column:
    """A JSON value that must be a text; missing and null ones are empty."""
    kind = F.schema_of_variant(value)
    wrong = F.raise_error(F.concat(F.lit("a name must be a text, not "), kind)).cast("string")
    return F.when(value.isNull() | F.is_variant_null(value), F.lit("")).when(kind == "STRING", F.variant_get(value, "$", "string")).otherwise(wrong)


def parse_graph(document: DataFrame) -> DataFrame:
    """Functions of the document in column ``value``: idx, name, base_name, callees, callers.

    Missing and null names are empty, missing and null lists too, that of
    ``functions`` as well; order and repeats stay. Other fields are ignored. A
    root that is neither a list nor an object raises, and so does a name that is
    no text.
    """
    none = F.array().cast("array<string>")
    item = F.col("item")
    names = lambda c: F.coalesce(F.transform(item[c], _text), none)
    read = _items(document).select(F.col("pos").cast("long").alias("idx"), _text(item["name"]).alias("name"), names("called_names").alias("callees"), names("caller_names").alias("callers"))
    return read.select("idx", "name", F.col("name").alias("base_name"), "callees", "callers")


def read_functions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Functions of a table, as :func:`parse_graph` gives them: Parquet, JSON lines ("json") or any other kind that Spark reads.

    The table has idx, name, called_names and caller_names, one row a function,
    so it is read by as many tasks as it has splits, and no function needs the
    whole document in one cell. A row's place is its idx: rows without one raise.
    """
    schema = "idx long, name string, called_names array<string>, caller_names array<string>"
    rows = spark.read.schema(schema).format(kind).load(path)
    none = F.array().cast("array<string>")
    idx = F.coalesce("idx", F.raise_error(F.lit("a function without idx")).cast("long"))
    names = lambda c: F.transform(F.coalesce(c, none), lambda x: F.coalesce(x, F.lit("")))
    name = F.coalesce("name", F.lit(""))
    return rows.select(idx.alias("idx"), name.alias("name"), name.alias("base_name"), names("called_names").alias("callees"), names("caller_names").alias("callers"))


def normalise(functions: DataFrame, rules: RuleSet | None = None, ignored: NameFilter | None = None) -> DataFrame:
    """Rewritten and demangled names; ignored functions and neighbours go.

    A function is judged by its raw name, a neighbour by its rewritten ones. idx
    keeps its order, with gaps. Each distinct name is worked on once.
    """
    rules, ignored = rules or rule_set(), ignored or NameFilter()
    base = F.col("base_name")
    kept = functions.where(~ignored.matches(base))
    names = kept.select(base.alias("raw")).union(kept.select(F.explode("callees"))).union(kept.select(F.explode("callers"))).distinct()
    once = cut(names.select("raw", rules.apply(F.col("raw")).alias("once")))
    # the rules run on a column that exists, so their chain isn't repeated in the plan
    readable = cut(once.withColumn("readable", demangle(F.col("once"))))
    done = cut(readable.select("raw", rules.apply(F.col("readable")).alias("name"), "once"))
    done = done.select("raw", "name", (~ignored.matches(F.col("once")) & ~ignored.matches(F.col("name"))).alias("neighbour"))

    def listed(column: str) -> DataFrame:
        each = kept.select("idx", F.posexplode(column).alias("pos", "raw")).join(done.where("neighbour"), "raw")
        return each.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias(column))

    own = kept.select("idx", "base_name").join(done.select(F.col("raw").alias("base_name"), "name"), "base_name")
    none = F.array().cast("array<string>")
    out = own.join(listed("callees"), "idx", "left").join(listed("callers"), "idx", "left")
    return out.select("idx", "name", "base_name", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def read_graph(spark: SparkSession, path: str, rules: RuleSet | None = None, ignored: NameFilter | None = None, normalised: bool = False) -> DataFrame:
    """The functions of a file, raw, or with ``normalised`` as :func:`normalise` makes them.

    A path that ends in .parquet or .jsonl is a table of functions (see
    :func:`read_functions`); any other one is a JSON document.
    """
    kind = {"parquet": "parquet", "jsonl": "json"}.get(path.rstrip("/").rpartition(".")[2])
    try:
        document = None if kind else spark.read.text(path, wholetext=True)
        functions = read_functions(spark, path, kind) if kind else parse_graph(document)
    except Exception as e:
        raise FileNotFoundError(f"File not found: {path}") from e
    return normalise(functions, rules, ignored) if normalised else functions


def neighbour_lists(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Graph rows from functions (idx, name) and calls (src, dst): the lists of an exporter, by idx."""
    named = functions.select(F.col("idx").alias("_i"), F.col("name").alias("_n"))

    def listed(own: str, other: str, column: str) -> DataFrame:
        each = calls.join(named, F.col(other) == F.col("_i")).groupBy(F.col(own).alias("idx"))
        return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_n"))), lambda x: x["_n"]).alias(column))

    none = F.array().cast("array<string>")
    out = functions.join(listed("src", "dst", "callees"), "idx", "left").join(listed("dst", "src", "callers"), "idx", "left")
    return out.withColumn("callees", F.coalesce("callees", none)).withColumn("callers", F.coalesce("callers", none))


def distinct_strings(references: DataFrame) -> DataFrame:
    """One row for each string that a function refers to: func, address, value."""
    return references.dropDuplicates(["func", "address"])


def function_record(name: Column, **fields: Column) -> Column:
    """A nested record of a function, as exporters write it."""
    return F.struct(name.alias("name"), *(c.alias(k) for k, c in fields.items()))
