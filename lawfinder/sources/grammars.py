"""Operator grammars: the built-in table, JSON files, and operator weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# 13 grammars as (id, name, equations, template, operator weights, whitelisted functions with counts; None where uncounted).
GRAMMARS = (
    ("0", "Linear–Polynomial", 243, "a*x + b", {"/": 0.3694, "^": 0.275, "+": 0.2279, "*": 0.1277}, {"ln": 10, "exp": 17, "sqrt": 12, "sin": 7, "cos": 4}),
    ("1", "Rational–Power", 377, "P(x)/Q(x)", {"/": 0.6048, "^": 0.3204, "*": 0.0641, "+": 0.0107}, {"sqrt": 42, "sin": 7, "cos": 9}),
    ("2", "Hybrid Composite", 157, "f(g(x))", {"/": 0.4682, "^": 0.3306, "+": 0.1786, "*": 0.0226}, {"sqrt": 23, "sin": 4, "ln": 4, "cos": 3, "exp": 4}),
    ("3", "Rational–Exponential", 78, "P(x)/Q(x)", {"/": 0.5153, "^": 0.3493, "+": 0.0961, "*": 0.0393}, {"exp": 11, "sqrt": 6, "cos": 7, "sin": 2, "tan": 2, "ln": None}),
    ("4", "Hybrid Root–Exponential", 18, "f(g(x))", {"/": 0.4719, "^": 0.2697, "+": 0.1685, "*": 0.0899}, {"sqrt": 19, "ln": 1, "exp": 1}),
    ("5", "Power–Composite", 63, "f(g(x))", {"^": 0.4504, "/": 0.3901, "+": 0.1348, "*": 0.0248}, {"exp": 3, "sinh": 2, "sqrt": 2, "cos": 1}),
    ("6", "General Hybrid", 192, "f(g(x))", {"/": 0.4575, "^": 0.3261, "+": 0.1855, "*": 0.0309}, {"sqrt": 18, "tan": 3, "sin": 3}),
    ("7", "Logarithmic", 52, "a*log(b*x) + c", {"/": 0.651, "^": 0.1879, "+": 0.1208, "*": 0.0403}, {"log": 13, "ln": 46, "sqrt": 6, "tan": 1}),
    ("8", "Exponential", 50, "a*exp(b*x)", {"/": 0.5574, "^": 0.3333, "+": 0.071, "*": 0.0383}, {"exp": 54, "sqrt": 1}),
    ("9", "Periodic–Root", 16, "a*sin(b*x) + c", {"/": 0.6364, "^": 0.2121, "+": 0.1212, "*": 0.0303}, {"sin": 16, "ln": 3, "sqrt": 5, "sinh": 3, "cos": 2}),
    ("10", "Multi-Angle Composite", 12, "a*sin(x)*cos(y)", {"/": 0.38, "^": 0.3, "+": 0.28, "*": 0.04}, {"sin": 8, "cos": 21, "sqrt": 1}),
    ("11", "General Rational", 61, "P(x)/Q(x)", {"^": 0.5482, "/": 0.2719, "+": 0.1272, "*": 0.0526}, {"sqrt": 3, "sin": 2, "cos": None, "sinh": 3, "cosh": 6, "ln": 3, "exp": None}),
    ("12", "Root–Angular", 5, "a*sin(b*x) + c", {"/": 0.5714, "^": 0.3333, "+": 0.0952}, {"tan": 5, "sqrt": 2}),
)
# Function names of grammars and what they mean here; other names are ignored.
FUNCTION_NAMES = {"ln": "log", "log": "log10", "exp": "exp", "sqrt": "sqrt", "sin": "sin", "cos": "cos", "tan": "tan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh"}
BINARY = ("+", "-", "*", "/", "^")
#: Operators that every grammar has at the default weight unless it sets one, and functions of a grammar without any.
ALWAYS, FALLBACK_FUNCTIONS = ("+", "-", "*", "/"), ("sqrt", "exp", "log")
DEFAULT_WEIGHT = 0.10

GRAMMAR_SCHEMA = "cluster_id string, name string, equation_count int, template string, operators map<string,double>, functions array<struct<token:string,weight:double>>"
_FILE_SCHEMA = (
    "family_label string, equation_count int, structure_template struct<template:string>, operators struct<weights:map<string,string>>, "
    "functions struct<whitelist:array<string>,all_functions:map<string,string>,weights:map<string,string>>"
)


def builtin(spark: SparkSession) -> DataFrame:
    """The built-in grammars, one row each."""
    rows = [(i, f"{name} Grammar", n, t, ops, [(k, float(1 if c is None else c)) for k, c in fns.items()]) for i, name, n, t, ops, fns in GRAMMARS]
    return spark.createDataFrame(rows, GRAMMAR_SCHEMA)


def from_directory(spark: SparkSession, path: str) -> DataFrame:
    """Grammars of a folder's ``*.json`` files; the id comes from the file name, unreadable files are left out."""
    try:
        whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], GRAMMAR_SCHEMA)
    sound = whole.where(F.try_parse_json("value").isNotNull())
    rows = sound.select(F.from_json("value", _FILE_SCHEMA).alias("g"), "file").select("g.*", "file")
    known = {r[0]: f"{r[1]} Grammar" for r in GRAMMARS}
    cid = F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), "^grammar_cluster_", "")
    fallback = F.concat(F.trim(F.regexp_replace(F.coalesce("family_label", F.lit("Unnamed Grammar")), r"\s*Family\s*$", "")), F.lit(" Grammar"))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), cid), fallback)
    number = lambda text, default: F.greatest(F.lit(0.0), F.coalesce(text.try_cast("double"), F.lit(default)))
    weight = lambda t: F.coalesce(F.col("functions.weights")[t], F.col("functions.all_functions")[t], F.lit("1"))
    return rows.select(
        cid.alias("cluster_id"), name.alias("name"), F.coalesce("equation_count", F.lit(0)).alias("equation_count"),
        F.coalesce("structure_template.template", F.lit("N/A")).alias("template"),
        F.transform_values(F.coalesce("operators.weights", F.create_map().cast("map<string,string>")), lambda _, w: number(w, DEFAULT_WEIGHT)).alias("operators"),
        F.transform(F.coalesce("functions.whitelist", F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), number(weight(t), 1.0).alias("weight"))).alias("functions"),
    ).orderBy("cluster_id")


def operator_table(grammars: DataFrame) -> DataFrame:
    """(cluster_id, op, arity, weight): what each grammar allows and how much it favours it.

    Function weights sum to one in each grammar; operator weights stay as
    given, and basic operators that are missing come in at the default.
    """
    names = F.create_map(*[F.lit(x) for kv in FUNCTION_NAMES.items() for x in kv])
    named = grammars.select("cluster_id", F.explode("functions").alias("f")).select("cluster_id", F.element_at(names, F.col("f.token")).alias("op"), F.col("f.weight").alias("weight")).where("op is not null")
    bare = grammars.select("cluster_id").join(named.select("cluster_id").distinct(), "cluster_id", "left_anti")
    spare = bare.select("cluster_id", F.explode(F.array(*map(F.lit, FALLBACK_FUNCTIONS))).alias("op"), F.lit(1.0).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("cluster_id"))
    summed = named.groupBy("cluster_id", "op").agg(F.sum("weight").alias("weight")).unionByName(spare)
    unary = summed.select("cluster_id", "op", F.lit(1).alias("arity"), F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")).alias("weight"))
    given = grammars.select("cluster_id", F.explode("operators").alias("op", "weight")).where(F.col("op").isin(*BINARY))
    basic = grammars.select("cluster_id", F.explode(F.array(*map(F.lit, ALWAYS))).alias("op"))
    added = basic.join(given.select("cluster_id", "op"), ["cluster_id", "op"], "left_anti").withColumn("weight", F.lit(DEFAULT_WEIGHT))
    binary = given.unionByName(added).select("cluster_id", "op", F.lit(2).alias("arity"), "weight")
    return unary.unionByName(binary)


def operator_costs(ops: DataFrame) -> DataFrame:
    """Search cost 1 to 5 of each operator: the rarer in its grammar, the dearer."""
    most = F.max("weight").over(Window.partitionBy("cluster_id"))
    scaled = 1 + 4 * (1 - F.col("weight") / F.when(most > 0, most).otherwise(1.0))
    return ops.select("cluster_id", "op", "arity", "weight", F.greatest(F.lit(1), F.bround(scaled).cast("int")).alias("cost"))


def weights_in_order(ops: DataFrame) -> DataFrame:
    """What each grammar allows, heaviest first; ties by name."""
    return ops.orderBy("cluster_id", "arity", F.desc("weight"), "op")


def profile(grammars: DataFrame, ops: DataFrame) -> DataFrame:
    """One row per grammar: its name, size and template, and its functions and operators by weight as text."""
    listed = lambda arity: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("arity") == arity, F.struct(-F.col("weight"), "op", "weight")))), lambda s: F.format_string("%s %.2f", s["op"], s["weight"])), ", ")
    texts = ops.groupBy("cluster_id").agg(listed(1).alias("functions_text"), listed(2).alias("operators_text"))
    return grammars.select("cluster_id", "name", "equation_count", "template").join(texts, "cluster_id")
