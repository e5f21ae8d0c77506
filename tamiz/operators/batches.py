"""Batch work: split, resume, merge, audit and validation of items and their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, NumericType, StringType


def split_round_robin(items: DataFrame, stratum: str, key: str, parts: int) -> DataFrame:
    """Adds ``part``: the items of each stratum dealt out in turn, so every part has its share of each.

    The deal begins where the strata before ended; their sizes, one row a stratum, are the only thing gathered.
    """
    within = Window.partitionBy(stratum).orderBy(key)
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = items.withColumn("__k", F.row_number().over(within) - 1)
    return numbered.join(offsets, numbered[stratum].eqNullSafe(offsets[stratum])).drop(offsets[stratum]).withColumn("part", F.pmod(F.col("__k") + F.col("__before"), F.lit(parts)).cast("int")).drop("__k", "__before")


def pending(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return items.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def resume(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Whole lines of a checkpoint, the last of each key; lines that could not be read are dropped."""
    good = lines.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in lines.columns else lines
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return good.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_parts(parts: list[DataFrame], known: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the first part that has each key, and the rows whose key is not known."""
    union = None
    for n, p in enumerate(parts):
        q = p.withColumn("__part", F.lit(n))
        union = q if union is None else union.unionByName(q, allowMissingColumns=True)
    ids = known.select(key).distinct()
    cols = [c for c in union.columns if c not in (key, "__part")]
    w = Window.partitionBy(key).orderBy("__part", *cols)
    kept = union.join(ids, key, "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__part")
    return kept, union.join(ids, key, "left_anti").drop("__part")


def schema_errors(df: DataFrame, schema: dict) -> Column:
    """Names of the properties of a row that break a JSON-like schema: required, enum, minLength, minimum, pattern, type.

    A boolean is no integer; a null property breaks only ``required``.
    """
    types = {f.name: f.dataType for f in df.schema}
    errors = []
    for name, rule in schema.get("properties", {}).items():
        if name not in types:
            if name in schema.get("required", []):
                errors.append(F.lit(f"{name}: missing"))
            continue
        c, kind = F.col(name), types[name]
        wanted = {"string": isinstance(kind, StringType), "integer": isinstance(kind, IntegralType) and not isinstance(kind, BooleanType), "number": isinstance(kind, NumericType), "array": isinstance(kind, ArrayType), "boolean": isinstance(kind, BooleanType)}
        if rule.get("type") and not wanted.get(rule["type"], True):
            errors.append(F.lit(f"{name}: type"))
        if "enum" in rule:
            errors.append(F.when(~c.isin(*rule["enum"]), F.lit(f"{name}: enum")))
        if "minLength" in rule:
            errors.append(F.when(F.length(c) < rule["minLength"], F.lit(f"{name}: minLength")))
        if "minimum" in rule:
            errors.append(F.when(c < rule["minimum"], F.lit(f"{name}: minimum")))
        if "pattern" in rule:
            errors.append(F.when(~c.rlike(rule["pattern"]), F.lit(f"{name}: pattern")))
        if name in schema.get("required", []):
            errors.append(F.when(c.isNull(), F.lit(f"{name}: required")))
    for rule in schema.get("allOf", []):
        (name, value), needed = next(iter(rule["if"].items())), rule["then"]
        errors += [F.when((F.col(name) == value) & F.col(n).isNull(), F.lit(f"{n}: required")) for n in needed]
    return F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>")


def audit_ids(answers: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """``(id, problem)``: repeated, foreign and missing ids of a delivery."""
    repeated = answers.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    foreign = answers.select(key).distinct().join(items.select(key), key, "left_anti").select(key, F.lit("foreign").alias("problem"))
    missing = items.select(key).distinct().join(answers.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return repeated.unionByName(foreign).unionByName(missing)


def is_empty(c: Column, kind: str) -> Column:
    """Null, empty string, empty array or empty map."""
    return c.isNull() | ((F.size(c) == 0) if kind.startswith(("array", "map")) else (c.cast("string") == ""))
