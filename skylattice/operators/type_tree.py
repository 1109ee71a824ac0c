"""Two-level type trees: nested to flat and back, and the keywords they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(tree: DataFrame) -> DataFrame:
    """type_code, type_name, parent_code, level of tree(code, name, subtypes)."""
    top = tree.select(F.col("code").alias("type_code"), F.col("name").alias("type_name"), F.lit(None).cast("string").alias("parent_code"), F.lit(1).alias("level"))
    sub = tree.select("code", F.explode("subtypes").alias("s")).select(F.col("s.code").alias("type_code"), F.col("s.name").alias("type_name"), F.col("code").alias("parent_code"), F.lit(2).alias("level"))
    return top.unionByName(sub)


def nest(flat: DataFrame) -> DataFrame:
    """code, name, subtypes (in order of code) of flat rows: one join in place of a query for each parent; parents without children stay."""
    top = flat.where("level = 1").select(F.col("type_code").alias("code"), F.col("type_name").alias("name"))
    sub = flat.where("level = 2").groupBy(F.col("parent_code").alias("code")).agg(F.sort_array(F.collect_list(F.struct(F.col("type_code").alias("code"), F.col("type_name").alias("name")))).alias("subtypes"))
    return top.join(sub, "code", "left").select("code", "name", F.coalesce("subtypes", F.array().cast("array<struct<code:string,name:string>>")).alias("subtypes"))


def keywords(tree: DataFrame) -> DataFrame:
    """keyword, position: the distinct names of a tree in order of first occurrence (parent, then its children, by code)."""
    names = tree.select("code", F.posexplode(F.concat(F.array("name"), F.transform("subtypes", lambda s: s["name"]))).alias("pos", "keyword"))
    return names.where("keyword <> ''").groupBy("keyword").agg(F.min(F.struct("code", "pos")).alias("position"))
