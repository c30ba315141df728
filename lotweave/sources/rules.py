"""Mapping files as rule rows, and rule rows as compiled rule sets per site."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.operators.selectors import compile_steps, rule_kind, terminal
from lotweave.session import literal_rows
from lotweave.sources.site_rules import SITE_RULES


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, config) of JSON mapping files; the file stem is the site."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, r"\.json$", "").alias("site_id"), F.col("value").alias("config")
    )


def built_in_configs(spark: SparkSession) -> DataFrame:
    """The known sites' mappings in the same (site_id, config) form."""
    rows = [(site, json.dumps(rules)) for site, rules in SITE_RULES.items()]
    return literal_rows(spark, rows, "site_id", "config")


def _typed(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(F.startswith(shape, F.lit("OBJECT")), F.lit("dict"))
        .when(F.startswith(shape, F.lit("ARRAY")), F.lit("list"))
        .when(shape != "STRING", F.lit("other"))
    )


def rule_rows(configs: DataFrame, key: str = "site_id") -> DataFrame:
    """One row per (site, or other key, and field) in file order; a config that is not JSON yields none.

    ``kind``: static, css, xpath, dict (selector and type inside), list or other.
    """
    entries = F.map_entries(F.from_json("config", "map<string,variant>"))
    valid = configs.where(F.try_parse_json("config").isNotNull())
    rows = valid.select(key, F.posexplode(entries).alias("pos", "e"))
    text = F.try_variant_get("e.value", "$", "string")
    rows = rows.select(
        key,
        F.col("e.key").alias("field"),
        (F.col("pos") + 1).alias("ordinal"),
        text.alias("rule"),
        _typed(F.col("e.value")).alias("shape"),
        F.try_variant_get("e.value", "$.selector", "string").alias("inner"),
        F.try_variant_get("e.value", "$.type", "string").alias("inner_type"),
    ).withColumn("kind", rule_kind(F.col("rule"), F.col("shape")))
    is_dict = F.col("kind") == "dict"
    return rows.select(
        key, "field", "ordinal", "rule", "kind",
        F.when(is_dict, F.coalesce("inner", F.lit("")))
        .when(F.col("kind").isin("css", "xpath"), F.col("rule")).alias("selector"),
        F.when(is_dict, F.when(F.col("inner_type") == "xpath", F.lit("xpath")).otherwise(F.lit("css")))
        .when(F.col("kind").isin("css", "xpath"), F.col("kind")).alias("selector_type"),
        F.when(is_dict, F.col("inner").isNotNull()).alias("has_selector"),
        F.when(is_dict, F.col("inner_type")).alias("given_type"),
    )


def rule_sets(rules: DataFrame) -> DataFrame:
    """(site_id, rules array): a site's compiled rules in order.  A group is one mapping file."""
    compiled = rules.select(
        "site_id", "ordinal", "field", "kind", "rule", "selector", "selector_type",
        compile_steps(F.col("selector"), F.col("selector_type")).alias("steps"),
        terminal(F.col("selector"), F.col("selector_type")).alias("end"),
    )
    item = F.struct("ordinal", "field", "kind", "rule", "selector", "selector_type", "steps", "end")
    return compiled.groupBy("site_id").agg(F.collect_list(item).alias("rules")).select(
        "site_id",
        F.array_sort("rules", lambda a, b: a["ordinal"] - b["ordinal"]).alias("rules"),
    )
