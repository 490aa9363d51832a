"""Rule catalog: JSON files or a table of targets in, one row per rule out.

A catalog may hold hundreds of thousands of targets, so parsing and checking
are DataFrame jobs. Two kinds of faults are told apart: a file whose *shape* is
wrong (unknown key, missing key, wrong type) is rejected as a whole, while a
well-formed rule with an impossible value fails the load.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nearmark.functions.network import cidr_bits
from nearmark.functions.patterns import pattern_problem
from nearmark.functions.text import is_ascii
from nearmark.schemas import (
    CHOICES,
    PARAM_TYPES,
    RULE_COLUMNS,
    RULE_VALUES,
    STEP_TYPE,
    VALUES_OPTIONAL,
)
from nearmark.session import configure, cut

GROUP_KEYS = ["name", "rule_sets"]
SET_KEYS = ["name", "string_match", "preprocessors", "match_rules"]
STEP_DEFAULTS = {"ignore_tld": False, "regex": False, "encode": True, "decode": True, "keep_both": False}
STEP_KINDS = ["split_target", "exclusion_set", "punycode"]
# Variant type names accepted for a parameter type.
VARIANT_TYPES = {"int": "BIGINT", "double": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN"}


class CatalogError(ValueError):
    """The catalog cannot be used; ``problems`` holds the first rows of the report."""

    def __init__(self, problems: list[Row]):
        self.problems = problems
        super().__init__("; ".join(f"{p.group_name}/{p.rule_set}: {p.problem}" for p in problems))


@dataclass(frozen=True)
class Catalog:
    """Rules, the rule sets they belong to, and the preprocessor chains of those sets."""

    rules: DataFrame
    sets: DataFrame
    chains: DataFrame
    rejects: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.rules.sparkSession

    @cached_property
    def profile(self) -> dict[str, Row]:
        """Per rule type: how many rules and how large they can get. One small job."""
        rows = self.rules.groupBy("rule_type").agg(
            F.count("*").alias("n"),
            F.max(F.octet_length("target")).alias("target_bytes"),
            F.max(F.octet_length(F.concat_ws("", "target", "pattern", "address", "custom_char_subset", "rule_values"))).alias("text_bytes"),
            F.max("exit_on_match").alias("exits"),
            F.max("maximum_distance").alias("distance"),
            F.collect_set("maximum_distance").alias("distances"),
            F.collect_set(F.octet_length("target")).alias("lengths"),
            F.collect_set(F.coalesce("soundex_type", "metaphone_type")).alias("kinds"),
        ).collect()
        return {r.rule_type: r for r in rows}

    @cached_property
    def set_bytes(self) -> int:
        """Upper bound of the rule-set table."""
        text = F.octet_length(F.concat_ws("", "group_source", "group_name", "rule_set", "target"))
        row = self.sets.agg(F.count("*").alias("n"), F.max(text).alias("text")).first()
        return row.n * ((row.text or 0) + 128)

    @property
    def has_exits(self) -> bool:
        return any(row.exits for row in self.profile.values())

    @cached_property
    def chain_shapes(self) -> dict[tuple, list[int]]:
        """Chain ids by the kinds of their steps. The lists inside a step stay in the table."""
        shapes: dict[tuple, list[int]] = {}
        light = F.transform(
            "steps",
            lambda s: F.struct(
                s["preprocessor_type"].alias("kind"), s["ignore_tld"].alias("ignore_tld"),
                s["exclusion_set_source"].alias("source"), s["path"].alias("path"), s["regex"].alias("regex"),
                s["encode"].alias("encode"), s["decode"].alias("decode"), s["keep_both"].alias("keep_both"),
            ),
        )
        for row in self.chains.select("chain_id", light.alias("steps")).collect():
            shapes.setdefault(tuple(row.steps), []).append(row.chain_id)
        return shapes

    @cached_property
    def exclusion_entries(self) -> DataFrame:
        """Inline exclusion entries: ``chain_id, step, entry``."""
        return (
            self.chains.select("chain_id", F.posexplode("steps").alias("step", "s"))
            .where("s.exclusion_set_source = 'list'")
            .select("chain_id", "step", F.explode("s.list").alias("entry"))
            .distinct()
        )

    def sizes(self) -> DataFrame:
        """Number of groups, rule sets, rules and distinct target strings."""
        sets = self.sets.agg(
            F.countDistinct("group_name").alias("string_groups"),
            F.count("*").alias("rule_sets"),
            F.countDistinct("target").alias("target_strings"),
        )
        return sets.join(F.broadcast(self.rules.agg(F.count("*").alias("rules"))))

    def problems(self) -> DataFrame:
        """Every reason why this catalog must not be used: ``group_name, rule_set, rule_idx, problem``."""
        return catalog_problems(self.rules, self.sets)

    def check(self) -> "Catalog":
        found = self.problems().limit(20).collect()
        if found:
            raise CatalogError(found)
        return self

    def settled(self) -> "Catalog":
        """The same catalog as written tables: every rule job reads it, so it should be parsed once."""
        return replace(self, rules=cut(self.rules, "rules"), sets=cut(self.sets, "rule-sets"),
                       chains=cut(self.chains, "chains"))


# --- reading JSON ---------------------------------------------------------------------------------


def _get(variant: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(variant), path, kind)


def _kind(variant: str, path: str) -> Column:
    """Variant type name at a path, NULL when the key is absent."""
    return F.schema_of_variant(_get(variant, path, "variant"))


def _keys(variant: str, path: str = "$") -> Column:
    return F.map_keys(_get(variant, path, "map<string,variant>"))


def _first(*problems: Column) -> Column:
    return F.coalesce(*problems)


def _unknown(keys: Column, allowed: Column, what: str) -> Column:
    extra = F.array_except(keys, allowed)
    return F.when(F.size(extra) > 0, F.concat(F.lit(f"unknown {what} key: "), F.array_join(extra, ", ")))


def _required(variant: str, path: str, kind: str, what: str) -> Column:
    return F.when(
        ~F.coalesce(_kind(variant, path).rlike(f"^({kind})"), F.lit(False)), F.lit(f"{what} missing or of wrong type")
    )


def _names(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def read_catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``group_source, groups`` where ``groups`` is NULL for text that is not JSON.

    A file is a JSON array of groups or a run of JSON objects, each starting on a new line. A raw
    line break cannot occur inside a JSON string, so ``}`` line break ``{`` always separates objects.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("group_source"), F.trim("value").alias("text"))
    )
    as_array = F.try_parse_json("text")
    run = F.concat(F.lit("["), F.regexp_replace("text", r"\}[ \t\r]*\n\s*\{", "},{"), F.lit("]"))
    return files.select(
        "group_source", F.lit(0).cast("bigint").alias("first_ord"),
        F.coalesce(
            F.try_variant_get(as_array, "$", "array<variant>"),
            F.try_variant_get(F.try_parse_json(run), "$", "array<variant>"),
        ).alias("groups"),
    )


def read_catalog_lines(spark: SparkSession, path: str, reject: str = "file") -> DataFrame:
    """Large JSON Lines catalogs: one group per line, files split between tasks.

    A bad line rejects its file, however the file is split; with ``reject="line"`` it rejects itself only.
    """
    if reject not in ("file", "line"):
        raise ValueError(f"reject must be 'file' or 'line', not {reject!r}")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    numbered = lines.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("first_ord"), "value")
    source = F.col("file") if reject == "file" else F.concat_ws("#", "file", F.col("first_ord").cast("string"))
    return numbered.select(
        source.alias("group_source"), "first_ord", F.try_parse_json("value").alias("v"),
    ).select("group_source", "first_ord", F.when(F.col("v").isNotNull(), F.array("v")).alias("groups"))


def _explode_groups(files: DataFrame) -> DataFrame:
    groups = files.select("group_source", "first_ord", F.posexplode("groups").alias("at", "g")).withColumn(
        "group_ord", F.col("first_ord") + F.col("at"))
    problem = _first(
        F.when(~F.schema_of_variant("g").startswith("OBJECT<"), F.lit("group is not an object")),
        _unknown(_keys("g"), _names(GROUP_KEYS), "group"),
        _required("g", "$.name", "STRING", "group name"),
        _required("g", "$.rule_sets", "ARRAY", "rule_sets"),
    )
    return groups.select(
        "group_source", "group_ord", _get("g", "$.name", "string").alias("group_name"),
        _get("g", "$.rule_sets", "array<variant>").alias("rule_sets"), problem.alias("problem"),
    )


def _step(s: Column) -> Column:
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(s, path, kind)

    flags = {k: F.coalesce(get(f"$.{k}", "boolean"), F.lit(v)) for k, v in STEP_DEFAULTS.items()}
    return F.struct(
        get("$.preprocessor_type", "string").alias("preprocessor_type"),
        flags["ignore_tld"].alias("ignore_tld"),
        get("$.exclusion_set_source", "string").alias("exclusion_set_source"),
        get("$.list", "array<string>").alias("list"),
        get("$.path", "string").alias("path"),
        flags["regex"].alias("regex"), flags["encode"].alias("encode"),
        flags["decode"].alias("decode"), flags["keep_both"].alias("keep_both"),
    )


def _step_is_bad(s: Column) -> Column:
    exclusion = s["preprocessor_type"] == "exclusion_set"
    listed = (s["exclusion_set_source"] == "list") & s["list"].isNotNull()
    filed = (s["exclusion_set_source"] == "file") & s["path"].isNotNull()
    return (
        s["preprocessor_type"].isNull()
        | ~s["preprocessor_type"].isin(STEP_KINDS)
        | (exclusion & ~F.coalesce(listed | filed, F.lit(False)))
    )


def _explode_sets(groups: DataFrame) -> DataFrame:
    sets = groups.where("problem is null").select(
        "group_source", "group_ord", "group_name", F.posexplode("rule_sets").alias("set_ord", "s")
    )
    steps = F.transform(F.coalesce(_get("s", "$.preprocessors", "array<variant>"), F.expr("array()")), _step)
    steps = steps.cast(f"array<{STEP_TYPE}>")
    sets = sets.withColumn("steps", steps)
    given = _kind("s", "$.preprocessors")
    problem = _first(
        F.when(~F.schema_of_variant("s").startswith("OBJECT<"), F.lit("rule set is not an object")),
        _unknown(_keys("s"), _names(SET_KEYS), "rule set"),
        _required("s", "$.name", "STRING", "rule set name"),
        _required("s", "$.string_match", "STRING", "string_match"),
        _required("s", "$.match_rules", "ARRAY", "match_rules"),
        F.when(given.isNotNull() & ~given.startswith("ARRAY"), F.lit("preprocessors is not an array")),
        F.when(F.exists("steps", _step_is_bad), F.lit("bad preprocessor")),
    )
    return sets.select(
        "group_source", "group_ord", "group_name", "set_ord",
        _get("s", "$.name", "string").alias("rule_set"),
        _get("s", "$.string_match", "string").alias("target"), "steps",
        _get("s", "$.match_rules", "array<variant>").alias("match_rules"), problem.alias("problem"),
    )


def _param(name: str, kind: str) -> Column:
    """A parameter, or the default of the rule type when the key is absent (JSON null stays NULL)."""
    path = f"$.values.{name}"
    defaults = {t: v[name] for t, v in RULE_VALUES.items() if name in v and v[name] is not ...}
    value = _get("r", path, kind)
    if not defaults:
        return value
    default = F.lit(None).cast(kind)
    for rule_type, v in defaults.items():
        default = F.when(F.col("rule_type") == rule_type, F.lit(v).cast(kind)).otherwise(default)
    return F.when(_kind("r", path).isNull(), default).otherwise(value)


def _rule_shape_problem(custom_types: list[str]) -> Column:
    allowed = F.create_map(*[c for t, v in RULE_VALUES.items() for c in (F.lit(t), _names(v))])
    kind = _kind("r", "$.values")
    checks = [
        F.when(~F.schema_of_variant("r").startswith("OBJECT<"), F.lit("rule is not an object")),
        _required("r", "$.rule_type", "STRING", "rule_type"),
    ]
    known = [*RULE_VALUES, *custom_types]
    checks.append(F.when(~F.col("rule_type").isin(known), F.concat(F.lit("unknown rule type: "), F.col("rule_type"))))
    exit_kind = _kind("r", "$.exit_on_match")
    checks.append(F.when(exit_kind != "BOOLEAN", F.lit("exit_on_match is not a boolean")))
    built_in = F.col("rule_type").isin(list(RULE_VALUES))
    optional = F.col("rule_type").isin(VALUES_OPTIONAL)
    checks.append(F.when(
        built_in & ~F.coalesce(kind.startswith("OBJECT<"), F.lit(False))
        & ~(optional & F.coalesce(kind, F.lit("VOID")).isin("VOID")),
        F.lit("values missing or not an object"),
    ))
    checks.append(F.when(
        built_in, _unknown(_keys("r", "$.values"), F.try_element_at(allowed, F.col("rule_type")), "values")
    ))
    for name, type_name in PARAM_TYPES.items():
        users = [t for t, v in RULE_VALUES.items() if name in v]
        needed = [t for t in users if RULE_VALUES[t][name] is ...]
        found = _kind("r", f"$.values.{name}")
        good = found.rlike(f"^({VARIANT_TYPES[type_name]})$")
        if name == "max_code_length":
            good = good | (found == "VOID")
        bad = F.col("rule_type").isin(users) & found.isNotNull() & ~good
        if needed:
            bad = bad | (F.col("rule_type").isin(needed) & found.isNull())
        if type_name == "int":
            bad = bad | F.coalesce(_get("r", f"$.values.{name}", "bigint") < 0, F.lit(False))
        if name in CHOICES:
            bad = bad | ~F.coalesce(F.col(name).isin(CHOICES[name]), F.lit(True))
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name} missing or invalid")))
    whole = (F.col("rule_type") == "soundex") & (
        (_kind("r", "$.values.minimum_similarity") != "BIGINT") | (F.col("minimum_similarity") < 0)
    )
    checks.append(F.when(whole, F.lit("minimum_similarity missing or invalid")))
    return _first(*checks)


def _explode_rules(sets: DataFrame, custom_types: list[str]) -> DataFrame:
    rules = (
        sets.where("problem is null")
        .select("group_source", "group_ord", "group_name", "set_ord", "rule_set", "set_id", "target", "chain_id",
                F.posexplode("match_rules").alias("rule_idx", "r"))
        .withColumn("rule_type", _get("r", "$.rule_type", "string"))
        .withColumn("exit_on_match", F.coalesce(_get("r", "$.exit_on_match", "boolean"), F.lit(False)))
        .withColumns({name: _param(name, kind) for name, kind in PARAM_TYPES.items()})
        .withColumn("rule_values", F.to_json(_get("r", "$.values", "variant")))
    )
    return rules.select(*RULE_COLUMNS, _rule_shape_problem(custom_types).alias("problem"))


def _identified(sets: DataFrame) -> DataFrame:
    """Add ``chain_id`` (equal chains share one) and ``set_id``."""
    return sets.withColumn("chain_id", F.xxhash64(F.to_json("steps"))).withColumn(
        "set_id", F.xxhash64("group_name", "rule_set")
    )


SET_COLUMNS = ["group_source", "group_ord", "group_name", "set_ord", "rule_set", "set_id", "target", "chain_id"]


def build_catalog(files: DataFrame, custom_types: list[str] | None = None) -> Catalog:
    """Rules from parsed files; files with a wrong shape end up in ``rejects``."""
    groups = _explode_groups(files)
    sets = _identified(_explode_sets(groups))
    rules = _explode_rules(sets, list(custom_types or []))
    bad = reduce(DataFrame.unionByName, [
        files.where("groups is null").select("group_source", F.lit("not JSON").alias("problem")),
        *[df.where("problem is not null").select("group_source", "problem") for df in (groups, sets, rules)],
    ])
    rejects = bad.groupBy("group_source").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    rejected = rejects.select("group_source")

    def kept(df: DataFrame) -> DataFrame:
        return df.join(rejected, "group_source", "left_anti")

    sets = kept(sets.where("problem is null"))
    return Catalog(
        rules=kept(rules).select(*RULE_COLUMNS),
        sets=sets.select(*SET_COLUMNS),
        chains=sets.select("chain_id", "steps").dropDuplicates(["chain_id"]),
        rejects=rejects,
    )


def load_catalog(spark: SparkSession, path: str, lines: bool = False,
                 custom_types: list[str] | None = None) -> Catalog:
    """Load a rule file or a folder of rule files, and fail on any impossible rule.

    A bad file in a folder is skipped and listed in ``rejects``; a bad single file fails the load.
    """
    configure(spark)
    files = (read_catalog_lines if lines else read_catalog_files)(spark, path)
    catalog = build_catalog(files, custom_types)
    rejected = catalog.rejects.limit(20).collect()
    if rejected and _is_single(spark, path):
        raise CatalogError([Row(group_name=r.group_source, rule_set="", problem=", ".join(r.problems))
                            for r in rejected])
    return catalog.settled().check()


def _is_single(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isFile()


# --- targets that already are a table ---------------------------------------------------------------


def _constant_steps(steps: list[Mapping] | None) -> Column:
    values = [{**STEP_DEFAULTS, **s} for s in steps or []]
    return F.from_json(F.lit(json.dumps(values)), f"array<{STEP_TYPE}>")


def _constant_chain(spark: SparkSession, steps: Column) -> DataFrame:
    # the chain is a constant, so its table does not scan the targets
    return spark.range(1).select(steps.alias("steps")).select(F.xxhash64(F.to_json("steps")).alias("chain_id"), "steps")


def catalog_from_targets(targets: DataFrame, column: str, rules: list[Mapping], steps: list[Mapping] | None = None,
                         group: str = "targets") -> Catalog:
    """One rule set per distinct string in a column, all with the same chain and rules.

    ``rules`` and ``steps`` are written as in a rule file.
    """
    step_array = _constant_steps(steps)
    sets = _identified(
        targets.where(F.col(column).isNotNull()).select(F.col(column).alias("target")).distinct().select(
            F.lit("").alias("group_source"), F.lit(0).cast("bigint").alias("group_ord"), F.lit(group).alias("group_name"),
            F.lit(0).alias("set_ord"), F.col("target").alias("rule_set"), "target", step_array.alias("steps"),
        )
    )
    typed = F.array(*[_literal_rule(i, r) for i, r in enumerate(rules)])
    table = sets.select(*SET_COLUMNS, F.explode(typed).alias("r")).select(*SET_COLUMNS, "r.*")
    return Catalog(rules=table.select(*RULE_COLUMNS), sets=sets.select(*SET_COLUMNS),
                   chains=_constant_chain(targets.sparkSession, step_array))


def catalog_from_rules(table: DataFrame, steps: list[Mapping] | None = None) -> Catalog:
    """Rules from a table with ``group_name, rule_set, target, rule_idx, rule_type`` and parameter columns.

    Missing parameter columns get the defaults of the rule type. All rule sets share one chain.
    """
    step_array = _constant_steps(steps)
    filled = table
    for name, kind in PARAM_TYPES.items():
        given = F.col(name) if name in table.columns else F.lit(None)
        for rule_type, values in RULE_VALUES.items():
            if name in values and values[name] is not ... and name not in table.columns:
                given = F.when(F.col("rule_type") == rule_type, F.lit(values[name])).otherwise(given)
        filled = filled.withColumn(name, given.cast(kind))
    for name, default in {"group_source": "", "group_ord": 0, "set_ord": 0, "exit_on_match": False, "rule_values": None}.items():
        if name not in table.columns:
            filled = filled.withColumn(name, F.lit(default))
    filled = _identified(filled.withColumn("steps", step_array)).withColumn("rule_values", F.col("rule_values").cast("string"))
    return Catalog(
        rules=filled.select(*RULE_COLUMNS), sets=filled.select(*SET_COLUMNS).distinct(),
        chains=_constant_chain(table.sparkSession, step_array))


def _literal_rule(index: int, rule: Mapping) -> Column:
    rule_type, values = rule["rule_type"], rule.get("values") or {}
    known = RULE_VALUES.get(rule_type, {})
    merged = {k: v for k, v in known.items() if v is not ...} | dict(values)
    return F.struct(
        F.lit(index).alias("rule_idx"), F.lit(rule_type).alias("rule_type"),
        F.lit(bool(rule.get("exit_on_match", False))).alias("exit_on_match"),
        *[F.lit(merged.get(name) if name in known else None).cast(kind).alias(name)
          for name, kind in PARAM_TYPES.items()],
        F.lit(json.dumps(values)).alias("rule_values"),
    )


# --- semantic checks ----------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _pattern_problem(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else pattern_problem(p))


def rule_problem() -> Column:
    """The first reason why a rule cannot work, NULL for a good rule."""
    kind = F.col("rule_type")
    similarity, percent = F.col("minimum_similarity"), F.col("match_percent_threshold")
    return _first(
        F.when((kind == "jaccard") & ~similarity.between(0, 1), F.lit("minimum_similarity must be between 0 and 1")),
        F.when(kind.isin("jaro", "jaro_winkler") & ~percent.between(0, 1),
               F.lit("match_percent_threshold must be between 0 and 1")),
        F.when(kind.isin("soundex", "metaphone") & ~is_ascii(F.col("target")),
               F.concat(kind, F.lit(" needs an ASCII target"))),
        F.when((kind == "soundex") & (F.col("soundex_type") == "normal") & (similarity > 4),
               F.lit("minimum_similarity of normal soundex is at most 4")),
        F.when((kind == "bitflip") & (F.col("char_subset") == "custom")
               & F.exists(F.split("custom_char_subset", ""), lambda c: F.ascii(c) > 255),
               F.lit("custom_char_subset has characters above code 255")),
        F.when((kind == "cidr") & cidr_bits(F.col("address")).isNull(), F.lit("invalid network address")),
    )


def catalog_problems(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """Impossible rules, and names used twice (over the whole catalog)."""
    where = ["group_name", "rule_set", "rule_idx"]
    values = rules.select(*where, rule_problem().alias("problem"))
    # each distinct pattern is checked once
    patterns = rules.where("rule_type = 'regex'").select("pattern").distinct().select(
        "pattern", _pattern_problem("pattern").alias("problem"))
    regexes = rules.join(patterns.where("problem is not null"), "pattern").select(*where, "problem")
    double_sets = sets.groupBy("group_source", "group_ord", "group_name", "rule_set").count().where("count > 1")
    double_sets = double_sets.select(
        "group_name", "rule_set", F.lit(None).cast("int").alias("rule_idx"),
        F.lit("duplicate rule set name in group").alias("problem"))
    double_groups = (
        sets.select("group_name", "group_source", "group_ord").distinct()
        .groupBy("group_name").count().where("count > 1")
        .select("group_name", F.lit(None).cast("string").alias("rule_set"), F.lit(None).cast("int").alias("rule_idx"),
                F.lit("duplicate group name").alias("problem"))
    )
    # ids are hashes of the names; two names with one id would mix up their results
    clash = (
        sets.groupBy("set_id").agg(F.countDistinct("group_name", "rule_set").alias("n"), F.first("group_name").alias("group_name"),
                                   F.first("rule_set").alias("rule_set")).where("n > 1")
        .select("group_name", "rule_set", F.lit(None).cast("int").alias("rule_idx"),
                F.lit("rule set id is not unique").alias("problem"))
    )
    return reduce(DataFrame.unionByName,
                  [df.where("problem is not null") for df in (values, regexes, double_sets, double_groups, clash)])
