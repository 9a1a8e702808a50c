"""Structural checks as joins, aggregates, windows and anti-joins over tables of syntax nodes and paths.

Every check gives violations (its key columns, line where there is one, message); summary() counts them against what was
checked. Keys are column names such as ["project", "rel_path"]; no join or group crosses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ALLOWED_STEMS, GENERIC_STEMS, basename, stem

# Limits of the checks.
MAX_NESTING, MAX_METHODS, MAX_WMC, MAX_WEIGHT = 5, 25, 80, 0.33
MIN_DUPLICATES, MIN_LITERAL, MIN_ASSERTIONS, MAX_LOOSE = 3, 4, 1, 0
HEX_COLOR = r"^0[xX][0-9a-fA-F]{6,8}\z"


def summary(checked: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: checked, violations, exit_code (2 if there are any)."""
    n = violations.agg(F.count("*").alias("n")).scalar()
    return checked.agg(F.count("*").alias("checked")).select("checked", n.alias("violations"), F.when(n > 0, 2).otherwise(0).alias("exit_code"))


def naming(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Files with generic names, or with a numeric suffix that isn't a term; generic wins, a file is named once."""
    s, name = stem(F.col(path)), basename(F.col(path))
    generic = F.concat(F.lit('generic name "'), name, F.lit('" — split by domain instead of accumulating unrelated declarations'))
    numeric = F.concat(F.lit('numeric suffix in "'), name, F.lit('" — split by domain instead of numbered parts (batch1, part2, v2 ...)'))
    message = F.when(s.isin(GENERIC_STEMS), generic).when(s.rlike(r"[a-z_][0-9]+\z") & ~s.isin(ALLOWED_STEMS), numeric)
    return files.withColumn("message", message).filter("message is not null")


def nesting(methods: DataFrame, most: int = MAX_NESTING) -> DataFrame:
    """Methods nested deeper than the limit."""
    text = F.concat("name", F.lit(" nesting="), F.col("nesting").cast("string"), F.lit(f" > max {most}"))
    return methods.filter(F.col("nesting") > most).withColumn("message", text)


def class_totals(classes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """classes with methods and wmc, the sum of their complexities; a class without concrete methods has 0 of each."""
    t = members.groupBy(*keys).agg(F.count("*").alias("methods"), F.sum("complexity").alias("wmc"))
    return classes.join(t, keys, "left").fillna(0, ["methods", "wmc"])


def class_size(totals: DataFrame, name: Column, most: int = MAX_METHODS, wmc: int = MAX_WMC) -> DataFrame:
    """A row for each limit that a class is over: methods first, then weighted methods."""
    many = F.when(F.col("methods") > most, F.concat(name, F.lit(" has "), F.col("methods").cast("string"), F.lit(f" methods > max {most}")))
    heavy = F.when(F.col("wmc") > wmc, F.concat(name, F.lit(" WMC="), F.col("wmc").cast("string"), F.lit(f" > max {wmc}")))
    return totals.select("*", F.posexplode(F.array(many, heavy)).alias("limit", "message")).filter("message is not null")


def class_weight(classes: DataFrame, members: DataFrame, keys: list[str], is_field: Column, is_method: Column) -> DataFrame:
    """classes with fields, members and weight: public fields against fields and concrete methods; 0 without any."""
    t = members.groupBy(*keys).agg(F.count_if(is_field).alias("fields"), F.count_if(is_field | is_method).alias("members"))
    out = classes.join(t, keys, "left").fillna(0, ["fields", "members"])
    return out.withColumn("weight", F.when(F.col("members") > 0, F.col("fields") / F.col("members")).otherwise(F.lit(0.0)))


def data_heavy(weights: DataFrame, most: float = MAX_WEIGHT) -> DataFrame:
    return weights.filter((F.col("fields") > 0) & (F.col("weight") > most))


def unreferenced(declarations: DataFrame, identifiers: DataFrame, keys: list[str]) -> DataFrame:
    """Declarations whose name occurs once among the identifiers of their key."""
    once = identifiers.groupBy(*keys).agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return declarations.join(once, keys, "left_semi")


def never_imported(files: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Files that no resolved import leads to."""
    return files.join(targets.select(*keys).distinct(), keys, "left_anti")


def resolved(imports: DataFrame, listing: DataFrame, ids: list[str], keys: list[str], candidates: Column, path: str) -> DataFrame:
    """imports, told apart by ids, with resolved: the first candidate that is in the listing (keys, path); null if none is.

    Candidates are unfolded with their order and meet the listing in a hash join; the least order wins."""
    c = imports.select(*ids, F.posexplode(candidates).alias("_at", path)).join(listing.select(*keys, path).distinct(), [*keys, path], "left_semi")
    first = c.groupBy(*ids).agg(F.min_by(path, "_at").alias("resolved"))
    return imports.join(first, ids, "left")


def banned(imports: DataFrame, rules: list[tuple[str, str, str | None]], file: Column, targets: list[Column]) -> DataFrame:
    """imports with rule, the first rule (source pattern, forbidden pattern, note) that bans them; others are dropped.

    Rules come from the command line, so they are a chain of literal patterns, compiled once, and no join."""
    hit = F.lit(None).cast("int")
    for k, (source, forbidden, _) in reversed(list(enumerate(rules))):
        bad = F.lit(False)
        for t in targets:
            bad = bad | F.coalesce(t.rlike(forbidden), F.lit(False))
        hit = F.when(file.rlike(source) & bad, F.lit(k)).otherwise(hit)
    return imports.withColumn("rule", hit).filter("rule is not null")


def ruled(files: DataFrame, rules: list[tuple[str, str, str | None]], file: Column) -> DataFrame:
    """Files that at least one rule applies to."""
    some = F.lit(False)
    for source, _, _ in rules:
        some = some | file.rlike(source)
    return files.filter(some)


def repeated(literals: DataFrame, keys: list[str], least: int = MIN_DUPLICATES) -> DataFrame:
    """Every occurrence of a value that occurs often enough in its key, with occurrences."""
    own = Window.partitionBy(*keys)
    return literals.withColumn("occurrences", F.count("*").over(own)).filter(F.col("occurrences") >= least)


def without_assertions(tests: DataFrame, assertions: DataFrame, keys: list[str], least: int = MIN_ASSERTIONS) -> DataFrame:
    """Tests with fewer assertions than the least, with their number."""
    n = assertions.groupBy(*keys).agg(F.count("*").alias("assertions"))
    return tests.join(n, keys, "left").fillna(0, ["assertions"]).filter(F.col("assertions") < least)
