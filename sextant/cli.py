"""The command line over the engine: a ranked change-risk report, a profile of timings, and the structural checks.

Exit codes: 0 passed, 1 usage or failure, 2 over a threshold or violations.
"""

from __future__ import annotations

import math
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .operators import crap, gates, profile, source
from .sources import coverage, gitstatus, listing, timings

GATES = list(render.SUMMARIES)
WHOLE = {"unused-code", "unused-files"}
STRICT = {"magic-constants", "test-assertions", "folder-structure"}
USAGE = f"""usage: python -m sextant [--changed] [--coverage FILE] [--threshold N] [paths]
       python -m sextant profile --timings FILE [--name PART] [--threshold MS] [--top N] [paths]
       python -m sextant {{{' | '.join(GATES)}}} [options] [paths]
       python -m sextant skill
banned-imports takes --from GLOB --forbid GLOB [--message TEXT], each as often as there are rules.
"""


SKILL = """---
name: sextant
description: Finds risky, slow and badly structured code of a JavaScript or TypeScript project.
---
Run `python -m sextant` in the project for its functions by change risk, the worst first; with coverage in
coverage/coverage-final.json. A score over 8 is worth a test or a simpler function. Exit codes: 0 passed, 1 could not
run, 2 over a threshold.

Run `python -m sextant profile --timings FILE` for where time goes. Means below 30 microseconds are marked `~`: they mostly
measure the measuring. Run a check by its name (`python -m sextant nesting`) before and after a change.
"""


class Usage(Exception):
    """Arguments that the command doesn't take."""


def number(text: str, what: str, least: float = 0, whole: bool = False) -> float:
    """A number as scripts write them: blank is 0, and hexadecimal and Infinity are numbers."""
    t = text.strip()
    try:
        n = float(int(t, 0)) if t.lower().startswith(("0x", "0o", "0b")) else float(t or 0) if "_" not in t else math.nan
    except ValueError:
        n = math.nan
    if math.isnan(n) or n < least or (whole and n != int(n)):
        raise Usage(f"Invalid {what}: {text}")
    return n


def options(args: list[str], takes: set[str], flags: set[str] = frozenset(), strict: bool = True) -> tuple[dict[str, list[str]], list[str]]:
    """Options as `--x v` or `--x=v`, and the paths."""
    out: dict[str, list[str]] = {}
    paths, i = [], 0
    while i < len(args):
        name, eq, value = args[i].partition("=")
        if name in takes:
            if not eq:
                i += 1
                if i >= len(args):
                    raise Usage(f"{name} requires a value")
                value = args[i]
            out.setdefault(name, []).append(value)
        elif args[i] in flags:
            out[args[i]] = []
        elif args[i].startswith("--") and (strict or eq):
            raise Usage(f"Unknown option: {args[i]}")
        else:
            paths.append(args[i])
        i += 1
    return out, paths


def rules_of(o: dict[str, list[str]]) -> list[tuple[str, str, str | None]]:
    """Rules zipped by their place: the n-th message goes with the n-th pair."""
    a, b, notes = (o.get(k, []) for k in ("--from", "--forbid", "--message"))
    if len(a) != len(b):
        raise Usage("--from and --forbid come in pairs")
    return [(x, y, notes[k] if k < len(notes) else None) for k, (x, y) in enumerate(zip(a, b, strict=True))]


def _warn(rows: DataFrame) -> int:
    found = source.failures(rows).collect()
    for r in found:
        print(f"Warning: {r.rel_path}: {r.error}", file=sys.stderr)
    return len(found)


def _files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    return listing.explicit(spark, "", root, paths) if paths else listing.sources(listing.listing(spark, {"": root}))


def analyze(spark: SparkSession, root: str, args: list[str]) -> int:
    o, paths = options(args, {"--coverage", "--threshold"}, {"--changed", "--help", "-h"})
    if "--help" in o or "-h" in o:
        print(USAGE, end="")
        return 0
    threshold = number(o.get("--threshold", ["8"])[-1], "threshold")
    files = _files(spark, root, paths)
    if "--changed" in o:
        files = files.join(gitstatus.changed(gitstatus.read(spark, root)), "rel_path", "left_semi")
    if files.isEmpty():
        print("No source files found.")
        return 0
    rows = source.parsed(listing.read(files))
    path = o.get("--coverage", [os.path.join(root, "coverage", "coverage-final.json")])[-1]
    none = spark.createDataFrame([], "project string, rel_path string, start_line int, end_line int, hits long")
    st = none
    if os.path.isfile(path):
        st = coverage.read(spark, path, os.path.abspath(root)).withColumn("project", F.lit("")).select(*none.columns)
    else:
        print(f"Warning: no coverage at {path}", file=sys.stderr)
    failed = _warn(rows)
    ranked = crap.ranked(source.crap_metrics(rows, st), "rel_path", "start_line", "method_id")
    text, passed = render.crap_report(ranked.toLocalIterator(), threshold, failed)
    print(text, end="")
    return 0 if passed else 2


def run_profile(spark: SparkSession, root: str, args: list[str]) -> int:
    o, paths = options(args, {"--timings", "--name", "--threshold", "--top"})
    limit = number(o["--threshold"][-1], "threshold") if "--threshold" in o else None
    top = int(number(o["--top"][-1], "top", 1, True)) if "--top" in o else 20
    if "--timings" not in o:
        raise Usage("--timings is required: running tests is left to the caller, see source.instrumented")
    found = timings.read(spark, o["--timings"][-1])
    rows = source.parsed(listing.read(_files(spark, root, paths)))
    inventory = source.methods(rows).select(F.col("rel_path").alias("file"), F.col("name").alias("method"), F.col("start_line").alias("line"), "method_id")
    if "--name" in o:
        inventory = inventory.filter(F.col("method").contains(o["--name"][-1]))
    got = profile.attributed(found, inventory, ["file", "method"]).persist()
    totals = profile.over_threshold(got, math.inf if limit is None else limit).first()
    hottest = lambda n: profile.hottest(got, n, "file", "line", "method_id")
    print(render.profile_report(hottest(top).toLocalIterator(), totals, limit), end="")
    stamp = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    render.write_profile(lambda: hottest(0).toLocalIterator(), totals, os.path.join(root, "profile-reports"), stamp)
    return 2 if totals.over_threshold else 0


def findings(spark: SparkSession, gate: str, files: DataFrame, everything: DataFrame, rules: list[tuple[str, str, str | None]]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Violations of a check in files, what it checked, and the parser's rows."""
    if gate == "file-naming":
        return source.file_naming(files), files, None
    rows = source.parsed(listing.read(files) if "content" not in files.columns else files)
    run = {
        "nesting": lambda: (source.nesting(rows), source.methods(rows)),
        "class-size": lambda: (source.class_size(rows), source.classes(rows)),
        "weight-of-class": lambda: (source.weight_of_class(rows), source.classes(rows)),
        "unused-code": lambda: (source.unused_code(rows), source.declarations(rows)),
        "unused-files": lambda: (source.unused_files(rows, files, everything), files),
        "banned-imports": lambda: (source.banned_imports(rows, everything, rules), files),
        "magic-constants": lambda: (source.magic_constants(rows), files),
        "test-assertions": lambda: (source.test_assertions(rows), source.tests(rows)),
    }
    return *run[gate](), rows


def check(spark: SparkSession, gate: str, root: str, args: list[str]) -> int:
    o, paths = options(args, {"--from", "--forbid", "--message"} if gate == "banned-imports" else set(), strict=gate in STRICT) if gate in STRICT or gate == "banned-imports" else ({}, args)
    rules = rules_of(o)
    if gate in WHOLE and paths:
        print(f"{gate} needs the whole project: skipped for a selection of paths.")
        return 0
    if gate == "banned-imports" and not rules:
        print("No rules given.")
        return 0
    everything = listing.listing(spark, {"": root})
    if gate == "folder-structure":
        if paths:
            raise Usage("folder-structure takes no arguments")
        text, code = render.gate_report(gate, source.folder_structure(listing.loose(everything)), int(os.path.isdir(os.path.join(root, "src"))))
        print(text, end="")
        return code
    if gate == "test-assertions":
        files = listing.explicit(spark, "", root, paths, tests=True) if paths else listing.test_files(everything)
    else:
        files = listing.gate_files(listing.explicit(spark, "", root, paths) if paths else everything)
    if gate == "banned-imports":
        files = gates.ruled(files, [(source.glob_pattern(a), b, n) for a, b, n in rules], F.col("rel_path"))
    if files.isEmpty():
        print("No source files to check.")
        return 0
    violations, checked, rows = findings(spark, gate, files, everything, rules)
    try:
        if rows is not None and _warn(rows):
            return 1
        text, code = render.gate_report(gate, violations, checked.count(), len(rules))
    finally:
        if rows is not None:
            rows.unpersist()
    print(text, end="")
    return code


def main(args: list[str], root: str = ".", spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("sextant").getOrCreate()
    try:
        if args[:1] == ["skill"]:
            print(SKILL + "To install: mkdir -p .agents/skills/sextant && python -m sextant skill > .agents/skills/sextant/SKILL.md")
            return 0
        if args[:1] == ["profile"]:
            return run_profile(spark, root, args[1:])
        if args and args[0] in GATES:
            return check(spark, args[0], root, args[1:])
        return analyze(spark, root, args)
    except (Usage, OSError) as e:
        print(e, file=sys.stderr)
        return 1
