"""Queries over a small corpus of source code of our own, with hand-derived rows as their SQL.

They run the parser and every check for real; the driver's tables have no source code to run them on.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..operators import crap, gates, profile, source
from .. import cli, render
from ..sources import gitstatus, listing, timings

CORPUS: dict[str, str] = {
    "src/mixed.js": """\
export function mixed(a, b) {
  let r = 0;
  if (a > 0) r++;
  if (b > 0) r++;
  for (let i = 0; i < 10; i++) r += i;
  const c = a > b ? 1 : 0;
  return r + c && a && b;
}
export function everything(o) {
  let r = 0;
  while (r < 5) r++;
  do { r++; } while (r < 9);
  for (const k in o) r++;
  for (const v of [1, 2]) r++;
  try { r--; } catch (e) { r++; }
  switch (r) { case 1: r++; break; case 2: r++; break; default: r++; }
  return r ?? o?.x;
}
""",
    "src/names.jsx": """\
const g = (x) => x && 1;
a.b = function () { if (x) return 1; };
a['k'] = () => 0;
this.x = () => 1;
const o = { m() { return 1; }, k: () => 2, 's'() {}, ...p };
class Box extends Base {
  constructor() { super(); }
  #hid() { return 1; }
  static get size() { return this.n ? 1 : 0; }
  run = () => 1;
}
function outer() {
  function inner() { if (a) return 1; if (b) return 2; }
  items.map((i) => (i ? 1 : 2));
  return <p onClick={() => a || b}>it's {outer} &amp; <b/></p>;
}
export default function () {}
""",
    "src/typed.ts": """\
interface Shape { kind: 'round' | 'square'; area(): number }
type Pair<T> = [T, T];
function over(a: string): void;
function over(a: any): any { return a as unknown as string; }
export abstract class Store<T extends object> implements Shape {
  private items: Map<string, Array<T>> = new Map();
  constructor(private readonly size: number) { super(); }
  abstract area(): number;
  get(key: string): T | undefined { return this.items.get(key) ?? undefined; }
}
export const pick = async <T,>(xs: T[], i = 0): Promise<T> => xs[i]!;
""",
    "src/deep.js": """\
function deep(a) {
  if (a) { for (;;) { while (a) { try { switch (a) { case 1: if (a) { b(); } } } catch (e) {} } } }
}
function flat(a) { return a; }
function chain(a) { if (a) {} else if (b) {} else if (c) {} }
""",
    "src/dead.js": """\
'use strict';
import { used } from './deep.js';
const alive = 1, dead = 2;
function gone() {}
class Lost {}
export const shown = alive + used;
const { ignored } = alive;
""",
    "src/data.js": """\
export class Data { a = 1; b = 2; #c = 3; static d = 4; get() { return this.a; } }
export class Calm { a = 1; one() {} two() {} three() {} }
export const C = class { m() { return class Inner { n() {} }; } };
""",
    "src/magic.js": """\
const ROOF = 0x8a4b2c;
const moor = 'heather', fen = wade('heather'), tarn = ['heather'];
paint(0x5d7fa1ff, wall);
let gate = 0x204060;
tide(1440.5, 'ebb'); tide(1440.5, 'ebb'); tide('ebb');
wade('heather'); wade(`heather`); tide(1440.5); wade("heather");
wade(map['low-road'], { 'low-road': 2 }); switch (map) { case 'low-road': wade('low-road'); }
""",
    "src/main.js": """\
const b = require('./lib');
import('./mixed.js').then((m) => m);
export * from './names';
import x from 'lodash';
export { y } from '../db/pool.js';
""",
    "src/lib/index.js": "export const lib = 1;\n",
    "src/utils.js": "export const u = 1;\n",
    "src/batch1.js": "export const v = 1;\n",
    "src/base64.js": "export const w = 1;\n",
    "src/broken.js": "}}}\n",
    "test/one.test.js": """\
import assert, { ok as fine } from 'node:assert';
test('empty', () => {});
it('plain', () => { assert.equal(1, 1); });
test.skip('renamed', { skip: true }, function () { fine(1); });
test('context', (t) => { t.assert.ok(1); }, { timeout: 5 });
test('other', (t) => { u.assert.ok(1); });
describe('group', () => { it(`x`, async () => { expect(1); }); });
test.todo('later');
""",
    "db/pool.js": "export const y = 1;\n",
}


def files(spark: SparkSession) -> DataFrame:
    """The corpus as listed files with contents."""
    df = spark.createDataFrame([("p", k, v) for k, v in CORPUS.items()], "project string, rel_path string, content string")
    return df.withColumn("ext", extension(F.col("rel_path")))


def _rows(spark: SparkSession, keep: Callable[[DataFrame], DataFrame] = listing.gate_files) -> DataFrame:
    return source.parsed(keep(files(spark)))


REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _values(columns: str, rows: list[tuple], types: tuple[str, ...]) -> str:
    """Hand-derived rows as SQL."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
    cast = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns.split(", "), types, strict=True))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({columns})"


def golden(columns: str, types: str, rows: list[tuple]):
    """Registers a query with the rows it must give."""

    def add(f: Callable[[SparkSession], DataFrame]):
        sql = _values(columns, rows, tuple(types.split(", ")))
        REGISTERED[f.__name__] = (lambda spark, _d: f(spark).select(*columns.split(", "))), sql
        return f

    return add


@golden("rel_path, name, start_line, end_line, complexity, nesting", "VARCHAR, VARCHAR, INT, INT, INT, INT", [
    ("src/mixed.js", "mixed", 1, 8, 7, 2), ("src/mixed.js", "everything", 9, 18, 9, 2),
    ("src/names.jsx", "g", 1, 1, 2, 1), ("src/names.jsx", "a.b", 2, 2, 2, 2), ("src/names.jsx", "a.<anon>", 3, 3, 1, 1), ("src/names.jsx", "<anonymous>.x", 4, 4, 1, 1),
    ("src/names.jsx", "m", 5, 5, 1, 1), ("src/names.jsx", "k", 5, 5, 1, 1), ("src/names.jsx", "<anonymous>", 5, 5, 1, 1), ("src/names.jsx", "Box.#hid", 8, 8, 1, 1), ("src/names.jsx", "Box.size", 9, 9, 2, 1),
    ("src/names.jsx", "outer", 12, 16, 3, 2), ("src/names.jsx", "inner", 13, 13, 3, 2), ("src/names.jsx", "<anonymous>", 17, 17, 1, 1),
    ("src/typed.ts", "over", 4, 4, 1, 1), ("src/typed.ts", "Store.get", 9, 9, 1, 1), ("src/typed.ts", "pick", 11, 11, 1, 1),
    ("src/deep.js", "deep", 1, 3, 7, 7), ("src/deep.js", "flat", 4, 4, 1, 1), ("src/deep.js", "chain", 5, 5, 4, 4),
    ("src/dead.js", "gone", 4, 4, 1, 1),
    ("src/data.js", "Data.get", 1, 1, 1, 1), ("src/data.js", "Calm.one", 2, 2, 1, 1), ("src/data.js", "Calm.two", 2, 2, 1, 1), ("src/data.js", "Calm.three", 2, 2, 1, 1), ("src/data.js", "m", 3, 3, 1, 1), ("src/data.js", "Inner.n", 3, 3, 1, 1),
])
def code_methods(spark: SparkSession) -> DataFrame:
    return source.methods(_rows(spark))


@golden("rel_path, name, complexity, coverage, crap_score", "VARCHAR, VARCHAR, INT, DOUBLE, DOUBLE", [
    ("src/deep.js", "deep", 7, 0.0, 56.0), ("src/deep.js", "flat", 1, 1.0, 1.0), ("src/deep.js", "chain", 4, None, None),
])
def code_crap(spark: SparkSession) -> DataFrame:
    statements = spark.createDataFrame([("p", "src/deep.js", 2, 2, 0), ("p", "src/deep.js", 4, 4, 3), ("p", "src/deep.js", None, 5, 1)], "project string, rel_path string, start_line int, end_line int, hits long")
    rows = source.parsed(files(spark).filter("rel_path = 'src/deep.js'"))
    return crap.ranked(source.crap_metrics(rows, statements), *source.KEYS, "start_line")


@golden("rel_path, failed", "VARCHAR, BOOLEAN", [("src/broken.js", True)])
def code_failures(spark: SparkSession) -> DataFrame:
    return source.failures(_rows(spark)).withColumn("failed", F.col("error").isNotNull())


@golden("rel_path, line, message", "VARCHAR, INT, VARCHAR", [("src/deep.js", 1, "deep nesting=7 > max 5")])
def code_nesting(spark: SparkSession) -> DataFrame:
    return source.nesting(_rows(spark))


@golden("rel_path, name, methods, wmc", "VARCHAR, VARCHAR, BIGINT, BIGINT", [
    ("src/names.jsx", "Box", 2, 3), ("src/typed.ts", "Store", 1, 1), ("src/dead.js", "Lost", 0, 0), ("src/data.js", "Data", 1, 1), ("src/data.js", "Calm", 3, 3), ("src/data.js", "<anonymous>", 1, 1), ("src/data.js", "Inner", 1, 1),
])
def code_class_totals(spark: SparkSession) -> DataFrame:
    return source.class_totals(_rows(spark))


@golden("rel_path, line, message", "VARCHAR, INT, VARCHAR", [("src/big.js", 1, "Big has 26 methods > max 25"), ("src/big.js", 1, "Big WMC=86 > max 80")])
def code_class_size(spark: SparkSession) -> DataFrame:
    body = " ".join(f"m{i}() {{}}" for i in range(25)) + " last() { " + "if (a) b(); " * 60 + "}"
    big = spark.createDataFrame([("p", "src/big.js", "js", f"class Big {{ {body} }}")], "project string, rel_path string, ext string, content string")
    return source.class_size(source.parsed(big))


@golden("rel_path, line, message", "VARCHAR, INT, VARCHAR", [("src/names.jsx", 6, "Box data weight 0.5 > max 0.33"), ("src/data.js", 1, "Data data weight 0.67 > max 0.33"), ("src/typed.ts", 5, "Store data weight 0.5 > max 0.33")])
def code_weight(spark: SparkSession) -> DataFrame:
    return source.weight_of_class(_rows(spark))


@golden("rel_path, line, message", "VARCHAR, INT, VARCHAR", [
    ("src/dead.js", 3, "dead is never referenced in the module"), ("src/dead.js", 4, "gone is never referenced in the module"), ("src/dead.js", 5, "Lost is never referenced in the module"),
    ("src/names.jsx", 1, "g is never referenced in the module"), ("src/names.jsx", 5, "o is never referenced in the module"), ("src/names.jsx", 6, "Box is never referenced in the module"),
    ("src/deep.js", 1, "deep is never referenced in the module"), ("src/deep.js", 4, "flat is never referenced in the module"), ("src/deep.js", 5, "chain is never referenced in the module"),
    ("src/magic.js", 1, "ROOF is never referenced in the module"), ("src/magic.js", 2, "moor is never referenced in the module"), ("src/magic.js", 2, "fen is never referenced in the module"),
    ("src/magic.js", 2, "tarn is never referenced in the module"), ("src/magic.js", 4, "gate is never referenced in the module"), ("src/main.js", 1, "b is never referenced in the module"),
])
def code_unused(spark: SparkSession) -> DataFrame:
    return source.unused_code(_rows(spark))


@golden("rel_path, specifier, resolved", "VARCHAR, VARCHAR, VARCHAR", [
    ("src/dead.js", "./deep.js", "src/deep.js"), ("src/main.js", "./lib", "src/lib/index.js"), ("src/main.js", "./mixed.js", "src/mixed.js"), ("src/main.js", "./names", "src/names.jsx"), ("src/main.js", "lodash", None), ("src/main.js", "../db/pool.js", "db/pool.js"),
])
def code_imports(spark: SparkSession) -> DataFrame:
    return source.resolved_imports(_rows(spark), files(spark))


@golden("rel_path, message", "VARCHAR, VARCHAR", [(f"src/{n}", "never imported by any analyzed source file") for n in ("typed.ts", "dead.js", "data.js", "magic.js", "main.js", "utils.js", "batch1.js", "base64.js", "broken.js")])
def code_unused_files(spark: SparkSession) -> DataFrame:
    return source.unused_files(_rows(spark), listing.gate_files(files(spark)), files(spark))


@golden("rel_path, message", "VARCHAR, VARCHAR", [("src/main.js", "import ../db/pool.js is banned for src/main.js — layers"), ("src/main.js", "import lodash is banned for src/main.js")])
def code_banned(spark: SparkSession) -> DataFrame:
    rules = [("src/**", "db/**", "layers"), ("src/*.js", "lodash", None), ("src/**", "lo*", "late"), ("lib/**", "**", None)]
    return source.banned_imports(_rows(spark), files(spark), rules)


@golden("rel_path, line, message", "VARCHAR, INT, VARCHAR", _MAGIC := [("src/magic.js", 3, "hex color outside a constant declaration"), ("src/magic.js", 4, "hex color outside a constant declaration")]
    + [("src/magic.js", 6, "literal heather repeats 3 times — extract a named constant")] * 3 + [("src/magic.js", k, "literal 1440.5 repeats 3 times — extract a named constant") for k in (5, 5, 6)])
def code_magic(spark: SparkSession) -> DataFrame:
    return source.magic_constants(_rows(spark))


@golden("rel_path, line, message", "VARCHAR, INT, VARCHAR", [("test/one.test.js", line, f"'{name}' has 0 assertion(s) — a test without assertions verifies nothing") for line, name in ((2, "empty"), (6, "other"), (7, "it"))])
def code_test_assertions(spark: SparkSession) -> DataFrame:
    return source.test_assertions(_rows(spark, listing.test_files))


@golden("rel_path, message", "VARCHAR, VARCHAR", [("src/utils.js", 'generic name "utils.js" — split by domain instead of accumulating unrelated declarations'), ("src/batch1.js", 'numeric suffix in "batch1.js" — split by domain instead of numbered parts (batch1, part2, v2 ...)')])
def code_naming(spark: SparkSession) -> DataFrame:
    return source.file_naming(listing.gate_files(files(spark)))


@golden("project, message", "VARCHAR, VARCHAR", [("p", "12 loose files directly in src — group them into feature packages (max 0)")])
def code_loose(spark: SparkSession) -> DataFrame:
    return source.folder_structure(listing.loose(files(spark)))


@golden("checked, violations, exit_code", "BIGINT, BIGINT, INT", [(27, 1, 2)])
def code_summary(spark: SparkSession) -> DataFrame:
    rows = _rows(spark)
    return gates.summary(source.methods(rows), source.nesting(rows))


@golden("rel_path, content", "VARCHAR, VARCHAR", [
    ("src/i.js", "// é\nfunction f() {const __sextant_start = performance.now(); try { return () => 1; } finally { __sextant_record({ key: \"src/i.js|f\", since: __sextant_start }); }}\nfunction empty() {}\n"), ("src/bad.js", "}}}"),
])
def code_instrumented(spark: SparkSession) -> DataFrame:
    text = spark.createDataFrame([("p", "src/i.js", "js", "// é\nfunction f() { return () => 1; }\nfunction empty() {}\n"), ("p", "src/bad.js", "js", "}}}")], "project string, rel_path string, ext string, content string")
    return source.instrumented(source.parsed(text), text)


def _source(spark: SparkSession, **texts: str) -> DataFrame:
    """Source files of project p under src."""
    return spark.createDataFrame([("p", f"src/{k}.js", "js", v) for k, v in texts.items()], "project string, rel_path string, ext string, content string")


def _numbered(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in their order, numbered from 1; for what is told line by line."""
    rows = [(n, *(r[c] for c in columns)) for n, r in enumerate(df.collect(), 1)]
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame(rows, ", ".join(["n int", *(f"{c} {kinds[c]}" for c in columns)]))


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "n int, line string")


@golden("name, message", "VARCHAR, VARCHAR", [
    (f"W{k}", f"W{k} data weight {text} > max 0.33") for k, text in enumerate(("0.42", "0.34", "0.38", "0.5", "1.0", "0.67"))
])
def code_weight_text(spark: SparkSession) -> DataFrame:
    """Quotients halfway between two hundredths are rounded by their exact binary values: 17/40 and 69/200 lie below, 3/8 is exact."""
    text = " ".join(f"class W{k} {{ {' '.join(f'f{i} = 1;' for i in range(f))} {' '.join(f'm{i}() {{}}' for i in range(m))} }}" for k, (f, m) in enumerate(((17, 23), (69, 131), (3, 5), (1, 1), (2, 0), (2, 1))))
    w = source.weight_of_class(source.parsed(_source(spark, w=text)))
    return w.withColumn("name", F.substring_index("message", " ", 1))


_TWENTY_SIX = " ".join(f"m{i}() {{}}" for i in range(26))


@golden("n, rel_path, line, message", "INT, VARCHAR, INT, VARCHAR", [
    (1, "src/a.js", 1, "Also has 26 methods > max 25"), (2, "src/z.js", 1, "Late has 26 methods > max 25"), (3, "src/z.js", 1, "Late WMC=106 > max 80"), (4, "src/z.js", 2, "Early has 26 methods > max 25"),
])
def code_emission_classes(spark: SparkSession) -> DataFrame:
    """Classes of a file in the order of its text, not of their names; methods before weighted methods."""
    heavy = _TWENTY_SIX.replace("m0() {}", "m0() { " + "if (a) b(); " * 80 + "}")
    rows = source.parsed(_source(spark, z=f"class Late {{ {heavy} }}\nclass Early {{ {_TWENTY_SIX} }}", a=f"class Also {{ {_TWENTY_SIX} }}"))
    return _numbered(render.in_order(source.class_size(rows)), "rel_path", "line", "message")


@golden("n, rel_path, line, message", "INT, VARCHAR, INT, VARCHAR", [
    (k, *_MAGIC[i]) for k, i in enumerate((0, 1, 2, 3, 4, 5, 6, 7), 1)
])
def code_emission_literals(spark: SparkSession) -> DataFrame:
    """Colours first, then values by their first occurrence, though that is in a const, each with its occurrences in order."""
    return _numbered(render.in_order(source.magic_constants(_rows(spark))), "rel_path", "line", "message")


@golden("rel_path", "VARCHAR", [("src/lib/index.js",), ("src/names.jsx",), ("src/typed.ts",)])
def code_ruled(spark: SparkSession) -> DataFrame:
    """Files that a rule applies to."""
    rules = [(source.glob_pattern(a), "", None) for a in ("src/lib/**", "src/*.?s?", "**/typed.*")]
    return gates.ruled(listing.gate_files(files(spark)), rules, F.col("rel_path"))


@golden("file, method, calls, total_micros, min_micros, max_micros", "VARCHAR, VARCHAR, BIGINT, BIGINT, BIGINT, BIGINT", [("src/a|b.js", "run", 3, 90, 10, 50), ("src/c.js", "<anonymous>", 1, 5, 5, 5)])
def code_timings(spark: SparkSession) -> DataFrame:
    """Timing documents: a key's last bar divides; text that is no JSON has no rows."""
    texts = ['{"src/a|b.js|run": {"calls": 3, "totalMicros": 90, "minMicros": 10, "maxMicros": 50}}', "[", '{"src/c.js|<anonymous>": {"calls": 1, "totalMicros": 5, "minMicros": 5, "maxMicros": 5}}']
    return timings.unpacked(spark.createDataFrame([(t,) for t in texts], "value string"))


_HEAD = "Method                         File                                  CC    Cov%     CRAP"


@golden("n, line", "INT, VARCHAR", list(enumerate([
    "CRAP Report", "===========", _HEAD, "-" * len(_HEAD),
    "deep                           src/deep.js                            7    0.0%     56.0",
    "flat                           src/deep.js                            1  100.0%      1.0",
    "chain                          src/deep.js                            4     N/A      N/A",
    "", "Max CRAP: 56.0 (threshold 8.0) — FAILED", "Parse failures: 2 file(s) — see warnings above.",
], 1)))
def code_report(spark: SparkSession) -> DataFrame:
    """The ranked report as text."""
    return _lines(spark, render.crap_report(code_crap(spark).toLocalIterator(), 8.0, 2)[0])


_PROFILE_HEAD = " TOTAL(ms)      %  CALLS   MEAN(µs)   MAX(µs)  @60fps(ms) METHOD                         FILE:LINE"


@golden("n, line", "INT, VARCHAR", list(enumerate([
    "Profile Report (3 methods, total 1.01ms)", _PROFILE_HEAD, "-" * len(_PROFILE_HEAD),
    "      0.90  88.7%      2      450.0       500       27.00 slow                           src/b.js:5",
    "      0.10   9.9%     10      ~10.0        20        0.60 fast                           src/a.js:1",
    "Full report: profile-reports/ (txt + json)", "Threshold: 0.50ms — 1 method(s) exceed",
], 1)))
def code_profile(spark: SparkSession) -> DataFrame:
    """The table of the two hottest functions, a mean below the noise floor marked, and the threshold's line."""
    t = spark.createDataFrame([("src/a.js", "fast", 1, 10, 100, 20), ("src/b.js", "slow", 5, 2, 900, 500), ("src/c.js", "rare", 9, 1, 15, 15)], "file string, method string, line int, calls long, total_micros long, max_micros long")
    return _lines(spark, render.profile_report(profile.hottest(t, 2, "file").collect(), profile.over_threshold(t, 0.5).first(), 0.5))


@golden("n, source, forbidden, note", "INT, VARCHAR, VARCHAR, VARCHAR", [(1, "a/**", "b/**", "first"), (2, "c", "d", None)])
def code_rules(spark: SparkSession) -> DataFrame:
    """Rules from options: the n-th note goes with the n-th pair."""
    o, _ = cli.options(["--from", "a/**", "--forbid=b/**", "--message", "first", "--forbid", "d", "--from=c"], {"--from", "--forbid", "--message"})
    return spark.createDataFrame([(n, *r) for n, r in enumerate(cli.rules_of(o), 1)], "n int, source string, forbidden string, note string")


@golden("given, value", "VARCHAR, DOUBLE", [("8", 8.0), (" 0.5 ", 0.5), ("", 0.0), ("0x10", 16.0), ("1e2", 100.0), ("-1", None), ("x", None), ("1_0", None)])
def code_numbers(spark: SparkSession) -> DataFrame:
    """Numbers of options; null where they are refused."""

    def one(text: str) -> float | None:
        try:
            return cli.number(text, "threshold")
        except cli.Usage:
            return None

    return spark.createDataFrame([(t, one(t)) for t in ("8", " 0.5 ", "", "0x10", "1e2", "-1", "x", "1_0")], "given string, value double")


_GATES: dict[str, tuple[str, int]] = {
    "file-naming": ("2/13 files with mechanical names", 2), "nesting": ("1/27 methods nested deeper than 5", 2), "class-size": ("7 classes within 25 methods/WMC 80", 0), "weight-of-class": ("3/7 classes over weight 0.33", 2),
    "unused-code": ("15 unused declarations in 18 module-scope declarations", 2), "unused-files": ("9/13 files never imported", 2), "banned-imports": ("2 banned import(s) in 13 files", 2),
    "magic-constants": ("8 magic constant(s) in 13 files", 2), "test-assertions": ("3/6 tests without assertions", 2), "folder-structure": ("1 directory(ies) with loose-file sprawl", 2),
}


@golden("gate, summary, exit_code", "VARCHAR, VARCHAR, INT", [(k, *v) for k, v in _GATES.items()])
def code_gates(spark: SparkSession) -> DataFrame:
    """The last line and exit code of every check, with the units it counts."""
    every, out = files(spark), []
    rules = [("src/**", "db/**", "layers"), ("src/*.js", "lodash", None)]
    for gate in _GATES:
        if gate == "folder-structure":
            bad, n = source.folder_structure(listing.loose(every)), 1
        else:
            bad, checked, _ = cli.findings(spark, gate, listing.test_files(every) if gate == "test-assertions" else listing.gate_files(every), every, rules)
            n = checked.count()
        text, code = render.gate_report(gate, bad, n, len(rules))
        out.append((gate, text.splitlines()[-1], code))
    return spark.createDataFrame(out, "gate string, summary string, exit_code int")


def _folder(texts: dict[str, str | bytes]) -> str:
    """A folder with files, which goes when the driver ends. All executors must see it: on a cluster, TMPDIR has to be shared."""
    root = tempfile.mkdtemp(prefix="sextant-")
    atexit.register(shutil.rmtree, root, True)
    for p, text in texts.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return root


@golden("kind, rel_path", "VARCHAR, VARCHAR", [
    *(("all", p) for p in ("readme.md", "src/a.js", "src/a.test.js", "src/sub/b.tsx", "test/t.js")), ("gates", "src/a.js"), ("gates", "src/sub/b.tsx"), ("tests", "src/a.test.js"), ("tests", "test/t.js"),
    ("loose", "src/a.js"), ("loose", "src/a.test.js"), ("explicit", "src/a.js"), ("explicit", "src/sub/b.tsx"), ("explicit tests", "src/a.js"), ("explicit tests", "src/a.test.js"), ("explicit tests", "src/sub/b.tsx"),
])
def code_listing(spark: SparkSession) -> DataFrame:
    """File sets of a folder that is made here."""
    root = _folder({p: "f();\n" for p in ("readme.md", "src/a.js", "src/a.test.js", "src/sub/b.tsx", "src/node_modules/x.js", "test/t.js")})
    every = listing.listing(spark, {"p": root})
    named = ["src", "src/a.js", "nowhere"]
    sets = {"all": every, "gates": listing.gate_files(every), "tests": listing.test_files(every), "loose": listing.loose(every), "explicit": listing.explicit(spark, "p", root, named), "explicit tests": listing.explicit(spark, "p", root, named, tests=True)}
    parts = [df.select(F.lit(k).alias("kind"), "rel_path") for k, df in sets.items()]
    return reduce(DataFrame.unionAll, parts)


@golden("rel_path, ext, content", "VARCHAR, VARCHAR, VARCHAR", [("src/a.js", "js", "é();\n"), ("src/b.ts", "ts", "a\ufffdb"), ("src/c.js", "js", None), ("src/d.js", "js", "")])
def code_read(spark: SparkSession) -> DataFrame:
    """Contents of listed files: bytes that aren't UTF-8 are replaced, a file that went away is null."""
    root = _folder({"src/a.js": "é();\n", "src/b.ts": b"a\xffb", "src/c.js": "gone", "src/d.js": ""})
    found = listing.gate_files(listing.listing(spark, {"p": root}))
    files_ = spark.createDataFrame(found.collect(), found.schema)  # listed before one goes
    os.remove(os.path.join(root, "src/c.js"))
    return listing.read(files_)


@golden("kind, rel_path", "VARCHAR, VARCHAR", [("changed", "src/a.js"), ("changed", "src/new.js"), ("changed", "src/staged.js"), ("staged", "src/staged.js"), ("staged", "tool.mjs")])
def code_git(spark: SparkSession) -> DataFrame:
    """Changed sources and staged scripts of a working tree that is made here."""
    root = _folder({"src/a.js": "1;\n", "src/same.js": "2;\n", "src/gone.js": "3;\n"})
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("-c", "user.name=t", "-c", "user.email=t@example.com", "-c", "commit.gpgsign=false", "commit", "-qm", "x")
    for p in ("src/a.js", "src/new.js", "src/staged.js", "tool.mjs", "src/new.test.js", "notes.txt"):
        with open(os.path.join(root, p), "w") as f:
            f.write("4;\n")
    os.remove(os.path.join(root, "src/gone.js"))
    git("add", "src/staged.js", "tool.mjs")
    changed = gitstatus.changed(gitstatus.read(spark, root)).select(F.lit("changed").alias("kind"), "rel_path")
    return changed.union(gitstatus.staged(spark, root).select(F.lit("staged").alias("kind"), "rel_path"))


_COMMANDS: list[tuple[str, int, str]] = [
    ("skill", 0, "To install: mkdir -p .agents/skills/sextant && python -m sextant skill > .agents/skills/sextant/SKILL.md"),
    ("", 2, "Max CRAP: 30.0 (threshold 8.0) — FAILED"), ("--threshold=30", 0, "Max CRAP: 30.0 (threshold 30.0) — passed"), ("--threshold x", 1, ""), ("--bogus", 1, ""), ("src/none.js", 0, "No source files found."),
    ("profile", 1, ""), ("profile --timings t.json --threshold 1", 2, "Threshold: 1.00ms — 1 method(s) exceed"), ("profile --timings t.json --top 1", 0, "Full report: profile-reports/ (txt + json)"),
    ("file-naming", 2, "1/2 files with mechanical names"), ("file-naming src/sub", 0, "1 files have domain-meaningful names"), ("nesting", 0, "1 methods within nesting 5"), ("class-size", 0, "0 classes within 25 methods/WMC 80"),
    ("weight-of-class", 0, "0 classes within weight 0.33"), ("unused-code", 0, "0 declarations all referenced"), ("unused-code src", 0, "unused-code needs the whole project: skipped for a selection of paths."),
    ("unused-files", 2, "2/2 files never imported"), ("banned-imports", 0, "No rules given."), ("banned-imports --from src/** --forbid lodash", 0, "2 files comply with 1 rule(s)"), ("banned-imports --from a", 1, ""),
    ("magic-constants", 0, "2 files free of magic constants"), ("test-assertions", 2, "1/1 tests without assertions"), ("test-assertions src/sub", 0, "0 tests assert their expectations"), ("test-assertions src/a.test.js", 2, "1/1 tests without assertions"),
    ("folder-structure", 2, "1 directory(ies) with loose-file sprawl"), ("folder-structure x", 1, ""),
]


@golden("command, code, last_line", "VARCHAR, INT, VARCHAR", _COMMANDS)
def code_commands(spark: SparkSession) -> DataFrame:
    """Exit code and last line of the command line's commands in a project that is made here."""
    statement = '{"start": {"line": 1, "column": 0}, "end": {"line": 1, "column": 9}}'
    root = _folder({"src/utils.js": "export const u = 1;\n", "src/sub/big.js": "export function f(a) { if (a) { if (a) { if (a) { if (a) {} } } } }\n", "src/a.test.js": "test('x', () => {});\n", "t.json": '{"src/sub/big.js|f": {"calls": 1, "totalMicros": 1500, "minMicros": 1, "maxMicros": 2}}'})
    os.makedirs(os.path.join(root, "coverage"))
    with open(os.path.join(root, "coverage/coverage-final.json"), "w") as f:
        f.write(f'{{"{root}/src/sub/big.js": {{"statementMap": {{"0": {statement}}}, "s": {{"0": 0}}}}}}')
    out = []
    for command, _, _ in _COMMANDS:
        text = io.StringIO()
        with contextlib.redirect_stdout(text), contextlib.redirect_stderr(io.StringIO()):
            code = cli.main([a.replace("t.json", f"{root}/t.json") for a in command.split()], root, spark)
        out.append((command, code, (text.getvalue().rstrip().splitlines() or [""])[-1]))
    return spark.createDataFrame(out, "command string, code int, last_line string")
