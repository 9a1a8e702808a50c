"""Operators and functions one by one."""

import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant import cli, render
from sextant.functions import paths
from sextant.operators import crap, profile, ranges, source
from sextant.parse.flatten import rows
from sextant.parse.lexer import SyntaxFailure
from sextant.parse.parser import parse
from sextant.sources import coverage, gitstatus, listing, timings
from sextant.streaming import timings as stream


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("cc, cov, want", [(5, 1.0, 5.0), (5, 0.0, 30.0), (8, 0.45, 18.648), (3, None, None)])
def test_crap_formula(spark, cc, cov, want):
    got = spark.createDataFrame([(cc, cov)], "c int, v double").select(crap.crap_score(F.col("c"), F.col("v")).alias("x")).first().x
    assert got == (None if want is None else pytest.approx(want, abs=0.01))


@pytest.mark.parametrize("statements, span, want", [
    ([(5, 5, 3), (6, 6, 0), (7, 7, 1)], (5, 7), 2 / 3), ([(4, 6, 2)], (5, 10), 1.0), ([(100, 100, 5)], (5, 10), None), ([], (1, 10), None), ([(1, 1, 0), (2, 2, 0)], (1, 2), 0.0), ([(1, 1, None)], (1, 1), 0.0), ([(None, 3, 1)], (1, 5), None),
])
def test_coverage_of_a_method(spark, statements, span, want):
    m = spark.createDataFrame([("f", 1, *span)], "rel_path string, method_id int, start_line int, end_line int")
    s = spark.createDataFrame([("f", *x) for x in statements], "rel_path string, start_line int, end_line int, hits long")
    assert crap.method_coverage(m, s, ["rel_path"]).first().coverage == want


def test_overlaps_against_all_pairs(spark):
    r = random.Random(1)
    a = [(r.randrange(3), k, s, s + r.randrange(200)) for k in range(60) for s in [r.randrange(1, 500)]]
    b = [(r.randrange(3), k, s, s + r.randrange(90)) for k in range(60) for s in [r.randrange(1, 500)]]
    left = spark.createDataFrame(a, "f int, i int, start_line int, end_line int")
    right = spark.createDataFrame(b, "f int, j int, other_start int, other_end int")
    got = sorted((x.i, x.j) for x in ranges.overlaps(left, right, ["f"]).collect())
    assert got == sorted((i, j) for f, i, s, e in a for g, j, t, u in b if f == g and u >= s and t <= e)


def test_ranking_and_verdict(spark):
    df = spark.createDataFrame([("low", "a", 1, 2.0), ("z", "z.js", 9, None), ("high", "a", 1, 30.0), ("a5", "a.js", 5, None), ("a2", "a.js", 2, None)], "name string, file string, line int, crap_score double")
    assert [r.name for r in crap.ranked(df, "file", "line").collect()] == ["high", "low", "a2", "a5", "z"]
    assert crap.verdict(df).first() == (5, 30.0, 1, True)
    assert crap.verdict(df.filter("crap_score is null")).first() == (3, 0.0, 0, False)
    assert not crap.verdict(df, 30.0).first().failed


def test_profile(spark):
    t = spark.createDataFrame([("f.js", "fast", 10, 100, 1, 20), ("f.js", "slow", 2, 900, 400, 500), ("f.js", "gone", 1, 5, 5, 5)], "file string, method string, calls long, total_micros long, min_micros long, max_micros long")
    inv = spark.createDataFrame([("f.js", "fast", 1), ("f.js", "slow", 5)], "file string, method string, line int")
    rows = profile.profiled(profile.attributed(t, inv, ["file", "method"]))
    top = profile.hottest(rows, 1, "file", "line").collect()
    assert [(r.method, r.pct, r.noisy) for r in top] == [("slow", 90.0, False)]
    assert profile.over_threshold(rows, 0.5).first().over_threshold == 1
    text = render.profile_report(top, profile.over_threshold(rows, 0.5).first(), 0.5)
    assert "slow" in text and "fast" not in text and "90.0%" in text and "total 1.00ms" in text and "1 method(s) exceed" in text
    assert "~10.0" in render.profile_report(rows.collect(), profile.over_threshold(rows, 0.5).first())


def test_profile_files(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("f.js", "é", 3, 1, 9, 9, 9), ("f.js", "b", 4, 2, 4, 1, 3)], "file string, method string, line int, calls long, total_micros long, min_micros long, max_micros long")
    for k, df in enumerate((rows, rows.limit(0))):
        render.write_profile(df.collect, profile.over_threshold(df, 1.0).first(), str(tmp_path), f"stamp{k}")
        got = json.loads((tmp_path / f"profile-stamp{k}.json").read_text())
        assert [m["method"] for m in got["methods"]] == ["é", "b"][: 2 * (k == 0)] and got["totalMicros"] == 13 * (k == 0) and got["generatedAt"] == f"stamp{k}"
        assert (tmp_path / f"profile-stamp{k}.json").read_text() == json.dumps(got, indent=2, ensure_ascii=False) + "\n"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 1000)), min_size=1, max_size=30))
def test_merging_timings_is_one_aggregate(spark, events):
    df = spark.createDataFrame(events, "k int, process int, micros long")
    whole = profile.timings(df, ["k"]).orderBy("k").collect()
    assert profile.merged(profile.timings(df, ["k", "process"]), ["k"]).orderBy("k").collect() == whole


def naive(glob, text):
    """A glob matched without regular expressions."""
    if not glob:
        return not text
    if glob.startswith("**/") and (naive(glob[3:], text) or any(text[i] == "/" and naive(glob[3:], text[i + 1 :]) for i in range(len(text)))):
        return True
    if glob.startswith("**") and not glob.startswith("**/"):
        return any(naive(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob.startswith("**/"):
        return False
    if glob[0] == "*":
        return naive(glob[1:], text) or (bool(text) and text[0] != "/" and naive(glob, text[1:]))
    return bool(text) and (text[0] != "/" if glob[0] == "?" else glob[0] == text[0]) and naive(glob[1:], text[1:])


@settings(max_examples=300, deadline=None)
@given(st.text("a*?/.", max_size=7), st.text("ab/.", max_size=8))
def test_globs(glob, text):
    import re

    assert bool(re.search(paths.glob_pattern(glob).replace(r"\z", r"\Z"), text)) == naive(glob, text)


@pytest.mark.parametrize("path, want", [("src/a/../b.js", "src/b.js"), ("./src//x", "src/x"), ("a/b/../../c", "c"), ("../x", "../x"), ("a/../../x", "../x"), ("src/./lib", "src/lib")])
def test_normalised(spark, path, want):
    assert one(spark, paths.normalised(F.col("p")), p=path) == want


@pytest.mark.parametrize("path, stem, ext", [("src/a.b1.js", "a.b1", "js"), ("src/.dot", ".dot", ""), ("src/Utils.JS", "utils", "JS"), ("x/y", "y", "")])
def test_names(spark, path, stem, ext):
    assert (one(spark, paths.stem(F.col("p")), p=path), one(spark, paths.extension(F.col("p")), p=path)) == (stem, ext)


@pytest.mark.parametrize("path, file, folder", [("src/a.test.js", True, True), ("src/a.test.mjs", False, False), ("src/__tests__/a.js", True, True), ("test/helper.js", False, True), ("src/testing.js", False, False), ("src/tests/x.js", False, True)])
def test_test_paths(spark, path, file, folder):
    assert (one(spark, paths.is_test_file(F.col("p")), p=path), one(spark, paths.is_test_path(F.col("p")), p=path)) == (file, folder)


def test_utf16_length(spark):
    assert one(spark, paths.utf16_length(F.col("p")), p="🙂🙂🙂") == 6


@pytest.mark.parametrize("x, n, want", [(0.35, 1, "0.3"), (1.005, 2, "1.00"), (0.145, 2, "0.14"), (0.25, 1, "0.3"), (2.0, 1, "2.0"), (0.0, 2, "0.00"), (18.648, 1, "18.6")])
def test_fixed_decimals(x, n, want):
    assert render.to_fixed(x, n) == want


def test_report():
    from pyspark.sql import Row

    m = [Row(name="high", rel_path="a.js", complexity=5, coverage=0.0, crap_score=30.0), Row(name="none", rel_path="b.js", complexity=1, coverage=None, crap_score=None)]
    text, passed = render.crap_report(m, 8.0, 1)
    assert not passed and "Max CRAP: 30.0 (threshold 8.0) — FAILED" in text and text.count("N/A") == 2 and "Parse failures: 1 file(s)" in text
    assert render.crap_report(m, 30.0)[1] and render.crap_report([], 8.0)[1]


@pytest.mark.parametrize("line, want", [("", None), ("??", None), ("abc", None), ("M  src/notes.txt", None), ("M  lib/x.js", None), ("D  src/gone.js", None), ("M  src/a.js", "src/a.js"), ("?? src/b.js", "src/b.js"), (" M src/x.js", "src/x.js"), ("R  src/old.js -> src/new.js", "src/new.js"), ("?? src/new/", None)])
def test_status_lines(spark, line, want):
    got = gitstatus.changed(spark.createDataFrame([(line,)], "line string")).collect()
    assert [r.rel_path for r in got] == ([want] if want else [])


def test_coverage_documents(spark):
    doc = '{"/p/src/a.js": {"statementMap": {"0": {"start": {"line": 1, "column": 0}, "end": {"line": 2, "column": 1}}, "1": {"start": {}, "end": {"line": 3}}}, "s": {"0": 4}}, "/q/x.js": {"statementMap": {}, "s": {}}, "/p/src/b.js": {"s": {"0": 1}}}'
    texts = spark.createDataFrame([(doc,), ("not json",)], "value string")
    got = sorted(map(tuple, coverage.statements(texts, "/p").collect()))
    assert got == [("src/a.js", "0", 1, 2, 4), ("src/a.js", "1", None, 3, None)]
    assert sorted(r.rel_path for r in coverage.files(texts, "/p").collect()) == ["src/a.js", "src/b.js"]


def test_timing_documents(spark):
    text = spark.createDataFrame([('{"src/a.js|f": {"calls": 2, "totalMicros": 10, "minMicros": 3, "maxMicros": 7}}',), ("{",)], "value string")
    assert [tuple(r) for r in timings.unpacked(text).collect()] == [("src/a.js", "f", 2, 10, 3, 7)]


SNIPPETS = {
    "js": ["const a = <div a='x' {...b}>it's {c && <b/>} <></> </div>;", "x = a ? (b) : c => d;", "a = (b, {c = 1, ...d}, [e,,f]) => ({g: 1});", "l: for (;;) { break l; }", "if (a) /re'/.test(b); else a / b / c;", "x = `a${b}c${`d`}`;",
           "export * as ns from 'm'; import d, {a as b, default as c} from \"x\"", "type A = {| a: string |}; function f(x: ?number, y?: string): Array<Map<string, number>> { return (x: any); }", "@dec() class Q { @d x = 1; accessor y = 2; static { f(); } }", "a = b\n/c/g.exec(d)", "return 5", "#!/bin/node\nx"],
    "ts": ["enum E { A = 'x', B }", "const x = <T,>(a: T): T => a; const y = f<string>(z)!;", "declare module 'x' { export const a: number; }\nimport fs = require('fs'); export = fs;", "abstract class A<T> implements I<T> { private readonly x: number = 1; abstract foo(): void; [k: string]: any }", "const g = a ? (b as C) : d;"],
}


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in SNIPPETS.items() for t in ts])
def test_parses(ext, text):
    assert parse(text, ext).type == "Program"


SEMANTIC = [
    "let a; let a;", "const a = 1; var a;", "function f(a, a) { 'use strict'; }", "return 5", "await x;", "export { nope };", "export default 1; export default 2;", "'use strict'; delete x;", "x = 010;", "l: l: for (;;);", "break;", "break l;",
    "super();", "class A { constructor() {} constructor() {} }", "class A { #x; #x; }", "a.#y;", "new.target;", "({ __proto__: 1, __proto__: 2 });", "import a from 'x'; import a from 'y';", "'use strict'; with (a) {}", "eval = 1;", "1 = 2;", "const x;",
]


@pytest.mark.parametrize("text", SEMANTIC)
def test_semantic_errors_still_give_rows(text):
    """What the grammar covers but a validator refuses: the functions beside it are still found."""
    assert [r["method_name"] for r in rows(f"{text}\nfunction beside() {{}}", "js") if r["method_name"] == "beside"] == ["beside"]


@pytest.mark.parametrize("text", ["}}}", "const = 1", "function (", "`a", "a = (", "<a></b>"])
def test_rejects(text):
    with pytest.raises(SyntaxFailure):
        parse(text)


@pytest.mark.parametrize("body, want", [("", 1), ("if (a) {}", 2), ("if (a) { for (;;) { while (b) { switch (c) {} } } }", 5), ("if (a) {} else if (b) {}", 3), ("try { if (a) { do { f(); } while (b); } } finally {}", 4)])
def test_nesting_of_bodies(body, want):
    assert [r["nesting"] for r in rows(f"function f() {{ {body} }}", "js") if r["method_name"]] == [want]


def test_walk_order_holds_descendants():
    got = list(rows("class A { m() { return [1, (x) => x]; } }\nconst b = { c };", "js"))
    for r in got[1:]:
        p = got[r["parent_id"]]
        assert p["node_id"] < r["node_id"] <= r["post"] <= p["post"] and p["type"] == r["parent_type"]
    assert sum(r["type"] == "Identifier" and r["name"] == "c" for r in got) == 2


@pytest.fixture
def project(tmp_path):
    files = {
        "src/utils.js": "export const u = 1;\n", "src/sub/big.js": "export function f(a) { if (a) { if (a) { if (a) { if (a) {} } } } }\n", "src/sub/a.test.js": "test('x', () => {});\n", "src/_hidden.js": "export const h = 1;\n",
        "src/node_modules/x.js": "}}}", "test/t.js": "import assert from 'node:assert';\nit('y', () => { assert(1); });\n", "readme.md": "",
    }
    for k, v in files.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    return tmp_path


def test_file_sets(spark, project):
    names = lambda df: sorted(r.rel_path for r in df.collect())
    every = listing.listing(spark, {"p": str(project)})
    assert names(listing.gate_files(every)) == ["src/_hidden.js", "src/sub/big.js", "src/utils.js"]
    assert names(listing.test_files(every)) == ["src/sub/a.test.js", "test/t.js"]
    assert names(listing.loose(every)) == ["src/_hidden.js", "src/utils.js"]
    assert names(listing.explicit(spark, "p", str(project), ["src/sub", "nowhere", "src/utils.js", "src/utils.js"])) == ["src/sub/big.js", "src/utils.js"]
    assert listing.read(listing.gate_files(every)).filter("content is null").count() == 0


def test_command_line(spark, project, capsys):
    run = lambda *a: (cli.main(list(a), str(project), spark), capsys.readouterr().out)
    code, out = run("file-naming")
    assert code == 2 and 'src/utils.js: generic name "utils.js"' in out and "1/3 files with mechanical names" in out
    assert run("nesting") == (0, "1 methods within nesting 5\n")
    code, out = run("test-assertions")
    assert code == 2 and "src/sub/a.test.js:1: 'x' has 0 assertion(s)" in out and "1/2 tests" in out
    code, out = run("test-assertions", "src/sub/a.test.js")
    assert code == 2 and "src/sub/a.test.js:1: 'x' has 0 assertion(s)" in out and "1/1 tests" in out
    assert run("skill")[0] == 0
    assert run("folder-structure")[0] == 2 and run("folder-structure", "x")[0] == 1
    assert run("unused-code", "src")[0] == 0
    assert run("banned-imports")[0] == 0 and run("banned-imports", "--bogus=1")[0] == 1
    code, out = run("--threshold", "4")
    assert code == 0 and "N/A" in out
    (project / "coverage").mkdir()
    (project / "coverage/coverage-final.json").write_text('{"%s/src/sub/big.js": {"statementMap": {"0": {"start": {"line": 1, "column": 0}, "end": {"line": 1, "column": 9}}}, "s": {"0": 0}}}' % project)
    code, out = run("--threshold=4")
    assert code == 2 and "30.0" in out and run("--threshold", "30")[0] == 0 and run("--threshold", "x")[0] == 1
    (project / "t.json").write_text('{"src/sub/big.js|f": {"calls": 1, "totalMicros": 1500, "minMicros": 1, "maxMicros": 2}}')
    code, out = run("profile", "--timings", str(project / "t.json"), "--threshold", "1")
    assert code == 2 and "100.0%" in out and len(list((project / "profile-reports").iterdir())) == 2
    (project / "src/bad.js").write_text("}}}")
    assert run("nesting")[0] == 1


def test_changed_files(spark, project):
    git = lambda *a: subprocess.run(["git", "-C", str(project), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "x")
    (project / "src/utils.js").write_text("export const u = 2;\n")
    (project / "src/new.js").write_text("")
    assert sorted(r.rel_path for r in gitstatus.changed(gitstatus.read(spark, str(project))).collect()) == ["src/new.js", "src/utils.js"]
    git("add", "src/new.js")
    assert [r.rel_path for r in gitstatus.staged(spark, str(project)).collect()] == ["src/new.js"]


def test_stream_of_timings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    q = stream.start(stream.events(spark, str(tmp_path / "in")), "running", str(tmp_path / "check"))
    try:
        for k, micros in enumerate(([5, 7], [1])):
            (tmp_path / f"in/{k}.json").write_text("".join(f'{{"file": "f", "method": "m", "micros": {m}}}\n' for m in micros))
            q.processAllAvailable()
        assert [tuple(r) for r in spark.table("running").collect()] == [("f", "m", 3, 13, 1, 7)]
    finally:
        q.stop()


def test_failures_are_rows(spark):
    df = spark.createDataFrame([("p", "a.js", "js", "}}}"), ("p", "b.js", "js", None), ("p", "c.js", "js", "f()")], "project string, rel_path string, ext string, content string")
    rows_ = source.parsed(df)
    assert [r.rel_path for r in source.failures(rows_).collect()] == ["a.js"]
    assert {r.rel_path for r in source.nodes(rows_).collect()} == {"b.js", "c.js"}


@pytest.mark.parametrize("part, whole, want", [(1, 2, "0.5"), (2, 3, "0.67"), (1, 1, "1.0"), (2, 5, "0.4"), (17, 40, "0.42"), (69, 200, "0.34"), (3, 8, "0.38"), (1, 200, "0.01"), (87, 200, "0.43")])
def test_weights_in_messages(spark, part, whole, want):
    got = spark.createDataFrame([(part, whole)], "p long, w long").select(source.two_places(F.col("p"), F.col("w")).alias("x")).first().x
    text = render.to_fixed(part / whole, 2)
    assert got == want == (text[:-1] if text.endswith("0") else text).removesuffix(".")


def test_two_places_is_to_fixed(spark):
    """Every quotient of small counts, against the exact decimal."""
    pairs = [(p, w) for w in range(1, 202) for p in range(w + 1) if w > 190 or w < 41]
    got = spark.createDataFrame(pairs, "p long, w long").select("p", "w", source.two_places(F.col("p"), F.col("w")).alias("x")).collect()
    for r in got:
        text = render.to_fixed(r.p / r.w, 2)
        assert r.x == (text[:-1] if text.endswith("0") else text).removesuffix("."), r


def test_one_parse(spark, tmp_path):
    """The parser runs once for a check, however often the check reads its rows."""
    df = spark.createDataFrame([("p", "src/a.js", "js", "import assert from 'assert';\ntest('x', () => { assert(1); });")], "project string, rel_path string, ext string, content string")
    rows_ = source.parsed(df)
    plan = source.test_assertions(rows_)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and source.test_assertions(rows_).count() == 0
    rows_.unpersist()
