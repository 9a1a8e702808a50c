"""Source code as tables: syntax nodes, and the functions, classes, imports, literals and tests found in them.

parsed() runs the parser once and keeps its rows; everything else is columns, joins and aggregates over them, keyed by
(project, rel_path), so no check parses again and none crosses a file unless it is about files.

Violations carry seq, by which those of a file are told in the order of its text.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import glob_pattern, import_candidates, normalised, utf16_length
from ..parse.flatten import ANONYMOUS, SCHEMA, flattened
from . import crap, gates

KEYS = ["project", "rel_path"]
# Names that decide results.
CLASS_TYPES = ["ClassDeclaration", "ClassExpression"]
METHOD_TYPES = ["ClassMethod", "ClassPrivateMethod"]
FIELD_TYPES = ["ClassProperty", "ClassPrivateProperty"]
IDENTIFIER_POSITIONS = {"ObjectProperty": "key", "MemberExpression": "property", "OptionalMemberExpression": "property", "SwitchCase": "test"}


def parsed(files: DataFrame) -> DataFrame:
    """Node rows of files (project, rel_path, ext, content), and a row with error for each that doesn't parse.

    They are persisted, in memory or on disk as there is room, since every check reads them several times; what a lost
    executor held is parsed again. The caller may unpersist() them."""
    return files.select("project", "rel_path", "ext", "content").mapInArrow(flattened, SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)


def failures(rows: DataFrame) -> DataFrame:
    return rows.filter("error is not null").select(*KEYS, "error")


def nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("node_id is not null")


def methods(rows: DataFrame) -> DataFrame:
    """The functions that are reported: method_id, name, start_line, end_line, complexity, nesting."""
    m = rows.filter("method_name is not null")
    return m.select(*KEYS, F.col("node_id").alias("method_id"), F.col("method_name").alias("name"), "start_line", "end_line", "complexity", "nesting")


def crap_metrics(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Change risk of all functions; statements: project, rel_path, start_line, end_line, hits."""
    return crap.crap_metrics(methods(rows), statements, KEYS)


def classes(rows: DataFrame) -> DataFrame:
    """class_id, name, line of every class, however deep."""
    c = rows.filter(F.col("type").isin(CLASS_TYPES))
    return c.select(*KEYS, F.col("node_id").alias("class_id"), F.coalesce("name", F.lit(ANONYMOUS)).alias("name"), F.col("start_line").alias("line"))


def members(rows: DataFrame) -> DataFrame:
    """Direct members of classes with class_id: a member's parent is the class body, which follows its class by parent_id."""
    body = rows.filter("type = 'ClassBody'").select(*KEYS, F.col("node_id").alias("body_id"), F.col("parent_id").alias("class_id"))
    m = rows.filter("parent_type = 'ClassBody'").select(*KEYS, F.col("parent_id").alias("body_id"), "node_id", "type", "kind", "is_static", "has_body", "complexity", "name")
    return m.join(body, [*KEYS, "body_id"])


def is_concrete_method() -> Column:
    return F.col("type").isin(METHOD_TYPES) & (F.coalesce("kind", F.lit("")) != "constructor") & F.col("has_body")


def nesting(rows: DataFrame) -> DataFrame:
    return gates.nesting(methods(rows)).select(*KEYS, F.col("method_id").alias("seq"), F.col("start_line").alias("line"), "message")


def class_totals(rows: DataFrame) -> DataFrame:
    concrete = members(rows).filter(is_concrete_method())
    return gates.class_totals(classes(rows), concrete, [*KEYS, "class_id"])


def class_size(rows: DataFrame) -> DataFrame:
    return gates.class_size(class_totals(rows), F.col("name")).select(*KEYS, F.struct("class_id", "limit").alias("seq"), "line", "message")


def class_weights(rows: DataFrame) -> DataFrame:
    """Public instance fields against those and concrete instance methods; private fields are in neither count."""
    own = members(rows).filter("not is_static")
    field = F.col("type").isin(FIELD_TYPES) & (F.col("type") != "ClassPrivateProperty")
    return gates.class_weight(classes(rows), own, [*KEYS, "class_id"], field, is_concrete_method())


#: Odd numbers of two-hundredths, halfway between two hundredths, whose double lies below them.
_BELOW = [n for n in range(1, 200, 2) if Fraction(n / 200) < Fraction(n, 200)]


def two_places(part: Column, whole: Column) -> Column:
    """The double part / whole (0 to 1) with two places, one trailing zero and then a trailing point cut: for the messages.

    Its exact binary value is rounded half up. Integers tell how far it is from halfway; only where the quotient is halfway
    does the double's own side decide."""
    doubled = part * 200
    halfway = (doubled % whole == 0) & (doubled / whole % 2 == 1) & (doubled / whole).cast("int").isin(_BELOW)
    hundredths = F.floor((doubled + whole) / (whole * 2)).cast("int") - halfway.cast("int")
    text = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.regexp_replace(F.regexp_replace(text, "0$", ""), r"\.$", "")


def weight_of_class(rows: DataFrame) -> DataFrame:
    w = gates.data_heavy(class_weights(rows))
    text = F.concat("name", F.lit(" data weight "), two_places(F.col("fields"), F.col("members")), F.lit(f" > max {gates.MAX_WEIGHT}"))
    return w.select(*KEYS, F.col("class_id").alias("seq"), "line", text.alias("message"))


def declarations(rows: DataFrame) -> DataFrame:
    """Module-scope functions, classes and plainly named variables that are not exported: declaration_id, name, line."""
    top = rows.filter("parent_type = 'Program'")
    named = top.filter(((F.col("type") == "FunctionDeclaration") & F.col("has_body") | (F.col("type") == "ClassDeclaration")) & F.col("name").isNotNull()).select(*KEYS, F.col("node_id").alias("declaration_id"), "name", F.col("start_line").alias("line"))
    lists = top.filter("type = 'VariableDeclaration'").select(*KEYS, F.col("node_id").alias("list_id"))
    each = rows.filter("type = 'VariableDeclarator'").select(*KEYS, F.col("parent_id").alias("list_id"), F.col("node_id").alias("declaration_id"), F.col("start_line").alias("line"))
    ids = rows.filter("parent_type = 'VariableDeclarator' and field = 'id' and type = 'Identifier'").select(*KEYS, F.col("parent_id").alias("declaration_id"), "name")
    variables = each.join(lists, [*KEYS, "list_id"]).join(ids, [*KEYS, "declaration_id"]).select(*KEYS, "declaration_id", "name", "line")
    return named.unionByName(variables)


def unused_code(rows: DataFrame) -> DataFrame:
    identifiers = rows.filter("type = 'Identifier'").select(*KEYS, "name")
    d = gates.unreferenced(declarations(rows), identifiers, [*KEYS, "name"])
    return d.select(*KEYS, F.col("declaration_id").alias("seq"), "line", F.concat("name", F.lit(" is never referenced in the module")).alias("message"))


def imports(rows: DataFrame) -> DataFrame:
    """import_id, specifier of every static, re-exporting, dynamic and required module named by a string literal."""
    text = rows.filter("type = 'StringLiteral'").select(*KEYS, F.col("parent_id").alias("import_id"), "node_id", "field", "parent_type", F.col("value").alias("specifier"))
    static = text.filter((F.col("field") == "source") & F.col("parent_type").isin("ImportDeclaration", "ExportAllDeclaration", "ExportNamedDeclaration", "ImportExpression"))
    callee = rows.filter("type = 'Identifier' and name = 'require' and field = 'callee' and parent_type = 'CallExpression'").select(*KEYS, F.col("parent_id").alias("import_id"))
    args = rows.filter("field = 'arguments' and parent_type = 'CallExpression'").groupBy(*KEYS, F.col("parent_id").alias("import_id")).agg(F.min("node_id").alias("node_id"))
    required = text.join(callee, [*KEYS, "import_id"], "left_semi").join(args, [*KEYS, "import_id", "node_id"], "left_semi")
    return static.unionByName(required).select(*KEYS, "import_id", "specifier")


def resolved_imports(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """imports with resolved, the file of the listing (project, rel_path) that a relative one leads to, or null."""
    target = normalised(F.concat(F.regexp_replace("rel_path", r"[^/]*\z", ""), "specifier"))
    candidates = F.when(F.col("specifier").startswith("."), import_candidates(target))
    files = listing.select("project", F.col("rel_path").alias("target"))
    return gates.resolved(imports(rows), files, [*KEYS, "import_id"], ["project"], candidates, "target")


def unused_files(rows: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that no import of theirs leads to; rows are of these files, the listing is of all."""
    targets = resolved_imports(rows, listing).filter("resolved is not null").select("project", F.col("resolved").alias("rel_path"))
    out = gates.never_imported(files.select(*KEYS), targets, KEYS)
    return out.withColumn("message", F.lit("never imported by any analyzed source file"))


def banned_imports(rows: DataFrame, listing: DataFrame, rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """A violation for each import that a rule (source glob, forbidden glob, note) bans, by its text or what it leads to."""
    patterns = [(glob_pattern(a), glob_pattern(b), note) for a, b, note in rules]
    bad = gates.banned(resolved_imports(rows, listing), patterns, F.col("rel_path"), [F.col("specifier"), F.col("resolved")])
    notes = F.array(*(F.lit(f" — {note}" if note else "") for _, _, note in rules))
    note = F.element_at(notes, F.col("rule") + 1)
    return bad.select(*KEYS, F.col("import_id").alias("seq"), F.concat(F.lit("import "), "specifier", F.lit(" is banned for "), "rel_path", note).alias("message"))


def literals(rows: DataFrame) -> DataFrame:
    """Literals that count for repeats, with line and in_const: numbers by their text, strings and plain templates by value."""
    value = F.when(F.col("type") == "NumericLiteral", F.col("raw")).when(F.col("type").isin("StringLiteral", "TemplateLiteral"), F.col("value"))
    positions = F.lit(False)
    for parent, field in IDENTIFIER_POSITIONS.items():
        positions = positions | ((F.col("parent_type") == parent) & (F.col("field") == field))
    index = (F.col("type") == "StringLiteral") & F.coalesce(positions, F.lit(False))
    out = rows.select(*KEYS, "node_id", F.col("start_line").alias("line"), "in_const", "type", "raw", value.alias("text"), index.alias("index"))
    return out.filter(F.col("text").isNotNull() & (utf16_length(F.col("text")) >= gates.MIN_LITERAL) & ~F.col("index")).drop("index")


def magic_constants(rows: DataFrame) -> DataFrame:
    """Hex colours outside const initialisers, and literals that repeat outside them; lines are where literals begin.

    Of a file, colours come first, then values in the order of their first occurrence, in a const or not."""
    colours = rows.filter("type = 'NumericLiteral' and not in_const").filter(F.col("raw").rlike(gates.HEX_COLOR))
    colours = colours.select(*KEYS, F.struct(F.lit(-1).alias("first"), "node_id").alias("seq"), F.col("start_line").alias("line"), F.lit("hex color outside a constant declaration").alias("message"))
    every = literals(rows).withColumn("first", F.min("node_id").over(Window.partitionBy(*KEYS, "text")))
    many = gates.repeated(every.filter("not in_const"), [*KEYS, "text"])
    text = F.concat(F.lit("literal "), "text", F.lit(" repeats "), F.col("occurrences").cast("string"), F.lit(" times — extract a named constant"))
    return colours.unionByName(many.select(*KEYS, F.struct("first", "node_id").alias("seq"), "line", text.alias("message")))


def tests(rows: DataFrame) -> DataFrame:
    """Registrations of tests with a function: test_id, name, line."""
    return rows.filter("test_name is not null").select(*KEYS, F.col("node_id").alias("test_id"), F.col("test_name").alias("name"), F.col("start_line").alias("line"))


def assertions(rows: DataFrame) -> DataFrame:
    """Assertion calls by the test whose function contains them; those in a nested test count for the outer one too."""
    return rows.filter("asserts_in is not null").select(*KEYS, F.col("node_id").alias("call_id"), F.explode("asserts_in").alias("test_id"))


def test_assertions(rows: DataFrame) -> DataFrame:
    bad = gates.without_assertions(tests(rows), assertions(rows), [*KEYS, "test_id"])
    text = F.concat(F.lit("'"), "name", F.lit("' has "), F.col("assertions").cast("string"), F.lit(" assertion(s) — a test without assertions verifies nothing"))
    return bad.select(*KEYS, F.col("test_id").alias("seq"), "line", text.alias("message"))


def file_naming(files: DataFrame) -> DataFrame:
    return gates.naming(files.select(*KEYS)).select(*KEYS, "message")


def folder_structure(loose: DataFrame, folder: str = "src") -> DataFrame:
    """Projects with sources directly in the folder."""
    n = loose.groupBy("project").agg(F.count("*").alias("n")).filter(F.col("n") > gates.MAX_LOOSE)
    text = F.concat(F.col("n").cast("string"), F.lit(f" loose files directly in {folder} — group them into feature packages (max {gates.MAX_LOOSE})"))
    return n.select("project", F.lit(folder).alias("rel_path"), text.alias("message"))


def instrumented(rows: DataFrame, files: DataFrame, timer: str = "__sextant_start", record: str = "__sextant_record") -> DataFrame:
    """project, rel_path, content with a timer around each block body: a function for a key `rel_path|name`.

    Insertions add no lines, so positions in messages stay right; empty blocks and expression bodies stay as they are, and so does
    a file without functions or one that doesn't parse."""
    m = rows.filter("method_name is not null").select(*KEYS, F.col("node_id").alias("function_id"), "method_name")
    body = rows.filter("type = 'BlockStatement' and field = 'body' and post > node_id").select(*KEYS, F.col("parent_id").alias("function_id"), "start_off", "end_off")
    b = m.join(body, [*KEYS, "function_id"])
    key = F.to_json(F.array(F.concat_ws("|", "rel_path", "method_name")))
    quoted = F.expr("substring(k, 2, length(k) - 2)")
    opening = F.struct((F.col("start_off") + 1).alias("at"), F.lit(f"const {timer} = performance.now(); try {{").alias("text"))
    closing = F.struct((F.col("end_off") - 1).alias("at"), F.concat(F.lit(f"}} finally {{ {record}({{ key: "), quoted, F.lit(f", since: {timer} }}); }}")).alias("text"))
    ins = b.withColumn("k", key).select(*KEYS, F.explode(F.array(opening, closing)).alias("i"))
    each = ins.groupBy(*KEYS).agg(F.array_sort(F.collect_list("i")).alias("ins"))
    out = files.select(*KEYS, "content").join(each, KEYS, "left")
    cuts = F.expr("concat(array(0), transform(ins, i -> i.at), array(length(content)))")
    text = F.expr("array_join(transform(sequence(0, size(ins)), k -> concat(substring(content, cuts[k] + 1, cuts[k + 1] - cuts[k]), if(k < size(ins), ins[k].text, ''))), '')")
    return out.withColumn("cuts", cuts).select(*KEYS, F.when(F.col("ins").isNull(), F.col("content")).otherwise(text).alias("content"))
