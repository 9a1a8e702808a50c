"""Path predicates, stems, globs and import candidates as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that decide results.
SOURCE_EXTENSIONS = ["js", "mjs", "cjs", "jsx", "ts", "tsx"]
TEST_FILE = r"\.(spec|test)\.(js|jsx|ts|tsx)\z"
GENERIC_STEMS = ["common", "core", "general", "helper", "helpers", "misc", "shared", "stuff", "temp", "tmp", "types", "util", "utils", "utilities", "utility", "various"]
ALLOWED_STEMS = [
    "aes128", "aes192", "aes256", "arm32", "arm64", "base32", "base64", "crc8", "crc16", "crc32", "f16", "f32", "f64", "h264", "h265", "http2",
    "http3", "i18n", "i2c", "int8", "int16", "int32", "int64", "ipv4", "ipv6", "l10n", "a11y", "md5", "oauth1", "oauth2", "sha1", "sha256",
    "sha384", "sha512", "uint8", "uint16", "uint32", "uint64", "utf8", "utf16", "utf32", "w3c", "webgl2", "x509", "x86", "x64",
]
CHANGE_STATUS = ["M", "A", "R", "C", "?"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last point of the name; a name that only starts with one has none."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)\z", 1)


def stem(path: Column) -> Column:
    """Lower-cased name without its last extension."""
    return F.lower(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", ""))


def is_source(path: Column) -> Column:
    return extension(path).isin(SOURCE_EXTENSIONS)


def is_test_file(path: Column) -> Column:
    """A test by its name, or by a __tests__ folder."""
    return path.rlike(TEST_FILE) | F.concat(F.lit("/"), path).contains("/__tests__/")


def is_test_path(path: Column) -> Column:
    """A test file, or any in a folder test or tests; judged on the path inside the project."""
    return is_test_file(path) | F.concat(F.lit("/"), path).rlike(r"/tests?/")


def is_loose(path: Column) -> Column:
    """A source file directly in src."""
    return is_source(path) & (F.size(F.split(path, "/")) == 2) & path.startswith("src/")


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: ** crosses folders, * and ? do not."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])))
            i += 1
    return rf"\A{''.join(out)}\z"


def normalised(path: Column) -> Column:
    """A relative path with its . and .. folded away; what climbs out of the project keeps its leading .. parts."""
    step = lambda a, p: F.when((p == "") | (p == "."), a).when(
        (p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    ).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_candidates(resolved: Column) -> Column:
    """Where a relative import may lead, in order: the path itself, with each extension, and an index file of each."""
    return F.array(resolved, *(F.concat(resolved, F.lit(f".{e}")) for e in SOURCE_EXTENSIONS), *(F.concat(resolved, F.lit(f"/index.{e}")) for e in SOURCE_EXTENSIONS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")
