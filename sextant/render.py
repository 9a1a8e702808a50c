"""Text reports of results that have been collected, and the numbers in them.

Formatting happens here alone; queries never round.
"""

from __future__ import annotations

import json
import textwrap
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

from pyspark.sql import DataFrame, Row

from .operators.profile import NOISE_FLOOR


def to_fixed(x: float, places: int) -> str:
    """x with so many decimals: the exact binary value rounded half up, away from zero."""
    text = str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return text.removeprefix("-") if x == 0 else text


def left(s: object, width: int) -> str:
    """Padded on the left; never cut."""
    return str(s).rjust(width)


def right(s: object, width: int) -> str:
    return str(s).ljust(width)


def crap_report(rows: Iterable[Row], threshold: float = 8.0, failures: int = 0) -> tuple[str, bool]:
    """The ranked report of rows (name, rel_path, complexity, coverage, crap_score), and whether the threshold is passed."""
    head = " ".join((right("Method", 30), right("File", 35), left("CC", 4), left("Cov%", 7), left("CRAP", 8)))
    lines, top = ["CRAP Report", "===========", head, "-" * len(head)], 0.0
    for r in rows:
        cov = "N/A" if r.coverage is None else to_fixed(r.coverage * 100, 1) + "%"
        score = "N/A" if r.crap_score is None else to_fixed(r.crap_score, 1)
        lines.append(" ".join((right(r.name, 30), right(r.rel_path, 35), left(r.complexity, 4), left(cov, 7), left(score, 8))))
        top = max(top, r.crap_score or 0.0)
    passed = top <= threshold
    lines += ["", f"Max CRAP: {to_fixed(top, 1)} (threshold {to_fixed(threshold, 1)}) — {'passed' if passed else 'FAILED'}"]
    if failures:
        lines.append(f"Parse failures: {failures} file(s) — see warnings above.")
    return "\n".join(lines) + "\n", passed


def milliseconds(micros: float) -> str:
    return to_fixed(micros / 1000, 2)


def _profile_lines(rows: Iterable[Row], totals: Row) -> Iterator[str]:
    head = " ".join((left("TOTAL(ms)", 10), left("%", 6), left("CALLS", 6), left("MEAN(µs)", 10), left("MAX(µs)", 9), left("@60fps(ms)", 11), right("METHOD", 30), "FILE:LINE"))
    yield from (f"Profile Report ({totals.methods} methods, total {milliseconds(totals.total_micros)}ms)", head, "-" * len(head))
    for r in rows:
        mean = r.total_micros / r.calls if r.calls > 0 else 0.0
        share = to_fixed(r.total_micros / totals.total_micros * 100 if totals.total_micros > 0 else 0.0, 1) + "%"
        noisy = ("~" if mean < NOISE_FLOOR else "") + to_fixed(mean, 1)
        yield " ".join((left(milliseconds(r.total_micros), 10), left(share, 6), left(r.calls, 6), left(noisy, 10), left(r.max_micros, 9), left(milliseconds(mean * 60), 11), right(r.method, 30), f"{r.file}:{r.line}"))
    yield "Full report: profile-reports/ (txt + json)"


def profile_report(rows: Iterable[Row], totals: Row, threshold_ms: float | None = None) -> str:
    """The table of rows (file, method, line, calls, total_micros, max_micros) as they come, and of all rows the totals
    (methods, total_micros, over_threshold)."""
    lines = list(_profile_lines(rows, totals))
    if threshold_ms is not None:
        lines.append(f"Threshold: {to_fixed(threshold_ms, 2)}ms — " + (f"{totals.over_threshold} method(s) exceed" if totals.over_threshold else "all methods OK"))
    return "\n".join(lines) + "\n"


def write_profile(rows: Callable[[], Iterable[Row]], totals: Row, folder: str, stamp: str) -> None:
    """The full report as text and JSON, written row by row."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    name = f"profile-{stamp.replace(':', '-').replace('.', '-')}"
    with (where / f"{name}.txt").open("w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in _profile_lines(rows(), totals))
        f.write("\n")
    keys = {"method": "method", "file": "file", "line": "line", "calls": "calls", "totalMicros": "total_micros", "minMicros": "min_micros", "maxMicros": "max_micros"}
    with (where / f"{name}.json").open("w", encoding="utf-8") as f:
        f.write(json.dumps({"generatedAt": stamp, "totalMicros": totals.total_micros, "methods": []}, indent=2, ensure_ascii=False).removesuffix("]\n}"))
        for k, r in enumerate(rows()):
            f.write(("," if k else "") + "\n" + textwrap.indent(json.dumps({n: r[c] for n, c in keys.items()}, indent=2, ensure_ascii=False), "    "))
        f.write("\n  ]\n}\n" if totals.methods else "]\n}\n")


#: The last line of each check, without and with violations.
SUMMARIES = {
    "file-naming": ("{checked} files have domain-meaningful names", "{violations}/{checked} files with mechanical names"),
    "nesting": ("{checked} methods within nesting 5", "{violations}/{checked} methods nested deeper than 5"),
    "class-size": ("{checked} classes within 25 methods/WMC 80", "{violations} violations in {checked} classes over 25 methods/WMC 80"),
    "weight-of-class": ("{checked} classes within weight 0.33", "{violations}/{checked} classes over weight 0.33"),
    "unused-code": ("{checked} declarations all referenced", "{violations} unused declarations in {checked} module-scope declarations"),
    "unused-files": ("{checked} files all imported", "{violations}/{checked} files never imported"),
    "banned-imports": ("{checked} files comply with {rules} rule(s)", "{violations} banned import(s) in {checked} files"),
    "magic-constants": ("{checked} files free of magic constants", "{violations} magic constant(s) in {checked} files"),
    "test-assertions": ("{checked} tests assert their expectations", "{violations}/{checked} tests without assertions"),
    "folder-structure": ("{checked} directories organized into packages", "{violations} directory(ies) with loose-file sprawl"),
}


def in_order(violations: DataFrame) -> DataFrame:
    """Violations by file and, in a file, in the order in which its text gives them."""
    return violations.orderBy(*(c for c in ("rel_path", "seq") if c in violations.columns))


def gate_report(gate: str, violations: DataFrame, checked: int, rules: int = 0) -> tuple[str, int]:
    """Lines `file[:line]: message`, the summary, and the exit code: 2 if there are violations."""
    lines, n = [], 0
    for r in in_order(violations).toLocalIterator():
        n += 1
        line = f":{r.line}" if "line" in violations.columns and r.line else ""
        lines.append(f"{r.rel_path}{line}: {r.message}")
    lines.append(SUMMARIES[gate][n > 0].format(checked=checked, violations=n, rules=rules))
    return "\n".join(lines) + "\n", 2 if n else 0
