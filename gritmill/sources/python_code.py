"""An outline of Python files by lines and indentation: symbols, imports, inheritance, calls and function measures."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

#: Patterns of declarations and of what a function's lines are counted for.
FROM = re.compile(r"^from\s+([\w.\-]+)\s+import\s+(.+)$", re.ASCII)
CLASS = re.compile(r"^class\s+([a-zA-Z_]\w*)(?:\(([a-zA-Z_]\w*)\))?\s*:", re.ASCII)
DEF = re.compile(r"^def\s+([a-zA-Z_]\w*)\s*\((.*?)\)\s*(?:->.*?)?:", re.ASCII)
CALL = re.compile(r"([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)\s*\(", re.ASCII)
BRANCH, LOOP, HANDLER, LOGIC, RETURN = (re.compile(p, re.ASCII) for p in (r"\b(if|elif)\b", r"\b(for|while)\b", r"\b(except|finally)\b", r"\b(and|or)\b", r"\breturn\b"))
#: Names before a bracket that count as no call.
NO_CALLS = {"if", "for", "while", "print", "range", "len", "enumerate", "int", "str", "float", "list", "dict", "set"}

#: Files whose outlines make one Arrow batch.
BATCH = 256
_MEASURES = ("lines", "parameter_count", "complexity", "nesting", "branch_count", "loop_count", "conditional_count", "return_count", "call_count")
SCHEMA = (
    "path string, line_count int, symbols array<struct<type: string, name: string, start: int, end: int>>, imports array<struct<target: string, symbols: array<string>, line: int>>, "
    "inheritance array<struct<class_name: string, parent: string, line: int>>, calls array<struct<caller: string, callee: string, line: int>>, "
    f"functions array<struct<name: string, start: int, end: int, {', '.join(f'{m}: int' for m in _MEASURES)}>>"
)


def _names(text: str) -> list[str]:
    return [n for n in (part.strip().split(" as ")[0].strip() for part in text.split(",")) if n]


def outline(path: str | None, text: str | None) -> dict:
    """One pass over the lines with a stack of the blocks that are open: a block ends before the first code line that is
    not indented more than its head, and every line counts for all functions around it. Blank lines and comments count for
    nothing; an asynchronous function is not seen as a function; empty and null texts have one line and no symbol but the
    file. Never fails: what is no declaration is skipped."""
    rows = (text or "").split("\n")
    out = {"path": path, "line_count": len(rows), "symbols": [{"type": "FILE", "name": path, "start": 1, "end": len(rows)}], "imports": [], "inheritance": [], "calls": [], "functions": []}
    open_blocks: list[tuple[int, dict, dict | None]] = []
    calls: list[tuple[int, dict]] = []
    in_class, class_indent = False, 0
    for number, row in enumerate(rows, 1):
        line = row.strip()
        if not line or line.startswith("#"):
            continue
        indent = len(row) - len(row.lstrip())
        if in_class and indent <= class_indent and not line.startswith(("class ", "def ")):
            in_class = False
        while open_blocks and open_blocks[-1][0] >= indent:
            open_blocks.pop()
        for head, symbol, f in open_blocks:
            symbol["end"] = number
            if f is not None:
                _count(f, line, indent - head, number, calls)
        if line.startswith("import "):
            for name in _names(line[7:]):
                out["imports"].append({"target": name, "symbols": [name], "line": number})
                out["symbols"].append({"type": "IMPORT", "name": name, "start": number, "end": number})
        elif m := FROM.match(line):
            out["imports"].append({"target": m[1], "symbols": _names(m[2]), "line": number})
            out["symbols"].append({"type": "IMPORT", "name": m[1], "start": number, "end": number})
        if m := CLASS.match(line):
            in_class, class_indent = True, indent
            symbol = {"type": "CLASS", "name": m[1], "start": number, "end": number}
            if m[2]:
                out["inheritance"].append({"class_name": m[1], "parent": m[2], "line": number})
            out["symbols"].append(symbol)
            open_blocks.append((indent, symbol, None))
        if m := DEF.match(line):
            given = [p.strip().split(":")[0].split("=")[0].strip() for p in m[2].split(",")]
            symbol = {"type": "METHOD" if in_class and indent > class_indent else "FUNCTION", "name": m[1], "start": number, "end": number}
            f = {"name": m[1], "start": number} | dict.fromkeys(_MEASURES, 0) | {"complexity": 1, "parameter_count": sum(1 for p in given if p not in ("", "self", "cls"))}
            out["symbols"].append(symbol)
            out["functions"].append((f, symbol))
            open_blocks.append((indent, symbol, f))
    out["functions"] = [f | {"end": s["end"], "lines": s["end"] - s["start"] + 1} for f, s in out["functions"]]
    out["calls"] = [c for _, c in sorted(calls, key=lambda c: c[0])]
    return out


def _count(f: dict, line: str, deeper: int, number: int, calls: list) -> None:
    f["nesting"] = max(f["nesting"], 1, deeper // 4)
    for pattern, names in ((BRANCH, ("complexity", "branch_count", "conditional_count")), (LOOP, ("complexity", "branch_count", "loop_count")), (HANDLER, ("complexity", "branch_count")), (LOGIC, ("complexity", "conditional_count")), (RETURN, ("return_count",))):
        if pattern.search(line):
            for n in names:
                f[n] += 1
    for name in CALL.findall(line):
        if name not in NO_CALLS:
            f["call_count"] += 1
            calls.append((f["start"], {"caller": f["name"], "callee": name, "line": number}))


def read_python(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """The outline of each file as one row of :data:`SCHEMA`; outlines leave a worker some files at a time."""
    schema = ship(files.sparkSession).createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                yield pa.RecordBatch.from_pylist([outline(p.as_py(), t.as_py()) for p, t in zip(part.column(0), part.column(1), strict=True)], schema=arrow)

    return files.select(path, text).mapInArrow(run, schema)
