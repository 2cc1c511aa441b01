"""What JavaScript files declare of an HTTP interface: imports by local name, mounts, middleware, routes and the contracts of
handlers, found among a file's tokens; a row for each file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .javascript import Broken, Token, _pairs, scan

# Methods that register a route, and names that tell calls of databases and of other services.
METHODS = ["get", "post", "put", "delete", "patch", "options", "head", "all"]
DATABASE_CALLS = ["query", "find", "findone", "findbyid", "create", "update", "delete", "save", "insert"]
DATABASE_OBJECTS = ["pool", "client", "db", "mongoose"]
EXTERNAL_CALLS = ["fetch", "axios", "request", "verifyidtoken"]
EXTERNAL_OBJECTS = ["client"]

_CONTRACT = "struct<parameters: array<struct<name: string, place: string>>, fields: array<string>, statuses: array<int>, shapes: array<array<string>>, downstream: array<string>, is_async: boolean, has_try: boolean, database: boolean, external: boolean>"
SCHEMA = (
    "path string, imports array<struct<local: string, target: string, line: int>>, mounts array<struct<prefix: string, name: string>>, middleware array<string>, "
    f"routes array<struct<method: string, path: string, router: string, line: int, place: int, middleware: array<string>, handler: string, contract: {_CONTRACT}>>, "
    f"functions array<struct<name: string, contract: {_CONTRACT}>>"
)


class _File:
    def __init__(self, tokens: list[Token]):
        self.t, self.pair = tokens, _pairs(tokens)
        self.open = {close: o for o, close in self.pair.items()}

    def raw(self, i: int) -> str:
        return self.t[i].raw if 0 <= i < len(self.t) and self.t[i].kind in ("mark", "word", "name") else ""

    def name(self, i: int) -> str | None:
        return self.t[i].raw if 0 <= i < len(self.t) and self.t[i].kind == "name" else None

    def split(self, i: int, end: int) -> list[tuple[int, int]]:
        """The parts between top-level commas."""
        parts, first = [], i
        while i < end:
            if self.raw(i) == "," and self.t[i].kind == "mark":
                parts.append((first, i))
                first = i + 1
            i = self.pair[i] + 1 if i in self.pair else i + 1
        return [p for p in [*parts, (first, end)] if p[0] < p[1]]

    def text(self, part: tuple[int, int] | None) -> str | None:
        """The value of a string, a template without expressions, or a sum of those."""
        out, i = "", part[0] if part else 0
        while part and i < part[1]:
            if self.t[i].kind == "string":
                out += self.t[i].raw[1:-1]
            elif self.raw(i) == "`" and self.raw(i + 2) == "`" and self.t[i + 1].kind == "template":
                out, i = out + self.t[i + 1].raw, i + 2
            elif self.raw(i) == "`" and self.raw(i + 1) == "`":
                i += 1
            else:
                return None
            if i + 1 == part[1]:
                return out
            if self.raw(i + 1) != "+":
                return None
            i += 2
        return None

    def called(self, part: tuple[int, int], other: str | None) -> str | None:
        """The name of a middleware: a name, a property, or a call's name with brackets."""
        a, b = part
        if b == a + 1:
            return self.name(a) or other
        if self.raw(b - 2) == "." and not any(i in self.pair for i in range(a, b)):
            return self.t[b - 1].raw
        if self.name(a) and self.raw(a + 1) == "(" and self.pair[a + 1] == b - 1:
            return f"{self.t[a].raw}()"
        return other

    def function(self, part: tuple[int, int]) -> tuple[int, int, bool, str | None] | None:
        """(first, last + 1, asynchronous, own name) of a part that is a function."""
        i, end = part
        is_async = self.raw(i) == "async"
        i += is_async
        if self.raw(i) == "function":
            return part[0], end, is_async, self.name(i + 1 + (self.raw(i + 1) == "*"))
        head = self.pair[i] + 1 if self.raw(i) == "(" else i + 1
        return (part[0], end, is_async, None) if self.raw(head) == "=>" else None

    def start_of(self, i: int) -> int:
        """Where the chain of names, brackets and calls begins whose last name is at i."""
        while True:
            if i in self.open:
                o = self.open[i]
                callee = o and (self.name(o - 1) or self.raw(o - 1) in (")", "]", "this"))
                i = o - 1 if callee and self.t[o].raw in "([" else o
                if not callee:
                    return i
                continue
            if self.raw(i - 1) == ".":
                i -= 2
                continue
            return i

    def calls(self, a: int, b: int):
        """(place of the name, object, name, arguments) of all calls; of a chain the last call comes first."""
        found = []
        for i in range(a, b - 1):
            if self.t[i].kind in ("name", "word") and self.raw(i + 1) == "(" and (self.t[i].kind == "name" or self.raw(i - 1) == ".") and self.raw(i - 1) not in ("function", "new"):
                found.append((self.start_of(i), -self.pair[i + 1], i))
        for _, _, i in sorted(found):
            member = self.raw(i - 1) == "."
            obj = self.name(i - 2) if member and self.raw(i - 3) not in (".", "?.") else None
            yield i, member, obj, self.t[i].raw, self.split(i + 2, self.pair[i + 1])

    def keys(self, i: int) -> list[str]:
        """The plain keys of an object or pattern that opens at i."""
        return [self.t[a].raw for a, b in self.split(i + 1, self.pair[i]) if self.t[a].kind in ("name", "word")]

    def contract(self, a: int, b: int, is_async: bool) -> dict:
        parameters, fields, statuses, shapes, downstream = {}, {}, {}, [], []
        c = {"is_async": is_async, "has_try": any(self.raw(i) == "try" and self.raw(i + 1) == "{" for i in range(a, b)), "database": False, "external": False}

        def take(place: str, names: list[str]) -> None:
            for n in names:
                if place == "body":
                    fields[n] = True
                else:
                    parameters[n, "path" if place == "params" else place] = True

        for i in range(a, b - 2):
            if self.name(i) == "req" and self.raw(i + 1) == "." and self.raw(i - 1) != "." and self.raw(i + 2) in ("params", "query", "body"):
                place = self.raw(i + 2)
                if self.raw(i + 3) in (".", "?.") and place != "params" and i + 4 < b:
                    take(place, [self.t[i + 4].raw])
                elif self.raw(i - 1) == "=" and self.raw(i - 2) == "}":
                    take(place, self.keys(self.open[i - 2]))
        for _, member, obj, name, arguments in self.calls(a, b):
            low = name.lower()
            if member and name in ("status", "sendStatus") and arguments and self.t[arguments[0][0]].kind == "num" and self.t[arguments[0][0]].raw.isdigit():
                statuses[int(self.t[arguments[0][0]].raw)] = True
            if member and name in ("json", "send"):
                statuses = statuses or {200: True}
                if arguments and self.raw(arguments[0][0]) == "{" and self.pair[arguments[0][0]] == arguments[0][1] - 1:
                    keys = self.keys(arguments[0][0])
                    if keys and keys not in shapes:
                        shapes.append(keys)
            if low in DATABASE_CALLS or (obj or "").lower() in DATABASE_OBJECTS:
                c["database"] = True
                downstream.append(f"db.{name}")
            if low in EXTERNAL_CALLS or obj in EXTERNAL_OBJECTS:
                c["external"] = True
                downstream.append(f"external.{name}")
        return c | {"parameters": [{"name": n, "place": p} for n, p in parameters], "fields": list(fields), "statuses": sorted(statuses), "shapes": shapes, "downstream": downstream}


def declared(path: str | None, text: str | None) -> dict:
    """One file's declarations; a text whose brackets don't match has none. Never fails."""
    out = {"path": path, "imports": [], "mounts": [], "middleware": [], "routes": [], "functions": []}
    try:
        f = _File(scan(text or "")[0])
    except Broken:
        return out
    t = f.t
    for i, token in enumerate(t):
        if token.kind == "word" and token.raw == "import" and f.raw(i + 1) not in ("(", "."):
            j, names = i + 1, []
            while j < len(t) and t[j].kind != "string" and f.raw(j) != ";":
                if f.raw(j) == "{":
                    names += [t[b - 1].raw for a, b in f.split(j + 1, f.pair[j])]
                    j = f.pair[j]
                elif t[j].kind == "name" and f.raw(j) not in ("from", "as"):
                    names.append(t[j].raw)
                j += 1
            if j < len(t) and t[j].kind == "string":
                out["imports"] += [{"local": n, "target": t[j].raw[1:-1], "line": token.line} for n in names]
        if f.name(i) == "require" and f.raw(i + 1) == "(" and f.raw(i - 1) == "=" and f.name(i - 2) and (target := f.text((i + 2, f.pair[i + 1]))) is not None:
            out["imports"].append({"local": t[i - 2].raw, "target": target, "line": token.line})
        if token.kind == "word" and token.raw == "function" and f.name(i + 1 + (f.raw(i + 1) == "*")):
            at = i + 2 + (f.raw(i + 1) == "*")
            body = f.pair[at] + 1 if f.raw(at) == "(" else at
            if f.raw(body) == "{" and f.raw(i - 1) not in ("=", "(", ",", ":", "return") and not (f.raw(i - 1) == "async" and f.raw(i - 2) in ("=", "(", ",", ":", "return")):
                out["functions"].append({"name": t[at - 1].raw, "contract": f.contract(body, f.pair[body], f.raw(i - 1) == "async")})
        if token.raw in ("const", "let", "var") and token.kind == "word" and f.name(i + 1) and f.raw(i + 2) == "=":
            value = f.function((i + 3, len(t)))
            if value:
                j = i + 3
                while j < len(t) and f.raw(j) != "{" and f.raw(j) != ";":
                    j = f.pair[j] + 1 if f.raw(j) == "(" else j + 1
                end = f.pair[j] if f.raw(j) == "{" else min(j, len(t))
                out["functions"].append({"name": t[i + 1].raw, "contract": f.contract(i + 3, end, value[2])})
    for i, member, obj, name, arguments in f.calls(0, len(t)):
        if not member or not arguments:
            continue
        first = f.text(arguments[0])
        if name == "use":
            if first is None:
                out["middleware"] += [n for n in (f.called(a, None) for a in arguments) if n]
            if len(arguments) == 1 and f.name(arguments[0][0]) and arguments[0][1] == arguments[0][0] + 1:
                out["mounts"].append({"prefix": "", "name": t[arguments[0][0]].raw})
            elif len(arguments) > 1 and first is not None and f.name(arguments[1][0]) and arguments[1][1] == arguments[1][0] + 1:
                out["mounts"].append({"prefix": first, "name": t[arguments[1][0]].raw})
        if name.lower() in METHODS and first is not None:
            handler, contract = "anonymous", None
            if len(arguments) > 1:
                a, b = arguments[-1]
                if found := f.function((a, b)):
                    handler, contract = found[3] or "anonymousHandler", f.contract(a, b, found[2])
                elif b == a + 1 and f.name(a):
                    handler = t[a].raw
                elif b > a + 2 and f.raw(b - 2) == ".":
                    handler = f"{f.name(a) if b == a + 3 and f.name(a) else 'obj'}.{t[b - 1].raw}"
            out["routes"].append({
                "method": name.upper(), "path": first, "router": obj or "app", "line": t[f.start_of(i)].line, "place": i,
                "middleware": [f.called(a, "middleware") for a in arguments[1:-1]], "handler": handler, "contract": contract,
            })
    return out


def read_routes(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """The declarations of JavaScript and TypeScript files (by their names) as rows of :data:`SCHEMA`; null texts have none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(ship(files.sparkSession).createDataFrame([], SCHEMA).schema)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_pylist([declared(p.as_py(), t.as_py()) for p, t in zip(part.column(0), part.column(1), strict=True)], schema=arrow)

    script = files.where(F.lower(path).rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$"))
    return script.select(path, text).mapInArrow(run, SCHEMA)
