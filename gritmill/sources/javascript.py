"""JavaScript and TypeScript sources: tokens with modes for templates and JSX, and an outline of symbols, imports, exports,
calls and function measures. Both work on one file's text in an Arrow batch; nothing is shared between files."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..shipping import ship
from .python_code import _MEASURES
from .python_code import SCHEMA as _OUTLINE

#: Words that are no identifiers.
RESERVED = set("""break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return
super switch this throw try typeof var void while with yield null true false let static await async enum""".split())
#: Words after which a slash begins a regular expression and ``<`` an element.
BEFORE_VALUE = set("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
PUNCTUATION = """>>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **
{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #""".split()
SPACE = re.compile(r"[^\S\n]+|\ufeff|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\A#![^\n]*")
NAME = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*|\\u[0-9a-fA-F]{4}[\w$]*")
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
STRING = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'?|\"(?:[^\"\\\n]|\\[\s\S])*\"?")
REGEXP = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
MARK = re.compile("|".join(map(re.escape, PUNCTUATION)))
ELEMENT = re.compile(r"<(?:>|[^\W\d][\w$.:-]*(?!\s*(?:,|extends\b)|[\w$.:-]))")
JSX_NAME = re.compile(r"[^\W\d][\w$.:-]*")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Token:
    __slots__ = ("end", "kind", "line", "raw")

    def __init__(self, kind: str, raw: str, line: int, end: int):
        self.kind, self.raw, self.line, self.end = kind, raw, line, end


def scan(text: str, jsx: bool = True) -> tuple[list[Token], int]:
    """The tokens of a text and its number of comments. Kinds: name, word (reserved), num, string, regexp, template (a
    literal part), text (between elements), jsx (an element's marks) and mark. Whether a slash divides and ``<`` compares
    is told by the token before, and for closing brackets by what was before the opening one. Never fails: what fits nothing
    is skipped, what is not closed ends with its line or the text."""
    out: list[Token] = []
    comments, at, line = 0, 0, 1
    #: What is open: a bracket with whether a value may follow its end, a template, a tag, or what stands between tags.
    open_: list[tuple[str, bool]] = []
    value = True  # whether a value may begin here

    def add(kind: str, raw: str) -> None:
        nonlocal line
        first = line
        line += raw.count("\n")
        out.append(Token(kind, raw, first, line))

    while at < len(text):
        mode = open_[-1][0] if open_ else ""
        if mode == "`":
            m = TEMPLATE.match(text, at)
            if m[0]:
                add("template", m[0])
            at = m.end()
            if text.startswith("${", at):
                add("mark", "${")
                open_.append(("${", False))
                at, value = at + 2, True
            elif at < len(text):
                add("mark", "`")
                open_.pop()
                at, value = at + 1, False
            continue
        if mode == "between":
            end = min([k for k in (text.find("<", at), text.find("{", at)) if k >= 0], default=len(text))
            if text[at:end].strip():
                add("text", text[at:end])
            else:
                line += text.count("\n", at, end)
            at = end
            if text.startswith("</", at):
                open_[-1] = ("close", False)
                add("jsx", "</")
                at += 2
            elif text.startswith("<", at):
                open_.append(("tag", False))
                add("jsx", "<")
                at += 1
            elif at < len(text):
                open_.append(("{", False))
                add("mark", "{")
                at, value = at + 1, True
            continue
        c = text[at]
        if c == "\n":
            line, at = line + 1, at + 1
            continue
        if m := SPACE.match(text, at):
            comments += m[0].startswith("/")
            line += m[0].count("\n")
            at = m.end()
            continue
        if mode in ("tag", "close"):
            if text.startswith("/>", at) or (c == ">" and mode == "close"):
                add("jsx", "/>" if c == "/" else ">")
                at += 2 if c == "/" else 1
                open_.pop()
                value = False
            elif c == ">":
                add("jsx", ">")
                open_[-1] = ("between", False)
                at += 1
            elif c == "{":
                add("mark", "{")
                open_.append(("{", False))
                at, value = at + 1, True
            elif c in "'\"":
                end = text.find(c, at + 1)
                end = len(text) if end < 0 else end + 1
                add("string", text[at:end])
                at = end
            elif m := JSX_NAME.match(text, at):
                add("name", m[0])
                at = m.end()
            else:
                add("jsx", c)
                at += 1
            continue
        if m := NAME.match(text, at):
            before = out[-1].raw if out else ""
            word = m[0] in RESERVED and before not in (".", "?.")
            add("word" if word else "name", m[0])
            value = m[0] in BEFORE_VALUE and before not in (".", "?.")
        elif m := (NUMBER.match(text, at) if c.isdigit() or c == "." else None):
            add("num", m[0])
            value = False
        elif m := STRING.match(text, at):
            add("string", m[0])
            value = False
        elif c == "`":
            add("mark", "`")
            open_.append(("`", False))
            at += 1
            continue
        elif c == "/" and value and (m := REGEXP.match(text, at)):
            add("regexp", m[0])
            value = False
        elif c == "<" and value and jsx and ELEMENT.match(text, at):
            add("jsx", "<")
            open_.append(("tag", False))
            at += 1
            continue
        elif m := MARK.match(text, at):
            mark = m[0]
            before = out[-1] if out else None
            if mark in OPEN:
                # after a condition's bracket and after a block a value may begin
                after = mark == "(" and before is not None and before.raw in ("if", "while", "for", "with")
                after |= mark == "{" and (before is None or before.raw in (")", ";", "{", "}", "else", "do", "try", "finally", "=>"))
                open_.append((mark, after))
                value = True
            elif mark in CLOSE:
                value = mark == "}"
                if open_ and open_[-1][0] in (CLOSE[mark], "${"):
                    value = open_.pop()[1]
            elif mark not in ("++", "--"):
                value = True
            add("mark", mark)
            at = m.end()
            continue
        else:
            at += 1
            continue
        at = m.end()
    return out, comments


class Broken(Exception):
    """Brackets that don't match."""


def _pairs(tokens: list[Token]) -> dict[int, int]:
    pairs: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.raw in ("(", "[", "{", "${"):
            stack.append(i)
        elif t.kind == "mark" and t.raw in CLOSE:
            if not stack or tokens[stack[-1]].raw not in (CLOSE[t.raw], "${" if t.raw == "}" else ""):
                raise Broken(f"line {t.line}: {t.raw} closes nothing")
            pairs[stack.pop()] = i
    if stack:
        raise Broken(f"line {tokens[stack[-1]].line}: {tokens[stack[-1]].raw} is not closed")
    return pairs


MODIFIERS = set("static async get set public private protected readonly abstract override declare accessor".split())
#: Tokens between which a line's end doesn't end a statement.
_JOINS = set("=> ... === !== == != <= >= && || ?? ?. += -= *= /= %= **= &&= ||= ??= &= |= ^= << >> >>> ** ( [ , < > + - * / % & | ^ ? : = .".split())


class _Walk:
    """One pass over the tokens, statement by statement. Each function has a frame; what it counts goes to the innermost
    frame and on through methods to the first function around them."""

    def __init__(self, tokens: list[Token], path: str | None, out: dict):
        self.t, self.pair, self.path, self.out = tokens, _pairs(tokens), path, out
        self.frames: list[dict] = []

    def raw(self, i: int) -> str:
        return self.t[i].raw if 0 <= i < len(self.t) and self.t[i].kind in ("mark", "word", "name") else ""

    def is_mark(self, i: int, mark: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "mark" and self.t[i].raw == mark

    def line(self, i: int) -> int:
        return self.t[i].line if i < len(self.t) else (self.t[-1].end if self.t else 1)

    def counting(self):
        for f in reversed(self.frames):
            yield f
            if f["closed"]:
                return

    def count(self, *names: str) -> None:
        for f in self.counting():
            for n in names:
                f[n] += 1

    def nested(self, step: int) -> None:
        for f in self.counting():
            f["deep"] += step
            f["nesting"] = max(f["nesting"], f["deep"])

    # --- statements

    def block(self, i: int, end: int) -> None:
        while i < end:
            after = self.statement(i, end)
            i = max(after, i + 1)

    def body(self, i: int, end: int) -> int:
        """A statement or block below a condition."""
        if self.is_mark(i, "{"):
            self.block(i + 1, self.pair[i])
            return self.pair[i] + 1
        return self.statement(i, end)

    def condition(self, i: int) -> int:
        if self.is_mark(i, "("):
            self.expression(i + 1, self.pair[i])
            return self.pair[i] + 1
        return i

    def statement(self, i: int, end: int) -> int:
        t = self.t[i]
        word = t.raw if t.kind in ("word", "name") else ""
        if self.is_mark(i, "{"):
            self.block(i + 1, self.pair[i])
            return self.pair[i] + 1
        if self.is_mark(i, ";"):
            return i + 1
        if self.is_mark(i, "@"):  # a decorator
            j = i + 2
            while self.is_mark(j, "."):
                j += 2
            return self.condition(j)
        if word == "if":
            self.count("complexity", "branch_count", "conditional_count")
            self.nested(1)
            i = self.body(self.condition(i + 1), end)
            if i < end and self.raw(i) == "else":
                i = self.body(i + 1, end)
            self.nested(-1)
            return i
        if word in ("for", "while") or (word == "with" and t.kind == "word"):
            if word != "with":
                self.count("complexity", "branch_count", "loop_count")
                self.nested(1)
            i += 2 if self.raw(i + 1) == "await" else 1
            if self.is_mark(i, "("):
                self.block(i + 1, self.pair[i])
                i = self.pair[i] + 1
            i = self.body(i, end) if i < end else i
            if word != "with":
                self.nested(-1)
            return i
        if word == "do":
            self.count("complexity", "branch_count", "loop_count")
            self.nested(1)
            i = self.body(i + 1, end)
            i = self.condition(i + 1) if i < end and self.raw(i) == "while" else i
            self.nested(-1)
            return i
        if word == "switch" and self.is_mark(i + 1, "("):
            self.nested(1)
            i = self.condition(i + 1)
            if self.is_mark(i, "{"):
                self.block(i + 1, self.pair[i])
                i = self.pair[i] + 1
            self.nested(-1)
            return i
        if word == "case" and t.kind == "word":
            self.count("complexity", "branch_count")
            return self.expression(i + 1, end, {":"}) + 1
        if word == "default" and self.is_mark(i + 1, ":"):
            return i + 2
        if word == "try" and self.is_mark(i + 1, "{"):
            self.nested(1)
            i = self.body(i + 1, end)
            if i < end and self.raw(i) == "catch":
                self.count("complexity", "branch_count")
                self.nested(1)
                i = self.body(self.pair[i + 1] + 1 if self.is_mark(i + 1, "(") else i + 1, end)
                self.nested(-1)
            if i < end and self.raw(i) == "finally":
                i = self.body(i + 1, end)
            self.nested(-1)
            return i
        if word == "import" and not self.is_mark(i + 1, "(") and not self.is_mark(i + 1, "."):
            return self.imported(i, end)
        if word == "export":
            return self.exported(i, end)
        if word == "function" or (word == "async" and self.raw(i + 1) == "function"):
            return self.function(i, declared=True)
        if word == "class" or (word == "abstract" and self.raw(i + 1) == "class"):
            return self.klass(i, declared=True)
        if word in ("var", "let", "const") and not (word == "const" and self.raw(i + 1) == "enum"):
            return self.declarators(i + 1, end)
        if word in ("interface", "namespace", "module", "enum", "declare", "type") and i + 1 < end and self.t[i + 1].kind in ("name", "word") and self.t[i + 1].line == t.line and self.raw(i + 1) not in ("in", "instanceof", "of"):
            return self.typed(i, end)
        if word == "return":
            self.count("return_count")
            return self.expression(i + 1, end, lines=True, begun=i)
        if t.kind == "name" and self.is_mark(i + 1, ":"):  # a label
            return self.statement(i + 2, end) if i + 2 < end else end
        return self.expression(i, end, lines=True)

    def typed(self, i: int, end: int) -> int:
        """What declares types alone is passed over; namespaces are blocks."""
        word = self.t[i].raw
        j = i + 1
        if word == "declare":
            return self.statement(j, end) if self.raw(j) not in ("function",) else self.past(j, end)
        if word in ("namespace", "module"):
            while j < end and not self.is_mark(j, "{"):
                j += 1
            return self.body(j, end) if j < end else j
        return self.past(j, end, block=word != "type")

    def past(self, i: int, end: int, block: bool = False) -> int:
        """Behind a declaration that has no code: its block, or its semicolon or line."""
        last = i
        while i < end:
            if self.is_mark(i, ";"):
                return i + 1
            if i > last and self.t[i].line > self.t[last].end and self.raw(i) not in _JOINS and self.raw(last) not in _JOINS | {"{", "|", "&"}:
                return i
            if self.t[i].kind == "mark" and i in self.pair:
                was, last = i, self.pair[i]
                i = last + 1
                if block and self.t[was].raw == "{":
                    return i
                continue
            last, i = i, i + 1
        return i

    # --- declarations

    def module(self, i: int, end: int) -> tuple[str | None, int]:
        """The string that names a module, from i on in the statement."""
        while i < end and not self.is_mark(i, ";"):
            if self.t[i].kind == "string":
                return self.t[i].raw[1:-1], i + 1
            i += 1
        return None, i

    def imported(self, i: int, end: int) -> int:
        first, names = i, []
        i += 1
        if i < end and self.raw(i) == "type" and i + 1 < end and (self.is_mark(i + 1, "{") or (self.t[i + 1].kind == "name" and self.raw(i + 1) != "from")):
            i += 1
        while i < end and self.t[i].kind != "string" and not self.is_mark(i, ";"):
            if self.is_mark(i, "{"):
                j = i + 1
                while j < self.pair[i]:
                    j += self.raw(j) == "type" and not self.is_mark(j + 1, ",") and j + 1 < self.pair[i] and self.raw(j + 1) != "as"
                    names.append(self.t[j].raw)
                    while j < self.pair[i] and not self.is_mark(j, ","):
                        j += 1
                    j += 1
                i = self.pair[i]
            elif self.is_mark(i, "*"):
                names.append("*")
                i += 2  # as and the name
            elif self.t[i].kind == "name" and self.raw(i) != "from":
                names.append("default")
            i += 1
        target, i = self.module(i, end)
        if target is not None:
            self.out["imports"].append({"target": target, "symbols": names, "line": self.line(first)})
            self.symbol("IMPORT", target, first, i - 1)
        return i + 1 if self.is_mark(i, ";") else i

    def exported(self, i: int, end: int) -> int:
        line, j = self.line(i), i + 1
        export = lambda name, default=False: self.out["exports"].append({"name": name, "is_default": default, "line": line})
        if self.raw(j) == "default":
            j += 1
            k = j + (self.raw(j) in ("async", "abstract"))
            if self.raw(k) in ("function", "class"):
                k += 1 + self.is_mark(k + 1, "*")
                name = self.t[k].raw if k < end and self.t[k].kind == "name" else "default"
                at = self.statement(j, end)
            else:
                name = self.t[j].raw if j < end and self.t[j].kind == "name" and (j + 1 >= end or self.is_mark(j + 1, ";") or self.t[j + 1].line > self.t[j].line) else "default"
                at = self.expression(j, end, lines=True)
            export(name, True)
            self.symbol("EXPORT", name, i, at - 1)
            return at
        if self.is_mark(j, "*"):
            if self.raw(j + 1) == "as":
                export(self.t[j + 2].raw)
            return self.module(j, end)[1]
        if self.raw(j) == "type" and self.is_mark(j + 1, "{"):
            j += 1
        if self.is_mark(j, "{"):
            k = j + 1
            while k < self.pair[j]:
                last = k
                while k < self.pair[j] and not self.is_mark(k, ","):
                    last, k = k, k + 1
                export(self.t[last].raw)
                k += 1
            at = self.pair[j] + 1
            return self.module(at, end)[1] if at < end and self.raw(at) == "from" else at
        if self.raw(j) in ("var", "let", "const") and self.raw(j + 1) != "enum":
            return self.declarators(j + 1, end, export)
        k = j
        while self.raw(k) in ("async", "abstract", "declare", "const"):
            k += 1
        if self.raw(k) in ("function", "class", "interface", "type", "enum", "namespace"):
            k += 1 + self.is_mark(k + 1, "*")
            if k < end and self.t[k].kind == "name":
                export(self.t[k].raw)
        return self.statement(j, end) if j < end else j

    def symbol(self, kind: str, name: str, first: int, last: int) -> dict:
        s = {"type": kind, "name": name, "start": self.line(first), "end": self.t[min(last, len(self.t) - 1)].end}
        self.out["symbols"].append(s)
        return s

    def declarators(self, i: int, end: int, export=None) -> int:
        """Names with their values, up to the end of the statement; functions as values are functions of that name."""
        while i < end:
            name, first = None, i
            if self.is_mark(i, "{") or self.is_mark(i, "["):
                i = self.pair[i] + 1
            elif self.t[i].kind in ("name", "word"):
                name = self.t[i].raw
                i += 1
            else:
                break
            if export and name:
                export(name)
            if self.is_mark(i, ":"):  # a type
                i = self.type_end(i + 1, end)
            elif i + 1 < end and self.is_mark(i, "!") and self.is_mark(i + 1, ":"):
                i = self.type_end(i + 2, end)
            if self.is_mark(i, "="):
                i += 1
                if i + 2 < end and self.raw(i) == "require" and self.is_mark(i + 1, "(") and self.t[i + 2].kind == "string":
                    self.out["imports"].append({"target": self.t[i + 2].raw[1:-1], "symbols": [name or "*"], "line": self.line(first)})
                at = self.named_function(i, end, name or "anonymous")
                i = self.expression(i if at is None else at, end, {","}, lines=True, begun=i - 1)
            elif i < end and self.raw(i) in ("of", "in"):
                return self.expression(i + 1, end)
            if self.is_mark(i, ","):
                i += 1
                continue
            break
        return i + 1 if i < end and self.is_mark(i, ";") else i

    def type_end(self, i: int, end: int) -> int:
        depth = 0
        while i < end:
            if i in self.pair:
                i = self.pair[i] + 1
                continue
            raw = self.raw(i)
            if raw == "<":
                depth += 1
            elif raw in (">", ">>", ">>>"):
                depth -= len(raw)
            elif depth <= 0 and raw in ("=", ",", ";", ")", "of", "in"):
                break
            elif depth <= 0 and i and self.t[i].line > self.t[i - 1].end and raw not in _JOINS and self.raw(i - 1) not in _JOINS:
                break
            i += 1
        return i

    # --- functions and classes

    def parameters(self, i: int) -> int:
        n, end, j, some = 0, self.pair[i], i + 1, False
        depth = 0
        while j < end:
            if j in self.pair:
                j, some = self.pair[j] + 1, True
                continue
            depth += (self.raw(j) == "<") - (self.raw(j) == ">")
            if self.is_mark(j, ",") and depth <= 0:
                n, some = n + some, False
            else:
                some = True
            j += 1
        return n + some

    def frame(self, name: str, caller: str, closed: bool, params: int) -> dict:
        f = dict.fromkeys(_MEASURES, 0) | {"name": name, "caller": caller, "closed": closed, "deep": 0, "complexity": 1, "parameter_count": params}
        self.frames.append(f)
        return f

    def run(self, f: dict, i: int, end: int, arrow: bool = False) -> int:
        """The function's body: a block, or an arrow's expression."""
        if i < end and self.is_mark(i, "{"):
            self.block(i + 1, self.pair[i])
            i = self.pair[i] + 1
        elif arrow:
            i = self.expression(i, end, {",", ":"}, lines=True)
        self.frames.pop()
        return i

    def measured(self, f: dict, s: dict) -> None:
        self.out["functions"].append({m: f[m] for m in _MEASURES} | {"name": s["name"], "start": s["start"], "end": s["end"], "lines": max(1, s["end"] - s["start"] + 1)})

    def opening(self, i: int, end: int) -> int:
        """The block behind a parameter list and its type; or where there is none."""
        i += 1
        if self.is_mark(i, ":"):
            i += 1
            while i < end and not (self.is_mark(i, "{") and self.raw(i - 1) not in (":", "|", "&", "=>", "<", ",")) and not self.is_mark(i, ";"):
                if self.t[i].line > self.t[i - 1].end and not self.is_mark(i, "{") and self.raw(i) not in _JOINS and self.raw(i - 1) not in _JOINS | {":"}:
                    return end
                i = self.pair[i] + 1 if i in self.pair else i + 1
        return i

    def generic(self, i: int, end: int) -> int:
        """Behind <...>, if it begins here."""
        if self.raw(i) == "<":
            depth = 0
            while i < end:
                depth += (self.raw(i) == "<") - {">": 1, ">>": 2, ">>>": 3}.get(self.raw(i), 0)
                i += 1
                if depth <= 0:
                    break
        return i

    def function(self, i: int, declared: bool = False, named: str | None = None) -> int:
        first, end = i, len(self.t)
        i += 1 + (self.raw(i) == "async")
        i += self.is_mark(i, "*")
        own = None
        if i < end and self.t[i].kind in ("name", "word"):
            own, i = self.t[i].raw, i + 1
        i = self.generic(i, end)
        if not self.is_mark(i, "("):
            return max(i, first + 1)
        params, at = self.parameters(i), self.opening(self.pair[i], end)
        if not self.is_mark(at, "{"):  # a signature
            return max(at, self.pair[i] + 1) if at < end else self.pair[i] + 1
        name = (own or "anonymous") if declared else named
        s = self.symbol("FUNCTION", name, first, self.pair[at]) if name else None
        f = self.frame(name or "", own or named or "global", True, params)
        if s:
            slot = len(self.out["functions"])
        i = self.run(f, at, end)
        if s:
            self.measured(f, s)
            self.out["functions"].insert(slot, self.out["functions"].pop())
        return i

    def arrow(self, i: int, end: int) -> tuple[int, int] | None:
        """(number of parameters, where the body begins) if an arrow function begins here."""
        i += self.raw(i) == "async" and self.t[i].kind == "word" and not self.is_mark(i + 1, "=>")
        if i + 1 < end and self.t[i].kind in ("name", "word") and self.is_mark(i + 1, "=>"):
            return 1, i + 2
        j = self.generic(i, end) if self.raw(i) == "<" else i
        if not self.is_mark(j, "("):
            return None
        k = self.pair[j] + 1
        if self.is_mark(k, ":"):  # a type
            k += 1
            while k < end and not self.is_mark(k, "=>"):
                if k in self.pair:
                    k = self.pair[k] + 1
                elif self.t[k].kind in ("name", "word") or self.raw(k) in ("<", ">", "|", "&", ".", ","):
                    k += 1
                else:
                    return None
        return (self.parameters(j), k + 1) if self.is_mark(k, "=>") else None

    def named_function(self, i: int, end: int, name: str) -> int | None:
        """A function that is a variable's value, recorded under its name; where it ends."""
        if i >= end:
            return None
        if self.raw(i) == "function" or (self.raw(i) == "async" and self.raw(i + 1) == "function"):
            return self.function(i, named=name)
        found = self.arrow(i, end)
        if not found:
            return None
        params, at = found
        s, slot = self.symbol("FUNCTION", name, i, at), len(self.out["functions"])
        f = self.frame(name, name, True, params)
        after = self.run(f, at, end, arrow=True)
        s["end"] = self.t[after - 1].end
        self.measured(f, s)
        self.out["functions"].insert(slot, self.out["functions"].pop())
        return after

    def klass(self, i: int, declared: bool = False) -> int:
        first, end = i, len(self.t)
        i += 1 + (self.raw(i) == "abstract")
        name, parent = "AnonymousClass", None
        if i < end and self.t[i].kind == "name" and self.raw(i) != "implements":
            name, i = self.t[i].raw, i + 1
        i = self.generic(i, end)
        if self.raw(i) == "extends":
            plain = i + 1 < end and self.t[i + 1].kind == "name" and (self.is_mark(i + 2, "{") or self.raw(i + 2) in ("implements", "<"))
            parent = self.t[i + 1].raw if plain else None
            i += 1
        while i < end and not self.is_mark(i, "{"):
            i = self.pair[i] + 1 if i in self.pair else i + 1
        if i >= end:
            return end
        close = self.pair[i]
        if declared:
            self.symbol("CLASS", name, first, close)
            if parent:
                self.out["inheritance"].append({"class_name": name, "parent": parent, "line": self.line(first)})
        j = i + 1
        while j < close:
            j = max(self.member(j, close), j + 1)
        return close + 1

    def member(self, i: int, end: int) -> int:
        """One member of a class."""
        if self.is_mark(i, ";"):
            return i + 1
        if self.is_mark(i, "@"):
            return self.statement(i, end)
        first = i
        while i + 1 < end and self.raw(i) in MODIFIERS and not self.is_mark(i + 1, "(") and self.raw(i + 1) not in ("=", ";", ":", "?", "!", "<"):
            if self.raw(i) == "static" and self.is_mark(i + 1, "{"):
                return self.body(i + 1, end)
            i += 1
        i += self.is_mark(i, "*")
        if i >= end:
            return i
        key = self.t[i]
        i = self.pair[i] + 1 if i in self.pair else i + 1
        i += i < end and self.raw(i) in ("?", "!")
        k = self.generic(i, end)
        if k < end and self.is_mark(k, "("):
            at = self.opening(self.pair[k], end)
            if at < end and self.is_mark(at, "{"):
                private = key.raw.startswith("#")
                name = key.raw if key.kind in ("name", "word") else "method"
                kind = "CONSTRUCTOR" if name == "constructor" else "METHOD"
                s = None if private else self.symbol(kind, name, first, self.pair[at])
                slot = len(self.out["functions"])
                f = self.frame(name, name if key.kind in ("name", "word") and not private else "global", False, self.parameters(k))
                i = self.run(f, at, end)
                if s:
                    self.measured(f, s)
                    self.out["functions"].insert(slot, self.out["functions"].pop())
                return i
            return at + 1 if at < end and self.is_mark(at, ";") else self.pair[k] + 1
        if i < end and self.is_mark(i, ":"):
            i = self.type_end(i + 1, end)
        if i < end and self.is_mark(i, "="):
            i = self.expression(i + 1, end, lines=True, begun=i)
        return i

    # --- expressions

    def expression(self, i: int, end: int, stops: set[str] = frozenset(), lines: bool = False, begun: int | None = None) -> int:
        """Passes over an expression up to a stop, a semicolon or the end; with ``lines`` also up to a line's end that
        ends a statement. Returns where it stops, behind a semicolon if no stops are given."""
        last, asked = begun, 0  # questions whose colon is still to come
        while i < end:
            t = self.t[i]
            if t.kind == "mark":
                if t.raw == ";":
                    return i if stops else i + 1
                if t.raw == ":" and asked:
                    asked -= 1
                elif t.raw in stops:
                    return i
            if lines and last is not None and t.line > self.t[last].end and self.splits(last, i):
                return i
            found = None
            if t.kind in ("name", "word") or (t.kind == "mark" and t.raw == "("):
                found = self.arrow(i, end) if not self.is_mark(i - 1, ".") and not (t.raw == "(" and self.calls(i)) else None
            if found:
                params, at = found
                last = self.run(self.frame("", "global", True, params), at, end, arrow=True) - 1
            elif t.kind == "word" and (t.raw == "function" or (t.raw == "async" and self.raw(i + 1) == "function")):
                last = self.function(i) - 1
            elif t.kind == "word" and t.raw == "class":
                last = self.klass(i) - 1
            elif t.kind == "mark" and t.raw in ("(", "["):
                if t.raw == "(":
                    self.call(i)
                self.items(i + 1, self.pair[i])
                last = self.pair[i]
            elif t.kind == "mark" and t.raw in ("{", "${"):
                if t.raw == "{" and not (i and self.t[i - 1].kind in ("jsx", "text")):
                    self.object(i)
                else:
                    self.items(i + 1, self.pair[i])
                last = self.pair[i]
            else:
                if t.kind == "mark":
                    if t.raw in ("&&", "||", "??"):
                        self.count("complexity", "conditional_count")
                    elif t.raw == "?" and not (i + 1 < end and self.raw(i + 1) in (":", ",", ")")):
                        self.count("complexity", "branch_count", "conditional_count")
                        asked += 1
                last = i
            i = last + 1
        return i

    def splits(self, last: int, i: int) -> bool:
        """Whether a statement ends between two tokens on different lines."""
        a, b = self.t[last], self.t[i]
        if b.kind == "mark" and (b.raw in _JOINS or b.raw in ("`", ")", "]", "}")):
            return False
        if b.raw in ("instanceof", "in", "of", "as", "satisfies") or b.kind in ("jsx", "text", "template"):
            return False
        if a.kind == "mark" and (a.raw in _JOINS or a.raw in ("!", "~", "${", "{")):
            return False
        return not (a.kind == "word" and a.raw in BEFORE_VALUE - {"return"})

    def items(self, i: int, end: int) -> None:
        while i < end:
            i = self.expression(i, end, {",", ";"}) + 1

    def object(self, i: int) -> None:
        """An object's members: methods have frames that count on outwards."""
        end, j = self.pair[i], i + 1
        while j < end:
            k = j
            while k + 1 < end and self.raw(k) in ("async", "get", "set") and self.raw(k + 1) not in (",", ":", "(", "="):
                k += 1
            k += self.is_mark(k, "*")
            if k < end:
                key, at = self.t[k], (self.pair[k] if k in self.pair else k) + 1
                if at < end and self.is_mark(at, "(") and key.kind in ("name", "word", "string", "num", "mark"):
                    body = self.opening(self.pair[at], end)
                    if body < end and self.is_mark(body, "{"):
                        named = key.raw if key.kind in ("name", "word") else "global"
                        j = self.run(self.frame("", named, False, 0), body, end) + 1
                        continue
                if at < end and self.is_mark(at, ":"):
                    j = at + 1
            j = self.expression(j, end, {","}) + 1

    def calls(self, i: int) -> bool:
        """Whether a bracket stands directly behind something that can be called."""
        if i == 0:
            return False
        b = self.t[i - 1]
        return b.kind == "name" or (b.kind == "mark" and b.raw in (")", "]", "!")) or (b.kind == "word" and b.raw in ("super", "import", "this"))

    def call(self, i: int) -> None:
        """Counts a call whose arguments open here, and records its name and caller."""
        if not self.calls(i):
            return
        parts: list[str] = []
        j, head = i - 1, False
        while j >= 0:
            if self.is_mark(j, "!"):
                j -= 1
                continue
            t = self.t[j]
            if t.kind in ("name", "word"):
                if self.raw(j - 1) == "?.":
                    return
                if self.is_mark(j - 1, "."):
                    parts.append(t.raw)
                    j -= 2
                    continue
                if t.kind == "name":
                    parts.append(t.raw)
                head = True
            elif self.is_mark(j, "]") or self.is_mark(j, ")"):
                o = next(a for a in range(j - 1, -1, -1) if self.pair.get(a) == j)
                if self.raw(o - 1) == "?.":
                    return
                if self.is_mark(j, "]") and o and (self.t[o - 1].kind in ("name", "word") or self.raw(o - 1) in (")", "]")):
                    if j == o + 2 and self.t[o + 1].kind in ("name", "string"):
                        parts.append(self.t[o + 1].raw.strip("'\""))
                    j = o - 1
                    continue
                j = o
            break
        if head and j and self.raw(j - 1) == "new" and self.t[j - 1].kind == "word":
            return
        self.count("call_count")
        name = ".".join(reversed(parts))
        if name and name != "require":
            self.out["calls"].append({"caller": self.frames[-1]["caller"] if self.frames else "global", "callee": name, "line": self.line(max(j, 0))})


#: An outline's columns: those of Python, exports, and how the parse went.
SCHEMA = _OUTLINE + ", exports array<struct<name: string, is_default: boolean, line: int>>, status string, error string, comment_count int"


def _has_elements(path: str | None) -> bool:
    """Whether ``<`` may begin an element in a file of that name."""
    return not re.search(r"\.[mc]?ts$", path or "")


def outline(path: str | None, text: str | None) -> dict:
    """The outline of one file; ``status`` is parse_failed, with nothing but the number of lines, where brackets don't match
    or nest too deep. A statement's function belongs to the name that it declares or is assigned to; counts go to the
    innermost function. Empty and null texts have one line and no symbol but the file. Never fails."""
    text = text or ""
    n = text.count("\n") + 1
    out = {k: [] for k in ("symbols", "imports", "inheritance", "calls", "functions", "exports")}
    out |= {"path": path, "line_count": n, "status": "analyzed", "error": None, "comment_count": 0}
    try:
        tokens, comments = scan(text, _has_elements(path))
        out["comment_count"] = comments
        out["symbols"].append({"type": "FILE", "name": path, "start": 1, "end": n})
        walk = _Walk(tokens, path, out)
        walk.block(0, len(tokens))
    except (Broken, RecursionError) as e:
        out |= {k: [] for k in ("symbols", "imports", "inheritance", "calls", "functions", "exports")} | {"status": "parse_failed", "error": str(e), "comment_count": 0}
    return out


#: Characters of the texts whose results a task remembers at most, and rows of a batch.
REMEMBERED, ROWS = 4_000_000, 1024


def remembering(parse, variant, arrow: pa.Schema, renamed):
    """Batches of what ``parse`` tells of (path, text), as Arrow. Texts that are equal, and whose paths have the same
    ``variant``, are parsed and turned into Arrow once as long as a task remembers them; ``renamed`` puts the paths into the
    columns of the rows that they share."""
    def run(batches):
        known: dict = {}
        table, held = None, 0
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                if held > REMEMBERED:
                    known, table, held = {}, None, 0
                paths, own, new = part.column(0).to_pylist(), [], []
                for path, text in zip(paths, part.column(1).to_pylist(), strict=True):
                    key = (text, variant(path))
                    if key not in known:
                        known[key] = len(known)
                        held += len(text or "") + 1000
                        new.append(parse(path, text))
                    own.append(known[key])
                if new:
                    new = pa.RecordBatch.from_pylist(new, schema=arrow)
                    table = pa.concat_batches([table, new]) if table is not None else new
                rows = table.take(pa.array(own, pa.int32()))
                columns = renamed({n: rows.column(n) for n in arrow.names}, pa.array(paths, pa.string()))
                yield pa.RecordBatch.from_arrays([columns[n] for n in arrow.names], schema=arrow)

    return run


def _named(columns: dict, paths: pa.Array) -> dict:
    """The outlines' columns under their files' paths, which are also the names of each file's first symbol."""
    symbols = columns["symbols"]
    values, sizes = symbols.flatten(), symbols.value_lengths().to_numpy()
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first = np.zeros(len(values), bool)
    first[starts[:-1][sizes > 0]] = True
    fields = [values.field(k) for k in range(values.type.num_fields)]
    at = values.type.get_field_index("name")
    fields[at] = pc.replace_with_mask(fields[at], pa.array(first), paths.filter(pa.array(sizes > 0)))
    named = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(values.type)), type=symbols.type)
    return columns | {"path": paths, "symbols": named}


def read_javascript(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """The outline of each file as one row of :data:`SCHEMA`; see :func:`outline`. Repeated rows have a row each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    run = remembering(outline, _has_elements, to_arrow_schema(ship(files.sparkSession).createDataFrame([], SCHEMA).schema), _named)

    return files.select(path, text).mapInArrow(run, SCHEMA)
