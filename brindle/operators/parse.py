"""Declarations, functions and imports read from whole texts.

Comments, strings and patterns are blanked first, brackets are matched once, and
declarations are found by their heads and closed by their brackets, so heads and
imports may span lines, ends are known and scopes nest to any depth.  Files are
worked in Arrow batches, dealt by path first: many small ones may come in one split.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..lineage import parts
from .symbols import SWIFT_PROTOCOLS

_BLANK = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`"
    r"|(?<=[=(,:;!&|?{}])\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
    re.S,
)
_NAME = r"[A-Za-z_$][\w$]*"
_TS_MODS = r"((?:(?:export|default|declare|abstract|public|private|protected|static|readonly|async|override)\s+)*)"
_TS_HEADS = (
    ("class", re.compile(rf"(?<![\w$.]){_TS_MODS}class\s+({_NAME})")),
    ("interface", re.compile(rf"(?<![\w$.]){_TS_MODS}interface\s+({_NAME})")),
    ("enum", re.compile(rf"(?<![\w$.]){_TS_MODS}(?:const\s+)?enum\s+({_NAME})")),
    ("namespace", re.compile(rf"(?<![\w$.]){_TS_MODS}namespace\s+([\w$.]+)\s*\{{")),
    ("module", re.compile(rf"(?<![\w$.]){_TS_MODS}module\s+([\w$.]+)\s*\{{")),
    ("type", re.compile(rf"(?:^|(?<=[;{{}}\n]))[ \t]*{_TS_MODS}type\s+({_NAME})\s*(?:<[^=;{{]*>)?\s*=", re.M)),
    ("function", re.compile(rf"(?<![\w$.]){_TS_MODS}function\s*\*?\s*({_NAME})")),
    ("constant", re.compile(rf"(?<![\w$.]){_TS_MODS}const\s+(?!enum\b)({_NAME})")),
    ("variable", re.compile(rf"(?<![\w$.]){_TS_MODS}(?:let|var)\s+({_NAME})")),
)
_TS_MEMBER = re.compile(rf"(?:^|(?<=[;{{}}\n]))[ \t]*((?:(?:abstract|public|private|protected|static|readonly|async|override|declare|get|set)\s+)*)\*?\s*(#?{_NAME})\s*([?!]?)\s*(?:<[^;{{}}()]*>\s*)?([(:=;])", re.M)
_SWIFT_MODS = r"((?:(?:public|private|fileprivate|internal|open|static|final|override|lazy|weak|mutating|class|convenience|required)(?:\(set\))?\s+)*)"
_SWIFT_HEADS = (
    ("class", re.compile(rf"(?<![\w.]){_SWIFT_MODS}class\s+(?!func\b|var\b|let\b)({_NAME})")),
    ("struct", re.compile(rf"(?<![\w.]){_SWIFT_MODS}struct\s+({_NAME})")),
    ("protocol", re.compile(rf"(?<![\w.]){_SWIFT_MODS}protocol\s+({_NAME})")),
    ("enum", re.compile(rf"(?<![\w.]){_SWIFT_MODS}enum\s+({_NAME})")),
    ("module", re.compile(rf"(?<![\w.]){_SWIFT_MODS}extension\s+([\w.]+)")),
    ("type", re.compile(rf"(?<![\w.]){_SWIFT_MODS}typealias\s+({_NAME})")),
    ("function", re.compile(rf"(?<![\w.]){_SWIFT_MODS}(?:func\s+({_NAME})|(?:init|deinit)(?=\s*[?!]?\s*[(<{{]))")),
    ("constant", re.compile(rf"(?<![\w.]){_SWIFT_MODS}let\s+({_NAME})")),
    ("variable", re.compile(rf"(?<![\w.]){_SWIFT_MODS}var\s+({_NAME})")),
)
_HOLDERS = {"class", "interface", "enum", "namespace", "module", "struct", "protocol"}
_NOT_MEMBERS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "await", "typeof", "throw", "super", "else", "do", "case", "default", "yield", "delete", "try"}
_BRANCH = re.compile(r"(?<![\w$.])(if|for|while|do|case|catch|guard|repeat)(?![\w$])")
_NESTING = re.compile(r"(?<![\w$.])(if|for|while|do|switch|catch|guard|repeat)(?![\w$])")
_LOGICAL, _TERNARY = re.compile(r"&&|\|\|"), re.compile(r"(?<![?\w)\]])\s\?(?![?.:,)])|(?<=[\w)\]])\s+\?(?![?.:,)])")
SYMBOLS = (
    "path string, name string, type string, start_line int, start_col int, end_line int, end_col int, scope array<struct<type:string,name:string>>, "
    "modifiers array<string>, attributes array<string>, superclass string, implements array<string>"
)
FUNCTIONS = "path string, name string, start_line int, end_line int, params int, cyclomatic int, cognitive int, nesting int"
IMPORTS = "path string, line int, specifier string, kind string, is_relative boolean, imported array<string>"


def blanked(text: str, pattern: re.Pattern = _BLANK) -> str:
    """The text with comments, strings and patterns as spaces; every other character keeps its place."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _parents(spans: list[tuple[int, int]]) -> list[int]:
    """For each of sorted nested spans the number of the one around it, or -1."""
    out, held = [], []
    for i, (begin, _) in enumerate(spans):
        while held and spans[held[-1]][1] < begin:
            held.pop()
        out.append(held[-1] if held else -1)
        held.append(i)
    return out


def _around(spans: list[tuple[int, int]], parent: list[int], place: int) -> int:
    k = bisect.bisect_left(spans, (place,)) - 1
    while k >= 0 and spans[k][1] < place:
        k = parent[k]
    return k


class Source:
    """A text with its brackets matched."""

    def __init__(self, text: str):
        self.text, self.code = text, blanked(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        self.braces: list[tuple[int, int]] = []
        held: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m[0] in "([{":
                held.append(m.start())
            elif held:
                begin = held.pop()
                self.close[begin] = m.start()
                if m[0] == "}":
                    self.braces.append((begin, m.start()))
        # what is never closed runs to the end
        for begin in held:
            self.close[begin] = len(text)
            if self.code[begin] == "{":
                self.braces.append((begin, len(text)))
        self.braces.sort()
        self.parent = _parents(self.braces)
        self.pairs = sorted(self.close.items())
        self.pair_parent = _parents(self.pairs)

    def at(self, place: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, place)
        return line, place - self.starts[line - 1] + 1

    def inside(self, place: int) -> int:
        """The innermost braces around a place, by number; -1 outside of all."""
        return _around(self.braces, self.parent, place)

    def bracket(self, place: int) -> int:
        """Where the innermost bracket of any kind around a place opens; -1 outside of all."""
        k = _around(self.pairs, self.pair_parent, place)
        return self.pairs[k][0] if k >= 0 else -1

    def body(self, place: int) -> tuple[int, int] | None:
        """The braces that follow a function's parameters, if there are such."""
        m = re.compile(r"[^;{}()=]*\(").match(self.code, place)
        if m and (end := self.close.get(m.end() - 1)) is not None:
            place = end + 1
        m = re.compile(r"\s*(?:(?:async|throws|rethrows)\s*)*(?:(:|->)|where\s)?").match(self.code, place)
        open_ = self._brace(m.end(), ":" if m[1] else "x")
        return None if open_ is None else (open_, self.close[open_])

    def _brace(self, place: int, before: str) -> int | None:
        """The brace that opens a body after a type, whose own braces follow a colon, comma, bar, ampersand or angle."""
        angles, code = 0, self.code
        while place < len(code):
            c = code[place]
            if c == "{":
                if before not in ":|&<," and not angles:
                    return place
                place = self.close[place]
            elif c in "([":
                place = self.close[place]
            elif c in ";})]" or c == "=" and code[place + 1 : place + 2] != ">":
                return None
            elif c == "\n" and not angles and before not in ":|&<,x" and not re.match(r"\s*(?:[{|&]|where\b)", code[place:]):
                return None
            elif c == "\n" and before == "x" and not re.match(r"\s*\{", code[place:]):
                return None
            angles += (c == "<") - (c == ">" and angles > 0 and code[place - 1] != "=" and code[place - 1] != "-")
            if not c.isspace():
                before = c if not c.isalnum() else "w"
            place += 1
        return None

    def statement_end(self, place: int) -> int:
        """Where a statement ends: at a semicolon, or a line break outside of brackets that does not go on."""
        while place < len(self.code):
            c = self.code[place]
            if c in "([{":
                place = self.close[place]
            elif c in ";)]}":
                return place
            elif c == "\n":
                rest = self.code[place:].lstrip() if place + 1 < len(self.code) else ""
                if not re.search(r"[=,+\-*/%&|?:(<>.]\s*$", self.code[max(0, place - 200) : place]) and not rest[:1] in tuple(".?:&|+*/,"):
                    return place
            place += 1
        return len(self.code)


class Declaration:
    __slots__ = ("kind", "name", "begin", "name_at", "end", "body", "modifiers", "head")

    def __init__(self, kind, name, begin, name_at, end, body, modifiers, head):
        self.kind, self.name, self.begin, self.name_at, self.end, self.body, self.modifiers, self.head = kind, name, begin, name_at, end, body, modifiers, head


def declarations(source: Source, language: str) -> list[Declaration]:
    """All declarations in order of place; locals of functions too."""
    swift, code, found = language == "swift", source.code, {}
    for kind, head in _SWIFT_HEADS if swift else _TS_HEADS:
        for m in head.finditer(code):
            name = m[2] or re.search(r"(de)?init$", m[0].rstrip())[0]
            name_at = m.start(2) if m[2] else m.end() - len(name)
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            if name_at in found or re.search(r"\bimport\s+$", code[max(0, begin - 20) : begin]):
                continue
            body, end = None, None
            if kind in _HOLDERS:
                open_ = code.find("{", name_at)
                if open_ < 0:
                    continue
                body = (open_, source.close[open_])
            elif kind == "function":
                body = source.body(name_at + len(name))
            if body:
                end = body[1] + 1
            else:
                end = source.statement_end(name_at + len(name))
                if kind in ("constant", "variable") and (m2 := re.compile(rf"\s*(?::[^=;]*)?=\s*(?:async\s*)?(?:function\b[^(]*)?(?=\(|{_NAME}\s*=>)").match(code, name_at + len(name))):
                    # an arrow function or function expression: its body, if it has one
                    after = source.close.get(m2.end(), m2.end()) + 1 if code[m2.end()] == "(" else m2.end()
                    m3 = re.compile(r"[^;{}()\n]*?=>\s*(\{)?|\s*(?::[^={]*)?(\{)").match(code, after)
                    if m3:
                        open_ = m3.start(1) if m3[1] else m3.start(2) if m3[2] else -1
                        body = (open_, source.close[open_]) if open_ >= 0 else (m3.end() - 1, end)
                        end = max(end, body[1] + (open_ >= 0))
            found[name_at] = Declaration(kind, name, begin, name_at, end, body, m[1].split(), code[begin : body[0] if body else end])
    if not swift:
        holders = {d.body[0] for d in found.values() if d.kind in ("class", "interface") and d.body}
        for m in _TS_MEMBER.finditer(code):
            name_at = m.start(2)
            if source.bracket(name_at) not in holders or name_at in found or m[2] in _NOT_MEMBERS:
                continue
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            if m[4] == "(":
                body = source.body(m.end(2))
                end = body[1] + 1 if body else source.statement_end(m.end(2))
                kind = "function"
            else:
                body, kind, end = None, "property", source.statement_end(m.end(2))
            found[name_at] = Declaration(kind, m[2], begin, name_at, end, body, m[1].split(), code[begin:end])
    return [found[k] for k in sorted(found)]


def _scoped(source: Source, language: str) -> Iterator[tuple[Declaration, list[Declaration]]]:
    held: list[Declaration] = []
    for d in declarations(source, language):
        while held and held[-1].body[1] < d.begin:
            held.pop()
        yield d, [h for h in held if h.body[0] < d.begin]
        if d.body:
            held.append(d)


def _heritage(d: Declaration, language: str) -> tuple[str | None, list[str]]:
    if d.kind not in _HOLDERS:
        return None, []
    head, before = d.head, ""
    while head != before:
        # type arguments, from the innermost out
        head, before = re.sub(r"<[^<>]*>", "", head), head
    names = lambda t: [x.strip() for x in t.split(",") if x.strip()]
    if language == "swift":
        m = re.search(r":\s*([^{]*?)(?:\bwhere\b|$)", head, re.S)
        parents = names(m[1]) if m else []
        first = d.kind == "class" and parents and not (parents[0] in SWIFT_PROTOCOLS or parents[0].endswith("Protocol"))
        return (parents[0], parents[1:]) if first else (None, parents)
    above = re.search(rf"\bextends\s+({_NAME}(?:\.{_NAME})*)", head)
    given = re.search(r"\bimplements\s+([^{]*)", head, re.S)
    return above and above[1], names(given[1]) if given else []


def _attributes(source: Source, d: Declaration) -> list[str]:
    before = re.search(r"(?:@[\w.]+(?:\([^()]*\))?\s*)+$", source.code[max(0, d.begin - 400) : d.begin])
    return re.findall(r"@[\w.]+", before[0]) if before else []


def spread(files: DataFrame) -> DataFrame:
    """`files` dealt by path over the session's number of partitions; a split of few bytes may hold more files than one task should read."""
    return files.repartition(parts(files.sparkSession), "path")


def _per_file(files: DataFrame, content: str, f, schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>+", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, lang, t in zip(b["path"], b["language"], b[content]) if isinstance(t, str) and t for r in f(t, lang)]
            yield pd.DataFrame(rows, columns=names)

    return spread(files.select("path", "language", content)).mapInPandas(run, schema)


def symbols(files: DataFrame, content: str = "content", locals_: bool = False) -> DataFrame:
    """SYMBOLS of FILES with their ends and scopes; declarations within functions only with `locals_`.  Null and empty texts have none."""

    def read(text: str, language: str):
        source = Source(text)
        for d, scope in _scoped(source, language):
            if not locals_ and any(x.kind not in _HOLDERS for x in scope):
                continue
            above, given = _heritage(d, language)
            yield (
                d.name, d.kind, *source.at(d.name_at), *source.at(d.end), [{"type": x.kind, "name": x.name} for x in scope],
                d.modifiers, _attributes(source, d), above, given,
            )

    return _per_file(files, content, read, SYMBOLS)


def _depths(source: Source, body: tuple[int, int], functions: set[int]) -> list[tuple[int, int]]:
    """Braces within a body with the number of branches around what they hold; functions begin anew."""
    out, depth = [(body[0], 0)], {body[0]: 0}
    for k in range(bisect.bisect_right(source.braces, body), len(source.braces)):
        begin, end = source.braces[k]
        if begin > body[1]:
            break
        around = source.braces[source.parent[k]][0] if source.parent[k] >= 0 else -1
        before = source.code[max(0, begin - 2000) : begin].rstrip()
        branch = re.search(r"(?<![\w$.])(?:else|do|catch|repeat)$", before) is not None
        if before.endswith(")"):
            open_ = next((a for a, z in source.close.items() if z == begin - (len(source.code[:begin]) - len(source.code[:begin].rstrip())) - 1), None)
            branch = open_ is not None and re.search(r"(?<![\w$.])(?:if|for|while|switch|catch|guard)\s*$", source.code[max(0, open_ - 40) : open_]) is not None
        elif not branch:
            branch = re.search(r"(?<![\w$.])(?:if|for|while|switch|guard)\s[^;{}\n]*$", before) is not None
        depth[begin] = 0 if begin in functions or before.endswith("=>") else depth.get(around, 0) + branch
        out.append((begin, depth[begin]))
    return out


def functions(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, name, lines, params, cyclomatic, cognitive, nesting) of every function with a body, nested ones also within the outer.

    cyclomatic: 1, one for each if, loop, case, catch, ternary, && and ||.
    cognitive: each branch 1 and the branches around it, each ternary and logical operator 1.
    """

    def read(text: str, language: str):
        source = Source(text)
        every = declarations(source, language)
        bodies = {d.body[0] for d in every if d.body and d.kind not in _HOLDERS}
        for d in every:
            if not d.body or d.kind in _HOLDERS:
                continue
            inner = source.code[d.body[0] : d.body[1] + 1]
            extra = len(_LOGICAL.findall(inner)) + len(_TERNARY.findall(inner))
            depths = _depths(source, d.body, bodies)
            known = dict(depths)
            cognitive = extra
            for m in _NESTING.finditer(source.code, d.body[0], d.body[1]):
                k = source.inside(m.start())
                while k >= 0 and source.braces[k][0] not in known:
                    k = source.parent[k]
                cognitive += 1 + (known.get(source.braces[k][0], 0) if k >= 0 else 0)
            # the while of a do belongs to it
            loops = len(re.findall(r"\}\s*while(?![\w$])", inner)) if re.search(r"(?<![\w$.])do\s*\{", inner) else 0
            begin = source.code.find("(", d.name_at)
            given = source.code[begin + 1 : source.close.get(begin, begin)] if 0 <= begin < d.body[0] else ""
            params = 0 if not given.strip() else 1 + re.sub(r"[(\[{<][^()\[\]{}<>]*[)\]}>]", "", given).rstrip().rstrip(",").count(",")
            yield (
                d.name, source.at(d.begin)[0], source.at(d.end)[0], params, 1 + len(_BRANCH.findall(inner)) - loops + extra, cognitive - loops, max(x for _, x in depths),
            )

    return _per_file(files, content, read, FUNCTIONS)


_JS_IMPORTS = (
    ("import", re.compile(r"""(?<![\w$.])import\s+(?:type\s+)?(?:([\w$*{}\s,]+?)\s+from\s+)?['"]([^'"\n]+)['"]""")),
    ("export", re.compile(r"""(?<![\w$.])export\s+(?:type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s+from\s+['"]([^'"\n]+)['"]""")),
    ("require", re.compile(r"""(?<![\w$.])require\s*(\()\s*['"]([^'"\n]+)['"]\s*\)""")),
    ("dynamic_import", re.compile(r"""(?<![\w$.])import\s*(\()\s*['"]([^'"\n]+)['"]\s*\)""")),
)
_SWIFT_IMPORT = re.compile(r"^[ \t]*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+|enum\s+|protocol\s+)?([\w.]+)", re.M)


def imports(files: DataFrame, content: str = "content") -> DataFrame:
    """IMPORTS of FILES, also such as span lines; line is where one begins."""

    def read(text: str, language: str):
        code = _without_comments(text)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        found = []
        if language == "swift":
            found = [(m.start() + len(m[0]) - len(m[0].lstrip()), m[1], "import", []) for m in _SWIFT_IMPORT.finditer(code)]
        else:
            for kind, pattern in _JS_IMPORTS:
                for m in pattern.finditer(code):
                    names = re.search(r"\{([^}]*)\}", m[1] or "")
                    imported = [re.match(r"(?:type\s+)?([\w$]+)", x.strip())[1] for x in names[1].split(",") if re.match(r"(?:type\s+)?[\w$]+", x.strip())] if names else []
                    found.append((m.start(), m[2], kind, imported))
            found += [(m.start(), m[1], "include", []) for m in re.finditer(r"""///\s*<reference\s+(?:path|types)=['"]([^'"]+)['"]""", text)]
        for at, specifier, kind, imported in sorted(found):
            yield bisect.bisect_right(starts, at), specifier, kind, specifier.startswith("."), imported

    return _per_file(files, content, read, IMPORTS)


def _without_comments(text: str) -> str:
    """Comments as spaces, strings as they are."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith(("//", "/*")) else m[0], text)
