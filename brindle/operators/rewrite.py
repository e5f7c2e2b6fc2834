"""Rewrites as data: edits are a table, applying them makes a new version of the files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s
from . import graph
from .lines import to_lines
from .symbols import references
from .textsearch import Query, matches

# Words that cannot be names.
RESERVED = (
    "function", "var", "let", "const", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "try", "catch", "finally", "throw", "class",
    "interface", "enum", "import", "export", "default", "from", "as", "type",
)
NAME = r"^[a-zA-Z_][a-zA-Z0-9_]*$"


class RewriteError(ValueError):
    """An edit that cannot be made."""


def valid_name(name: Column) -> Column:
    return name.rlike(NAME) & ~name.isin(*RESERVED)


def check_rename(old: str, new: str) -> None:
    if not new or not re.match(NAME, new):
        raise RewriteError(f"{new!r} is no name")
    if new in RESERVED:
        raise RewriteError(f"{new!r} is reserved")
    if old == new:
        raise RewriteError("old and new name are the same")


def rename_edits(files: DataFrame, old: str, new: str, content: str = "content") -> DataFrame:
    """EDITS of a textual rename: every whole word, comments included; files without the name are left before they become lines."""
    check_rename(old, new)
    hits = matches(to_lines(files.where(F.col(content).contains(old)), content), Query(old, case_sensitive=True, whole_word=True))
    return hits.select(
        "path", F.col("line").alias("start_line"), F.col("column").alias("start_col"), F.col("line").alias("end_line"),
        (F.col("column") + len(old)).alias("end_col"), F.lit(old).alias("old_text"), F.lit(new).alias("new_text"),
    )


def rename(files: DataFrame, old: str, new: str, content: str = "content") -> DataFrame:
    """The files after a rename; one expression, no edits needed."""
    check_rename(old, new)
    return files.withColumn(content, F.regexp_replace(content, s.whole_word(s.escape_regex(old)), new))


def rename_conflicts(files: DataFrame, new: str) -> DataFrame:
    """REFS of the new name that exist already."""
    return references(files, new)


def preview(edits: DataFrame) -> DataFrame:
    """(files, edits, millis): what an application would touch, and a guess of ten milliseconds an edit."""
    return edits.agg(F.count_distinct("path").alias("files"), F.count("*").alias("edits"), (F.count("*") * 10).alias("millis"))


def apply_edits(files: DataFrame, edits: DataFrame, content: str = "content") -> DataFrame:
    """(path, content) after all edits, from the last to the first; overlapping ones raise.

    Positions are lines and columns from 1, ends exclusive.  A file's edits
    travel with it as one array; files without edits stay as they are.
    """
    own = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "start_col", "end_line", "end_col", "new_text")), asc=False).alias("_e"))
    with_edits = files.select("path", content).join(own, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, content):
                rows = zip(b.column("path").to_pylist(), b.column(content).to_pylist(), b.column("_e").to_pylist())
                out = [text if todo is None or text is None else _edited(path, text, todo) for path, text, todo in rows]
                yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, b.schema.field(content).type)], ["path", content])

    return with_edits.mapInArrow(run, f"path string, {content} string")


def portions(batch: pa.RecordBatch, content: str, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """`batch` (content, _e) in slices of about `size` bytes of text and edits, a row at least: edits are many times as large as objects."""
    edits = pc.fill_null(pc.list_value_length(batch.column("_e")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(text + 256 * edits)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _edited(path: str, text: str, todo: list[dict]) -> str:
    """`text` after edits given from the last to the first."""
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    limit, pieces = len(text) + 1, []
    for e in todo:
        a, z = starts[e["start_line"] - 1] + e["start_col"] - 1, starts[e["end_line"] - 1] + e["end_col"] - 1
        if not 0 <= a <= z <= limit:
            raise RewriteError(f"edits overlap or leave the text in {path}")
        pieces += [text[z:limit], e["new_text"]]
        limit = a
    return "".join([text[:limit], *reversed(pieces)])


def inverted(edits: DataFrame) -> DataFrame:
    """EDITS that undo single-line `edits`: columns move by what earlier edits of the line added."""
    order = W.partitionBy("path", "start_line").orderBy("start_col").rowsBetween(W.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("new_text") - F.length("old_text")).over(order), F.lit(0))
    return edits.select(
        "path", "start_line", (F.col("start_col") + moved).cast("int").alias("start_col"), "end_line", (F.col("start_col") + moved + F.length("new_text")).cast("int").alias("end_col"),
        F.col("new_text").alias("old_text"), F.col("old_text").alias("new_text"),
    )


def batch_rename(files: DataFrame, names: dict[str, str], content: str = "content") -> DataFrame:
    """All renames at once: what one of them makes is no other's old name, so names can be exchanged.

    The text is cut at every whole word that is an old name, in one pass; each
    such word is replaced by the map.
    """
    for old, new in names.items():
        check_rename(old, new)
    if not names:
        return files
    # longer names first, for one may begin with another
    any_old = "|".join(s.escape_regex(n) for n in sorted(names, key=len, reverse=True))
    word = s.whole_word(f"(?:{any_old})")
    new_of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    between = F.split(F.col(content), word, -1)
    found = F.transform(F.regexp_extract_all(F.col(content), F.lit(word), 0), lambda w: F.element_at(new_of, w))
    # texts and words by turns; there is one word less than texts
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return files.withColumn(content, F.when(F.col(content).rlike(word), joined).otherwise(F.col(content)))


# --- moves

def strip_known(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(?:tsx?|jsx?|mjs|cjs|swift|vue)$", "")


def import_path(from_file: Column, to_file: Column) -> Column:
    """The relative specifier by which one file imports another, without a known extension."""
    rel = strip_known(s.relative_path(s.dirname(from_file), to_file))
    return F.when(rel.startswith("."), rel).otherwise(F.concat(F.lit("./"), rel))


def alias_path(specifier: Column, aliases: dict[str, str]) -> Column:
    """A specifier with an alias like '@/' or '@app/*' replaced by its folder; others unchanged."""
    out = specifier
    for alias, folder in aliases.items():
        head, place = alias.removesuffix("*"), folder.removesuffix("*")
        out = F.when(specifier.startswith(head), F.concat(F.lit(place), F.substring(specifier, len(head) + 1, 1 << 20))).otherwise(out)
    return out


def specifier_kind(specifier: Column, aliases: dict[str, str] | None = None) -> Column:
    known = F.lit(False)
    for a in aliases or ():
        known |= specifier.startswith(a.removesuffix("*"))
    return F.when(specifier.startswith("."), "relative").when(known, "alias").when(specifier.startswith("/"), "absolute").otherwise("package")


def move_updates(imports: DataFrame, files: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, line, old, new): specifiers to change when files move; `moves` has (src, dst).

    Importers of a moved file, and the moved file's own relative imports; paths
    are given as they are after the move.
    """
    resolved = graph.resolve(imports, files).where("found")
    own = imports.where("is_relative").select(F.col("path").alias("src"), "line", "specifier")
    full = own.join(resolved.select("src", "specifier", "dst"), ["src", "specifier"])
    a, b = moves.toDF("src", "new_src"), moves.toDF("dst", "new_dst")
    both = full.join(a, "src", "left").join(b, "dst", "left").where("new_src is not null or new_dst is not null")
    place, target = F.coalesce("new_src", "src"), F.coalesce("new_dst", "dst")
    return both.select(place.alias("path"), "line", F.col("specifier").alias("old"), import_path(place, target).alias("new")).where("old <> new")


def apply_moves(files: DataFrame, imports: DataFrame, moves: DataFrame, content: str = "content") -> DataFrame:
    """The files at their new places with specifiers changed."""
    moved = files.join(moves.toDF("path", "_to"), "path", "left").withColumn("path", F.coalesce("_to", "path")).drop("_to")
    updates = move_updates(imports, files, moves).groupBy("path").agg(F.collect_set(F.struct("old", "new")).alias("_u"))
    quoted = lambda c: [F.concat(F.lit(q), c, F.lit(q)) for q in "'\""]

    def changed(text, u):
        for a, b in zip(quoted(u["old"]), quoted(u["new"])):
            text = F.replace(text, a, b)
        return text

    return moved.join(updates, "path", "left").withColumn(
        content, F.aggregate(F.coalesce("_u", F.expr("cast(array() as array<struct<old:string,new:string>>)")), F.col(content), changed)
    ).drop("_u")


# --- functions: one request on one text, on the driver

_WORD = re.compile(r"(?<![\w.$])[A-Za-z_$][\w$]*")
_KEYWORDS = set(RESERVED) | {
    "debugger", "delete", "extends", "in", "instanceof", "new", "super", "this", "typeof", "void", "with", "yield", "async", "await", "true", "false", "null", "undefined", "of", "static", "console", "Math", "JSON", "Object", "Array", "Promise", "String", "Number", "Boolean", "Error", "Date",
}


def extract_function(text: str, first: int, last: int, name: str) -> str:
    """Lines `first` to `last` as a function of their free variables, and a call in their place.

    A variable that the lines declare and that is used after them is returned.
    """
    check_rename("", name)
    lines = text.split("\n")
    if not 1 <= first <= last <= len(lines):
        raise RewriteError("lines outside of the text")
    body, before, after = lines[first - 1 : last], "\n".join(lines[: first - 1]), "\n".join(lines[last:])
    code = "\n".join(body)
    if code.count("{") != code.count("}") or code.count("(") != code.count(")"):
        raise RewriteError("the lines are no whole statements")
    bare = re.sub(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|//[^\n]*", "", code)
    declared = set(re.findall(r"\b(?:const|let|var|function|class)\s+([A-Za-z_$][\w$]*)", bare))
    known = set(re.findall(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)", before)) | {
        p for ps in re.findall(r"\(([^()]*)\)\s*(?::[^{=]+)?(?:\{|=>)", before) for p in re.findall(r"(?:^|,)\s*([A-Za-z_$][\w$]*)", ps)
    }
    used = dict.fromkeys(w for w in _WORD.findall(bare) if w not in _KEYWORDS)
    params = [w for w in used if w in known and w not in declared]
    out = [d for d in dict.fromkeys(re.findall(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)", bare)) if re.search(rf"(?<![\w$.]){re.escape(d)}(?![\w$])", after)]
    if len(out) > 1:
        raise RewriteError("more than one value would be returned")
    is_async = re.search(r"\bawait\b", bare) is not None
    returns = re.search(r"^\s*return\b", bare, re.M) is not None
    indent = re.match(r"\s*", body[0])[0]
    call = f"{'await ' if is_async else ''}{name}({', '.join(params)});"
    call = indent + (f"const {out[0]} = {call}" if out else f"return {call}" if returns else call)
    inner = [("  " + line[len(indent) :]) if line.strip() else line for line in (x if x.startswith(indent) else indent + x.lstrip() for x in body)]
    if out and not returns:
        inner.append(f"  return {out[0]};")
    made = [f"{'async ' if is_async else ''}function {name}({', '.join(params)}) {{", *inner, "}"]
    return "\n".join([*lines[: first - 1], call, *lines[last:], "", *made])


def inline_function(text: str, name: str) -> str:
    """Calls of a function of one return statement replaced by its expression, and the function removed."""
    m = re.search(rf"^[ \t]*(?:export\s+)?function\s+{re.escape(name)}\s*\(([^)]*)\)[^{{]*\{{\s*return\s+([^;{{}}]+);?\s*\}}\n?", text, re.M)
    if not m:
        raise RewriteError(f"{name} is no function of one return statement")
    params = [re.sub(r"[:=].*", "", p).strip() for p in m[1].split(",") if p.strip()]
    body = m[2].strip()
    if re.search(rf"\b{re.escape(name)}\s*\(", body):
        raise RewriteError(f"{name} calls itself")
    if len(body) > 200 or re.search(r"\b(?:arguments|this|await)\b", body):
        raise RewriteError(f"{name} cannot be inlined")
    rest = text[: m.start()] + text[m.end() :]

    def put(call: re.Match) -> str:
        args = [a.strip() for a in re.split(r",(?![^(\[]*[)\]])", call[1])] if call[1].strip() else []
        if len(args) != len(params):
            raise RewriteError("a call has another number of arguments")
        values = {p: a if re.fullmatch(r"[\w$.\"']+", a) else f"({a})" for p, a in zip(params, args)}
        return "(" + re.sub(r"(?<![\w$.])[A-Za-z_$][\w$]*", lambda w: values.get(w[0], w[0]), body) + ")"

    return re.sub(rf"(?<![\w$.]){re.escape(name)}\(([^()]*(?:\([^()]*\)[^()]*)*)\)", put, rest)


SINGLETON = """  private static instance: {name} | undefined;

  static getInstance(): {name} {{
    return ({name}.instance ??= new {name}());
  }}
"""


def apply_singleton(text: str, name: str) -> str:
    """A class with an instance accessor and a private constructor."""
    m = re.search(rf"\bclass\s+{re.escape(name)}\b[^{{]*\{{\n?", text)
    if not m:
        raise RewriteError(f"there is no class {name}")
    body = re.sub(r"(?m)^(\s*)(?:public\s+)?constructor\s*\(", r"\1private constructor(", text[m.end() :], count=1)
    own = SINGLETON.format(name=name)
    if "constructor(" not in text[m.end() :]:
        own += "\n  private constructor() {}\n"
    return text[: m.end()] + own + body


def factory_source(name: str, products: list[str]) -> str:
    """Source of a factory over product classes."""
    cases = "\n".join(f"      case '{p}':\n        return new {p}();" for p in products)
    return f"export class {name}Factory {{\n  static create(kind: string): {name} {{\n    switch (kind) {{\n{cases}\n      default:\n        throw new Error(`unknown kind ${{kind}}`);\n    }}\n  }}\n}}\n"


def transform_files(files: DataFrame, f, content: str = "content") -> DataFrame:
    """Applies a text function to each file; where it raises RewriteError the text stays and `error` says why."""

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for t in b[content]:
                try:
                    texts.append(f(t))
                    errors.append(None)
                except RewriteError as e:
                    texts.append(t)
                    errors.append(str(e))
            b[content], b["error"] = texts, errors
            yield b

    return files.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", error string")
