"""Scalar functions over columns; all stay in generated code or built-in higher-order functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(v: Column) -> Column:
    """Two decimals, halves up, as floor(v * 100 + 0.5) / 100 in doubles."""
    return F.floor(v.cast("double") * 100 + F.lit(0.5)) / F.lit(100.0)


def round_half_up(v: Column) -> Column:
    return F.floor(v.cast("double") + F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --- arrays

def chunk(a: Column, size: int) -> Column:
    """The array in pieces of `size`; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(size))
    return F.when(F.size(a) > 0, F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(size)))).otherwise(F.filter(F.array(a), lambda x: F.lit(False)))


def compact(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def partition(a: Column, predicate) -> Column:
    """Those that satisfy the predicate, and the others."""
    return F.struct(F.filter(a, predicate).alias("yes"), F.filter(a, lambda x: ~F.coalesce(predicate(x), F.lit(False))).alias("no"))


def difference(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, repeats kept."""
    return F.filter(a, lambda x: ~F.coalesce(F.array_contains(b, x), F.lit(False)))


def intersection(a: Column, b: Column) -> Column:
    """Elements of a that b has, repeats kept."""
    return F.filter(a, lambda x: F.coalesce(F.array_contains(b, x), F.lit(False)))


# --- objects, as maps

def pick(m: Column, *keys: str) -> Column:
    """The entries of these keys; none of a null map."""
    return F.map_filter(m, lambda k, v: k.isin(*keys) if keys else F.lit(False))


def omit(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys) if keys else F.lit(True))


def merged(a: Column, b: Column) -> Column:
    """Entries of both; b's values where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def is_empty(m: Column) -> Column:
    return m.isNull() | (F.size(m) <= 0)


def at_path(json: Column, path: str) -> Column:
    """The value at a path like a.b[0] of a JSON text; null if there is none."""
    return F.get_json_object(json, "$." + path)


def has_path(json: Column, path: str) -> Column:
    return at_path(json, path).isNotNull()


# --- strings

def escape_regex(text: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], text)


def whole_word(pattern: str) -> str:
    """ASCII word edges; Java's own \\b also counts accented letters as word characters."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def in_order(text: str) -> str:
    """A pattern for the characters of `text` in order, the nearest one each time.

    Between two of them stands whatever is not the second, taken for good, so
    that a line without a match is given up without backtracking.
    """
    out = escape_regex(text[:1])
    for c in text[1:]:
        out += f"[^{escape_regex(c) if c not in '^-' else chr(92) + c}\\n]*+{escape_regex(c)}"
    return out


def subsequence(text: str) -> str:
    """A pattern that matches the characters of `text` in order, anything between, in any case."""
    return "(?i)" + in_order(text)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def _separated(s: Column, mark: str) -> Column:
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", f"$1{mark}$2")
    return F.lower(F.regexp_replace(s, "[\\s_-]+", mark))


def snake_case(s: Column) -> Column:
    return _separated(s, "_")


def kebab_case(s: Column) -> Column:
    return _separated(s, "-")


def camel_case(s: Column) -> Column:
    """Words after separators begin in upper case, the first letter is in lower case."""
    words = F.split(s, "[\\s_-]+")
    joined = F.array_join(F.concat(F.slice(words, 1, 1), F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), capitalize)), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))


def truncate(s: Column, length: int, mark: str = "...") -> Column:
    return F.when(F.length(s) > length, F.concat(F.substring(s, 1, length), F.lit(mark))).otherwise(s)


def slugify(s: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(s)), "[^\\p{L}\\p{N}_\\s-]", "")
    return F.regexp_replace(F.regexp_replace(s, "[\\s_-]+", "-"), "^-+|-+$", "")


def strip_indent(s: Column) -> Column:
    """Takes the smallest indent of non-blank lines off all lines."""
    lines = F.split(s, "\n")
    indents = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    least = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, least + 1)), "\n")


def fill_template(template: Column, values: Column) -> Column:
    """{{name}} replaced by map entries; unknown names stay."""
    return F.aggregate(
        F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit("")))
    )


def similarity(a: Column, b: Column) -> Column:
    """(longer - edit distance) / longer; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise((longer - F.levenshtein(a, b)) / longer)


# --- paths

def path_parts(p: Column) -> Column:
    """Components after resolving '.', '..' and repeated slashes."""
    absolute = F.substring(p, 1, 1) == "/"
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    empty = F.filter(parts, lambda x: F.lit(False))
    return F.aggregate(
        parts, empty,
        lambda acc, x: F.when(
            x == "..",
            F.when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(absolute, acc).otherwise(F.concat(acc, F.array(x))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def normalize_path(p: Column) -> Column:
    joined = F.array_join(path_parts(p), "/")
    return F.when(F.substring(p, 1, 1) == "/", F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def dirname(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(p, "[^/]*$", ""), "(.)/$", "$1")


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def extension(p: Column) -> Column:
    """From the last dot of the name on; '' without one or if the name only begins with it."""
    return F.regexp_extract(basename(p), r".(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]*$", "")


def change_extension(p: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", ""), F.lit(ext if ext.startswith(".") or not ext else "." + ext))


def path_depth(p: Column) -> Column:
    return F.size(path_parts(p))


def is_sub_path(child: Column, parent: Column) -> Column:
    c, p = path_parts(child), path_parts(parent)
    return (F.size(c) > F.size(p)) & (F.slice(c, F.lit(1), F.size(p)) == p)


def join_path(base: Column, rest: Column) -> Column:
    return F.when(F.substring(rest, 1, 1) == "/", normalize_path(rest)).otherwise(normalize_path(F.concat(base, F.lit("/"), rest)))


def relative_path(start: Column, target: Column) -> Column:
    """The way from directory `start` to `target`, both normalized."""
    a, b = path_parts(start), path_parts(target)
    upto = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    shared = F.array_max(F.filter(upto, lambda k: (k == 0) | (F.slice(a, F.lit(1), F.greatest(k, F.lit(1))) == F.slice(b, F.lit(1), F.greatest(k, F.lit(1))))))
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    down = F.when(F.size(b) > shared, F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(1)))).otherwise(F.filter(b, lambda x: F.lit(False)))
    return F.array_join(F.concat(up, down), "/")


def sanitize_name(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")


def glob_regex(pattern: str) -> str:
    """An anchored Java pattern for a path glob: ** any components, * within one, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or escape_regex(c)
            i += 1
    return f"^{out}$"


# --- scopes and sizes

def scope_key(scope: Column) -> Column:
    return F.array_join(F.transform(scope, lambda s: F.concat_ws(":", s["type"], s["name"])), "/")


def within_scope(child: Column, parent: Column) -> Column:
    """Whether the root-first scope `parent` encloses `child` or is it."""
    return (F.size(parent) == 0) | (F.slice(child, F.lit(1), F.greatest(F.size(parent), F.lit(1))) == parent)


def format_bytes(n: Column) -> Column:
    """Two decimals and the largest unit, up to GB, that leaves 1 or more."""
    out = F.format_string("%.2f B", n.cast("double"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / F.lit(float(1024**power)))).otherwise(out)
    return out


def hit_rate(hits: Column, misses: Column) -> Column:
    return ratio(hits, hits + misses)


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100)).otherwise(round_half_up(F.try_divide(done, total) * 100)).cast("int")
