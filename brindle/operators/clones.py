"""Clone detection: exact, normalised and approximate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from . import allpairs

TOKENS = r"[\p{L}_$][\p{L}\p{N}_$]*|[0-9]+(?:\.[0-9]+)?|\"[^\"\n]*\"|'[^'\n]*'|[^\s\p{L}\p{N}_]"
# Words of the languages that normalisation leaves.
KEYWORDS = (
    "break", "case", "catch", "class", "const", "continue", "do", "else", "enum", "export", "extends", "false", "finally", "for", "func", "function", "guard",
    "if", "import", "in", "interface", "let", "new", "null", "return", "static", "struct", "switch", "this", "throw", "true", "try", "var", "while",
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), 0)


def normalized(text: Column) -> Column:
    """Identifiers, numbers and strings replaced by placeholders, blanks collapsed."""
    t = F.regexp_replace(text, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", "\u0001")
    t = F.regexp_replace(t, r"(?<![A-Za-z0-9_$])[0-9]+(?:\.[0-9]+)?", "\u0002")
    t = F.regexp_replace(t, rf"(?<![A-Za-z0-9_$])(?!(?:{'|'.join(KEYWORDS)})(?![A-Za-z0-9_$]))[A-Za-z_$][A-Za-z0-9_$]*", "\u0003")
    for mark, name in (("\u0001", "\\$STR\\$"), ("\u0002", "\\$NUM\\$"), ("\u0003", "\\$VAR\\$")):
        t = F.regexp_replace(t, mark, name)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def severity(count: Column, lines: Column, high: tuple[int, int] = (5, 50), medium: tuple[int, int] = (3, 20)) -> Column:
    return F.when((count >= high[0]) | (lines >= high[1]), "high").when((count >= medium[0]) | (lines >= medium[1]), "medium").otherwise("low")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def exact(fragments: DataFrame, code: str = "code", key: str = "path", least_tokens: int = 5) -> DataFrame:
    """(hash, members, files, lines, first, severity): groups of fragments with equal tokens.

    Only counts and the first member leave a group, so it may be of any size.
    """
    t = F.filter(tokens(F.col(code)), lambda x: ~x.startswith("//"))
    marked = fragments.select(key, F.size(t).alias("n"), F.md5(F.array_join(t, "")).alias("hash"), line_count(F.col(code)).alias("lines")).where(F.col("n") >= least_tokens)
    groups = marked.groupBy("hash").agg(F.count("*").alias("members"), F.approx_count_distinct(key).alias("_f"), F.max("lines").alias("lines"), F.min(key).alias("first")).where("members > 1")
    return groups.drop("_f").withColumn("severity", severity(F.col("members"), F.col("lines")))


def normalised(fragments: DataFrame, code: str = "code", key: str = "path", least_tokens: int = 5) -> DataFrame:
    """(hash, files, variants, first, severity): equal after normalisation, in two files at least, and not all equal before it."""
    marked = fragments.select(
        key, F.md5(normalized(F.col(code))).alias("hash"), F.md5(F.col(code)).alias("raw"), line_count(F.col(code)).alias("lines"), F.size(tokens(F.col(code))).alias("n")
    ).where(F.col("n") >= least_tokens)
    first = marked.groupBy("hash", key).agg(F.min("raw").alias("raw"), F.max("lines").alias("lines"))
    # two levels of aggregation, so that no set is built for a group
    variants = first.groupBy("hash", "raw").agg(F.count("*").alias("files"), F.min(key).alias("first"), F.max("lines").alias("lines"))
    groups = variants.groupBy("hash").agg(F.sum("files").alias("files"), F.count("*").alias("variants"), F.min("first").alias("first"), F.max("lines").alias("lines"))
    return groups.where("files >= 2 and variants > 1").withColumn("severity", severity(F.col("files"), F.col("lines"), (4, 40), (3, 15)))


def token_sets(fragments: DataFrame, code: str = "code", key: str = "path") -> DataFrame:
    """(id, tokens, n): 64-bit hashes of the distinct lower-cased tokens of each distinct text; equal texts stand for one another.

    Sets are formed where the texts lie; only hashes are shuffled, under two hashes of the text.
    """
    hashed = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(code), F.lit(r"[^\s]+"), 0)), lambda t: F.xxhash64(t))
    own = fragments.select(F.md5(F.col(code)).alias("digest"), F.col(key).alias("key"), hashed.alias("tokens"))
    return own.groupBy("digest", "tokens").agg(F.min("key").alias("id")).select("id", "tokens", F.size("tokens").alias("n")).where("n > 0")


def similar_pairs(sets: DataFrame, least: float = 0.7, below: float | None = None, rows: int | None = None) -> DataFrame:
    """(a, b, jaccard) with least <= jaccard, exact: pairs that their sketches admit, confirmed on the sets.

    `rows` says about how many sets there are, where that is known.
    """
    rows = sets.count() if rows is None else rows
    pairs = allpairs.candidates(allpairs.sketches(sets, False), rows, False, least, allpairs.jaccard_bound(least))
    x, y = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    found = pairs.join(x, "a").join(y, "b").select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("jaccard")).where(F.col("jaccard") >= least)
    return found if below is None else found.where(F.col("jaccard") < below)


def edit_distance(p: list, q: list) -> int:
    """Levenshtein distance of two sequences, a whole column of the table in one integer (Myers, Hyyroe)."""
    if not p or not q:
        return len(p) + len(q)
    at: dict = {}
    for i, t in enumerate(p):
        at.setdefault(t, []).append(i)
    eq = {}
    for t, places in at.items():
        bits = bytearray(len(p) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        eq[t] = int.from_bytes(bits, "little")
    every, last = (1 << len(p)) - 1, len(p) - 1
    up, down, distance = every, 0, len(p)
    for t in q:
        e = eq.get(t, 0)
        diagonal = (((e & up) + up) ^ up) | e | down
        plus, minus = down | (every & ~(diagonal | up)), up & diagonal
        distance += (plus >> last & 1) - (minus >> last & 1)
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        up, down = minus | (every & ~(diagonal | plus)), plus & diagonal
    return distance


def approximate(fragments: DataFrame, code: str = "code", key: str = "path", least: float = 0.7, below: float = 0.95) -> DataFrame:
    """(a, b, similarity): half edit similarity of the token sequences, .3 Jaccard, .2 ratio of lengths.

    Every pair of distinct texts is compared by sketches, which bound how many
    tokens they share and so all three parts; what may reach `least` is computed
    exactly.
    """
    # tokens are read where the texts lie; only their hashes are shuffled, once
    hashed = F.transform(tokens(F.col(code)), lambda t: F.xxhash64(t))
    own = fragments.select(F.md5(F.col(code)).alias("digest"), F.col(key).alias("key"), hashed.alias("tokens"))
    marked = own.groupBy("digest", "tokens").agg(F.min("key").alias("id")).select("id", "tokens").where(F.size("tokens") > 0)
    # .5 + .2 of the parts are no more than the ratio of lengths
    ratio = max(0.0, (least - 0.3) / 0.7)
    pairs = allpairs.candidates(allpairs.sketches(marked, True), fragments.count(), True, ratio, allpairs.blend_bound(least))
    x, y = marked.toDF("a", "sa"), marked.toDF("b", "sb")

    @F.pandas_udf("double")
    def rate(left, right):
        import numpy as np
        import pandas as pd

        out = []
        for p, q in zip(left, right):
            most = max(len(p), len(q))
            (u, m), (v, n) = np.unique(p, return_counts=True), np.unique(q, return_counts=True)
            _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            rest = 0.3 * (len(i) / (len(u) + len(v) - len(i))) + 0.2 * (min(len(p), len(q)) / most)
            # the edit similarity is no more than the shared tokens over the longer length
            if rest + 0.5 * np.minimum(m[i], n[j]).sum() / most < least - 1e-9:
                out.append(0.0)
            else:
                out.append(rest + 0.5 * (1 - edit_distance(p.tolist(), q.tolist()) / most))
        return pd.Series(out, dtype=float)

    rated = pairs.join(x, "a").join(y, "b").select("a", "b", rate("sa", "sb").alias("similarity"))
    return rated.where((F.col("similarity") >= least - 1e-12) & (F.col("similarity") < below))


def blocks(files: DataFrame, content: str = "content", size: int = 10) -> DataFrame:
    """FRAGMENTS of `size` lines each."""
    lines = F.split(F.col(content), "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size))
    return files.select("path", lines.alias("_l"), F.explode(starts).alias("_s")).select(
        "path", F.lit("block").alias("kind"), (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + size, F.size("_l")).alias("end_line"),
        F.array_join(F.slice("_l", F.col("_s") + 1, F.lit(size)), "\n").alias("code"),
    )


def fragments(files: DataFrame, content: str = "content", least_lines: int = 3) -> DataFrame:
    """FRAGMENTS (methods, header comments, constant and configuration objects) by brace matching that knows strings and comments."""

    def scan(batches):
        import re

        import pandas as pd

        heads = [
            ("config", re.compile(r"^\s*(?:export\s+)?const\s+\w*[cC]onfig\w*\s*(?::[^=]+)?=\s*\{", re.M)),
            ("constant", re.compile(r"^\s*(?:export\s+)?const\s+[A-Z][A-Z0-9_]+\s*(?::[^=]+)?=\s*[\{\[]", re.M)),
            ("method", re.compile(r"^[ \t]*(?:(?:export|public|private|protected|static|async|override|internal)\s+)*(?:function\s+\w+|func\s+\w+|(?!if|for|while|switch|catch|return)\w+)\s*\([^)]*\)[^;{}\n]*\{", re.M)),
        ]
        skip = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`", re.S)
        for frame in batches:
            rows = []
            for path, text in zip(frame["path"], frame[content]):
                text = text or ""
                plain = skip.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
                if m := re.match(r"\s*/\*.*?\*/", text, re.S):
                    rows.append((path, "comment", 1 + text[: m.start()].count("\n"), 1 + text[: m.end()].count("\n"), m[0].strip()))
                seen: set[int] = set()
                for kind, head in heads:
                    for m in head.finditer(plain):
                        if m.start() in seen:
                            continue
                        depth, at = 0, m.end() - 1
                        while at < len(plain):
                            depth += (plain[at] in "{[") - (plain[at] in "}]")
                            if not depth:
                                break
                            at += 1
                        begin = m.start() + len(m[0]) - len(m[0].lstrip())
                        code = text[begin : at + 1]
                        if code.count("\n") + 1 >= least_lines:
                            seen.add(m.start())
                            rows.append((path, kind, 1 + text[:begin].count("\n"), 1 + text[: at + 1].count("\n"), code))
            yield pd.DataFrame(rows, columns=["path", "kind", "start_line", "end_line", "code"])

    found = files.select("path", content).mapInPandas(scan, "path string, kind string, start_line int, end_line int, code string")
    return found.withColumn("tokens", F.filter(F.split("code", r"\s+"), lambda x: x != "")).withColumn("hash", F.md5("code"))


def duplicated_fragments(frags: DataFrame, least_lines: int = 3) -> DataFrame:
    """(hash, members, files, extra): trimmed texts of at least `least_lines` lines in two files and more; extra = members - 1."""
    marked = frags.select("path", F.trim("code").alias("code")).where(line_count(F.col("code")) >= least_lines)
    per = marked.groupBy(F.md5("code").alias("hash"), "path").agg(F.count("*").alias("n"))
    return per.groupBy("hash").agg(F.sum("n").alias("members"), F.count("*").alias("files")).where("files >= 2").withColumn("extra", F.col("members") - 1)


def stats(groups: DataFrame) -> DataFrame:
    """(severity, groups, members, lines) of the groups of a clone table with `members` and `lines`."""
    return groups.groupBy("severity").agg(F.count("*").alias("groups"), F.sum("members").alias("members"), F.sum(F.col("members") * F.col("lines")).alias("lines"))


def mean_similarity(pairs: DataFrame, column: str = "similarity") -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), s.round2(F.avg(column)).alias("mean"))
