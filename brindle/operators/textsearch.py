"""Text search over lines: literal, regex, whole-word and fuzzy; ranked, with context."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s
from ..lineage import cut, parts
from .lines import to_lines

# Words whose weights semantic search sends to all tasks; it only decides where work is done.
FREQUENT_WORDS = 200_000

# code points that are no characters, so no text has them
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"

# Words that a prefix is completed to.
KEYWORDS = (
    "class", "function", "interface", "type", "const", "let", "var", "import", "export", "async", "await", "return", "if", "for",
)


@dataclass(frozen=True)
class Query:
    text: str
    regex: bool = False
    case_sensitive: bool = False
    whole_word: bool = False
    fuzzy: bool = False
    multiline: bool = False

    def pattern(self) -> str | None:
        """A Java pattern; None for the empty query, which matches nothing."""
        if not self.text:
            return None
        if self.fuzzy:
            p = s.in_order(self.text)
        else:
            p = self.text if self.regex else s.escape_regex(self.text)
        if self.whole_word:
            p = s.whole_word(p)
        return ("" if self.case_sensitive else "(?i)") + ("(?m)" if self.multiline else "") + p

    def literal(self) -> str | None:
        """A literal that every match contains, for a cheap filter ahead of the pattern."""
        return None if self.regex or self.fuzzy or not self.text else self.text


def _maybe(text: Column, q: Query) -> Column:
    literal = q.literal()
    if literal is None:
        return F.lit(True)
    return text.contains(literal) if q.case_sensitive else F.lower(text).contains(literal.lower())


def matches(lines: DataFrame, q: Query, text: str = "text") -> DataFrame:
    """`lines` exploded to one row a match: column (from 1), match.

    Matches are marked in the line and the marks read back, so that columns
    are right whatever the pattern looks around at.  Empty matches are no hits.
    """
    pattern = q.pattern()
    if pattern is None:
        return lines.where(F.lit(False)).select("*", F.lit(0).alias("column"), F.lit("").alias("match"))
    marked = F.regexp_replace(F.col(text), pattern, f"{_OPEN}$0{_CLOSE}")
    parts = F.split(marked, _OPEN)
    hits = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.length(F.get(parts, 0)).alias("at"), F.expr("cast(array() as array<struct<column:int,match:string>>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) - 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + 1).cast("int").alias("column"), F.substring_index(p, _CLOSE, 1).alias("match")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    found = lines.where(_maybe(F.col(text), q)).where(F.col(text).rlike(pattern))
    return found.select("*", F.explode(hits).alias("_hit")).select(*lines.columns, "_hit.column", "_hit.match").where("match <> ''")


def literal_matches(lines: DataFrame, q: Query, text: str = "text") -> DataFrame:
    """As `matches` for a literal query, by splitting the line at it.

    Without regard to case the line itself is split, not its lower case, whose
    letters may be more or fewer; what the literal met is as long as the literal.
    """
    quoted = s.escape_regex(q.text)
    parts = F.split(F.col(text), quoted if q.case_sensitive else f"(?iu){quoted}" if not q.text.isascii() else f"(?i){quoted}", -1)
    size = len(q.text)
    columns = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: (F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * size + 1).cast("int"),
    )
    return (
        lines.where(_maybe(F.col(text), q)).where(F.size(parts) > 1)
        .select("*", F.explode(columns).alias("column"))
        .withColumn("match", F.substr(F.col(text), F.col("column"), F.lit(size)))
    )


def score(q: Query, text: str = "text", match: str = "match") -> Column:
    """Exactness, then length, place and brevity of the line; 1 at most."""
    t, m = F.col(text), F.col(match)
    exact = F.when(m == q.text, 1.0).when(F.lower(m) == q.text.lower(), 0.8).otherwise(0.5)
    place = (1 - (F.position(m, t) - 1) / F.length(t)) * 0.2
    brief = (1 - F.least(F.length(t) / 200, F.lit(1.0))) * 0.1
    return F.least(F.lit(1.0), exact + F.length(m) / len(q.text) * 0.2 + place + brief)


def search(files: DataFrame, q: Query, limit: int = 1000, context: int = 0, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The best `limit` hits: score desc, path, line, column.  Ranked before the cut, so the best are never missed."""
    lines = to_lines(files, content, keep, context)
    hits = matches(lines, q) if q.literal() is None or q.whole_word else literal_matches(lines, q)
    return hits.withColumn("score", score(q) if q.text else F.lit(0.0)).orderBy(F.desc("score"), *keep, "line", "column").limit(limit)


def total(files: DataFrame, q: Query, content: str = "content") -> DataFrame:
    """(hits, files): all of them, not only those within a limit."""
    pattern = q.pattern()
    count = F.regexp_count(F.col(content), F.lit(pattern)) if pattern else F.lit(0)
    return files.where(_maybe(F.col(content), q)).select(count.alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count_if(F.col("n") > 0).alias("files")
    )


def without_match(files: DataFrame, q: Query, content: str = "content") -> DataFrame:
    """Files that hold no match at all."""
    pattern = q.pattern()
    return files if pattern is None else files.where(~F.coalesce(F.col(content).rlike(pattern), F.lit(False)))


def batch(files: DataFrame, queries: dict[str, Query], content: str = "content") -> DataFrame:
    """(query_id, hits, files) of several queries in one pass over the text; invalid patterns are the caller's error."""
    ids = list(queries)
    counts = [F.regexp_count(F.col(content), F.lit(queries[i].pattern() or "(?!)")).alias(f"q{k}") for k, i in enumerate(ids)]
    sums = files.select(*counts).agg(
        *[F.coalesce(F.sum(f"q{k}"), F.lit(0)).alias(f"h{k}") for k in range(len(ids))],
        *[F.count_if(F.col(f"q{k}") > 0).alias(f"f{k}") for k in range(len(ids))],
    )
    rows = F.array(*[F.struct(F.lit(i).alias("query_id"), F.col(f"h{k}").alias("hits"), F.col(f"f{k}").alias("files")) for k, i in enumerate(ids)])
    return sums.select(F.inline(rows))


def suggest(candidates: DataFrame, text: str, column: str = "word", least: float = 0.5, limit: int = 10) -> DataFrame:
    """(suggestion, score) by edit similarity to `text`; equal scores in order of the words."""
    word = F.col(column)
    short, long_ = F.least(F.length(word), F.lit(len(text))), F.greatest(F.length(word), F.lit(len(text)))
    # the difference of lengths alone bounds the similarity
    return (
        candidates.select(column).distinct().where(short >= least * long_)
        .select(word.alias("suggestion"), s.similarity(F.lower(word), F.lit(text.lower())).alias("score"))
        .where(F.col("score") >= least).orderBy(F.desc("score"), "suggestion").limit(limit)
    )


def suggest_all(history: DataFrame, text: str, context: tuple[tuple[str, float], ...] = (), limit: int = 10) -> DataFrame:
    """Suggestions from past queries that contain the text, keywords that it begins and words in context; best score of each."""
    spark = history.sparkSession
    fixed = [(k, 0.8) for k in KEYWORDS if k.startswith(text.lower())] + [(c, v) for c, v in context if text.lower() in c.lower()]
    past = history.where(F.lower("query").contains(text.lower())).select(
        F.col("query").alias("suggestion"), s.similarity(F.lower("query"), F.lit(text.lower())).alias("score")
    )
    every = past.unionByName(spark.createDataFrame(fixed, "suggestion string, score double"))
    return every.groupBy("suggestion").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "suggestion").limit(limit)


def query_stats(log: DataFrame, query: str = "query", ts: str = "ts", millis: str = "millis") -> DataFrame:
    """(query, times, mean_millis, last_ts) of a log of queries."""
    return log.groupBy(F.col(query).alias("query")).agg(
        F.count("*").alias("times"), F.avg(millis).alias("mean_millis"), F.max(ts).alias("last_ts")
    )


def recent(log: DataFrame, keep: int = 50, key: tuple[str, ...] = (), ts: str = "ts", tie: str = "query") -> DataFrame:
    """The last `keep` entries of each key."""
    order = W.partitionBy(*key).orderBy(F.desc(ts), F.desc(tie))
    return log.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= keep)


def semantic(files: DataFrame, text: str, limit: int = 100, content: str = "content", key: str = "path") -> DataFrame:
    """(key, score) of the files most like `text`: cosine of term frequency times inverse document frequency, ln((1 + files) / (1 + files with it)) + 1.

    Words are runs of ASCII letters and digits in lower case.  Counts are taken
    over all files.  Texts are dealt by key, so words are counted where they are;
    the weights of the `FREQUENT_WORDS` most frequent words are sent to them, and
    only the other words of each file are shuffled.
    """
    word = r"[a-z0-9]+"
    dealt = files.select(key, F.lower(content).alias("_c")).repartition(parts(files.sparkSession), key)
    counted = dealt.select(key, F.explode(F.regexp_extract_all("_c", F.lit(word), 0)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("files"))
    df = cut(counted.groupBy("w").agg(F.count("*").alias("df")))
    idf = df.crossJoin(F.broadcast(total)).select("w", "df", (F.log((F.col("files") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    frequent = idf.orderBy(F.desc("df"), "w").limit(FREQUENT_WORDS).drop("df")
    idf = idf.drop("df")
    asked: dict[str, int] = {}
    for w in re.findall(word, text.lower()):
        asked[w] = asked.get(w, 0) + 1
    if not asked:
        return files.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    times = F.element_at(F.create_map(*[F.lit(v) for kv in asked.items() for v in kv]), F.col("w"))
    own = F.col("w").isin(*asked)
    q = idf.where(own).agg(F.sqrt(F.sum(F.pow(times * F.col("idf"), 2))).alias("q"))
    near = counted.join(F.broadcast(cut(frequent)), "w", "left")
    rare = near.where("idf is null").drop("idf").join(idf, "w")
    sums = [
        some.withColumn("x", F.col("n") * F.col("idf")).groupBy(key).agg(F.sum(F.when(own, F.col("x") * times * F.col("idf"))).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("square"))
        for some in (near.where("idf is not null"), rare)
    ]
    dots = sums[0].unionByName(sums[1]).groupBy(key).agg(F.sum("dot").alias("dot"), F.sqrt(F.sum("square")).alias("norm")).where("dot is not null")
    return dots.crossJoin(F.broadcast(q)).select(key, (F.col("dot") / F.col("norm") / F.col("q")).alias("score")).orderBy(F.desc("score"), key).limit(limit)
