"""Subword lattice likelihood of documents.

The pieces of an existing vocabulary span a lattice over every word; the
forward recursion sums, in log space, over all segmentations, so a document's
score is its marginal probability and not that of one segmentation.  No piece
of such a vocabulary crosses a word's beginning, so the recursion over a text
is the product of those over its words and each distinct word is worked once.

The vocabulary's own scores (log probabilities of a unigram model, or the merge
ranks of a BPE model, read as 1 / (rank + 1)) weight all segmentations in
`lattice_score`, in which nothing is trained.  `score` is the trained model:

* The inventory of pieces stays; their weights start from the vocabulary's
  scores and go through expectation-maximisation over the distinct words of the
  training documents.
* A word seen in training is one more edge of its lattice, from its start to
  its end, weighted by its count less an estimated absolute discount; what the
  discounts free is the weight of spelling a word in pieces.
* Languages spell differently, so every class of training documents (the values
  of a column such as the language) has weights of its own.  A document's class
  is not given: its probability is summed over classes as over segmentations.
* A text repeats its own words.  Each next word is drawn from those before it in
  the text with probability i / (i + c) after i words, and anew otherwise; the
  strength c of new draws is summed over too, as it differs between texts.

All of it together is a proper distribution over texts.

Word counts are taken over all training documents.  For the sums per document
the most frequent words, a number bounded by a parameter, are looked up in a
broadcast table; the others are joined, summed per document beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from ..lineage import cut

#: Words looked up in the broadcast table are those with at least this part of all occurrences, so no more than
#: so many; 25 bytes each and 8 for each class, 97 MB at most.
HOT_WORDS = 1 << 20
#: Strengths of new draws against words of the text itself.
DRAWS = (100.0, 10_000.0)
#: Classes of documents with weights of their own, besides one for the rest.
MOST_CLASSES = 8
_LONG = 48
_FLUSH = 1_500_000


class Pieces:
    """Byte strings of a vocabulary with log probabilities; a word begins with a space."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, float)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        self.longest = int(sizes.max())
        hashes = _hashes(data, ends - sizes, ends)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.ids = {p: i for i, p in enumerate(pieces)}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of those of `hashes` that are pieces, and the pieces."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        return at[hit], self.order[place[hit]]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = textkit._power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textkit._BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece model file; bytes that no piece spells stand alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    lone: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(len(model))]
    ranks = min(scores) < -1000 and all(s == int(s) for s in scores)
    for i, score in enumerate(scores):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            continue
        weight = -math.log1p(-score) if ranks else score
        if model.is_byte(i):
            lone[bytes([int(piece[3:5], 16)])] = weight
        else:
            text = piece.replace("▁", " ").encode()
            if b" " not in text[1:] and text == text.lower():
                rank[text] = weight
    for byte in range(256):
        rank.setdefault(bytes([byte]), lone.get(bytes([byte]), min(rank.values())))
    pieces = sorted(rank)
    logp = np.array([rank[p] for p in pieces])
    return Pieces(pieces, logp - np.logaddexp.reduce(logp))


def _lattice(words: list[bytes], pieces: Pieces, length: int):
    """Edges (end, begin, row, piece) of the lattices of words of `length` bytes, by end."""
    n = len(words)
    data = np.frombuffer(b"".join(words), np.uint8)
    power, inverse = textkit._power_tables(length + 1)
    total = np.zeros((length + 1, n), np.uint64)
    np.cumsum(textkit._BYTE_VALUE[data].reshape(n, length).T * power[:length, None], axis=0, out=total[1:])
    for end in range(1, length + 1):
        for begin in range(max(0, end - pieces.longest), end):
            at, piece = pieces.find((total[end] - total[begin]) * inverse[begin])
            if len(at):
                yield end, begin, at, piece


def _forward(words: list[bytes], pieces: Pieces, logp: np.ndarray, length: int) -> np.ndarray:
    """Log forward sums by end; `logp` has one weight a piece, or a row of weights, one for each of several models."""
    forward = np.full((length + 1, len(words), *logp.shape[1:]), -np.inf)
    forward[0] = 0
    for end, begin, at, piece in _lattice(words, pieces, length):
        forward[end, at] = np.logaddexp(forward[end, at], forward[begin, at] + logp[piece])
    return forward


def _forward_long(word: bytes, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    forward = [np.zeros(logp.shape[1:])]
    for end in range(1, len(word) + 1):
        terms = []
        for begin in range(max(0, end - pieces.longest), end):
            piece = pieces.ids.get(word[begin:end])
            if piece is not None:
                terms.append(forward[begin] + logp[piece])
        forward.append(np.logaddexp.reduce(terms))
    return forward[-1]


def _expect_long(word: bytes, times: float, pieces: Pieces, logp: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected counts of one long word; only sums by place are kept, edges are found again on the way back."""
    n, longest, get, exp, log = len(word), pieces.longest, pieces.ids.get, math.exp, math.log
    weights = logp.tolist()

    def edges(end: int) -> list[tuple[int, int]]:
        found = ((begin, get(word[begin:end])) for begin in range(max(0, end - longest), end))
        return [(begin, piece) for begin, piece in found if piece is not None]

    forward = [0.0] + [-math.inf] * n
    for end in range(1, n + 1):
        terms = [forward[begin] + weights[piece] for begin, piece in edges(end)]
        top = max(terms, default=-math.inf)
        if top > -math.inf:
            forward[end] = top + log(sum(exp(x - top) for x in terms))
    # backward sums of a place as shares: the chance that a segmentation passes through it
    through = [0.0] * n + [float(times)]
    for end in range(n, 0, -1):
        if through[end]:
            for begin, piece in edges(end):
                share = through[end] * exp(forward[begin] + weights[piece] - forward[end])
                out[piece] += share
                through[begin] += share


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        length = int(lengths[own[0]])
        if length > _LONG:
            yield length, own
        else:
            for a in range(0, len(own), 20_000):
                yield length, own[a : a + 20_000]


def marginals(words: list[bytes], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log probability of each word, given with its leading space, over all segmentations."""
    out = np.zeros((len(words), *logp.shape[1:]))
    if len(words):
        for length, own in _by_length(words):
            some = [words[i] for i in own]
            if length > _LONG:
                out[own] = [_forward_long(w, pieces, logp) for w in some]
            else:
                out[own] = _forward(some, pieces, logp, length)[-1]
    return out


def expected_counts(words: list[bytes], times: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """How often each piece is used in `times` occurrences of the words, in expectation.

    Sums are kept as such, each byte scaled by e^4, so that words of 48 bytes
    stay far from the limits of doubles; longer words are worked one by one in
    log space.
    """
    out = np.zeros(len(pieces.pieces))
    weight = np.exp(logp + 4.0 * np.array([len(p) for p in pieces.pieces]))
    for length, own in _by_length(words) if len(words) else ():
        if length > _LONG:
            for i in own:
                _expect_long(words[i], times[i], pieces, logp, out)
            continue
        edges: list = []
        forward, backward = np.zeros((length + 1, len(own))), np.zeros((length + 1, len(own)))
        forward[0] = backward[length] = 1
        for end, begin, at, piece in _lattice([words[i] for i in own], pieces, length):
            w = weight[piece]
            forward[end, at] += forward[begin, at] * w
            edges.append((end, begin, at, piece, w))
        share, used, shares = times[own] / forward[length], [], []
        for end, begin, at, piece, w in reversed(edges):
            back = backward[end, at] * w
            backward[begin, at] += back
            used.append(piece)
            shares.append(forward[begin, at] * back * share[at])
        out += np.bincount(np.concatenate(used), np.concatenate(shares), len(out))
    return out


def _maximised(times: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Weights of pieces by their expected counts; a class without any keeps those it has."""
    some = times + 0.1
    return np.where(times.any(0), np.log(some) - np.log(some.sum(0)), logp)


def _cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings of `data` between `starts` and `ends`."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _count(classes: int):
    """(word, c_all, c0, ...): occurrences in all texts and in the training texts of each class; summed while memory allows."""
    names = ["word", "c_all", *[f"c{k}" for k in range(classes)]]

    def summed(held):
        if len(held) == 1:
            return held
        h, counts = (np.concatenate(x) for x in list(zip(*held))[:2])
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        words = pa.concat_arrays([x[2] for x in held]).take(pa.array(at))
        return [(h[at], np.column_stack([np.bincount(back, c) for c in counts.T]), words)]

    def out(held):
        _, counts, words = summed(held)[0]
        words = words.cast(pa.binary())
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([words[a : a + 50_000], *[pa.array(c.astype(np.int64)) for c in counts[a : a + 50_000].T]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            class_of = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in textkit.text_chunks(batch.column(0)):
                starts, ends, first = textkit.word_spans(data, offsets)
                if not len(starts):
                    continue
                hashes = textkit.word_hashes(data, starts, ends)
                own = np.repeat(class_of[a:b], np.diff(first))
                h, at, back = np.unique(hashes, return_index=True, return_inverse=True)
                # occurrences by class, the column before them for texts that are not learnt from
                by = np.bincount(back * (classes + 1) + own + 1, minlength=len(h) * (classes + 1)).reshape(len(h), classes + 1)
                counts = np.column_stack([by.sum(1), by[:, 1:]])
                held.append((h, counts, _cut_out(textkit.lower(data), starts[at], ends[at])))
            if sum(len(x[0]) for x in held) > _FLUSH:
                held = summed(held)
                if len(held[0][0]) > _FLUSH // 2:
                    yield from out(held)
                    held = []
        if held:
            yield from out(held)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows, for work that is cheaper on many words of one length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _spaced(column: pa.Array) -> list[bytes]:
    return [b" " + w for w in column.to_pylist()]


def _own_hashes(words: list[bytes]) -> np.ndarray:
    """textkit's hashes of words."""
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    return textkit.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series, ten further up."""
    y = x + 10.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + k) for k in range(10))


def _rising(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Logarithms of (1 + x) (2 + x) ... (m - 1 + x), for m of 2 and more."""
    out = np.log1p(x)
    few = m <= 12
    for j in range(2, 12):
        more = np.flatnonzero(few & (m > j))
        if len(more):
            out[more] += np.log(j + x[more])
    many = np.flatnonzero(~few)
    out[many] = _log_gamma(m[many] + x[many]) - _log_gamma(1 + x[many])
    return out


def lattice_scores(
    docs: DataFrame, training: str, vocabulary: str, rounds: int = 5, hot_words: int = HOT_WORDS, draws: tuple[float, ...] = DRAWS,
    id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang",
) -> DataFrame:
    """One row for each row of `docs`: (doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score).

    `training` is a SQL predicate over `docs` naming the documents to learn
    from.  Tokens are lower-cased words and one end.  base_score: the smoothed
    word unigram model; score: log10 of the marginal probability of the text,
    its end included, over all classes, strengths and segmentations;
    lattice_score: log10 of the marginal probability of its words over all
    segmentations by the vocabulary's own scores.  Classes are the commonest
    values of `class_col` in training, and one for all others; a text's own
    value is not looked at, and without the column there is one class.  Null
    and empty texts have the end alone; without training documents the
    vocabulary's own scores are used and no token is known.  Repeated rows give
    repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary)
    value = F.col(class_col).cast("string") if class_col in docs.columns else F.lit(None).cast("string")
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), value.alias("value"),
        F.coalesce(F.expr(training), F.lit(False)).alias("training"),
    )
    # at most MOST_CLASSES rows
    common = given.where("training").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(MOST_CLASSES).collect()
    class_of = F.lit(len(common))
    for k, r in enumerate(common):
        class_of = F.when(F.col("value").eqNullSafe(F.lit(r["value"])), k).otherwise(class_of)
    given = given.withColumn("class", F.when(F.col("training"), class_of).otherwise(-1).cast("int"))
    ends = np.zeros(len(common) + 1)
    for r in given.where("training").groupBy("class").count().collect():
        ends[r["class"]] = r["count"]
    classes = max(1, len(ends) if ends[-1] else len(ends) - 1)
    ends = ends[:classes]

    train = [f"c{k}" for k in range(classes)]
    counted = cut(
        given.select("text", "class")
        .mapInArrow(_count(classes), "word binary, c_all long, " + ", ".join(f"{c} long" for c in train))
        .groupBy("word")
        .agg(*[F.sum(c).cast("long").alias(c) for c in ("c_all", *train)])
    )
    c_train = sum((F.col(c) for c in train), F.lit(0))
    row = counted.agg(
        F.coalesce(F.sum("c_all"), F.lit(0)), F.count_if(c_train > 0), *[F.coalesce(F.sum(c), F.lit(0)) for c in train],
        *[F.count_if(F.col(c) > 0) for c in train], *[F.count_if(F.col(c) == 1) for c in train], *[F.count_if(F.col(c) == 2) for c in train],
    ).first()
    every, (words, distinct, once, twice) = row[0], np.array(row[2:], float).reshape(4, classes)
    # absolute discounting: taken off each word's count for words not seen in training, by how many were seen once and twice
    discount = np.clip((once + 1) / (once + 2 * twice + 2), 0.1, 0.95)
    n, v = int(words.sum() + ends.sum()), row[1] + bool(ends.any())
    below = n + 0.5 * (v + 1)

    logp = np.repeat(pieces.logp[:, None], classes, axis=1)
    for _ in range(rounds if words.any() else 0):
        now = spark.sparkContext.broadcast((pieces, logp))

        def expect(batches, now=now):
            pieces, logp = now.value
            total = np.zeros(logp.shape)
            for batch in _gathered(batches):
                spaced = _spaced(batch.column(0))
                for k in range(classes):
                    own = np.flatnonzero(batch.column(1 + k).to_numpy() > 0)
                    total[:, k] += expected_counts([spaced[i] for i in own], np.ones(len(own)), pieces, logp[:, k])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], ["piece", "times"])

        # as many rows as the vocabulary has pieces, for each class
        rows = (
            counted.where(c_train > 0).select("word", *train).mapInArrow(expect, "piece long, times double")
            .groupBy("piece").agg(F.sum("times").alias("times")).toPandas()
        )
        times = np.zeros(logp.size)
        times[rows["piece"].to_numpy()] += rows["times"].to_numpy()
        logp = _maximised(times.reshape(logp.shape), logp)
    # the vocabulary's own weights beside those of the classes
    model = spark.sparkContext.broadcast((pieces, np.column_stack([pieces.logp, logp])))

    log10 = math.log(10)
    base_of = lambda c: np.log10((c + 0.5) / below)
    spelled = np.log(np.maximum(discount * distinct, 0.5) / np.maximum(words, 1)) if n else np.zeros(classes)
    of_class = [f"t{k}" for k in range(classes)]
    table_schema = "key long, k long, b double, v double, " + ", ".join(f"{x} double" for x in of_class)

    def score_words(batches):
        """Of words: the hash, whether one is known, log10 of its probability in the base model, the vocabulary's and each class's."""
        pieces, weights = model.value
        for batch in _gathered(batches, 50_000):
            got = batch.column(0).to_pylist()
            c = np.column_stack([batch.column(1 + k).to_numpy() for k in range(classes)])
            total = c.sum(1)
            spelt = marginals([b" " + w for w in got], pieces, weights)
            edge = np.log(np.maximum(c - discount, 0) / np.maximum(words, 1), where=c > 0, out=np.full(c.shape, -np.inf))
            own = np.logaddexp(edge, spelled + spelt[:, 1:]) / log10
            yield pa.RecordBatch.from_arrays(
                [pa.array(_own_hashes(got).view(np.int64)), pa.array((total > 0).astype(np.int64)), pa.array(base_of(total)), pa.array(spelt[:, 0] / log10), *map(pa.array, own.T.copy())],
                ["key", "k", "b", "v", *of_class],
            )

    # words of at least 1 / hot_words of all words are hot_words at most
    is_hot = F.col("c_all") >= max(1.0, every / hot_words)
    top = counted.where(is_hot).select("word", *train).mapInArrow(score_words, table_schema).toPandas()
    hashes = top["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    column = lambda c: top[c].to_numpy().astype(float)[order]
    hot = spark.sparkContext.broadcast((hashes[order], column("k") > 0, column("b"), column("v"), [column(c) for c in of_class]))
    # the end's part of all tokens of a class, and what is left for words
    share = np.maximum(ends, 0.5) / np.maximum(words + ends, 1) if n else np.full(classes, 1e-3)
    share = np.minimum(share, 1 - 1e-9)
    end_p, word_p = np.log10(share), np.log10(1 - share)
    end = (int(ends.any()), float(base_of(ends.sum())))
    models = [(k, c) for k in range(classes) for c in draws]
    lattice = [f"l{i}" for i in range(len(models))]

    plain = [f"s{k}" for k in range(classes)]
    names = ["doc_id", "digest", "h", "times", "rows", "tokens", "known", "base", "vocab", *lattice]
    schema = "doc_id long, digest long, h long, times long, rows long, tokens long, known long, base double, vocab double, " + ", ".join(f"{x} double" for x in lattice)

    def look_up(batches):
        table, known, base, vocab, scores = hot.value
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in textkit.text_chunks(batch.column(1)):
                starts, ends_, first = textkit.word_spans(data, offsets)
                hashes = textkit.word_hashes(data, starts, ends_)
                count, digest = np.diff(first), _digests(hashes, first)
                text = np.repeat(np.arange(b - a), count)
                place = np.minimum(np.searchsorted(table, hashes), max(len(table) - 1, 0))
                hit = table[place] == hashes if len(table) else np.zeros(len(hashes), bool)
                # each text's distinct words and how often it has them
                pairs, m = np.unique(text[hit] * len(table) + place[hit], return_counts=True)
                of, at = np.divmod(pairs, max(len(table), 1))
                total = lambda x: np.bincount(of, x, b - a).astype(float)
                again = np.flatnonzero(m > 1)
                sums = []
                for k, c in models:
                    p = scores[k][at]
                    x = p + math.log10(c)
                    fresh = c * 10.0 ** p[again]
                    x[again] += _rising(fresh, m[again]) / log10
                    drawn = (_log_gamma(count + c) - _log_gamma(np.full(b - a, c))) / log10
                    sums.append(pa.array(total(x) - drawn + count * word_p[k] + end_p[k]))
                one, zero = np.ones(b - a, np.int64), np.zeros(b - a, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b], pa.array(digest), pa.nulls(b - a, pa.int64()), pa.array(zero), pa.array(one), pa.array(count + 1),
                        pa.array(total(known[at] * m).astype(np.int64) + end[0]), pa.array(total(base[at] * m) + end[1]), pa.array(total(vocab[at] * m)), *sums,
                    ],
                    names,
                )
                h, t = hashes[~hit], text[~hit]
                if len(h):
                    order = np.lexsort((h, t))
                    h, t = h[order], t[order]
                    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
                    times, h, t = np.diff(np.r_[new, len(h)]), h[new], t[new]
                    none = pa.nulls(len(h), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids[a:b].take(pa.array(t)), pa.array(digest[t]), pa.array(h.view(np.int64)), pa.array(times),
                            *[none] * 3, *[none.cast(pa.float64())] * (2 + len(models)),
                        ],
                        names,
                    )

    looked = given.select("doc_id", "text").mapInArrow(look_up, schema)
    table = counted.where(~is_hot).select("word", *train).mapInArrow(score_words, table_schema)
    # rows without a word are dealt out by their document, not by the null key
    keyed = looked.withColumn("key", F.coalesce("h", F.xxhash64("doc_id", "digest")))
    is_word = F.col("h").isNotNull() & F.col("b").isNotNull()
    of_word = lambda x: F.when(is_word, x)

    def repeats(k: int, c: float):
        """log10 of (1 + c p) (2 + c p) ... for the repeats of a word of probability p."""
        steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("times") - 1, F.lit(0)))
        more = F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + F.when(j > 0, F.log10(j + c * F.pow(F.lit(10.0), of_class[k]))).otherwise(0.0))
        return F.when(is_word & (F.col("times") > 1), more)

    sums = (
        keyed.join(table, "key", "left")
        .groupBy("doc_id", "digest")
        .agg(
            F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum(F.coalesce("known", of_word(F.col("k") * F.col("times")))).alias("known"),
            F.sum(F.coalesce("base", of_word(F.col("b") * F.col("times")))).alias("base"), F.sum(F.coalesce("vocab", of_word(F.col("v") * F.col("times")))).alias("vocab"),
            # a text's words beyond the table: how many, their logarithms by class, and what their repeats add
            F.count_if(is_word).alias("new"), *[F.coalesce(F.sum(of_word(F.col(x))), F.lit(0.0)).alias(p) for x, p in zip(of_class, plain)],
            *[F.sum(F.coalesce(x, repeats(k, c))).alias(x) for x, (k, c) in zip(lattice, models)],
        )
    )
    prior = np.log10(np.maximum(ends, 0.5) / max(ends.sum(), 1)) if n else np.zeros(1)
    ways = [
        (F.col(x) + F.col(plain[k]) + F.col("new") * math.log10(c)) / F.col("rows") + float(prior[k]) - math.log10(len(draws)) for x, (k, c) in zip(lattice, models)
    ]
    best = F.greatest(*ways) if len(ways) > 1 else ways[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), F.greatest(x - best, F.lit(-300.0))) for x in ways), F.lit(0.0)))
    return sums.select(
        "doc_id", F.expr("tokens div rows").alias("n_tokens"), F.expr("known div rows").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), score.alias("score"), (F.col("vocab") / F.col("rows")).alias("lattice_score"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"),
    ).drop("copy")


def _digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each text's word sequence."""
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(textkit.mix(hashes ^ textkit.mix(place)), out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)
