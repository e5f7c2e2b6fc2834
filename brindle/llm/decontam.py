"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a run of `min_match` words (a seed) are
compared by greedy string tiling: the longest common runs of words that no tile
covers yet are marked again and again, found by Karp-Rabin hashes of windows
whose length shrinks.  The share of the item under tiles does not depend on the
order of its passages, so reordered ones count as well.

Words are runs of letters, marks and digits in lower case of any alphabet; where
a script has no blanks between words, each of its characters is one.  An item of
fewer words than a seed is found where all of it stands together.

The documents are never shuffled.  Test items are dealt to them in blocks of a
bounded number of words; each block is broadcast once and met by all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

#: Words of test items in a block; 8 bytes each, and 12 for its seeds.
BLOCK_WORDS = 4_000_000
_MARKS = r"[^\pL\pN\pM\x00-\x7f]+"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: Stands between runs of a text that are far apart; the hash of no word but by chance.
_GAP = textkit.stream(1, 77)[0]


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of n words, rolled as differences of running sums."""
    power, inverse = textkit._power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    at = np.arange(len(words) - n + 1)
    return textkit.mix((total[at + n] - total[at]) * inverse[at])


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) of greedy string tiling of two word-hash sequences."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), len(text)))
    while True:
        matches = _matches(item, text, free_item, free_text, length) if length <= min(len(item), len(text)) else []
        longest = max((m[2] for m in matches), default=0)
        for i, j, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if free_item[i : i + n].all() and free_text[j : j + n].all():
                free_item[i : i + n] = free_text[j : j + n] = False
                tiles.append((i, j, n))
        if longest > length:
            continue  # parts of runs cut by a tile may still be as long as this
        if length == min_match:
            if longest < min_match:
                return tiles
            continue
        length = max(min_match, length // 2)


def _matches(item, text, free_item, free_text, length):
    """Maximal common runs of at least `length` unmarked words."""
    open_ = lambda free: np.flatnonzero(np.convolve(free, np.ones(length, int), "valid") == length)
    at_item, at_text = open_(free_item), open_(free_text)
    if not len(at_item) or not len(at_text):
        return []
    own, other = _windows(item, length)[at_item], _windows(text, length)[at_text]
    keep = np.isin(other, own)
    at_text, other = at_text[keep], other[keep]
    places = defaultdict(list)
    for i, h in zip(at_item.tolist(), own.tolist()):
        places[h].append(i)
    pairs = {(i, j) for j, h in zip(at_text.tolist(), other.tolist()) for i in places[h]}
    out = []
    for i, j in pairs:
        if (i - 1, j - 1) in pairs:
            continue  # the run began earlier
        n = length
        while (i + n - length + 1, j + n - length + 1) in pairs:
            n += 1
        out.append((i, j, n))
    return out


class _Seeds:
    """Runs of `length` words of some items, and which items have them."""

    def __init__(self, length: int, numbers: list[int], words: list[np.ndarray]):
        self.length = length
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        seeds, begin = textkit.gram_hashes(flat, first, length, whole_if_short=False)
        owner = np.repeat(np.array(numbers, np.int64), np.diff(begin))
        order = np.lexsort((owner, seeds))
        seeds, owner = seeds[order], owner[order]
        new = np.ones(len(seeds), bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
        self.seeds, self.owner = seeds[new], owner[new]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def near(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of grams that are seeds, and the span of the seed's owners."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(42)).astype(np.int64)])
        low, high = (np.searchsorted(self.seeds, grams[at], side) for side in ("left", "right"))
        hit = high > low
        return at[hit], low[hit], high[hit]


class _Items:
    """A block of test items with the seeds that lead to them: runs of `min_match` words, or all words of a shorter item."""

    def __init__(self, ids: list, words: list[np.ndarray], min_match: int):
        self.ids, self.words = ids, words
        self.size = np.array([len(w) for w in words], np.int64)
        of = np.minimum(self.size, min_match)
        self.seeds = [_Seeds(int(n), np.flatnonzero(of == n).tolist(), [words[i] for i in np.flatnonzero(of == n)]) for n in np.unique(of)]
        # for one text at a time: where an item's last seed was, and its words under seeds
        self.last, self.reach = np.full(len(words), -(1 << 40), np.int64), np.zeros(len(words), np.int64)

    def candidates(self, seeds: _Seeds, places: np.ndarray, low: np.ndarray, high: np.ndarray, coverage: float) -> dict[int, list[int]]:
        """Items so many of whose words may be under their seeds in a text, and where those are.

        Only words under seeds can be covered.  A seed may have very many
        owners, so items are counted in arrays and only those that can reach
        the coverage are looked at singly.
        """
        met = []
        for p, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
            own = seeds.owner[a:b]
            self.reach[own] += np.minimum(p - self.last[own], seeds.length)
            self.last[own] = p
            met.append(own)
        met = np.unique(np.concatenate(met))
        enough = met[np.minimum(self.reach[met], self.size[met]) >= coverage * self.size[met]]
        self.last[met], self.reach[met] = -(1 << 40), 0
        found: dict[int, list[int]] = {int(o): [] for o in enough}
        if found:
            for p, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
                for o in np.intersect1d(seeds.owner[a:b], enough, assume_unique=True).tolist():
                    found[o].append(p)
        return found


def _plain_words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, first word of each text) of some texts at a time; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at in range(0, len(column), 512):
        some = pc.utf8_lower(pc.utf8_normalize(pc.fill_null(column.slice(at, 512).cast(pa.large_string()), ""), form="NFKC"))
        some = pc.replace_substring_regex(pc.replace_substring_regex(some, pattern=_MARKS, replacement=" "), pattern=_UNSPACED, replacement=r" \1 ")
        for a, b, data, offsets in textkit.text_chunks(some, textkit.SMALL_BYTES):
            data = textkit.plain(data)
            starts, ends, first = textkit.word_spans(data, offsets)
            yield at + a, at + b, textkit.word_hashes(data, starts, ends), first


def contaminated(
    docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) of each document and test item that it holds.

    A pair is returned if tiles of at least `min_match` words cover at least
    `coverage` of the item's words, or, of an item with fewer words, if all of
    them stand together in the text.  Words are runs of letters and digits in
    lower case, or single characters of scripts without blanks.  Null texts,
    empty ones and such without words match nothing; null ids stay null;
    repeated documents or items give repeated rows; other columns are ignored.
    Documents that hold no item have no row, and neither have empty tables.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in _blocks(items.select(F.col(item_id_col).cast("long"), F.col(item_text_col).cast("string")), min_match, block_words):
        part = given.mapInArrow(
            _search(spark.sparkContext.broadcast(block), min_match, coverage),
            "doc_id long, item_id long, item_words int, covered_words int, tiles int, coverage double",
        )
        found = part if found is None else found.unionByName(part)
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words, first in _plain_words(batch.column(1)):
            held = [words[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(held, pa.binary())], ["item_id", "words"])


def _blocks(items: DataFrame, min_match: int, block_words: int) -> Iterator[_Items]:
    """Items row by row, hashed where they lie, as blocks that fit a broadcast; one block at least."""
    ids, words, held, made = [], [], 0, False
    for item_id, data in items.mapInArrow(_hashed, "item_id long, words binary").toLocalIterator():
        own = np.frombuffer(data, np.uint64)
        if held + len(own) > block_words and ids:
            yield _Items(ids, words, min_match)
            ids, words, held, made = [], [], 0, True
        if len(own):
            ids.append(item_id)
            words.append(own)
            held += len(own)
    if ids or not made:
        yield _Items(ids, words, min_match)


def _pairs(items: _Items, column: pa.Array, min_match: int, coverage: float, first_only: bool = False):
    """(row, item, words, covered, tiles) of what is found; with `first_only` not all of a row."""
    for a, _, words, first in _plain_words(column) if len(items.ids) else ():
        for seeds in items.seeds:
            grams, begin = textkit.gram_hashes(words, first, seeds.length, whole_if_short=False)
            at, low, high = seeds.near(grams)
            doc = np.searchsorted(begin, at, "right") - 1
            for span in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1):
                if not len(span):
                    continue
                d = int(doc[span[0]])
                own = words[first[d] : first[d + 1]]
                for o, where in sorted(items.candidates(seeds, at[span] - begin[d], low[span], high[span], coverage).items()):
                    item = items.words[o]
                    # an item that is a seed itself is covered wherever the seed is
                    tiles = [(0, where[0], len(item))] if len(item) == seeds.length else tile(item, _under(own, where, min_match), min_match)
                    covered = sum(n for _, _, n in tiles)
                    if covered >= coverage * len(item):
                        yield a + d, o, len(item), covered, len(tiles)
                        if first_only:
                            break


def _search(block, min_match: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = block.value
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[r].as_py(), items.ids[o], n, c, t, c / n) for r, o, n, c, t in _pairs(items, batch.column(1), min_match, coverage)]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage"]
            )

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5, block_words: int = BLOCK_WORDS,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, that hold none of the items in the sense of `contaminated`.

    Null and empty texts stay, repeated rows stay or go alike, and without items
    all rows stay.  Rows pass through one filter for each block of items;
    nothing is shuffled.
    """
    place = docs.columns.index(text_col)
    for block in _blocks(items.select(F.col(item_id_col).cast("long"), F.col(item_text_col).cast("string")), min_match, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for row, *_ in _pairs(sent.value, batch.column(place), min_match, coverage, first_only=True):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _under(words: np.ndarray, where: list[int], n: int) -> np.ndarray:
    """The words under seeds that begin at `where`; between runs that are apart stands one word that no item has."""
    edge = np.zeros(len(words) + 1, int)
    np.add.at(edge, where, 1)
    np.add.at(edge, np.array(where) + n, -1)
    inside = np.cumsum(edge)[:-1] > 0
    after = np.zeros(len(words), bool)
    after[1:] = inside[:-1] & ~inside[1:]
    return np.where(after, _GAP, words)[inside | after]
