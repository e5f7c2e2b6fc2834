"""Exact token counts at every prefix of a text, without encoding it again.

A byte-level BPE encodes the pre-tokens of a text one by one.  Within one, the
encoding of every prefix follows from shorter ones: the last token of a prefix
is that suffix of it whose pair with the last token of what remains would not
have been merged otherwise, and it is unique.  So one pass of dynamic
programming over a pre-token gives the counts of all its prefixes, and the
counts at the ends of pre-tokens are running sums.  Pre-tokens repeat, so their
count arrays are kept in a table of bounded size.

Where a prefix ends inside a run of white space or inside a contraction, its
own pre-tokens differ from the text's; those are handled as such.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a worker keeps.
MOST_KEPT = 1_000_000
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with, by the published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary in the `tokenizers` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE vocabularies have prefix counts here")
        special = [a for a in spec.get("added_tokens", ())]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in special):
            raise ValueError("added tokens that take in their surroundings are not known here")
        letters = _byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[spell(left), spell(right)] = i
        own = {a["content"] for a in special}
        self.tokens = {spell(t) for t in spec["model"]["vocab"] if t not in own}
        self.longest = max(map(len, self.tokens))
        self.special = regex.compile("|".join(map(regex.escape, sorted(own, key=len, reverse=True)))) if own else None
        self.split = regex.compile(_SPLIT)
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.totals: dict[str, int] = {}
        self.built: dict[bytes, bool] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """The tokens of one pre-token, by merging the pair of lowest rank again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay two when they meet."""
        key = (left, right)
        if key not in self.joins:
            if len(self.joins) >= MOST_KEPT // 4:
                self.joins.clear()
            self.joins[key] = self.encode(left + right) == [left, right]
        return self.joins[key]

    def _built(self, token: bytes) -> bool:
        if token not in self.built:
            self.built[token] = self.encode(token) == [token]
        return self.built[token]

    def piece(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one pre-token."""
        counts, last = [0], [b""]
        tokens, longest = self.tokens, self.longest
        for end in range(1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = data[begin:end]
                if token in tokens and (not begin or self._apart(last[begin], token)):
                    # a token that its own merges do not build is never output
                    if begin or self._built(token):
                        counts.append(counts[begin] + 1)
                        last.append(token)
                        break
        return counts

    def total(self, piece: str) -> int:
        count = self.totals.get(piece)
        if count is None:
            if len(piece) > 64:
                return self.piece(piece.encode())[-1]
            if len(self.totals) >= MOST_KEPT:
                self.totals.clear()
            count = self.totals[piece] = self.piece(piece.encode())[-1]
        return count

    def _segments(self, text: str) -> Iterator[tuple[int, str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield at, text[at : m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        yield at, text[at:], False

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ends of pre-tokens, in characters, and the token counts there; both begin with 0."""
        ends, counts = [0], [0]
        for at, part, whole in self._segments(text):
            if whole:
                ends.append(at + len(part))
                counts.append(1)
            elif part:
                pieces = self.split.findall(part)
                ends.extend((np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) + at).tolist())
                counts.extend(map(self.total, pieces))
        return np.array(ends), np.cumsum(counts)

    def at(self, text: str, cut: int) -> int:
        """Tokens of text[:cut]."""
        return int(self.at_all(text, [cut])[0])

    def at_all(self, text: str, cuts) -> np.ndarray:
        """Tokens of text[:c] for every c in `cuts`."""
        ends, counts = self.ends(text)
        out = np.empty(len(cuts), np.int64)
        for i, cut in enumerate(cuts):
            out[i] = self._tail(text, ends, counts, cut)
        return out

    def _tail(self, text: str, ends: np.ndarray, counts: np.ndarray, cut: int) -> int:
        k = int(np.searchsorted(ends, cut, "right")) - 1
        # step back over what a shorter text would split in another way: white space before the cut, a contraction, a special string
        while k > 0 and (text[ends[k] - 1 : ends[k]].isspace() or text[ends[k - 1] : ends[k]].startswith("'")):
            k -= 1
        tail = text[ends[k] : cut]
        extra = 0
        for _, part, whole in self._segments(tail):
            extra += 1 if whole else sum(map(self.total, self.split.findall(part)))
        return int(counts[k]) + extra

    def fits(self, text: str, ends: np.ndarray, counts: np.ndarray, limit: int) -> int:
        """Characters of the longest prefix within `limit` tokens."""
        if counts[-1] <= limit:
            return len(text)
        k = int(np.flatnonzero(counts <= limit)[-1])
        # counts at ends of pre-tokens never fall, so the cut is in the next pre-token or the white space after it
        for p in (k + 1, k):
            if p + 1 < len(ends):
                begin, end = int(ends[p]), int(ends[p + 1])
                if end - begin > 16:
                    # one pass over a long pre-token answers for all its prefixes
                    piece = text[begin:end]
                    own = self.piece(piece.encode())
                    at = np.cumsum([0, *[len(c.encode()) for c in piece]])
                    for size in range(len(piece), 1, -1):
                        if counts[p] + own[at[size]] <= limit:
                            return begin + size
                    end = begin + 1
                for cut in range(end, begin, -1):
                    if self._tail(text, ends, counts, cut) <= limit:
                        return cut
        return int(ends[k])


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter a worker and vocabulary: what it has learned serves later tasks too."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars), one row for each row of `docs`.

    n_tokens is what the library of `vocabulary` (a byte-level BPE JSON file
    that every worker can read) gives without added tokens; fit_chars is the
    length of the longest prefix of at most `limit` tokens.  Null and empty
    texts have no bytes and no tokens.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(ids), 512):
                rows = []
                for text in texts[a : a + 512].to_pylist():
                    text = text or ""
                    ends, counts = counter.ends(text)
                    n = int(counts[-1])
                    rows.append((len(text.encode()), n, n > limit, counter.fits(text, ends, counts, limit)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids[a : a + 512], *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
