"""All pairs of sets or sequences that may be alike, by sketches: exact bounds, no list of candidates on disk.

A sketch says for each of some hundred bits whether an odd number of tokens falls
on it.  Two sketches differ in no more bits than the tokens differ, so what is
too far apart is left out for certain.  Sketches are dealt to a grid of cells of
bounded size; a cell compares its rows a block at a time and returns what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of the sketches of a set and a sequence, and those of long ones beside them.
SET, SEQUENCE, WIDE_SET, WIDE_SEQUENCE = 512, 1024, 4096, 8192
LONG = 400
ROWS = 40_000  # rows of a side of a cell
LEAST_SIDES = 8

_SCHEMA = "n int, d int, s binary, m binary, ws binary, wm binary"


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _parity(hashes: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketch(tokens: np.ndarray, sequences: bool) -> tuple:
    """(n, d, ...) of hashed tokens; the k-th repeat of a token counts as a token of its own in a sequence."""
    t = np.sort(tokens.view(np.uint64))
    first = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
    own = _mixed(t[first])
    long_ = len(t) >= LONG
    if not sequences:
        return len(own), len(own), _parity(own, SET), b"", _parity(own >> np.uint64(9), WIDE_SET) if long_ else b"", b""
    begin = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
    every = _mixed(t + (np.arange(len(t)) - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (
        len(t), len(own), _parity(own, SET), _parity(every, SEQUENCE),
        _parity(own >> np.uint64(9), WIDE_SET) if long_ else b"", _parity(every >> np.uint64(10), WIDE_SEQUENCE) if long_ else b"",
    )


def sketches(df: DataFrame, sequences: bool) -> DataFrame:
    """(id, n, d, sketches) of (id, tokens): arrays of hashes; empty ones are left out."""
    names = ["n", "d", "s", "m", "ws", "wm"]
    kind = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            rows = [_sketch(values[at[i] : at[i + 1]], sequences) for i in range(len(lists))]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(columns, kind))], ["id", *names])

    held = df.select("id", "tokens").where(F.size("tokens") > 0)
    return held.mapInArrow(run, f"id {dict(df.dtypes)['id']}, {_SCHEMA}")


Bound = Callable[..., np.ndarray]


def jaccard_bound(least: float) -> Bound:
    """Whether sets may have a Jaccard index of at least `least`."""

    def may(na, nb, da, db, apart_s, apart_m):
        return apart_s * (1 + least) <= (da + db) * (1 - least) + 1e-6

    return may


def blend_bound(least: float) -> Bound:
    """Whether half edit similarity, .3 Jaccard and .2 ratio of lengths may come to `least`.

    The edit similarity is no more than shared tokens over the longer length,
    and no more distinct tokens are shared than tokens.
    """

    def may(na, nb, da, db, apart_s, apart_m):
        short, most = np.minimum(na, nb), np.maximum(na, nb)
        shared = np.minimum((na + nb - apart_m) * 0.5, short)
        both = np.minimum(np.minimum((da + db - apart_s) * 0.5, shared), np.minimum(da, db))
        return 0.5 * shared / most + 0.3 * both / (da + db - both) + 0.2 * short / most >= least - 1e-6

    return may


def _words(column: pd.Series, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), bits // 64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each row of `a` differs from each of `b`."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


class _Side:
    def __init__(self, frame: pd.DataFrame, sequences: bool):
        f = frame.sort_values("n", kind="stable").reset_index(drop=True)
        self.ids, self.n, self.d = f["id"].to_numpy(), f["n"].to_numpy(np.float32), f["d"].to_numpy(np.float32)
        self.s, self.m = _words(f["s"], SET), _words(f["m"], SEQUENCE) if sequences else None
        long_ = f["ws"].str.len() > 0
        self.place = np.where(long_, np.cumsum(long_) - 1, -1)
        self.ws = _words(f["ws"][long_], WIDE_SET)
        self.wm = _words(f["wm"][long_], WIDE_SEQUENCE) if sequences else None


def _compare(a: _Side, b: _Side, same: bool, ratio: float, may: Bound) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a.n), 64):
        top = min(i + 64, len(a.n))
        lo = np.searchsorted(b.n, a.n[i] * ratio - 1e-2)
        hi = np.searchsorted(b.n, a.n[top - 1] / ratio + 1e-2, "right")
        lo = max(lo, i) if same else lo
        for j in range(lo, hi, 4096):
            end = min(j + 4096, hi)
            na, nb, da, db = a.n[i:top, None], b.n[None, j:end], a.d[i:top, None], b.d[None, j:end]
            apart_m = None if a.m is None else _apart(a.m[i:top], b.m[j:end])
            keep = may(na, nb, da, db, _apart(a.s[i:top], b.s[j:end]), apart_m) & (np.minimum(na, nb) >= ratio * np.maximum(na, nb) - 1e-2)
            x, y = np.nonzero(keep)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            p, q = a.place[x], b.place[y]
            both = (p >= 0) & (q >= 0)
            for k in range(0, len(x), 4096):
                u, v, w = x[k : k + 4096], y[k : k + 4096], both[k : k + 4096]
                ok = np.ones(len(u), bool)
                if w.any():
                    pw, qw, uw, vw = a.place[u[w]], b.place[v[w]], u[w], v[w]
                    s = np.bitwise_count(a.ws[pw] ^ b.ws[qw]).sum(1)
                    m = None if a.wm is None else np.bitwise_count(a.wm[pw] ^ b.wm[qw]).sum(1)
                    ok[w] = may(a.n[uw], b.n[vw], a.d[uw], b.d[vw], s, m)
                yield u[ok], v[ok]


def candidates(sketched: DataFrame, rows: int, sequences: bool, ratio: float, may: Bound) -> DataFrame:
    """(a, b), a < b: every pair of `sketched` that `may` admits, with sizes within `ratio` of each other.

    The grid is laid out for about `rows` rows.
    """
    kind = dict(sketched.dtypes)["id"]
    sides = max(LEAST_SIDES, -(-rows // ROWS))
    cells = sides * (sides + 1) // 2
    side = F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int")
    dealt = sketched.withColumn("side", side).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    low, high = F.least("side", "h"), F.greatest("side", "h")
    # the cell's number is its place in the triangle; ranges of it are dealt evenly
    dealt = dealt.withColumn("cell", (high * (high + 1) / 2 + low).cast("int")).withColumn("first", F.col("side") == low).withColumn("same", low == high).drop("side", "h")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = bool(frame["same"].iloc[0])
        a = _Side(frame[frame["first"]], sequences)
        b = a if same else _Side(frame[~frame["first"]], sequences)
        found = list(_compare(a, b, same, ratio, may)) if len(a.n) and len(b.n) else []
        x = np.concatenate([a.ids[p] for p, _ in found]) if found else a.ids[:0]
        y = np.concatenate([b.ids[q] for _, q in found]) if found else b.ids[:0]
        swap = x > y
        return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})

    return dealt.repartition(cells, "cell").groupBy("cell").applyInPandas(run, f"a {kind}, b {kind}")
