import random
from collections import defaultdict

import numpy as np

from brindle.llm.packing import RoomTree, best_fit_decreasing, encoder, pack_tokens, write_packed
from brindle.llm.queries import vocabulary

RANKS = vocabulary("byte_bpe_50k.tiktoken")


def test_tree_finds_the_least_room():
    rng = random.Random(1)
    tree, held = RoomTree(100), []
    for row in range(2000):
        if rng.random() < 0.6:
            room = rng.randrange(0, 101)
            tree.put(room, row)
            held.append(room)
        else:
            need = rng.randrange(0, 101)
            want = min((r for r in held if r >= need), default=None)
            got = tree.take(need)
            assert (got and got[0]) == want if want is not None else got is None
            if want is not None:
                held.remove(want)


def test_best_fit_as_defined():
    rng = random.Random(2)
    sizes = np.array([rng.randrange(1, 65) for _ in range(500)])
    rooms = []
    for n in sorted(sizes.tolist(), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    rows = best_fit_decreasing(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(500))
    assert sorted(64 - sizes[r].sum() for r in rows) == sorted(rooms)


def _unpacked(rows):
    got = defaultdict(dict)
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert r.position_ids[a:b] == list(range(b - a))
            got[d].setdefault(k, []).append(r.input_ids[a:b])
    return got


def test_round_trip(spark, docs):
    encode, end = encoder(RANKS)
    rows = pack_tokens(docs, RANKS, row_length=128).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    got = _unpacked(rows)
    want = {r.doc_id: encode.encode_ordinary(r.text) + [end] for r in docs.select("doc_id", "text").collect()}
    assert {d: [t for k in sorted(p) for t in p[k][0]] for d, p in got.items()} == want
    assert sum(r.n_tokens for r in rows) / (128 * len(rows)) > 0.97


def test_blocks_bound_memory_not_content(spark, docs):
    a = _unpacked(pack_tokens(docs, RANKS, row_length=128, block_tokens=5000).collect())
    assert a == _unpacked(pack_tokens(docs, RANKS, row_length=128).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    _, end = encoder(RANKS)
    got = _unpacked(pack_tokens(odd_docs, RANKS, row_length=128).collect())
    assert got[1] == {0: [[end]]} and got[2] == {0: [[end]]} and len(got[5][0]) == 2 and None in got
    assert pack_tokens(no_docs, RANKS).count() == 0


def test_binary_rows(spark, docs, tmp_path):
    packed = pack_tokens(docs.limit(20), RANKS, row_length=64)
    write_packed(packed, str(tmp_path / "out"))
    want = {r.pack_id: r.input_ids for r in packed.collect()}
    got = {r.pack_id: np.frombuffer(r.input_ids, "<i4").tolist() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
