import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brindle.llm import lattice
from brindle.llm.queries import queries, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def all_ways(word, pieces, logp):
    """Sum over every segmentation, one by one."""
    if not word:
        return 1.0
    return sum(math.exp(logp[pieces.ids[word[:k]]]) * all_ways(word[k:], pieces, logp) for k in range(1, len(word) + 1) if word[:k] in pieces.ids)


def test_marginals_and_expectations_by_enumeration():
    pieces = lattice.Pieces([b" ", b" a", b"a", b"b", b"ab", b"ba", b" ab", b"c", b"abc"], np.log([0.1, 0.1, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1]))
    words = [b" a", b" ab", b" abab", b" abcba", b" cab", b" " + b"ab" * 40]
    got = lattice.marginals(words, pieces, pieces.logp)
    for w, g in zip(words[:-1], got):
        assert g == pytest.approx(math.log(all_ways(w, pieces, pieces.logp)))
    assert got[-1] == pytest.approx(lattice._forward(words[-1:], pieces, pieces.logp, len(words[-1]))[-1][0])
    # the gradient of the log marginal by a log weight is the expected count
    base, times = words[:5], np.array([1.0, 2, 3, 1, 1])
    counts = lattice.expected_counts(base, times, pieces, pieces.logp)
    for i in range(len(pieces.pieces)):
        shifted = pieces.logp.copy()
        shifted[i] += 1e-6
        slope = (lattice.marginals(base, pieces, shifted) - lattice.marginals(base, pieces, pieces.logp)) @ times / 1e-6
        assert slope == pytest.approx(counts[i], abs=1e-4)


def test_long_words_are_expected_too():
    pieces = lattice.Pieces([b" ", b" a", b"a", b"b", b"ab", b"ba", b" ab", b"c", b"abc"], np.log([0.1, 0.1, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1]))
    words, times = [b" " + b"abc" * 30, b" cab", b" " + b"ba" * 3000], np.array([2.0, 1, 3])
    counts = lattice.expected_counts(words, times, pieces, pieces.logp)
    # every byte is spelled once in each occurrence
    assert counts @ [len(p) for p in pieces.pieces] == pytest.approx(times @ [len(w) for w in words])
    for i in range(len(pieces.pieces)):
        up, down = pieces.logp.copy(), pieces.logp.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (lattice.marginals(words, pieces, up) - lattice.marginals(words, pieces, down)) @ times / 2e-4
        assert slope == pytest.approx(counts[i], rel=1e-3, abs=1e-3)


def test_long_words_are_worked_alike_on_both_paths(monkeypatch):
    pieces = lattice.Pieces([b" ", b"a", b"b", b"ab", b"ba", b" ab"], np.log([0.2, 0.1, 0.1, 0.3, 0.2, 0.1]))
    words, times = [b" abab", b" ba", b" abbaab"], np.array([1.0, 2, 5])
    short = lattice.expected_counts(words, times, pieces, pieces.logp)
    monkeypatch.setattr(lattice, "_LONG", 1)
    assert lattice.expected_counts(words, times, pieces, pieces.logp) == pytest.approx(short)


def test_class_without_expectation_keeps_its_weights():
    logp, times = np.log(np.array([[0.7, 0.6], [0.3, 0.4]])), np.array([[3.0, 0.0], [1.0, 0.0]])
    got = lattice._maximised(times, logp)
    assert got[:, 1] == pytest.approx(logp[:, 1])
    assert np.exp(got[:, 0]) == pytest.approx([3.1 / 4.2, 1.1 / 4.2])


def test_script_without_blanks_is_learnt(spark):
    rows = [(i, chr(0x4E00 + i % 3) * 2 + "日本語の文章は空白がないので全体が一つの長い語になる" * 3 + chr(0x4E00 + i), "ja") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    score = lambda rounds: sum(r.score for r in lattice.lattice_scores(df, "doc_id % 3 > 0", MODEL, rounds=rounds).collect() if r.doc_id % 3 == 0)
    assert score(3) > score(0) + 100


def test_query_by_hand(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries()["op3_lattice"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(t in c for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel=1e-9)
        assert r.score < 0


def spelled_by_definition(word, weight):
    """Sum over all segmentations, from the end."""
    after = [0.0] * len(word) + [1.0]
    for k in reversed(range(len(word))):
        after[k] = sum(weight.get(word[k:j], 0.0) * after[j] for j in range(k + 1, len(word) + 1))
    return after[0]


def expected_by_definition(word, weight):
    """Expected uses of pieces in one word, from forward and backward sums."""
    n = len(word)
    fore, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        fore[j] = sum(fore[k] * weight.get(word[k:j], 0.0) for k in range(j))
    for k in reversed(range(n)):
        back[k] = sum(weight.get(word[k:j], 0.0) * back[j] for j in range(k + 1, n + 1))
    uses = Counter()
    for k in range(n):
        for j in range(k + 1, n + 1):
            uses[word[k:j]] += fore[k] * weight.get(word[k:j], 0.0) * back[j] / back[0]
    return {p: x for p, x in uses.items() if p in weight}


@pytest.mark.parametrize("rounds", [0, 2])
def test_score_by_definition(spark, docs, rounds):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect() if len(r.text) < 1500][:60]
    rows += [(90_000, "", "en"), (90_001, "x " * 300, "de"), (90_002, "ab ab ab zzzqq zzzqq", "fr")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {i: (re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), c) for i, t, c in rows}
    training = {i for i in texts if i % 3 > 0}
    names = Counter(texts[i][1] for i in training)
    pieces = lattice.load_pieces(MODEL)
    existing = dict(zip(pieces.pieces, np.exp(pieces.logp).tolist()))
    classes = []
    for name, ends in names.items():
        count = Counter(w for i in training if texts[i][1] == name for w in texts[i][0])
        once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
        weight = existing
        for _ in range(rounds):
            uses = Counter()
            for w in count:
                uses.update(expected_by_definition(b" " + w.encode(), weight))
            total = sum(uses.values()) + 0.1 * len(weight)
            weight = {p: (uses[p] + 0.1) / total for p in weight}
        classes.append((ends, count, min(max((once + 1) / (once + 2 * twice + 2), 0.1), 0.95), weight))

    def log_score(words):
        ways = []
        for ends, count, discount, weight in classes:
            all_words = sum(count.values())
            for strength in lattice.DRAWS:
                total, seen = math.log(ends / len(training)) - math.log(len(lattice.DRAWS)), Counter()
                for k, w in enumerate(words):
                    p = max(count[w] - discount, 0) / all_words + discount * len(count) / all_words * spelled_by_definition(b" " + w.encode(), weight)
                    total += math.log(all_words / (all_words + ends)) + math.log((seen[w] + strength * p) / (k + strength))
                    seen[w] += 1
                ways.append(total + math.log(ends / (all_words + ends)))
        top = max(ways)
        return (top + math.log(sum(math.exp(x - top) for x in ways))) / math.log(10)

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lattice.lattice_scores(df, "doc_id % 3 > 0", MODEL, rounds=rounds, hot_words=300).collect()}
    for i, (words, _) in texts.items():
        assert got[i].score == pytest.approx(log_score(words), rel=1e-7)
        assert got[i].lattice_score == pytest.approx(sum(math.log10(spelled_by_definition(b" " + w.encode(), existing)) for w in words), rel=1e-7)


def test_held_out_texts_are_likelier_than_by_the_base(spark, sf):
    rows = [r for r in queries()["op3_lattice"](spark, sf.replace("0.001", "0.01")).collect() if r.held_out]
    score, base = sum(r.score for r in rows), sum(r.base_score for r in rows)
    assert score > base, (score / sum(r.n_tokens for r in rows), base / sum(r.n_tokens for r in rows))


def test_rising_products():
    x, m = np.geomspace(1e-12, 1e4, 80), np.tile([2, 3, 11, 12, 13, 5000, 2, 7], 10)
    assert lattice._rising(x, m) == pytest.approx([sum(math.log(j + v) for j in range(1, k)) for v, k in zip(x, m.tolist())], rel=1e-11, abs=1e-11)


def test_log_gamma():
    x = np.concatenate([np.geomspace(1e-9, 1e9, 200), [1.0, 2.0]])
    assert lattice._log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_few_or_many_words_in_the_table_give_the_same(spark, docs):
    few = {r.doc_id: r for r in lattice.lattice_scores(docs, "doc_id % 3 > 0", MODEL, hot_words=1).collect()}
    for r in lattice.lattice_scores(docs, "doc_id % 3 > 0", MODEL).collect():
        f = few[r.doc_id]
        assert (f.n_tokens, f.n_known) == (r.n_tokens, r.n_known)
        assert f.score == pytest.approx(r.score, rel=1e-9) and f.base_score == pytest.approx(r.base_score, rel=1e-9)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = lattice.lattice_scores(odd_docs, "doc_id is not null", MODEL).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[4].n_tokens == 60_001
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert sum(r.doc_id == 5 for r in rows) == 2
    untrained = lattice.lattice_scores(odd_docs, "false", MODEL).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)
    assert lattice.lattice_scores(no_docs, "true", MODEL).count() == 0
