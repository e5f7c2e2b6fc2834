import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm.queries import queries, vocabulary
from brindle.llm.tokencount import PrefixCounter, count_tokens

PATH = vocabulary("byte_bpe_50k.json")
COUNTER, LIBRARY = PrefixCounter(PATH), Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


ODD = [
    "", " ", "a  b", "a   b\n\n\n c", "don't we'll 'll x", "<|endoftext|>a<|endoftext|>", "  <|endoftext|>  x", "日本語テキスト", "ééé  àà", "a" * 300, "1234567 89", "!!!??? ...",
    "\t\tx\n \n y", "'s's'll", "x '", "x 'l", "it's <|endof", "hello've", "  's", "\n's", "👍🏽 ok", " x\x85y",
]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(text):
    want = [library(text[:i]) for i in range(len(text) + 1)]
    assert COUNTER.at_all(text, range(len(text) + 1)).tolist() == want
    ends, counts = COUNTER.ends(text)
    for limit in (0, 1, 2, 5, 20):
        assert COUNTER.fits(text, ends, counts, limit) == max(i for i, n in enumerate(want) if n <= limit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abthein 's\n.,1é日<|>👍 "), max_size=40))
def test_any_text(text):
    assert COUNTER.at_all(text, range(len(text) + 1)).tolist() == [library(text[:i]) for i in range(len(text) + 1)]


def test_query(spark, sf):
    rows = {r.doc_id: r for r in queries()["op6_token_counts"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n = library(d.text)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 1024)
        assert library(d.text[: r.fit_chars]) <= 1024


def test_odd_rows(spark, odd_docs, no_docs):
    rows = count_tokens(odd_docs, PATH).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[1].n_tokens == by[2].n_tokens == by[1].n_bytes == 0
    assert by[4].n_tokens == library("word " * 60_000) and by[4].over_limit and by[9].n_tokens == library("y" * 70_000)
    assert count_tokens(no_docs, PATH).count() == 0
