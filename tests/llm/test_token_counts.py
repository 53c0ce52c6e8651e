import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from threadloom.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_table_as_the_library(spark, data_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    found = entry.queries()["op10_token_counts"](spark, data_dir).collect()
    want = {i: len(library.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    assert {r.doc_id: r.n_tokens for r in found} == want
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in found)


ODD = ["a<|endoftext|>b", "<|startoftext|><|endoftext|> <", "x<|endoftext|", "İΣΑΣ \x1c a\x1cb", "é é ² ½ 123", "日本語 한국어", "it's IT'S", "́ á\nñ", "x" * 5000, "a\xa0b　c"]


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_odd_texts(spark, odd_docs, library, head):
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, x) for i, x in enumerate(ODD)], "doc_id long, text string"))
    found = t.count_tokens(df, PATH, head_size=head).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_words_cut_together_as_one_by_one():
    with open(PATH, encoding="utf-8") as f:
        known = t.PreTokens(f.read())
    words = [x.encode() for x in ("it's", "a\xa0b", "\xa0", "x\x1c", "É\u0301t", "日本", "1,2", "\u2003", "I'LL", "İ", "!!", "q\u3000")]
    alone = {w: next(iter(known.of([w])))[1] for w in words}
    assert dict(known.of(words)) == alone
    assert alone[b"it's"] == ["it", "'s"]


def test_empty_table(no_docs):
    assert t.count_tokens(no_docs, PATH).count() == 0
