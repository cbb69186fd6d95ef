import public_tokenizers
import pytest
import sentencepiece

from lexframe.llm.token_counts import TokenCounter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a ", "\n", "\n\na\n b", "x\ty", "▁", "a▁b", "<s> </s> <unk> <0x0A>", "漢字 テキスト", "é é ﬁ",
       "\x00a\x00", "a b", "🙂🙂 ok", "a" * 500, " " * 50 + "x", "\r\n \r\n", "x" * 70 + " " + "x" * 70, "▁▁a ▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equal_to_the_library(library):
    counter = TokenCounter(open(PATH, "rb").read(), remembered=5)
    assert counter.safe and len(counter.whole) > 30_000
    for text in ODD:
        assert counter.count(text) == len(library.encode(text)), text


def test_all_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = count_tokens(docs, PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(library.encode(r["text"]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(r["text"].encode()), n, n > 4096)


def test_odd_rows(spark, odd_docs, no_docs, library):
    for r in count_tokens(odd_docs.withColumn("n_tokens", odd_docs["lang"]), PATH).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or ""))
    assert count_tokens(no_docs, PATH).count() == 0
