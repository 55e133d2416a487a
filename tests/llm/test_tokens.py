"""Encoding, decoding and counting against the tokenizer libraries on whole texts."""

import hashlib

import public_tokenizers as public
import pytest

from ledgerloom.llm import bpe, token_counts

RANKS = public.path("byte_bpe_multi_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    "  \t\n ",
    "It's a test, isn't it... Yes.",
    "Äpfel, Öl und Spaß! 123 4567 été́ é",
    "<|endoftext|> and <|startoftext|>x<|ENDOFTEXT|> <|endoftext|>.",
    "a b c \x1c!\x1c! İ J̌ Ḱ,",
    "日本語のテキスト。 한국어 العربية",
    "x" * 5000,
    "word, other. " * 9000,
    ("tabs\tand\r\nbreaks   of  many   spaces \n\n\n" * 3000),
    "👍🏽👩‍👩‍👧 ok ok ok",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 1)]
    rows.append((None, "no id", "x", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, unit string, n_tokens long")


def test_ids_and_bytes_equal_the_library(spark, docs):
    encoding = bpe.load_encoding(RANKS, public.PATTERN)
    got = bpe.encode_documents(docs, RANKS, public.PATTERN).collect()
    assert len(got) == docs.count()
    for row in got:
        text = ("no id" if row["doc_id"] is None else TEXTS[row["doc_id"]]) or ""
        ids = encoding.encode_ordinary(text)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row["ids_sha256"] == hashlib.sha256(raw).hexdigest()


def test_cuts_are_safe():
    encoding = bpe.load_encoding(RANKS, public.PATTERN)
    for text in filter(None, TEXTS):
        for size in (1, 7, 50):
            assert "".join(bpe.pieces(text, size)) == text
            assert bpe.encode(encoding, text, size).tolist() == encoding.encode_ordinary(text)


def library_counts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("head", [1, 5, 1000])
def test_counts_equal_the_library(spark, docs, head):
    got = token_counts.count_tokens(docs, WORDS, limit=20, head=head).collect()
    assert len(got) == docs.count()
    wanted = dict(enumerate(library_counts(TEXTS))) | {None: library_counts(["no id"])[0]}
    for row in got:
        assert row["n_tokens"] == wanted[row["doc_id"]], row
        text = "no id" if row["doc_id"] is None else TEXTS[row["doc_id"]] or ""
        assert row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 20)


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    assert bpe.encode_documents(none, RANKS, public.PATTERN).count() == 0
    assert token_counts.count_tokens(none, WORDS).count() == 0
    assert not token_counts.count_tokens(docs.limit(1), WORDS).first()["over_limit"]


def test_whole_documents(spark):
    """Every text of the smallest table, as the queries run it."""
    from ledgerloom.llm.queries import op5_byte_bpe, op9_token_counts

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = dict(zip(texts, library_counts(texts.values())))
    got = {r["doc_id"]: r["n_tokens"] for r in op9_token_counts(spark, sf_dir).collect()}
    assert got == counts
    encoding = bpe.load_encoding(RANKS, public.PATTERN)
    for row in op5_byte_bpe(spark, sf_dir).collect():
        assert row["n_tokens"] == len(encoding.encode_ordinary(texts[row["doc_id"]]))
        text = texts[row["doc_id"]].encode()
        assert row["decoded_sha256"] == hashlib.sha256(text).hexdigest()
