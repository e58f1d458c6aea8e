import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm.encoding import decode_documents, decode_tree, default_vocabulary, encode_documents, encode_tree, load

PIECES = ["a", "the", " ", "  ", "\n", "\t ", "'", "'s", "'ll", "don't", "42", "7", ".", "...", "#!", "é", "ß", "好", "日本語", "́", " ", "　", "👩‍💻", "<|endoftext|>", "x" * 40, "-", "_", "Ünï", "​", "٣"]


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(PIECES), max_size=120), leaf=st.sampled_from([1, 2, 7, 64]))
def test_tree_gives_the_tokens_of_the_whole(parts, leaf):
    enc, text = load(default_vocabulary()), "".join(parts)
    ids = encode_tree(enc.encode_ordinary, text, leaf)
    assert ids == enc.encode_ordinary(text)
    assert decode_tree(enc.decode_bytes, ids, leaf).decode() == text


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=300), leaf=st.sampled_from([1, 5, 50]))
def test_any_text(text, leaf):
    enc = load(default_vocabulary())
    assert encode_tree(enc.encode_ordinary, text, leaf) == enc.encode_ordinary(text)


def test_texts_without_a_boundary():
    enc = load(default_vocabulary())
    for text in ("x" * 30_000, " " * 30_000, "!" * 9_000, "字" * 20_000, "a b" * 20_000):
        assert encode_tree(enc.encode_ordinary, text, 1000) == enc.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "Hello  world", "x"), (2, "", "x"), (3, None, "x"), (4, " \n", None), (5, "word " * 100_000, "x"), (5, "again", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = load(default_vocabulary())
    got = sorted(((r.doc_id, r.ids) for r in encode_documents(df).collect()), key=str)
    assert got == sorted(((i, enc.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    sizes = sorted(((r.doc_id, r.n_tokens) for r in encode_documents(df, sizes_only=True).collect()), key=str)
    assert sizes == sorted(((i, len(x)) for i, x in got), key=str)
    assert encode_documents(df.limit(0)).count() == 0
    back = decode_documents(encode_documents(df))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)


def test_round_trip_of_the_corpus_and_the_other_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    ids = encode_documents(df, leaf=512).cache()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert {r.doc_id: r.text for r in decode_documents(ids).collect()} == text
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    want = {i: other.encode(t, add_special_tokens=False).ids for i, t in text.items()}
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == want
