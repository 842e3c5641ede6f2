import pytest
from probelake.llm import tokens
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "hello world", "don't  stop\n\n\n  now <|endoftext|>", "a" * 700, " " * 300, "\n\n\n" * 90 + "x", "日本語テキスト" * 40, "naïve café 123 456\t\tx_y = f(1);\r\n" * 30, "é​😀😀 " * 50, "ab1" * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash"), (None, "no id", "clash"), (8, TEXTS[9], "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


@pytest.mark.parametrize("chunk,overlap", [(8192, 1024), (100, 30), (40, 8), (7, 3)])
def test_ids_equal_whole_encoding(docs, chunk, overlap):
    encode = tokens.encoding("byte_bpe_50k").encode_ordinary
    want = sorted((r.doc_id if r.doc_id is not None else -1, tuple(encode(r.text) if r.text else [])) for r in docs.collect())
    got = tokens.encode_corpus(docs, chunk_chars=chunk, overlap=overlap).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids)) for r in got) == want
    counts = tokens.encode_corpus(docs, chunk_chars=chunk, overlap=overlap, count_only=True).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in counts) == sorted((i, len(x)) for i, x in want)


def test_long_texts_are_cut(docs):
    long = docs.where(F.length("text") > 500).where("doc_id <> 8").select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"))
    by = {}
    for p in sorted(tokens.text_pieces(long, 100, 30).collect(), key=lambda p: (p["__key"], p["at"])):
        by.setdefault(p["__key"], []).append(p["__text"])
    assert {k: "".join(v) for k, v in by.items()} == {r["__key"]: r["__text"] for r in long.collect()}
    assert len(by[9]) > 5 and len(by[5]) == 1  # a run of one class is never cut


def test_other_library_agrees(docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for r in tokens.encode_corpus(docs.where("doc_id is not null and doc_id <> 8")).join(docs.drop("ids").dropDuplicates(["doc_id"]), "doc_id").select("text", "ids").collect():
        assert t.encode(r.text or "", add_special_tokens=False).ids == list(r.ids)


def test_round_trip_and_empty(spark, docs):
    ids = tokens.encode_corpus(docs.where("doc_id is not null and doc_id <> 8"))
    back = {r.doc_id: r.text for r in tokens.decode_corpus(ids).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.where("doc_id is not null and doc_id <> 8").collect()}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0
