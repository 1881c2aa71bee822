"""Ids of packed pieces against the tokenizers file as it comes, added tokens in texts too."""

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfold.llm import packing

END = "<|endoftext|>"
FILE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PIECES = st.lists(st.sampled_from([END, "<|", "|>", "endoftext", " ", "  ", "\n", "a", "b'", "s", "é", "日", "😀", "1", ".", "="]), max_size=14)


@settings(max_examples=200, deadline=None)
@given(PIECES.map("".join))
def test_codec_gives_the_files_ids(text):
    codec = packing.rank_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, packing.added_tokens(P.path("byte_bpe_50k.json")))
    assert codec.encode(text, allowed_special="all") == FILE.encode(text, add_special_tokens=False).ids


def test_pieces_of_texts_with_added_tokens(spark):
    texts = [f"a {END} b", END * 3, f" {END}\n", "x" + END + " word" * 2000 + END, "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in enumerate(texts)}
    assert want[0] == 5
    packed = corpus_pipeline.pack_documents(spark, docs, "").toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == want
    pieces = packing.token_pieces(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, added=packing.added_tokens(P.path("byte_bpe_50k.json"))).orderBy("doc_id", "piece").collect()
    for k, x in enumerate(texts):
        got = np.frombuffer(b"".join(bytes(p.ids) for p in pieces if p.doc_id == k), "<u4").tolist()
        assert got == [*t.encode(x, add_special_tokens=False).ids, 2]
