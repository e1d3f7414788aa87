import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import packing, queries
from tests.llm.samples import ODD_TEXTS, documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = ["á b\u0085c\x1cd  x y don't it's_a <|endoftext|>z <|startoftext|> Ångström ΣΣ ́a\tq", "İstanbul\x0b\x0c12,5 ab",
          '<|ENDOFTEXT|> a\'re. rock\'n\'roll "quoted" (x) ª º ß é́  a\x00b 日本語。 ½ x²', "it's' 's 's. ' don't. a.'s",
          "x" * 5000, "naïve Éàü. (Ça) STRASSE straße, …", "a" + "!" * 300]


def test_words_give_the_ids_of_the_text():
    whole, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for text in [*TRICKY, *(prose(k, 300) for k in range(5))]:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode(text.encode()) == want


def test_capitals_beside_special_tokens():
    whole, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for text in ["<| Hello The", "<|user|> Hello. THE end, Straße <|endoftext|> World!", "hello <| Hello hello"]:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode(text.encode()) == want
    assert words.encode(b"<| Hello")[-4:] == words.encode(b"hello")[-4:]


@pytest.mark.parametrize("tokens", [0, 1, 2, 3, 1000, 2047, 2048, 2049, 5000])
def test_binary_lengths(tokens):
    lengths = packing.binary_lengths(tokens)
    assert sum(lengths) == tokens and lengths == sorted(lengths, reverse=True)
    assert all(n & (n - 1) == 0 and n <= 2048 for n in lengths)
    assert len({n for n in lengths if n < 2048}) == sum(n < 2048 for n in lengths)


def test_pieces_give_the_documents_back(spark, tmp_path):
    texts = ODD_TEXTS + [(60, prose(1, 6000)), (61, TRICKY[2])]
    pieces = packing.pack(documents(spark, texts, ("ids", "start", "bucket")), PATH)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(len(r.ids) == 4 * r.length and r.length == 1 << r.bucket and r.offset == 0 for r in rows)
    whole = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id not in (4, None):  # two rows share the id
            assert r.start == sum(map(len, got[r.doc_id])) // 4
            got[r.doc_id].append(bytes(r.ids))
    for i, text in texts:
        if i not in (4, None):
            want = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert b"".join(got[i]) == want
    packing.write_buckets(pieces, str(tmp_path / "packed"))
    again = spark.read.parquet(str(tmp_path / "packed"))
    assert again.count() == len(rows) and again.filter("length <> pow(2, bucket)").count() == 0


def test_query_digests(spark):
    rows = queries.op8_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    whole = Tokenizer.from_file(PATH)
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    assert packing.pack(documents(spark, []), PATH).collect() == []
