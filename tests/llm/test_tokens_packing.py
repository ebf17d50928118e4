import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twigline.llm import queries, tokens
from twigline.llm.bitpack import BitFile, pack_bits, read_token_files, unpack_bits, vocabulary_bits, write_blob, write_token_files
from twigline.llm.packing import CapacityTree, first_fit_decreasing, pack_documents
from twigline.llm.tokens import WordEncoder, default_path, encoder

ODD = [
    None, "", " ", "don't stop'll", "A\x1cB a", "ÉÈ ŸŒ İstanbul ΣΑΣ ﬁ ½²ª º µ", "<|endoftext|> x", "a<|startoftext|>b<|ENDOFTEXT|>", "<|end of|text|>", "naïve é ́x 日本語 123abc 1,234.5 a'b 'tis",
    "x" * 5000, "the  ,the ''' '", "😀😀 a😀b", "\x85a\x00b\x7f c", "a\u2003b\xa0c\u180ed\u200be\u3000f", "\ufeffa \u2028b", "word " * 6000,
]


@pytest.fixture(scope="module")
def truth():
    stock = Tokenizer.from_file(default_path())
    return lambda t: np.array([*stock.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_encoder_is_exact(truth):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab eÉß'.,!7\n\t-é") for _ in range(200)) for _ in range(60)]
    for t, ids in zip(ODD + made, encoder().encode_documents(ODD + made), strict=True):
        assert ids.tolist() == truth(t).tolist()
        assert encoder().encode_document(t).tolist() == ids.tolist()


def test_other_rules_go_through_the_library(tmp_path, truth):
    spec = json.loads(open(default_path(), encoding="utf-8").read())
    texts = [t for t in ODD if t] + ["Case MATTERS here's 12 É"]
    for key in ("normalizer", "pre_tokenizer"):
        changed = {**spec, key: {"type": "Lowercase"} if key == "normalizer" else {"type": "WhitespaceSplit"}}
        path = str(tmp_path / f"{key}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(changed, f)
        other, stock = WordEncoder(path), Tokenizer.from_file(path)
        assert not other.by_word
        for t, ids in zip(texts, other.encode_documents(texts), strict=True):
            assert ids.tolist() == [*stock.encode(t, add_special_tokens=False).ids, 1]


def test_caches_stay_bounded(monkeypatch, truth):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    enc, rng = WordEncoder(), random.Random(11)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abc,.é", k=5)) for _ in range(40)) + " " + "y" * 300 for _ in range(3)]
        for t, ids in zip(texts, enc.encode_documents(texts), strict=True):
            assert ids.tolist() == truth(t).tolist()
    assert len(enc.words) < 400 and len(enc.known_pieces) < 400 and "y" * 300 not in enc.words


def test_first_fit_decreasing_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins: list[int] = []
        expected = [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            for b, used in enumerate(bins):
                if used + sizes[i] <= 100:
                    break
            else:
                b, used = len(bins), 0
                bins.append(0)
            expected[i] = (b, used)
            bins[b] += sizes[i]
        assert first_fit_decreasing(sizes, 100) == (expected, len(bins))
    with pytest.raises(ValueError):
        CapacityTree(2, 10).place(11)


def test_packing(docs, truth):
    df = docs(ODD).unionByName(docs(["twice"], 50)).unionByName(docs(["twice"], 50))
    rows = pack_documents(df, sequence_tokens=256, group_tokens=3000).collect()
    of = {i: truth(t) for i, t in enumerate(ODD)} | {50: truth("twice")}
    for r in rows:
        assert r.ids == of[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(of[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, of.values())) + len(of[50])
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256
    assert pack_documents(df.filter("false")).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.doc_id for r in pack_documents(nulls).collect()} == {None}


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 20, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint32)
        assert (unpack_bits(pack_bits(ids, bits), bits, n) == ids).all()
    docs_ = [rng.integers(0, 1 << bits, n, dtype=np.uint32) for n in (0, 5, 700, 64, 1)]
    f = BitFile(write_blob([None, -3, 7, 7, 9], docs_, bits, block=128) + b"\n")
    assert [f.doc_id(i) for i in range(5)] == [None, -3, 7, 7, 9]
    for i, d in enumerate(docs_):
        assert (f.doc(i) == d).all()
    every = np.concatenate(docs_)
    assert (f.read(100, 400) == every[100:400]).all()


def test_bits_errors():
    assert vocabulary_bits(49408) == 16 and vocabulary_bits(1) == 1
    with pytest.raises(ValueError):
        pack_bits(np.array([4], dtype=np.uint32), 2)
    with pytest.raises(ValueError):
        BitFile(b"something else")
    with pytest.raises(ValueError):
        BitFile(write_blob([1], [np.arange(9, dtype=np.uint32)], 5)[:-4])


def test_token_files(docs, spark, tmp_path, truth):
    df = docs(ODD).repartition(3)
    write_token_files(df, str(tmp_path / "t"), file_tokens=2000)
    back = read_token_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(back, ODD, strict=True):
        ids = truth(t)
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    write_token_files(df.filter("false"), str(tmp_path / "e"))
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_token_files_of_repeated_ids(docs, spark, tmp_path, truth):
    df = docs(["one text here", "another"] * 40).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.lit(7)))
    write_token_files(df, str(tmp_path / "t"), file_tokens=50)
    back = read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    at = 0
    for r in back:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in back]
    assert len(back) == 80 and ids == sorted(ids, key=lambda i: (i is not None, i))
    assert sorted(r.ids for r in back) == sorted([truth("one text here").tobytes(), truth("another").tobytes()] * 40)


@pytest.mark.parametrize("name", ["op1_packing", "op3_token_files"])
def test_queries_against_the_library(spark, truth, name):
    """Every document of the small table, by the stock tokenizer."""
    data = "/root/testdata/sf0.001"
    docs_ = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    of = {i: truth(t) for i, t in docs_.items()}
    rows = queries.QUERIES[name](spark, data).collect()
    if name == "op3_token_files":
        at = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(of[r.doc_id]), zlib.crc32(of[r.doc_id].tobytes()))
            at += r.n_tokens
        assert len(rows) == len(of)
        return
    seen = dict.fromkeys(of, 0)
    used = {}
    for r in rows:
        piece = of[r.doc_id][r.start : r.start + r.length]
        assert (zlib.crc32(piece.tobytes()), r.doc_tokens) == (r.ids_crc32, len(of[r.doc_id]))
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in of.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, of.values())) > 0.97 * 2048 * len(used)
