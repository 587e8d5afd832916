"""The BPE coder against the tokenizer library, and on odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from perdura.llm import bpe
from perdura.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe.from_file(BYTE_BPE)


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def odd_texts(coder, n=4000):
    rng = random.Random(3)
    pieces = "ab'tsre  \n\t<|endoftext|>19éß中͸ "
    for _ in range(n):
        yield from (
            "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 9))),
            "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))),
            coder.decode(b"".join(coder.packed[rng.randrange(50_257)] for _ in range(rng.randint(1, 8)))),
            "<|endoftext|>".join(rng.choice(["a ", " ", "", "x\n", "'ll"]) for _ in range(3)),
            rng.choice("a-=xé ") * rng.randint(1, 300) + rng.choice("a-=b ") * rng.randint(1, 30),
        )


def test_every_odd_text_as_the_library_has_it(library, coder):
    texts = list(odd_texts(coder))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in coder.encode_all(texts)] == want
    got = [coder.decode(np.array(w, "<u4").tobytes()) for w in want]
    assert got == library.decode_batch(want, skip_special_tokens=False)


def test_every_code_point_splits_as_the_library_splits_it(library, coder):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for low in range(0, len(points), 1 << 14):
        text = "".join(f"a{chr(p)}1{chr(p)} {chr(p)}\n" for p in points[low : low + (1 << 14)])
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert coder.words.findall(text) == want
        if low == 0:
            near = text[: text.index(chr(bpe.NEAR)) - 1]
            assert coder.near_words.findall(near) == coder.words.findall(near)


def test_every_token_alone(library, coder):
    texts = [t.decode() for t in coder.tokens if t.decode("utf-8", "ignore").encode() == t]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in coder.encode_all(texts)] == want


def test_long_words_long_texts_and_full_tables(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    rng = random.Random(5)
    small = bpe.Bpe.from_file(BYTE_BPE)
    texts = ["x" * 50_000, "ab" * 3000 + "é" * 3000, " ".join("w" * rng.randint(1, 400) for _ in range(500)), "\n" * 999]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 600))) for _ in range(50)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in small.encode_all(texts)] == want
    assert [ids(small.encode(t)) for t in texts] == want


def test_rows_with_nulls_repeats_and_clashing_columns(spark, library):
    long = "many words of a text, " * 300_000  # above one slice
    rows = [(1, "Hello there"), (1, "Hello there"), (None, "x <|endoftext|> y"), (2, None), (3, ""), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(1))
    got = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for (doc_id, text), r in zip(sorted(rows, key=key), sorted(got, key=key), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"], ids(r["ids"]), r["text"]) == (doc_id, len(want), want, text or "")
    assert bpe.encode(docs.limit(0), BYTE_BPE).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary"), BYTE_BPE).first()["text"] == ""
    broken = spark.createDataFrame([(1, 1, np.array([library.token_to_id("Ã")], "<u4").tobytes())], "doc_id long, n_tokens long, ids binary")
    assert bpe.decode(broken, BYTE_BPE).first()["text"] == "�"


def test_query_as_the_library_has_it(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op13_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
