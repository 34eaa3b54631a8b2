"""Ids and texts next to the library on whole texts."""

import hashlib

import numpy as np
import pytest
import sentencepiece

from helioframe.llm import pieces
from helioframe.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute(library, key, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return key, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids).encode())


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_pieces_whole_table(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert order(map(tuple, QUERIES["op11_pieces"](spark, SF).collect())) == order(brute(library, r.doc_id, r.text) for r in rows)


def test_pieces_odd_rows(spark, library, folder, docs):
    assert order(map(tuple, QUERIES["op11_pieces"](spark, folder).collect())) == order(brute(library, r.doc_id, r.text) for r in docs.collect())


ODD = ["", " ", "  ", "a", "a ", " a", "a  ", "a   b", "\t", "\n \n", "a▁b", "▁", "▁▁x ▁", "\x00 \x00", "<s> </s> <unk> <0x41>", "漢 字　\U0001d49c \U0001f600",
       "é ﬁ ﻿", " x y", " " * 100 + "z" + " " * 33, "x" * 20_000 + " y"]


@pytest.mark.parametrize("block_bytes, part_bytes", [(pieces.BLOCK_BYTES, pieces.PART_BYTES), (3000, 4000), (9000, 10**9)])
def test_pieces_blocks_and_parts(spark, library, block_bytes, part_bytes):
    rows = list(enumerate([*ODD, *ODD, "z" * 50, None, "", "z" * 50]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = pieces.decode_ids(pieces.encode_texts(df, PIECES, block_bytes=block_bytes, part_bytes=part_bytes), PIECES)
    got = {r.doc_id: (np.frombuffer(r.ids, dtype="<u4").tolist(), r.decoded, r.n_tokens) for r in out.collect()}
    for k, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[k] == (ids, library.decode(ids), len(ids)), text
    bare = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in pieces.encode_texts(df, PIECES, ends=False).collect()}
    assert bare == {k: library.encode(t or "") for k, t in rows}


def test_blocks_of_empty_texts(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "a"), (3, "")], "doc_id bigint, text string")
    out = pieces.encode_texts(df, PIECES, block_bytes=0)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {0: 2, 1: 2, 2: 3, 3: 2}


def test_each_distinct_chunk_once():
    """A block lists a chunk once however often it occurs, and the parts of a list are disjoint."""
    numbers, places, lists = pieces.number_block(["b a b  b", "a b", ""], PIECES, 3)
    words = [w for part in sorted(lists) for w in lists[part]]
    assert sorted(words) == [b"  b", b" a", b" b"] and len(numbers[2]) == 0
    assert [words[places[n]] for n in numbers[0]] == [b" b", b" a", b" b", b"  b"]
    assert numbers[0][0] == 0       # the most frequent one


def test_numbered_texts_are_not_shuffled(spark):
    """Only the lists by part and the answers by block are."""
    df = spark.createDataFrame([(k, f"a b {k}") for k in range(9)], "doc_id bigint, text string")
    out = pieces.encode_texts(df, PIECES, block_bytes=8)
    assert out.count() == 9
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanged = [x for x in plan.splitlines() if " Exchange " in x or "- Exchange" in x]
    assert not any("places" in x for x in exchanged)
    assert plan.count("Exchange hashpartitioning(block") <= 2 and "numbers" not in "".join(exchanged)


def test_models_whose_pieces_cross_take_whole_texts(library):
    known = pieces.Model(PIECES)
    assert known.by_chunk
    known.by_chunk = False
    assert known.cut("a b ") == [" a b "] and known.segment([" a b "]) == [library.encode("a b ")]
