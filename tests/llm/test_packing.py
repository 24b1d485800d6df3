import zlib
from array import array

import pytest
from tokenizers import Tokenizer

from churnlens.llm import catalog, packing

from .helpers import SF, VOCABULARY, docs, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def check(pieces, texts, library, window):
    """Every token once, in order, with the right digest; sequences full of consecutive pieces. Returns sequence lengths."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = (library.encode(texts[d], add_special_tokens=False).ids if texts[d] else []) + [0]
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(array("I", ids[at:at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in own) for own in by_seq.values()]


def test_packer_places_best_fit_and_emits_the_fullest():
    p = packing.Packer(10, 2)
    ids = lambda n: b"\1\0\0\0" * n
    assert list(p.add("a", 0, ids(6), 6)) == [] and list(p.add("b", 0, ids(8), 8)) == []
    assert [len(w) for w in p.open] == [3, 3] and [w[0] for w in p.open] == [6, 8]
    assert list(p.add("c", 0, ids(2), 2))[0][0][0] == "b"                    # 2 fits into 8 + 2, not into the emptier one
    assert list(p.add("d", 0, ids(7), 7)) == []
    closed = list(p.add("e", 0, ids(5), 5))                                   # fits nowhere: the fullest (d) goes
    assert [x[0] for x in closed[0]] == ["d"]
    assert [[x[0] for x in w] for w in p.rest()] == [["e"], ["a"]] and p.open == []
    assert [len(w[0][2]) // 4 for w in packing.Packer(4, 1).add("z", 0, ids(11), 11)] == [4, 4]


def test_rows(spark, library):
    texts = {1: None, 2: "", 3: "hello world", 4: " ".join(prose(1, 5000)), 5: "x", None: "no id"} | {10 + i: " ".join(prose(i, 5 + i)) for i in range(60)}
    got = packing.pack(docs(spark, list(texts.items()), extra=True).repartition(3), VOCABULARY, window=256, open_windows=4).collect()
    lengths = check(got, texts, library, 256)
    assert sum(lengths) / (256 * len(lengths)) > 0.9
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0


def test_repeated_rows_are_packed_each(spark):
    got = packing.pack(docs(spark, [(1, "hello"), (1, "hello")]), VOCABULARY).collect()
    assert sum(p["length"] for p in got) == 4


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lengths = check(catalog.op5_packing(spark, SF).collect(), texts, library, 1024)
    assert sum(lengths) / (1024 * len(lengths)) > 0.97
