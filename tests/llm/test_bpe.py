import hashlib
import random

import pytest
from tokenizers import Tokenizer

from churnlens.llm import bpe, catalog

from .helpers import SF, VOCABULARY, docs


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_automaton_of_a_few_merges():
    labels = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ab": 258, b"aba": 259}
    a = bpe.Automaton(labels, [(b"a", b"a"), (b"aa", b"b"), (b"a", b"b"), (b"ab", b"a")])
    name = {t: w for w, t in labels.items()}
    spell = lambda w: [name[t] for t in a.encode_word(w)]
    assert spell(b"aaa") == [b"aa", b"a"]
    assert spell(b"aaab") == [b"aa", b"ab"]
    assert spell(b"aab") == [b"aab"]
    assert spell(b"aba") == [b"aba"]
    assert spell(b"baabab") == [b"b", b"aab", b"ab"]


def test_a_rule_that_can_never_fire_makes_no_token():
    labels = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    a = bpe.Automaton(labels, [(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")])
    assert a.encode_word(b"abc") == [256, ord("c")]


def test_every_path_is_the_librarys(codec, library):
    rng = random.Random(1)
    parts = ["a", "aaaa", "  ", "\n", " \n", "\t", "\x1c", "\x85", " ", "<|endoftext|>", "é", "日本", "1", "²", "'s", "'ll", "!!", "the", "ing",
             "　", "\x0b", "🙂", "é", " ", "İ", "​", "_", " x"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = library.encode(s, add_special_tokens=False).ids
        assert codec.encode(s).tolist() == want, s
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_very_long_words(codec, library):
    for s in ("a" * 20_000, "ab" * 9_000, "the" * 5_000, " " * 5_000 + "x", "é" * 5_000):
        assert codec.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "TABLE_CELLS", 3)
    with open(VOCABULARY, encoding="utf-8") as f:
        tight = bpe.Codec(f.read())
    s = "Many words that are met again and again, and words that are not met again."
    assert tight.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids


def test_bytes_that_are_no_utf8_are_replaced(codec, library):
    ids = codec.encode("é🙂").tolist()
    for cut in (ids[:1], ids[1:], ids[:-1]):
        assert codec.decode(cut) == library.decode(cut, skip_special_tokens=False)


def test_rows(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "hello")], extra=True)
    got = sorted((r["doc_id"] or 0, len(r["ids"])) for r in bpe.encode(df, VOCABULARY).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    back = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).collect()
    assert sorted(r["decoded"] for r in back) == ["", "", "hello", "hello world", "hello world"]
    assert bpe.digests(df.limit(0), VOCABULARY).count() == 0


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.op1_bpe(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
