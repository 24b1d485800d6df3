import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlens.llm import catalog, large_items, token_ids

from .helpers import SF, VOCABULARY, docs, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def one_by_one(lengths, window):
    """The method piece by piece: the tokens of every sequence."""
    large = sorted((k for k in lengths if 3 * k > window), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        fits = [b for b in large if a + b <= window]
        if fits:
            large.remove(fits[0])
        gaps.append(window - a - (fits[0] if fits else 0))
    for s in sorted((k for k in lengths if 3 * k <= window), reverse=True):
        holds = [g for g in gaps if g >= s]
        if holds:
            gaps.remove(min(holds))
        gaps.append((min(holds) if holds else window) - s)
    return Counter(window - g for g in gaps)


def laid(counts, window):
    """sequence -> [(offset, length)] of all pieces of a plan."""
    plan = large_items.lay_out(counts, window)
    length = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
    number = np.concatenate([np.arange(n) for n in counts.values()] or [[]]).astype(np.int64)
    out = defaultdict(list)
    if len(length):
        for s, at, k in zip(*map(np.ndarray.tolist, large_items.places(plan, length, number)), length.tolist()):
            out[s].append((at, k))
    return out


def gapless(own, window):
    at = 0
    for offset, k in sorted(own):
        assert offset == at
        at += k
    assert at <= window
    return at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_layout_equals_the_method_piece_by_piece(lengths):
    got = laid(Counter(lengths), 30)
    assert Counter(gapless(own, 30) for own in got.values()) == one_by_one(lengths, 30)
    assert all(sum(3 * k > 30 for _, k in own) <= 2 for own in got.values())
    assert sum(len(own) for own in got.values()) == len(lengths)


def test_layout_of_many_pieces_is_as_small_as_that_of_few():
    rng = random.Random(1)
    counts = {k: rng.randint(1, 10 ** 9) for k in range(1, 2049)}
    plan = large_items.lay_out(counts, 2048)
    assert len(plan) < 40_000
    tokens = sum(k * n for k, n in counts.items())
    per_length = defaultdict(int)
    for length, first, n, *_ in plan.tolist():
        assert first == per_length[length]
        per_length[length] += n
    assert per_length == counts
    sequences = max(s + -(-n // c) for _, _, n, c, s, _ in plan.tolist())
    assert -(-tokens // 2048) <= sequences <= 1.01 * tokens / 2048
    with pytest.raises(ValueError):
        large_items.lay_out({2049: 1}, 2048)


def test_cut():
    assert list(large_items.cut(1, 4)) == [(0, 1)] and list(large_items.cut(4, 4)) == [(0, 4)]
    assert list(large_items.cut(9, 4)) == [(0, 1), (1, 5), (5, 9)] and list(large_items.cut(8, 4)) == [(0, 4), (4, 8)]


def check(pieces, texts, library, window):
    """Every piece is right and has its place; returns the tokens of each sequence."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = (library.encode(texts[d], add_special_tokens=False).ids if texts[d] else []) + [0]
        own.sort(key=lambda p: p["piece"])
        assert [(p["piece"], p["start"], p["start"] + p["length"]) for p in own] == [(i, a, b) for i, (a, b) in enumerate(large_items.cut(len(ids), window))]
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(array("I", ids[p["start"]:p["start"] + p["length"]]).tobytes())
    return Counter(gapless(own, window) for own in by_seq.values())


def test_rows(spark, library):
    texts = {1: None, 2: "", 3: "hello world", 4: " ".join(prose(1, 9000)), 5: "x", None: "no id"} | {10 + i: " ".join(prose(i, 3 * i)) for i in range(90)}
    got = large_items.pack(docs(spark, list(texts.items()), extra=True).repartition(5), VOCABULARY, window=256).collect()
    assert check(got, texts, library, 256) == one_by_one([p["length"] for p in got], 256)
    assert large_items.pack(docs(spark, []), VOCABULARY).count() == 0


def test_repeated_rows_are_packed_each_and_tasks_do_not_matter(spark):
    rows = docs(spark, [(1, "hello")] * 300 + [(2, " ".join(prose(3, 700)))] * 40)
    counts = set()
    for tasks in (1, 7):
        got = large_items.pack(rows.repartition(tasks), VOCABULARY).collect()
        assert len(got) == 340 or {p["piece"] for p in got} == {0, 1}
        by_seq = defaultdict(list)
        for p in got:
            by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
        counts.add(tuple(sorted(gapless(own, 2048) for own in by_seq.values())))
    assert len(counts) == 1


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op13_bestfit(spark, SF).collect()
    assert check(got, texts, library, 2048) == one_by_one([p["length"] for p in got], 2048)


def test_ids_are_the_library_s(library):
    encode = token_ids.text_ids(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(4)
    made = ["".join(rng.choice(" ab'\n\t.Ġé1 　 <|endoftext|>") for _ in range(60)) for _ in range(400)]
    for text in ["a  b", " ", "\n\n a", "a\tb \x00 c", "Ġ Ġx  Ġ", "x <|endoftext|> y", "don't I'll 12 3.5", "x" * 5000, *made]:
        assert encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_a_full_generation_of_pieces_makes_room(library, monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 20)
    encode = token_ids.TextIds(open(VOCABULARY, encoding="utf-8").read())
    for i in range(40):
        text = " ".join(prose(i, 30, words=60))
        assert encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(encode._young) + len(encode._old) <= 60
