import hashlib
import random
import re

import numpy as np
import pytest

from churnlens.llm import catalog, pii
from churnlens.llm.tagger import Tagger, symbols

from .helpers import SF, docs

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            if (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    for letters in ("a1.@- +()", "0123456789.", "0123456789 -", "a@.b-", "+1 (0).-", "é1🙂@a."):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(t)


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = Tagger.new(pii.follows(), 4, 5, 1)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    ids, mask = rng.integers(0, 99, (3, 7)), np.ones((3, 7))
    mask[1, 5:] = 0
    gold = np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 5, 6, 0, 0, 0], [7, 8, 8, 0, 0, 1, 2]])
    _, g = tagger.loss(ids, mask, gold)
    for k, w in tagger.w.items():
        at = (ids[0, 2], 1) if k == "emb" else tuple(rng.integers(0, s) for s in w.shape)
        if k == "trans" and not tagger.allowed[at]:
            continue
        old, step = w[at], 1e-4
        w[at] = old + step
        up = tagger.loss(ids, mask, gold)[0]
        w[at] = old - step
        down = tagger.loss(ids, mask, gold)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3, k


def test_decoding_is_the_best_allowed_path():
    tagger = Tagger.new(pii.follows(), 4, 5, 3)
    ids = symbols("a1")[None, :]
    path, sure = tagger.decode(ids, np.ones((1, 2), np.float32))
    score, _ = tagger._network(ids, np.ones((1, 2), np.float32))
    trans, start = tagger._steps()
    every = {(i, j): start[i] + score[0, 0, i] + trans[i, j] + score[0, 1, j] for i in range(9) for j in range(9)}
    assert tuple(path[0]) == max(every, key=every.get) and (sure > 0).all() and (sure <= 1).all()


def test_windows_cover_every_seed_and_are_reconciled():
    text = "x" * 30 + "1" * 150 + "y" * 200 + "@" + "z" * 10
    covered = np.zeros(len(text), bool)
    for a in pii.windows(text):
        covered[a:a + pii.WINDOW] = True
    assert all(covered[i] for i, c in enumerate(text) if c in "1@")
    tags = np.zeros((2, pii.WINDOW), np.int64)
    tags[0, 40:] = 2
    tags[0, 40] = 1
    tags[1, 8:20] = 2
    tags[1, 8] = 1
    got, p = pii.reconciled(96, [0, 32], tags, np.ones(tags.shape))
    assert pii.read_spans(got, p) == [(0, 40, 52, 1.0)]


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), epochs=8)


def test_tagger_adds_what_the_patterns_run_together(tagger):
    text = "Call erre to +1 (843) 555-7672 170.106.4.9 in the"
    (base, spans), = pii.tag_texts(tagger, [text])
    assert set(base) <= set(spans)
    for kind, a, b in set(spans) - set(base):
        assert pii.sound(kind, text[a:b])


def test_rows(spark, tagger):
    mail = "write to ann.b@mail.example.com or 10.0.0.1 now"
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (None, "+44 20 7946 0958"), (4, "clean text"), (5, "x " * 30_000 + mail)]
    df = docs(spark, rows, extra=True)
    got = {r["doc_id"]: r for r in pii.find(df, tagger, redact=True).collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[4]["text"] == "clean text"
    assert got[3]["text"] == "write to <email> or <ip> now" and got[5]["text"].endswith("<ip> now") and got[None]["text"] == "<phone>"
    assert [tuple(s) for s in got[5]["base"]] == [("email", 60_009, 60_031), ("ip", 60_035, 60_043)]
    assert pii.find(df.limit(0), tagger).count() == 0
    assert pii.report(docs(spark, [])).count() == 0


def test_overlapping_spans_are_redacted_once():
    assert pii.redacted("ab12cd", [(0, 0, 4), (2, 2, 6)]) == "<email>"


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.op8_pii(spark, SF).collect():
        want = brute(texts[r["doc_id"]])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == i for w in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(","))
