import re
from collections import Counter

import numpy as np

from churnlens.llm import catalog, quality

from .helpers import SF, docs, prose


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if threes[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(covered)]


def test_base_counts():
    for t in (None, "", " \n", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n\n x\r\nx", "é🙂 #$% b\x85", "one two\n" * 50, "a b a b a"):
        assert quality.features(t)[:5] == brute(t), t


def test_estimation_finds_the_class_without_labels():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.55])
    right = rng.random((len(good), 5)) < accuracy
    votes = np.where(rng.random((len(good), 5)) < 0.2, 2, np.where(right, good[:, None], ~good[:, None]))
    patterns, place, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, by_class, share = quality.fit(patterns, n.astype(float))
    assert abs(share - 0.8) < 0.03
    assert ((post[place.ravel()] >= 0.5) == good).mean() > 0.95
    believed = by_class[1, :, 1] / (by_class[1, :, 1] + by_class[1, :, 0])
    assert np.abs(believed - accuracy).max() < 0.06                         # the rule that guesses is found out


def test_verdicts_and_edge_rows(spark):
    fine = [" ".join(prose(i, 120)).capitalize() + "." for i in range(40)]
    junk = ["### $$$ %%% && " * 40 + " ".join(prose(90 + i, 20)).upper() + "!! " * 30 for i in range(10)]
    rows = [(i, t) for i, t in enumerate(fine)] + [(100 + i, t) for i, t in enumerate(junk)] + [(200, None), (201, ""), (202, "short text."), (0, fine[0]), (None, fine[1])]
    got = quality.verdicts(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    kept = {(r["doc_id"], r["kept"]) for r in got}
    assert all((i, True) in kept for i in range(40)) and (None, True) in kept
    assert all((100 + i, False) in kept for i in range(10))
    assert all((i, False) in kept for i in (200, 201, 202))
    assert quality.verdicts(docs(spark, [])).count() == 0


def test_one_pattern_only(spark):
    got = quality.verdicts(docs(spark, [(i, " ".join(prose(7, 120)) + ".") for i in range(3)])).collect()
    assert len({r["posterior"] for r in got}) == 1


def test_query_against_brute_force_and_labels(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in catalog.op4_quality(spark, SF).collect():
        want = brute(texts[r["doc_id"]])
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            right.append(r["kept"] == bool(labels[r["doc_id"]]))
    assert sum(right) / len(right) > 0.95
