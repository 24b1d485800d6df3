import random
import re

import corpus_pipeline as cp
from churnlens import session
from churnlens.llm.common import stored

from .helpers import SF, prose
from .test_minhash import brute as near
from .test_pii import brute as personal
from .test_repeats import brute as repeated

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_their_order():
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packing"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:4]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != before[r["doc_id"]])
        if name == "language":
            assert after == {d: t for d, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert after == {d: before[d] for d, (_, c) in near(before.items(), k=5).items() if c == d}
        elif name == "repeated_passages":
            want = repeated(before.items(), 50)
            assert after == {d: before[d] if t.split() == before[d].split() else t for d, t in want.items() if t or not before[d].split()}
        else:
            for d, t in before.items():
                spans = personal(t)
                assert (after[d] == t) if not re.search(r"[0-9@]", t) else all(t[a:b] not in after[d] for _, a, b in spans)
        before = after
    pieces = cp.pack_sequences(spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(before)


def test_edge_rows(spark):
    base = " ".join(prose(1, 80))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", "en", "s", 3), (None, base + " x@y.example", "en", None, None), (4, base, "en", "s", 5), (5, base, "en", "s", 5)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in cp.STAGES[:4]:
        docs = stored(stage(spark, docs, SF), "test")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, base + " <email>"), (4, base)]
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_near_duplicates_are_judged_by_five_words(spark):
    words = [f"w{i}" for i in range(80)]
    # 69 of 85 shingles of four words in common, but 66 of 86 of five
    apart = [w + "x" if i in (25, 55) else w for i, w in enumerate(words)]
    # 71 of 81 shingles of five words in common
    close = [w + "y" if i == 40 else w for i, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(apart), 3: " ".join(close)}
    assert near(texts.items())[2][1] == 1 and near(texts.items(), k=5)[2][1] == 2
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], COLUMNS)
    kept = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {d for d, (_, c) in near(texts.items(), k=5).items() if c == d} == {1, 2}


def test_language_stage_drops_what_is_in_no_language(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(n)) for n in (60, 900)]
    short = [t.split()[0] for t in (r["text"] for r in docs.filter("text is not null").limit(30).collect()) if t.split()[:1] and t.split()[0].isalpha()]
    extra = spark.createDataFrame([(10 ** 6 + i, t, None, "s", len(t)) for i, t in enumerate(noise + short)], COLUMNS)
    kept = {r["doc_id"] for r in cp.keep_known_languages(spark, docs.unionByName(extra), SF).collect()}
    assert not kept & {10 ** 6, 10 ** 6 + 1} and kept >= {10 ** 6 + len(noise) + i for i in range(len(short))}


def test_run_keeps_two_results_at_most(spark, monkeypatch):
    """Each stage's tables are gone when the next one runs, and its result after that."""
    held = []
    trace = lambda f: lambda *a: (held.append(list(session._PATHS[spark.sparkContext.applicationId])), f(*a))[1]
    monkeypatch.setattr(cp, "STAGES", [(name, trace(f)) for name, f in cp.STAGES])
    before = set(session._PATHS.get(spark.sparkContext.applicationId, []))
    assert cp.run(spark, SF).count() > 0
    assert [len(set(h) - before) for h in held] == [1, 2, 2, 2, 2]
    assert len(set(session._PATHS[spark.sparkContext.applicationId]) - before) == 1
