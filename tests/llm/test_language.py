import math
import random
import string
import zlib

import numpy as np

from churnlens.llm import catalog, language

from .helpers import SF

LANGS = "doc_id long, text string, lang string"


def bits_by_hand(train, text, order):
    """PPM, method C, with exclusion, one byte after the other."""
    data = [b"\0" * order + t.encode() for t in train]
    counts = {}
    for d in data:
        for i in range(order, len(d)):
            for k in range(order + 1):
                c = counts.setdefault(d[i - k:i], {})
                c[d[i]] = c.get(d[i], 0) + 1
    out, raw = 0.0, b"\0" * order + text.encode()
    for i in range(order, len(raw)):
        p, gone = 1.0, set()
        for k in range(order, -2, -1):
            if k < 0:
                p *= 1 / (256 - len(gone)) if raw[i] not in gone else 0
                break
            c = counts.get(raw[i - k:i])
            if not c:
                continue
            # the shorter context's probabilities without the excluded bytes, spread over what is left
            n, d = sum(c.values()), len(c) if len(c) < 256 else 0
            own = {b: v / (n + d) for b, v in c.items()}
            left = 1 - sum(lower(counts, raw, i, k, b, order, own) for b in gone) if gone else 1.0
            if raw[i] in c:
                p *= own[raw[i]] / left
                break
            p *= (d / (n + d)) / left
            gone |= set(c)
        out -= math.log2(p)
    return out


def lower(counts, raw, i, k, b, order, own):
    """Probability of byte b in the context of k bytes, escapes included."""
    if k < 0:
        return 1 / 256
    c = counts.get(raw[i - k:i])
    if not c:
        return lower(counts, raw, i, k - 1, b, order, own)
    n, d = sum(c.values()), len(c) if len(c) < 256 else 0
    if b in c:
        return c[b] / (n + d)
    rest = sum(lower(counts, raw, i, k - 1, x, order, own) for x in range(256) if x not in c)
    return d / (n + d) * lower(counts, raw, i, k - 1, b, order, own) / rest


def model(train, order):
    counts = {}
    for lang, texts in train.items():
        code, n = language.grams(b"\0" * order + texts[0].encode(), order)
        counts[lang] = (code, n.astype(float))
    return language.build(counts, order)


def test_code_lengths_are_those_of_the_trees():
    train = {"x": ["abracadabra abra"], "y": ["the cat sat on the mat"]}
    for order in (1, 2):
        m = model(train, order)
        for text in ("abra", "the zebra", "\x01\xff", "cat abra", "a"):
            want = [bits_by_hand(train[x], text, order) for x in m.langs]
            assert np.allclose(m.code_lengths(text), want, rtol=1e-4), (order, text)


def test_probabilities_of_a_context_add_up():
    m = model({"x": ["abracadabra abra é"]}, 2)
    p = np.exp2(-m.trees[0].bits.reshape(-1, 256).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_texts_are_coded_whole(monkeypatch):
    m = model({"x": ["abracadabra " * 50], "y": ["lorem ipsum dolor " * 50]}, 2)
    text = "lorem abra " * 5000
    whole = m.code_lengths(text)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.allclose(m.code_lengths(text), whole)


def test_edge_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der die das und ", "de"), ("the of and to ", "en")] * 20)]
    rows += [(100, None, "en"), (101, "the und", None), (102, "12 34 !?", None), (103, "", None), (105, "² ½ Ⅷ _", None), (104, "the of and " * 30_000, None), (104, "the of and " * 30_000, None), (None, "der die", None)]
    df = spark.createDataFrame(rows, LANGS).selectExpr("*", "'q' as lang_pred", "0 as score", "1 as n", "2 as gram")
    counts = language.train(df)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(df, counts).collect()]
    assert len(got) == len(rows)
    by = {d: (p, s) for d, p, s in got}
    assert by[100] == by[102] == by[103] == by[105] == ("und", 0.0)
    assert by[104][0] == "en" and by[None][0] == "de" and by[0][0] == "de" and by[1][0] == "en"
    assert all(0 <= s <= 1 for _, _, s in got)
    assert language.predict(df.limit(0), counts).count() == 0
    none = language.train(df.limit(0))
    assert none == {} and {r["lang_pred"] for r in language.predict(df, none).collect()} == {"und"}


def test_labels_and_held_out_texts_teach_nothing(spark):
    rows = [(i, ("aaaa " if i % 2 else "bbbb ") * 5, "x" if i % 2 else "y") for i in range(60)]
    lied = [(d, t, "z" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    one, two = (sorted(map(tuple, language.identify(spark.createDataFrame(r, LANGS)).collect())) for r in (rows, lied))
    assert one == two
    assert {(d, h) for d, h, *_ in one} == {(d, zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in rows}


def test_held_out_accuracy_of_the_query(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in catalog.op7_language(spark, SF).collect()]
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(right) / len(right) > 0.97


def test_surprise_tells_texts_of_no_language_from_short_ones(spark):
    rng = random.Random(2)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]]
    clean = [t for _, t, _ in rows if any(map(str.isalpha, t))]
    words = [w for t in clean for w in t.split()[:2] if any(map(str.isalpha, w))]
    gibberish = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (12, 40, 300, 5000)]
    other = ["Ничего не понимаю, но всё это очень интересно", "これは日本語の文章です。とても短いです。"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(clean + words + gibberish + other)], LANGS)
    got = {r["doc_id"]: r["surprise"] for r in language.predict(df, language.train(spark.createDataFrame(rows, LANGS))).collect()}
    n = len(clean) + len(words)
    assert max(got[i] for i in range(n)) < 5 < min(got[i] for i in range(n, len(got)))


def test_many_languages_take_room_only_for_what_they_hold():
    """Fifty made-up languages, each with its own letters, three bytes each."""
    rng = random.Random(9)
    texts = {f"l{k:02d}": "".join(chr(0x4E00 + 300 * k + rng.randrange(250)) + rng.choice(["", " "]) for _ in range(4000)) for k in range(50)}
    m = model({x: [t] for x, t in texts.items()}, 2)
    assert sum(t.bits.nbytes + t.row_of.nbytes for t in m.trees) < 100e6
    assert all(m.predict(t[2000:2050])[0] == x for x, t in texts.items())


def test_runs_are_added_up_in_parts(spark, monkeypatch):
    rows = [(i, t, x) for i, (t, x) in enumerate([("abra cadabra", "x"), ("the cat", "y"), ("abra", "x")] * 7)]
    df = spark.createDataFrame(rows, LANGS).repartition(2)
    whole = sorted(map(tuple, language._count(df.select("text", "lang"), 2).collect()))
    monkeypatch.setattr(language, "WAITING", 3)
    assert sorted(map(tuple, language._count(df.select("text", "lang"), 2).collect())) == whole
    code, n = language.added([language.grams(b"\0\0" + t.encode(), 2) for _, t, x in rows if x == "x"])
    assert [(c, k) for x, c, k in whole if x == "x"] == list(zip(code.tolist(), n.tolist()))
