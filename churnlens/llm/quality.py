"""Document quality by weak supervision (operator 4).

Each rule looks at one property of a document and votes junk or good, or abstains. No rule decides. How often each
rule votes what, given that a document is good or junk, is estimated from all documents' votes alone by expectation
maximisation (the documents' classes are the hidden variable), and a document's verdict is the posterior probability
that it is good.

Documents with the same votes are alike to the model, so the votes are counted by pattern (at most 3^rules patterns,
whatever the table holds), the model is fitted to these counts, and the posterior of each pattern is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import only, small, stored
from churnlens.llm.words import hashes, window_hashes, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEPT_FROM = 0.5
#: Vote that a rule is taken to give more often to the class it names: share of the documents added as if seen.
PRIOR_SHARE = 0.01
ROUNDS, CHANGE = 200, 1e-9

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_WHITE = np.array([0x20, *range(0x09, 0x0E)])
_END_MARKS = (".", "!", "?", "…", ":", '"', "”", "»", ")")

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct",
            "n_short_words", "n_letters", "n_upper", "n_marks"]


def features(text: str | None) -> list[int]:
    """The counts named in ``FEATURES``, of a whole text."""
    if not text:
        return [0] * len(FEATURES)
    raw = text.encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    tokens = raw.split()
    chars = int(seen.sum() - seen[0x80:0xC0].sum())                      # bytes that start a code point
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    covered = np.zeros(len(tokens) + 1, np.int64)
    if len(tokens) > 3:
        threes = window_hashes(hashes(tokens), 3)
        _, place, times = np.unique(threes, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[place] > 1)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 3, -1)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    return [len(tokens), chars - int(seen[_WHITE].sum()), int(seen[[ord(c) for c in SYMBOLS]].sum()), len(lines) - len(set(lines)),
            int((np.cumsum(covered[:-1]) > 0).sum()), len(lines), sum(x.rstrip().endswith(_END_MARKS) for x in lines), len(set(tokens)),
            sum(len(w) <= 3 for w in tokens), upper + lower + int(seen[0xC0:].sum()), upper, int(seen[ord("!")] + seen[ord("?")])]


@dataclass(frozen=True)
class Rule:
    """Votes junk where ``junk`` holds, else good where ``good`` holds, else abstains (nulls abstain)."""

    name: str
    junk: Column
    good: Column


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def default_rules() -> list[Rule]:
    """Rules over ``FEATURES``; shares of few words or lines abstain."""
    enough = F.col("n_words") >= 30
    long_enough = (F.col("n_words") >= MIN_WORDS) & (F.col("n_words") <= 3000)
    chars = _share("n_letters", "word_chars")
    of = lambda name, share, junk, good, when=enough: Rule(name, when & junk(share), when & good(share))
    return [
        of("symbols", _share("n_symbols", "n_words"), lambda x: x > 0.1, lambda x: x < 0.02),
        of("capitals", _share("n_upper", "n_letters"), lambda x: x > 0.4, lambda x: x < 0.1),
        of("marks", _share("n_marks", "n_words"), lambda x: x > 0.25, lambda x: x < 0.05),
        of("repeats", _share("n_repeat_words", "n_words"), lambda x: x > 0.25, lambda x: x < 0.1),
        of("copied lines", _share("n_dup_lines", "n_lines"), lambda x: x > 0.35, lambda x: x < 0.1, F.col("n_lines") >= 3),
        of("ended lines", _share("n_ended_lines", "n_lines"), lambda x: x < 0.5, lambda x: x > 0.85),
        of("variety", _share("n_distinct", "n_words"), lambda x: x < 0.25, lambda x: x > 0.4, long_enough),
        of("letters", chars, lambda x: x < 0.85, lambda x: x > 0.92),
        of("short words", _share("n_short_words", "n_words"), lambda x: (x < 0.08) | (x > 0.48), lambda x: (x > 0.18) & (x < 0.42)),
    ]


def pattern(rules: Sequence[Rule]) -> Column:
    """All votes as one number: a digit to base 3 each, 0 junk, 1 good, 2 abstains."""
    out = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        vote = F.when(F.coalesce(r.junk, F.lit(False)), 0).when(F.coalesce(r.good, F.lit(False)), 1).otherwise(2)
        out = out + vote * F.lit(3 ** k)
    return out


def fit(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, how the rules vote by class, and the share of good documents.

    ``votes``: patterns x rules, 0 junk, 1 good, 2 abstains; ``n``: documents with each. Starts from the majority of
    the votes given. That a vote favours its own class is all that is known before.
    """
    rules, total = votes.shape[1], n.sum()
    good, junk = (votes == 1).sum(1), (votes == 0).sum(1)
    post = np.clip((good + 1.0) / (good + 2 * junk + 2.0), 0.05, 0.95)
    seen = np.stack([votes == v for v in range(3)], -1).astype(float)           # patterns x rules x votes
    prior = np.ones((2, rules, 3))
    for c in range(2):
        prior[c, :, c] += PRIOR_SHARE * total
    for _ in range(ROUNDS):
        share = (post @ n + 1) / (total + 2)
        by_class = np.stack([np.einsum("p,prv->rv", w * n, seen) for w in (1 - post, post)]) + prior
        by_class /= by_class.sum(2, keepdims=True)
        log = np.einsum("prv,crv->cp", seen, np.log(by_class)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max() < CHANGE:
            break
        post = new
    return new, by_class, float(share)


def _measure(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = np.array([features(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in found.T.copy()]], ["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} long" for f in FEATURES))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None,
             kept_from: float = KEPT_FROM) -> DataFrame:
    """Per document: its ``FEATURES``, ``base_failed``, ``posterior`` (probability of being good) and ``kept``.

    Null and empty texts have counts of 0 and fail the base; texts of any length are measured whole; repeated rows
    each get a row and each count as a document; null ids stay; in a table where all vote alike, all get the
    same posterior; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rules = default_rules() if rules is None else rules
    rows = stored(_measure(only(docs, doc_id=id_col, text=text_col)).withColumn("pattern", pattern(rules)), "quality")
    counted = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()     # 3^rules rows at most
    code = counted["pattern"].to_numpy(np.int64)
    votes = code[:, None] // 3 ** np.arange(len(rules)) % 3
    post = fit(votes, counted["n"].to_numpy(float))[0] if len(code) else np.zeros(0)
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(code, post)], "pattern long, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (rows.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= kept_from))
            .select("doc_id", *FEATURES, "base_failed", "posterior", "kept"))
