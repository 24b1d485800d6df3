"""Prefix trie of conversations by parallel tree contraction (operator 12).

Conversations that begin alike share the nodes of their common turns. A node is a distinct sequence of turns, found without
comparing any two: a turn's hash includes its place, and the sum of the hashes of the first d turns names the sequence. Sums
over parts of a conversation add up, so one of any length is numbered and summed in pieces.

What a node's subtree holds is gathered by contraction, in rounds of joins. Each round compresses and rakes: a chain of nodes with one child
is contracted to its last one, found by doubling pointers along it, and all leaves are added to their parents and go. After
it only nodes remain that had two children in the contracted tree, so there are as many rounds as the logarithm of the
leaves, however deep the tree is. Contracted nodes are then expanded again, last round first: a node's total is what the chain
held below it and the total of the chain's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import crc32_text, only, shuffle_width, stored
from churnlens.operators.ranking import number_in_group

#: Consecutive conversations that lend their first turns to each other, and the turns lent: the remainder of a checksum by this.
FAMILY, LENT = 20, 4
#: Turns of one conversation that a running sum takes at once; ids that a piece of a hashed list holds.
PIECE, IDS = 4096, 1024

_KEY = ["depth", "k1", "k2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): every conversation's turns in order, as hashes of role and text."""
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = lambda df: df.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("a"),
                                  F.xxhash64(F.lit(1), "text", "role").alias("b"), *[c for c in df.columns if c in ("text", "tie")],
                                  F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words") if "text" in df.columns else "words")
    turns = stored(hashed(rows).drop("text"), "turns").withColumn("tie", F.lit(0).cast("long"))
    # texts decide only between different rows of one turn and role, so only those of such rows are moved
    tied = turns.groupBy("conv_id", "turn", "role").agg(F.min("a") != F.max("a")).toDF("c", "t", "r", "tied").filter("tied").drop("tied")
    tied = stored(tied, "tied")
    if not tied.isEmpty():
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r"))
        texts = hashed(rows).join(tied, same, "left_semi").select("conv_id", "turn", "role", "text", "a", "b").distinct()
        order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
        placed = number_in_group(stored(texts, "tied-texts"), "conv_id", order, "tie").select(
            F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("a").alias("x"), F.col("b").alias("y"), "tie")
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
        turns = turns.drop("tie").join(placed, same, "left").select(*turns.drop("tie").columns, F.coalesce("tie", F.lit(0).cast("long")).alias("tie"))
        turns = stored(turns, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    return stored(number_in_group(turns, "conv_id", order, "pos").select("conv_id", "pos", "a", "b", "words"), "numbered")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, last, a, b, words) of the rebuilt turns, (conv_id, last) of the conversations); ``last``: how many turns there are."""
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    lent = F.pmod(crc32_text(F.col("conv_id")), F.lit(LENT)).cast("long")
    lender = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = F.least("lent", F.coalesce("there", F.lit(0)))
    convs = (sizes.select("conv_id", "n", lent.alias("lent"), lender.alias("lender"))
             .join(sizes.select(F.col("conv_id").alias("lender"), F.col("n").alias("there")), "lender", "left")
             .select("conv_id", "lender", "lent", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("lent"), F.lit(0))).alias("last")))
    convs = stored(convs, "convs")
    own = (turns.join(convs, "conv_id").filter("pos > lent")
           .select("conv_id", (F.col("pos") - F.col("lent") + F.col("taken")).alias("depth"), "last", "a", "b", "words"))
    first = turns.filter(F.col("pos") < LENT).withColumnRenamed("conv_id", "lender")
    borrowed = first.join(convs, "lender").filter("pos <= lent").select("conv_id", F.col("pos").alias("depth"), "last", "a", "b", "words")
    return stored(own.unionByName(borrowed), "rebuilt"), convs.select("conv_id", "last")


def running_sums(rows: DataFrame, group: str, place: str, columns: list[str], piece: int = PIECE) -> DataFrame:
    """``rows`` with each of ``columns`` (decimals) replaced by its sum up to the row's ``place`` (1, 2, ...) in its ``group``.

    A group is summed in pieces of ``piece`` places, and the pieces' sums are summed likewise, so no task needs more than a piece of it.
    """
    longest = rows.agg(F.max(place)).first()[0] or 0
    upto = lambda *by: Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, w: F.sum(c).over(w).cast("decimal(38,0)").alias(c)
    others = [c for c in rows.columns if c not in columns]
    if longest <= piece:
        return rows.select(*others, *[total(c, upto(group)) for c in columns])
    at = F.floor((F.col(place) - 1) / piece).alias("_piece")
    rows = rows.select("*", at)
    sums = stored(rows.groupBy(group, (F.col("_piece") + 1).alias("_place")).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in columns]), "pieces")
    before = running_sums(sums, group, "_place", columns, piece).select(group, F.col("_place").alias("_piece"), *[F.col(c).alias(f"_{c}") for c in columns])
    within = rows.select(*others, "_piece", *[total(c, upto(group, "_piece")) for c in columns])
    return within.join(before, [group, "_piece"], "left").select(
        *others, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("decimal(38,0)").alias(c) for c in columns])


def _named(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, last, words, k1, k2, p1, p2): the keys of the first ``depth`` turns, and of all but the last of these."""
    wide = lambda *of: F.xxhash64(*of).cast("decimal(38,0)")
    placed = rebuilt.select("conv_id", "depth", "last", "words", wide("depth", "a").alias("s1"), wide("b", "depth").alias("s2"),
                            wide("depth", "a").alias("x1"), wide("b", "depth").alias("x2"))
    low = lambda c: (F.pmod(c, F.lit(Decimal(1 << 64)).cast("decimal(38,0)")) - F.lit(Decimal(1 << 63))).cast("long")
    return running_sums(placed, "conv_id", "depth", ["s1", "s2"]).select(
        "conv_id", "depth", "last", "words", *[low(F.col(f"s{i}")).alias(f"k{i}") for i in (1, 2)],
        *[low(F.col(f"s{i}") - F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def id_lists(rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """(key, ids_sha256): SHA-256 of each key's ids, ascending, comma-joined.

    A digest is made in one place, but ids aren't brought there one by one: rows are ordered by key and id over all tasks, which join
    runs of them to texts of at most ``IDS`` ids; a key's few texts are then hashed one after the other, none of them kept.
    """
    names, width = [*key, id_col], shuffle_width(rows.sparkSession)
    kinds = ", ".join(f"{c} long" for c in key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []
        schema = pa.schema([*[(c, pa.int64()) for c in key], ("first", pa.int64()), ("ids", pa.string())])

        def close() -> None:
            if ids:
                out.append((*now, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for *k, i in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now or len(ids) >= IDS:
                    close()
                    now = k
                ids.append(i)
            yield _batch(out, schema)
            out.clear()
        close()
        yield _batch(out, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        schema = pa.schema([*[(c, pa.int64()) for c in key], ("ids_sha256", pa.string())])
        for batch in batches:
            for *k, text in zip(*[c.to_pylist() for c in batch.columns]):
                if k == now:
                    sha.update(b"," + text.encode())
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(text.encode())
            yield _batch(out, schema)
            out.clear()
        if now is not None:
            out.append((*now, sha.hexdigest()))
        yield _batch(out, schema)

    ordered = stored(rows.select(*names), "ids").repartitionByRange(width, *names).sortWithinPartitions(*names)
    texts = stored(ordered.mapInArrow(join, f"{kinds}, first long, ids string"), "id-texts")
    return (texts.repartition(width, *key).sortWithinPartitions(*key, "first").select(*key, "ids")
            .mapInArrow(digest, f"{kinds}, ids_sha256 string"))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): each of ``values`` summed over the node's subtree, itself included.

    ``tree`` has ``id``, ``parent`` (null: a root) and ``values``; ids are unique and of any type that joins, parents exist. Any number of trees of any
    depth; a parent with many children gets their partial sums, and joins are against tables with one row a key.
    """
    edge = [f"{v}_up" for v in values]                  # what the contracted chain above a node adds on the way to its parent
    kids = tree.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("parent", "id")
    alive = stored(tree.join(kids, "id", "left").select("id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values,
                                                        *[F.lit(0).cast("long").alias(e) for e in edge]), "alive")
    raked: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        # compress: nodes with one child, and a parent, point to that child; pointers double until they leave the chain
        single = alive.filter("kids = 1 and parent is not null")
        child = alive.filter("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("next"), (F.col("kids") == 1).alias("on"), *edge)
        to = stored(single.join(child.withColumnsRenamed({e: f"{e}_next" for e in edge}), "id")
                    .select("id", "parent", "next", "on", *[(F.col(v) + F.col(f"{e}_next")).alias(v) for v, e in zip(values, edge)], *edge), "chain")
        if not to.isEmpty():
            while not to.filter("on").isEmpty():
                far = to.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("on").alias("far_on"), *[F.col(v).alias(f"{v}_far") for v in values])
                longer = to.filter("on").join(far, "next").select(
                    "id", "parent", F.col("far").alias("next"), F.col("far_on").alias("on"), *[(F.col(v) + F.col(f"{v}_far")).alias(v) for v in values], *edge)
                to = stored(longer.unionByName(to.filter("not on")), "chain")
            chains.append(to.select("id", "next", *values))
            # the chain's end takes the place of its head, whose parent is no part of a chain, and what the chain held goes on its edge
            inner = single.select(F.col("id").alias("parent"))
            head = to.join(inner, "parent", "left_anti").select(F.col("next").alias("id"), F.col("parent").alias("above"),
                                                                         *[(F.col(v) + F.col(e)).alias(f"{v}_chain") for v, e in zip(values, edge)])
            alive = stored(alive.filter("kids <> 1 or parent is null").join(head, "id", "left").select(
                "id", F.coalesce("above", "parent").alias("parent"), "kids", *values,
                *[F.coalesce(f"{v}_chain", e).alias(e) for v, e in zip(values, edge)]), "alive")
        # rake: leaves have their totals; parents get them, and what chains add on the way
        raked.append(alive.filter("kids = 0").select("id", *values))
        leaves = alive.filter("kids = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(e)).alias(f"{v}_more") for v, e in zip(values, edge)])
        left = alive.filter("kids > 0")
        if left.isEmpty():
            break
        alive = stored(left.join(leaves, "id", "left").select(
            "id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
            *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values], *edge), "alive")
    done = raked[0]
    for more in raked[1:]:
        done = done.unionByName(more)
    for chain in reversed(chains):                       # a chain's end was raked, or went with a later chain
        ends = done.select(F.col("id").alias("next"), *[F.col(v).alias(f"{v}_end") for v in values])
        back = stored(chain.join(ends, "next").select("id", *[(F.col(v) + F.col(f"{v}_end")).alias(v) for v in values]), "expanded")
        done = done.unionByName(back)
    return done


def _parents(nodes: DataFrame, root: int) -> DataFrame:
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.filter("depth > 1").join(above, ["depth", "p1", "p2"])
            .unionByName(nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(root).cast("long"))))


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations' trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. A node's name is its smallest member and its depth.

    Null turns come first; rows of one turn are ordered by role, then text (null: empty); repeated rows are turns of their own. Rows without a
    conversation id take no part. A conversation all of whose turns were its first, with an absent lender, ends at the root. An empty
    table gives no rows; other columns are ignored. Texts of any length are read once, in place, and moved only if rows tie.
    """
    spark = conversations.sparkSession
    rebuilt, convs = _rebuilt(_turns(conversations))
    root, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    named = stored(_named(rebuilt), "named")
    nodes = stored(named.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                            *[F.min(c).alias(c) for c in ("words", "p1", "p2")]), "nodes")
    no = F.lit(None).cast("long")
    top = spark.range(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), no.alias("parent_conv_id"),
                                F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    tree = stored(_parents(nodes, root).select(*top.columns).unionByName(top), "tree")
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    has = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = stored(tree.join(has, ["conv_id", "depth"], "left").select(*top.columns, F.coalesce("n_children", F.lit(0)).alias("n_children")), "tree")
    totals = subtree_totals(tree.select(F.struct("conv_id", "depth").alias("id"), parent.alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = (named.filter("depth = last").select(*_KEY, "conv_id")
            .unionByName(convs.filter("last = 0").select(*[F.lit(0).cast("long").alias(c) for c in _KEY], "conv_id")))
    digests = id_lists(ends, _KEY, "conv_id").withColumnRenamed("ids_sha256", "ends_sha256")
    none = hashlib.sha256(b"").hexdigest()
    return (tree.join(digests, _KEY, "left").join(totals.select("id.conv_id", "id.depth", "n_leaves", "saved_tokens"), ["conv_id", "depth"])
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
