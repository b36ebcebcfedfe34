"""The prefix trie of conversations by the Euler-tour technique.

1. Turns are numbered by a sort by range, so a conversation may be of any length. The name of a
   prefix is the exclusive or of a hash of every (place, turn) in it, in two independent halves of 64
   bits: a sum that needs no order, so it is taken in blocks and a long conversation passes through many tasks.
2. Prefixes with one name are a node. Nodes are numbered in the order of (smallest member, depth).
3. Every node has an arc that enters it and one that leaves it. Entering goes on to the first child, leaving to
   the next sibling or out of the parent: one list of arcs, whose ranking gives the sums of leaves and
   savings before each arc. What lies between a node's two arcs is its subtree, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.llm.common import Columns, n_words, numbered
from findling.llm.list_ranking import BLOCK, list_rank
from findling.session import ship
from findling.storage import written

#: Turns of a conversation, and neighbouring numbers of nodes, that one window holds.
SPAN = 4096
#: Identifiers that one row holds where those of a node are joined.
JOINED = 4096
KEY = ("depth", "name_a", "name_b")


def numbered_turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``i`` (from 0), ``n`` (turns of the conversation), ``mark`` (what tells turns apart) and ``words``.

    Turns are in the order of ``turn_col``, null first; equal ones in that of a digest of role and text, so repeated
    rows are turns of their own. Null roles and texts count as empty, rows without a conversation are left
    out. Very long texts are digested whole; extra columns are ignored, whatever their names.
    """
    own = Columns(table)
    role, text = (F.coalesce(F.col(own.at(c)), F.lit("")) for c in (role_col, text_col))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = own.table.select(F.col(own.at(conv_col)).cast("long").alias("conv"), F.col(own.at(turn_col)).alias("turn"), mark.alias("mark"), n_words(text).alias("words"))
    rows = numbered(rows.filter("conv IS NOT NULL"), ["conv", F.col("turn").asc_nulls_first(), "mark"], "place", "trie-turns")
    firsts = rows.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return rows.join(firsts, "conv").select("conv", (F.col("place") - F.col("first")).alias("i"), "n", "mark", "words")


def with_shared_beginnings(turns: DataFrame, group: int = 20, beginnings: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their beginning from the first one of their group.

    The first h turns of conversation c become those of c - c % ``group`` (all it has, if fewer; none, if there is none),
    where h is the CRC-32 of c's decimal digits modulo ``beginnings``. Returns the turns (``conv``, ``depth`` from 1, ``length``
    of the conversation, ``mark``, ``words``) and the conversations (``conv``, ``length``), those without turns included.
    """
    convs = turns.groupBy("conv").agg(F.first("n").alias("n"))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % beginnings).cast("long")
    convs = convs.withColumns({"taken": taken, "base": F.col("conv") - F.col("conv") % group})
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("taken", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("taken"), F.lit(0)))
    convs = written(convs.select("conv", "base", "taken", "shared", "length"), "trie-convs")
    out = ["conv", "depth", "length", "mark", "words"]
    own = turns.join(convs, "conv").filter("i >= taken").withColumn("depth", F.col("i") - F.col("taken") + F.col("shared") + 1)
    lent = turns.filter((F.col("i") < beginnings - 1) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "i", "mark", "words")
    lent = lent.join(convs.filter("shared > 0"), "base").filter("i < shared").withColumn("depth", F.col("i") + 1)
    return own.select(out).unionByName(lent.select(out)), convs.select("conv", "length")


def _named(turns: DataFrame) -> DataFrame:
    """``turns`` with the names of the prefixes that end at them and of those before."""
    halves = {c: F.xxhash64(F.lit(seed), "depth", "mark") for c, seed in (("a", "one half"), ("b", "other half"))}
    turns = turns.withColumns({**halves, "block": F.floor(F.col("depth") / SPAN)})
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = turns.filter(F.col("length") >= SPAN).groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    cells = cells.select("conv", "block", *[F.bit_xor(c).over(upto).alias(f"before_{c}") for c in "ab"])
    rows = turns.withColumns({f"in_{c}": F.bit_xor(c).over(inside) for c in "ab"}).join(cells, ["conv", "block"], "left")
    rows = rows.withColumns({f"name_{c}": F.col(f"in_{c}").bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in "ab"})
    return rows.select("conv", "length", "words", *KEY, *[F.col(f"name_{c}").bitwiseXOR(F.col(c)).alias(f"up_{c}") for c in "ab"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted identifiers of nodes, several in a row."""
    key, first, ids = None, None, []
    for batch in batches:
        out = []
        for *k, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != key or len(ids) == JOINED:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids = k, conv, []
            ids.append(str(conv))
        yield _rows(out, (*KEY, "first"), "ids")
    if ids:
        yield _rows([(*key, first, ",".join(ids))], (*KEY, "first"), "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's identifiers, joined from rows in order; nothing but its state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for *k, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != key:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(out, KEY, "ends_sha256")
    if state:
        yield _rows([(*key, state.hexdigest())], KEY, "ends_sha256")


def _rows(rows: list[tuple], longs: tuple[str, ...], text: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(longs) + 1)
    return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*longs, text])


def ending_digests(ends: DataFrame) -> DataFrame:
    """For each node (``KEY``) the SHA-256 of its ``conv``, ascending, in decimal and joined by commas."""
    order = [*KEY, "conv"]
    ordered = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ordered.mapInArrow(_chunks, ", ".join(f"{c} long" for c in (*KEY, "first")) + ", ids string")
    chunks = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return chunks.mapInArrow(_digests, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct prefix of the conversations, from the empty one (depth 0).

    ``turns`` has ``conv``, ``depth`` (from 1, gapless), ``length``, ``mark`` and ``words``; ``convs`` has ``conv`` and
    ``length`` of all conversations, 0 for those without turns, which belong to the root only. Returns, as
    long, ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` ((members - 1) x words of the last
    turn, summed over the subtree), then ``ends_sha256`` (the members that end here) and the places ``enter`` and ``leave`` of its arcs in
    the tour. Node (``conv_id``, ``depth``) is turn ``depth`` of that conversation, which gives its text. No conversations give no node. ``block`` bounds what a task of the ranking holds.
    """
    ship(turns.sparkSession)
    named = written(_named(turns), "trie-named")
    found = named.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.withColumns({c: zero for c in (*KEY, "words", "up_a", "up_b")})
    found = found.withColumn("depth", F.col("depth").cast("long")).unionByName(root)
    found = numbered(found, ["conv_id", "depth"], "node", "trie-nodes")

    # The root's parent would have depth -1. A node with many children is the smaller side's hot key, which a join splits.
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("name_a").alias("up_a"), F.col("name_b").alias("up_b"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(found.join(up, ["depth", "up_a", "up_b"], "left").drop("up_a", "up_b"), "trie-parents")
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), F.min("node").alias("child"))
    tree = nodes.select("node", "parent", "n_convs", "words", F.floor(F.col("node") / SPAN).alias("span"))
    cells = tree.filter("parent IS NOT NULL").groupBy("parent", "span").agg(F.min("node").alias("least"))
    cells = cells.select("parent", "span", F.lead("least").over(Window.partitionBy("parent").orderBy("span")).alias("beyond"))
    tree = tree.withColumn("next", F.lead("node").over(Window.partitionBy("parent", "span").orderBy("node")))
    tree = tree.join(cells, ["parent", "span"], "left").join(children.withColumnRenamed("parent", "node"), "node", "left")
    saved = (F.col("n_convs") - 1) * F.col("words")
    leaves = F.col("child").isNull().cast("long")
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    arc = lambda at, to, leaf, gain: F.struct(at.alias("id"), to.alias("next"), leaf.alias("leaves"), gain.alias("saved"), F.lit(1).cast("long").alias("arcs"))
    both = F.array(
        arc(enter("node"), F.coalesce(enter("child"), leave("node")), leaves, saved),
        arc(leave("node"), F.coalesce(enter("next"), enter("beyond"), leave("parent")), zero, zero),
    )
    tour = tree.select("n_children", F.explode(both).alias("arc")).select("arc.*")
    sums = list_rank(tour, ["leaves", "saved", "arcs"], block)

    of = lambda c: F.sum(F.when(F.col("id") % 2 == 1, F.col(c)).otherwise(-F.col(c)))
    subtree = sums.groupBy(F.shiftright("id", 1).alias("node")).agg(of("leaves").alias("n_leaves"), of("saved").alias("saved_tokens"), F.min("arcs").alias("enter"), F.max("arcs").alias("leave"))
    ends = named.filter("depth = length").select("conv", *KEY).unionByName(convs.filter("length = 0").select("conv", *[zero.alias(c) for c in KEY]))
    out = nodes.join(subtree, "node").join(children.select(F.col("parent").alias("node"), "n_children"), "node", "left").join(ending_digests(ends), list(KEY), "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        "enter",
        "leave",
    )
