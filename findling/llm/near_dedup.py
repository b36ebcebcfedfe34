"""Near duplicates by SuperMinHash, banding, verification and union-find grouping.

1. Each text becomes its set of word shingles. Equal sets are one class from here on, so
   a group of copies, however large, is one node.
2. A class gets a SuperMinHash signature: every shingle walks through the slots by its own
   random permutation, and the rank in that walk is the whole part of its value. Slots
   are so correlated that few stay empty for long; the walk ends at the rank that no slot
   can still improve.
3. Bands of slots are buckets. In each bucket the members are verified against one pivot,
   on full sets; verified links are joined into components.
4. What then lies in one bucket but in different components is compared in blocks of bounded size: a class is
   there by the size of its set and the parities of the set's hashes in a table of bits. Two sets differ
   in at least as many elements as their tables do in bits, so a pair whose tables differ in more bits than linked
   sets may differ in elements is no link. That bound is exact and passes next to nothing below a similarity of 0.7.
5. Classes that it leaves with a possible pair come to the blocks again with their whole sets of hashes, each once to a block
   whose size is bounded by their elements. There every possible pair of different components is decided, in the first of the bands that it
   shares, and what is linked is joined at once. Blocks give links only, at most one less than they have members: no pairs
   leave a block, whatever a group's similarity.

At similarity 0.75 a pair shares no bucket with a chance of (1 - 0.75^4)^32 = 5e-6, at 0.8
of 5e-8; the README has the recall against all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import REMEMBERED, Columns
from findling.plans.components import connected_components
from findling.session import ship
from findling.storage import release, written

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Members of a bucket in one block of the comparison in blocks.
BLOCK = 2000
#: Bits of a table for each element, and the most bits: with fewer the bound passes more, but nothing less.
BITS, MOST_BITS = 4, 1 << 17
#: Elements that go through the permutations together; words whose hash a worker remembers.
CHUNK, MEMO = 200_000, 500_000
RANK_BITS = 40
#: Tasks that share the classes of a component.
SALTS = 8
#: Elements of all members of a bucket in one block where whole sets are compared.
ELEMENTS = 1_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ALL = (1 << 64) - 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self) > MEMO:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; ASCII letters count as lower-case.

    Fewer words make one shingle; none make an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        short = len(h)
        for x in h.tolist():
            short = (short * int(_A) + x) & _ALL
        return _mixed(np.array([short ^ int(_C)], np.uint64))
    n = len(h) - width + 1
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc = acc * _A + h[i : i + n]
    return np.unique(_mixed(acc))


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of non-empty sets: rank << RANK_BITS | random bits, one row a set."""
    out = np.empty((len(sets), slots), np.int64)
    begin = 0
    while begin < len(sets):
        end, n = begin, 0
        while end < len(sets) and (end == begin or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        out[begin:end] = _walk(sets[begin:end], slots)
        begin = end
    return out


def _walk(sets: list[np.ndarray], slots: int) -> np.ndarray:
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
    best = np.full(len(sets) * slots, np.iinfo(np.int64).max, np.int64)
    row = np.arange(len(element))
    for rank in range(slots):
        x = _mixed(element[row] + np.uint64((rank + 1) * int(_A) & _ALL))
        to = rank + ((x & np.uint64(0xFFFFFF)) % np.uint64(slots - rank)).astype(np.int64)
        slot = order[row, to]
        order[row, to] = order[row, rank]
        value = (x >> np.uint64(64 - RANK_BITS)).astype(np.int64) | (rank << RANK_BITS)
        np.minimum.at(best, owner[row] * slots + slot, value)
        improvable = best.reshape(-1, slots).max(axis=1) >= (rank + 1) << RANK_BITS
        row = row[improvable[owner[row]]]
        if not len(row):
            break
    return best.reshape(-1, slots)


def parities(elements: np.ndarray) -> bytes:
    """A table of at least BITS bits an element: a bit tells if an odd number of hashes fall on it.

    Sizes are powers of two, so a table folds to half its size by exclusive or.
    """
    size = 64
    while size < min(MOST_BITS, BITS * len(elements)):
        size *= 2
    # Other bits of the hash than those that name a shingle's place in a walk.
    odd = np.bincount((_mixed(elements) >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Class, size of the set, signature (16 bits of each slot) and parities of each text; other columns are carried."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingle_set(t, width) for t in part.column(0).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            slots: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if full:
                low = (superminhash([sets[i] for i in full]) & 0xFFFF).astype("<u2")
                for i, s in zip(full, low, strict=True):
                    keys[i], slots[i], bits[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), s.tobytes(), parities(sets[i])
            made = [pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(slots, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.record_batch([*part.columns, *made], names=[*part.schema.names, "cls", "n", "slots", "bits"])


def _verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    last_text, last_set = None, None
    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            a = batch.column(2)[i].as_py()
            if a != last_text:
                last_text, last_set = a, shingle_set(a, width)
            other = shingle_set(batch.column(3)[i].as_py(), width)
            both = len(np.intersect1d(last_set, other, assume_unique=True))
            good.append(100 * both >= percent * (len(last_set) + len(other) - both))
        yield batch.select([0, 1]).append_column("linked", pa.array(good, pa.bool_()))


def _tables(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size of table: the places that have such a table, and the tables as rows of 64-bit numbers."""
    sizes = np.array([len(b) for b in bits])
    return {int(s): (at := np.flatnonzero(sizes == s), np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)) for s in np.unique(sizes)}


def _folded(table: np.ndarray, words: int) -> np.ndarray:
    while table.shape[-1] > words:
        half = table.shape[-1] // 2
        table = table[..., :half] ^ table[..., half:]
    return table


def possible_partners(n: np.ndarray, comp: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For places of ``left`` the places of ``right`` in other components that the bound leaves possible, where there are any."""
    tables = _tables(bits)
    own = {int(i): table[k] for at, table in tables.values() for k, i in enumerate(at)}
    within = np.zeros(len(n), bool)
    within[right] = True
    # Where both sides are one block, each pair is looked at once.
    same = np.array_equal(left, right)
    sides = [(at[within[at]], table[within[at]]) for at, table in tables.values()]
    for i in left.tolist():
        found = []
        for at, table in sides:
            # Linked sets of sizes p <= q have 100 p >= percent q, and differ in at most (100 - percent) / (100 + percent) of p + q elements.
            low, high = np.minimum(n[at], n[i]), np.maximum(n[at], n[i])
            fit = (comp[at] != comp[i]) & (100 * low >= percent * high)
            fit = np.flatnonzero(fit & (at > i) if same else fit)
            if not len(fit):
                continue
            words = min(table.shape[1], len(own[i]))
            differ = np.bitwise_count(_folded(table[fit], words) ^ _folded(own[i], words)).sum(axis=1, dtype=np.int64)
            found.append(at[fit[(100 + percent) * differ <= (100 - percent) * (n[at[fit]] + n[i])]])
        near = np.concatenate(found) if found else np.empty(0, np.int64)
        if len(near):
            yield i, near


def _cells(where: DataFrame, elements: int | None = None) -> DataFrame:
    """Buckets of several components as pairs of blocks (``lower``, ``upper``); ``blk`` is the one that a row is in.

    In a large bucket the members of its largest component, which needs no comparison within, have blocks of their own: they
    meet the others only, so a group of near copies that is joined already is not copied once for each of its blocks. With
    ``elements``, blocks also hold so many of them on average; ``where`` has them as ``n`` then.
    """
    count = F.count("*") if elements is None else F.greatest(F.count("*"), F.ceil(F.sum("n") * F.lit(BLOCK / elements)))
    sizes = where.groupBy("key", "comp").agg(count.alias("rows"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("most"), F.sum("rows").alias("all")).filter("most.rows < all")
    rows = where.join(sizes.hint("merge"), "key")
    large = F.col("all") > BLOCK
    major = large & (F.col("comp") == F.col("most.comp"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    minors, majors = blocks(F.when(large, F.col("all") - F.col("most.rows")).otherwise(F.col("all"))), blocks(F.col("most.rows"))
    rows = rows.withColumns({"minors": minors, "majors": majors, "hash": F.xxhash64("node"), "major": major})
    rows = rows.withColumn("blk", F.when(major, -1 - F.pmod("hash", "majors")).otherwise(F.pmod("hash", "minors")).cast("int"))
    pair = lambda lower, upper: F.struct(lower.cast("int").alias("lower"), upper.cast("int").alias("upper"))
    each = F.sequence(F.lit(0), F.col("minors") - 1)
    own = F.transform(each, lambda i: pair(F.least(F.col("blk"), i), F.greatest(F.col("blk"), i)))
    cross = F.when(large, F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: pair(F.col("blk"), -1 - j))).otherwise(F.slice(own, 1, 0))
    cells = F.when(F.col("major"), F.transform(each, lambda i: pair(i, F.col("blk")))).otherwise(F.concat(own, cross))
    return rows.select("key", "node", "comp", "blk", F.explode(cells).alias("cell")).select("key", "node", "comp", "blk", "cell.lower", "cell.upper")


def _possible(percent: int):
    """The classes of a pair of blocks that have a possible pair there."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        names, n, comp, left, right = _sides(key, table)
        marked = np.zeros(len(n), bool)
        for i, near in possible_partners(n, comp, table["bits"].to_pylist(), left, right, percent):
            marked[i] = True
            marked[near] = True
        return pa.table({"key": pa.array([key[0].as_py()] * int(marked.sum()), pa.int64()), "node": names[marked]})

    return work


def _sides(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, sizes and components of the members of a pair of blocks, and the places of those on either side."""
    blk = table["blk"].to_numpy()
    comp = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
    return table["node"].to_numpy(), table["n"].to_numpy(), comp, np.flatnonzero(blk == key[1].as_py()), np.flatnonzero(blk == key[2].as_py())


def decided_links(n: np.ndarray, comp: np.ndarray, partners: Iterator[tuple[int, np.ndarray]], sets: list[np.ndarray], slots: np.ndarray, band: int, percent: int) -> list[tuple[int, int]]:
    """The links among possible ``partners`` that join components; pairs that share an earlier band are left to that one.

    Elements are numbered in the block, so what a set shares with all its partners is counted at once.
    """
    root, out = list(range(int(comp.max(initial=-1)) + 1)), []
    ends = np.cumsum([0, *map(len, sets)])
    names, code = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    own = np.zeros(len(names), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, near in partners:
        near = near[~(slots[near, :band] == slots[i, :band]).all(axis=2).any(axis=1)]
        p = find(comp[i])
        near = near[[find(c) != p for c in comp[near].tolist()]] if len(near) else near
        if not len(near):
            continue
        mine = code[ends[i] : ends[i + 1]]
        own[mine] = True
        shared = np.add.reduceat(own[np.concatenate([code[ends[j] : ends[j + 1]] for j in near.tolist()])], np.cumsum([0, *n[near[:-1]]]), dtype=np.int64)
        own[mine] = False
        for j in near[100 * shared >= percent * (n[i] + n[near] - shared)].tolist():
            p, q = find(comp[i]), find(comp[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((i, j))
    return out


def _decided(percent: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        names, n, comp, left, right = _sides(key, table)
        partners = possible_partners(n, comp, table["bits"].to_pylist(), left, right, percent)
        sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
        slots = np.frombuffer(b"".join(table["slots"].to_pylist()), "<u2").reshape(-1, BANDS, ROWS)
        links = decided_links(n, comp, partners, sets, slots, key[0].as_py() & (BANDS - 1), percent)
        return pa.table({"a": names[np.array([i for i, _ in links], np.int64)], "b": names[np.array([j for _, j in links], np.int64)]})

    return work


def _elements(width: int):
    """Texts as the bytes of their sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.record_batch([part.column(0), pa.array([shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["node", "elements"])

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Every row of ``docs`` (all columns) with ``n_shingles``, ``component_id`` and ``kept``.

    Two texts are linked if 100 x shared shingles >= ``percent`` x all their shingles.
    ``component_id`` is the smallest identifier reachable over links, ``kept`` marks one row
    of each component, the one with that identifier. Texts of fewer than ``width`` words
    are one shingle. Null and empty texts and texts without words have no shingles, are
    linked with nothing and stay. Of rows that share the smallest identifier one is kept.
    Null identifiers come last. Very long texts are compared whole. An empty table gives an
    empty result. Columns may have any names; those called like the added ones, in any case, are replaced.
    """
    own = Columns(docs, ("n_shingles", "component_id", "kept"))
    found = _near(own.table, own.at(id_col), own.at(text_col), width, percent)
    return found.select(*own.own(), "n_shingles", "component_id", "kept")


def _near(table: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    ship(table.sparkSession)
    if percent < 75:
        raise ValueError("the bands are set for similarities of 0.75 and more")
    carried = table.columns
    source = table.select(F.col(text_col).alias("text"), *[c for c in carried if c != text_col])
    schema = source.schema[:].add("cls", "binary").add("n", "long").add("slots", "binary").add("bits", "binary")
    table = source.mapInArrow(lambda it: _sketch(it, width), schema).withColumn("row", F.monotonically_increasing_id())
    table = written(table, "near-rows")
    order = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("row").alias("row"))
    # A class is a node from here on, named by one of its rows.
    classes = table.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("slots").alias("slots"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.min("row").alias("node"), F.min(order).alias("best"))
    classes = written(classes, "near-classes")
    # Joins from here on merge: Spark sizes a table by its compressed file, without what an explode adds, and would collect on the driver what it so takes for small.

    banded = classes.select("node", "slots", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    piece = F.expr(f"substring(slots, band * {2 * ROWS} + 1, {2 * ROWS})")
    # The last bits of a key are its band.
    keys = banded.select("node", F.xxhash64("band", piece).bitwiseAND(F.lit(-BANDS)).bitwiseOR(F.col("band")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    buckets = written(keys.join(shared.hint("merge"), "key"), "near-buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = written(table.select(F.col("row").alias("node"), "text").join(need.hint("merge"), "node"), "near-texts")
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        checked = both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, width, percent), "a long, b long, linked boolean")
        out = written(checked, "near-pairs")
        release(texts)
        return out

    def components(links: DataFrame) -> DataFrame:
        found = connected_components(links, "a", "b").select("node", F.col("component").alias("comp"))
        return written(found, "near-components")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components after links between components a and b: only components are joined, not members."""
        over = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        known = comp.unionByName(over.select(F.col("comp").alias("node"), "comp").join(comp.select("node").hint("merge"), "node", "left_anti"))
        new = known.join(over.hint("merge"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        return written(new, "near-components")

    def placed(members: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
        c = comp.select(F.col("node").alias(node), F.col("comp").alias("c"))
        return members.join(c.hint("merge"), node, "left").withColumn(name, F.coalesce("c", node)).drop("c")

    # First one pivot a class, then the pivots of all its buckets that this hasn't joined.
    pairs = buckets.filter("pivot != node").groupBy("node").agg(F.min("pivot").alias("a")).select("a", F.col("node").alias("b"))
    done = verified(pairs)
    comp = components(done.filter("linked"))
    star = buckets.filter("pivot != node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = placed(placed(star, comp, "a", "ca"), comp, "b", "cb").filter("ca != cb")
    star = written(star.join(done.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "near-stars")
    if not star.isEmpty():
        more = verified(star.select("a", "b"))
        links = star.join(more.filter("linked").hint("merge"), ["a", "b"], "left_semi")
        comp = joined(comp, links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    # Buckets that still hold several components are compared in blocks.
    where = written(placed(buckets.select("key", "node"), comp, "node", "comp"), "near-placed")
    held = classes.select("node", "n", "bits")
    cells = _cells(where).join(held.hint("merge"), "node").select("key", "lower", "upper", "blk", "node", "comp", "n", "bits")
    possible = written(cells.groupBy("key", "lower", "upper").applyInArrow(_possible(percent), "key long, node long").distinct(), "near-possible")
    if not possible.isEmpty():
        need = possible.select("node").distinct()
        texts = table.select(F.col("row").alias("node"), "text").join(need.hint("merge"), "node")
        sets = written(texts.mapInArrow(_elements(width), "node long, elements binary"), "near-sets")
        rest = where.join(possible.hint("merge"), ["key", "node"], "left_semi").join(classes.select("node", "n").hint("merge"), "node")
        whole = classes.select("node", "n", "bits", "slots").join(sets.hint("merge"), "node")
        cells = _cells(rest, ELEMENTS).join(whole.hint("merge"), "node").select("key", "lower", "upper", "blk", "node", "comp", "n", "bits", "slots", "elements")
        links = written(cells.groupBy("key", "lower", "upper").applyInArrow(_decided(percent), "a long, b long"), "near-links")
        release(sets)
        links = placed(placed(links, comp, "a", "ca"), comp, "b", "cb").filter("ca != cb")
        links = written(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "near-links")
        if not links.isEmpty():
            comp = joined(comp, links)

    # Components of several classes only; salted, for one may hold a third of all.
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    whole = classes.select("cls", "node", "best").join(comp.hint("merge"), "node").withColumn("salt", salt)
    best = whole.groupBy("comp").agg(F.min("best").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    label = whole.join(best.hint("merge"), ["comp", "salt"]).select("node", "least")
    label = classes.select("cls", "node", "best").join(label.hint("merge"), "node", "left").select("cls", F.coalesce("least", "best").alias("best"))
    out = table.join(label.hint("merge"), "cls", "left")
    alone = F.col("best").isNull()
    return out.select(
        *[F.col("text").alias(c) if c == text_col else F.col(c) for c in carried],
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col(id_col)).otherwise(F.col("best.id")).alias("component_id"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group of near duplicates, with the columns of ``docs``."""
    own = Columns(docs)
    return _near(own.table, own.at(id_col), own.at(text_col), width, percent).filter("kept").select(*own.all())
