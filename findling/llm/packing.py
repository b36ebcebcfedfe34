"""Packing token pieces into sequences, shortest pack first.

Documents are tokenised and cut into pieces of at most the capacity. The histogram of
piece lengths (at most one bin per length, so bounded by the capacity) is packed on
the driver: lengths go from longest to shortest, each into the pattern with the most
room left, and packs with the same content are one pattern with a count. Patterns are
then joined back to the pieces by each piece's rank among those of its length. Ranks
are counts per range of a hash plus a place in the range, so a length that a third of
all pieces have is ranked in many tasks.
"""

from __future__ import annotations

import math
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findling.llm.common import REMEMBERED, Columns
from findling.session import ship
from findling.storage import written

#: Words whose ids a worker remembers in each of two generations; a full one replaces the older. None is
#: longer than REMEMBERED bytes, so a generation has less than 400 MB, whatever the texts.
MEMO = 800_000
#: Longer words are looked up alone, in parts of about so many characters where a probe shows that the tokenizer parts them.
PART = 1 << 15
#: Characters after which, and before which, a long word may be cut.
CUT_AFTER, CUT_BEFORE = "0123456789\u3002\uff0c\u3001\uff1b", "0123456789a-zA-Z\u4e00-\u9fff"
#: Texts, and their characters, that go through the tokenizer together.
TEXTS, CHARACTERS = 256, 1_000_000
#: Marks that end a word and are cut off before the rest is looked up.
ENDS = b".,;:!?*#$%&"
#: Pieces of all lengths that share a range of the hash, on average, and the most ranges.
RANGE_ROWS, MAX_RANGES = 500, 1 << 16
_MEMO: dict[str, _Ids] = {}
_CUT = re.compile(f"(?<=[{CUT_AFTER}])(?=[{CUT_BEFORE}])")


class _Memory:
    """Two generations of what is known."""

    def __init__(self):
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > MEMO:
            self.new, self.old = {}, self.new

    def missing(self, keys: set[bytes]) -> list[bytes]:
        out = []
        for k in keys.difference(self.new):
            ids = self.old.get(k)
            if ids is None:
                out.append(k)
            else:
                self.new[k] = ids
        return out


class _Ids:
    """Ids of whole texts by one tokenizer, word by word where that gives the same.

    Where the tokenizer drops white space and never merges across it, the ids of a text are
    those of its words in turn; words repeat, so most come from memory. A probe at load tells if it does: every pair of
    kinds of characters around every kind of white space must give the ids of its parts. Other tokenizers get whole
    texts. Where it lowers letters itself, ASCII letters are lowered first, and where it parts letters from
    marks, so are the marks at the end of a word: fewer different words remain. What is new goes
    through the tokenizer together, kept apart by one of its special tokens, which it
    cuts out before anything else. Tests compare with the ids of whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        self.words = _Memory()
        self.special = {v.content.encode(): i for i, v in t.get_added_tokens_decoder().items()}
        self.begins = {s[:1] for s in self.special}
        self.mark = next(iter(self.special), b"")
        self.lowers = t.normalizer is not None and t.normalizer.normalize_str("A") == "a"
        self.parts_marks = t.pre_tokenizer is not None and len(t.pre_tokenizer.pre_tokenize_str("ab,")) == 2
        self.by_word = self._probe()
        self.cuts = self._probe_cuts()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _probe(self) -> bool:
        sides = ("a", "Zz", "\u00e9", "e\u0301", "\u0301", "7", "'s", "'", ",", "-.", "\u4e2d", "\u0627", "\U0001d4b3", "\u00a0", "<", "_")
        alone = {s: self._whole(s) for s in sides}
        texts = [(a, space, b) for a in sides for b in sides for space in (" ", "  ", "\t", "\n", "\r\n", "\x0b\x0c")]
        got = self.tokenizer.encode_batch_fast([" " + "".join(p) + "\n" for p in texts], add_special_tokens=False)
        return all(g.ids == alone[a] + alone[b] for g, (a, _, b) in zip(got, texts, strict=True))

    def _probe_cuts(self) -> bool:
        """If every character to cut after ends a token before each kind of character to cut before."""
        befores = ("7", "a", "Q", "s", "\u4e2d", "\u6587")
        return all(self._whole(f"b{x}{y}c") == self._whole(f"b{x}") + self._whole(f"{y}c") for x in CUT_AFTER for y in befores)

    def _long(self, word: str) -> bytes:
        """The ids of a long word; a run of letters without a place to cut is tokenised whole."""
        if not self.cuts or len(word) <= PART or any(s.decode() in word for s in self.special):
            parts = [word]
        else:
            ends, parts, begin = [m.start() for m in _CUT.finditer(word)] + [len(word)], [], 0
            for a, b in zip(ends, [*ends[1:], None], strict=True):
                if b is None or b - begin > PART:
                    parts.append(word[begin:a])
                    begin = a
        return b"".join(np.array(self._whole(p), dtype="<u4").tobytes() for p in parts)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(g.ids, dtype="<u4").tobytes() for g in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lists, odd = [], False
        for text in texts:
            data = text.encode()
            low = data.lower() if self.lowers else data
            if any(c in low for c in self.begins) and any(s in low for s in self.special):
                low, odd = data, True
            lists.append(low.split())
        self.words.turn()
        new = self.words.missing(set().union(*lists))
        long = [w for w in new if len(w) > REMEMBERED]
        if long:
            new = [w for w in new if len(w) <= REMEMBERED]
        if new:
            self._learn(new, odd)
        known = self.words.new
        # Known for as long as these texts take.
        known.update((w, self._long(w.decode())) for w in long)
        out = [b"".join(map(known.__getitem__, words)) for words in lists]
        for w in long:
            del known[w]
        return out

    def _learn(self, new: list[bytes], odd: bool) -> None:
        """Words with marks at their end from what stands before and the marks, which are words too."""
        cuts, plain, needed = [], [], set()
        for w in new:
            core = w.rstrip(ENDS) if self.parts_marks else w
            if len(core) < len(w) and (core.isalpha() or core.decode().isalpha()):
                end = w[len(core) :]
                cuts.append((w, core, end))
                needed.add(core)
                needed.add(end)
            else:
                plain.append(w)
        needed.difference_update(plain)
        self._encode(plain + self.words.missing(needed), odd)
        known = self.words.new
        for w, core, end in cuts:
            known[w] = known[core] + known[end]

    def _encode(self, parts: list[bytes], odd: bool) -> None:
        apart = [p for p in parts if any(s in p for s in self.special)] if odd or not self.mark else []
        alone = set(apart if self.mark else parts)
        plain = [p for p in parts if p not in alone] if alone else parts
        groups = [plain[i : i + 50] for i in range(0, len(plain), 50)]
        for some, got in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.special[self.mark]).tolist()
            if len(ends) + 1 != len(some):
                raise ValueError("the tokenizer didn't keep its special token apart")
            data = ids.tobytes()
            for p, a, b in zip(some, [0, *(4 * e + 4 for e in ends)], [*(4 * e for e in ends), len(data)], strict=True):
                self.words.new[p] = data[a:b]
        for p in alone:
            self.words.new[p] = np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()


PIECE = ("start", "length", "doc_tokens", "ids")


def _pieces(path: str, capacity: int, end_id: int, carried: list[str]):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _MEMO.get(path) or _MEMO.setdefault(path, _Ids(path))
        for batch in batches:
            row, start, length, total, ids, held = [], [], [], [], [], 0

            def flush():
                keys = batch.select(carried).take(pa.array(row, pa.int64())).columns  # noqa: B023
                return pa.record_batch([*keys, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=[*carried, *PIECE])  # noqa: B023

            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                some = min(TEXTS, max(1, int(np.searchsorted(ends, before + CHARACTERS, "right")) - first))
                texts = [t or "" for t in batch.column(batch.num_columns - 1).slice(first, some).to_pylist()]
                for i, got in enumerate(encode(texts), first):
                    whole = got + tail
                    n = len(whole) // 4
                    for a in range(0, n, capacity):
                        part = whole[4 * a : 4 * (a + capacity)]
                        row.append(i)
                        start.append(a)
                        length.append(len(part) // 4)
                        total.append(n)
                        ids.append(part)
                        held += len(part)
                first += some
                if held > 8_000_000:
                    yield flush()
                    row, start, length, total, ids, held = [], [], [], [], [], 0
            yield flush()

    return cut


def tokenise_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """The token ids of each document and ``end_id``, cut into pieces of at most ``capacity``.

    Returns ``id_col``, the columns of ``carry``, ``start`` (ids before the piece), ``length``, ``doc_tokens`` and
    ``ids`` (little-endian unsigned 32-bit). Null and empty texts have only ``end_id``. A
    very long text gives full pieces and a rest; null and repeated identifiers and repeated rows are carried. An empty
    table gives an empty result. Columns of ``docs`` may have any names; a carried one called like an added one, in any
    case, is an error, for one of the two would be lost.
    """
    ship(docs.sparkSession)
    own = Columns(docs)
    carried = [own.at(c) for c in dict.fromkeys([id_col, *carry])]
    if clash := {own.named(c).lower() for c in carried} & set(PIECE):
        raise ValueError(f"rename the columns {sorted(clash)}, pieces have columns of these names")
    source = own.table.select(*carried, F.col(own.at(text_col)).alias("text"))
    schema = source.schema[:-1].add("start", "long").add("length", "long").add("doc_tokens", "long").add("ids", "binary")
    pieces = source.mapInArrow(_pieces(tokenizer_path, capacity, end_id, carried), schema)
    return pieces.select(*[F.col(c).alias(own.named(c)) for c in carried], *PIECE)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, count) that hold every piece of ``histogram`` once.

    Shortest pack first: each length, from the longest, goes to the open patterns with the
    fewest tokens. Patterns split where a length has fewer pieces than the pattern has packs.
    """
    full, open_by_used = [], defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length <= 0 or length > capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            used = min((u for u in open_by_used if u + length <= capacity), default=None)
            if used is None:
                lengths, count = [], left
            else:
                lengths, count = open_by_used[used].pop()
                if count > left:
                    open_by_used[used].append((lengths, count - left))
                if not open_by_used[used]:
                    del open_by_used[used]
            n = min(left, count)
            grown = ([*lengths, length], n)
            total = (used or 0) + length
            (full if total == capacity else open_by_used[total]).append(grown)
            left -= n
    return full + [p for used in sorted(open_by_used) for p in open_by_used[used]]


def pack_pieces(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence holds over ``capacity``.

    Offsets in a sequence are gapless from 0. Pieces of equal length are ranked by a hash
    of ``order_cols``; pieces equal in them may change places. Other columns are carried, nulls, repeated rows and any
    names included; those called ``sequence_id`` or ``offset``, in any case, are replaced.
    A length that is null, below 1 or above ``capacity`` is an error. Empty in, empty out.
    """
    spark = pieces.sparkSession
    own = Columns(pieces, ("sequence_id", "offset"))
    length, order = own.at(length_col), [own.at(c) for c in order_cols]
    held = written(own.table, "pieces")
    n = held.count()
    ranges = min(MAX_RANGES, max(1, math.ceil(n / RANGE_ROWS)))
    keyed = held.select(*dict.fromkeys([*own.kept, length, *order])).withColumn("key", F.xxhash64(F.lit(17), *order)).withColumn("range", F.pmod("key", F.lit(ranges)).cast("int"))
    cells = keyed.groupBy(length, "range").agg(F.count("*").alias("n"))
    # At most `capacity` rows come to the driver, whatever the input.
    histogram = {r[length]: r["n"] for r in cells.groupBy(length).agg(F.sum("n").alias("n")).collect()}
    if None in histogram:
        raise ValueError("a piece has no length")
    taken: dict[int, int] = defaultdict(int)
    sequence, lines = 0, []
    for lengths, count in pack_histogram(histogram, capacity):
        at = 0
        for one in lengths:
            lines.append((one, taken[one], taken[one] + count, sequence, at))
            taken[one] += count
            at += one
        sequence += count
    by_length = defaultdict(list)
    for one, *line in lines:
        by_length[one].append(line)
    slots = [(k, [x[1] for x in v], [x[0] for x in v], [x[2] for x in v], [x[3] for x in v]) for k, v in by_length.items()]
    # One row a length; the splits of patterns are bounded by the lengths too, not by the pieces.
    slots = spark.createDataFrame(slots, f"{length} long, ends array<long>, begins array<long>, bases array<long>, offsets array<long>")
    upto = Window.partitionBy(length).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(length, "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy(length, "range").orderBy("key", *order)
    # Cells grow with the pieces, so their join merges.
    ranked = keyed.withColumn("nth", F.row_number().over(inside) - 1).join(cells.hint("merge"), [length, "range"])
    ranked = ranked.join(F.broadcast(slots), length).withColumn("rank", F.col("before") + F.col("nth"))
    at = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = ranked.withColumn("at", at).withColumns({"sequence": F.get("bases", F.col("at")) + F.col("rank") - F.get("begins", F.col("at")), "begin": F.get("offsets", F.col("at"))})
    return placed.select(*own.own(), F.col("sequence").alias("sequence_id"), F.col("begin").alias("offset"))
