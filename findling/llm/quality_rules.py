"""Quality rules with a line labeller.

Counts of the text decide first. What passes is labelled line by line: Viterbi decoding of
a linear-chain conditional random field marks each line content or boilerplate, and
the share of words in content lines decides whether the document stays.

The field is trained here, on a bounded sample of labelled documents. Labels of lines are
distant ones: a line of a document of low quality is boilerplate if lines with the same
features stand in such documents more than twice as often as in others, and so is a short
line that many documents of the sample hold word for word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import REMEMBERED, Columns
from findling.session import ship

#: Labelled documents of each quality that the field is trained on.
SAMPLE = 1500
#: Characters and lines of a text beyond which the training doesn't draw it.
SAMPLE_CHARS, SAMPLE_LINES = 20_000, 400
#: Share of words in content lines from which a document stays.
LEAST_CONTENT = 0.5
#: Words whose hash a worker remembers.
MEMO = 500_000
#: Documents of the sample that must hold a short line for it to be boilerplate, and its most words.
SPREAD, SHORT = 20, 20
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = (
    "bias", "some symbols", "symbols", "many symbols", "bars", "marks", "capitals", "digits", "long words", "short words",
    "one word", "few words", "many words", "no stop", "repeated", "notice", "link",
)
_NOTICE = re.compile(r"licen[sc]e|copyright|rights reserved|cookie|subscribe|click here|terms of|privacy", re.I)
_LINK = re.compile(r"https?://|www\.", re.I)
_DIGIT = re.compile(r"[0-9]")
_ASIDE = str.maketrans("", "", SYMBOLS)


@dataclass(frozen=True)
class LineField:
    """Weights of a chain over (boilerplate, content)."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # from x to
    start: np.ndarray  # 2

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of a document's lines; 1 is content, also in ties."""
        e = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            p0, p1 = (0, 1) if a + m00 > b + m10 else (1, 0), (0, 1) if a + m01 > b + m11 else (1, 0)
            back.append((p0[0], p1[0]))
            a, b = max(a + m00, b + m10) + e0, max(a + m01, b + m11) + e1
        label = int(b >= a)
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return np.array(out[::-1], dtype=np.int8)


#: Keeps every line; what a field without training data is.
NEUTRAL = LineField(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that hold a word, and their numbers of words."""
    rows, words, seen = [], [], set()
    for line in lines:
        body = line.strip(SPACE)
        if not body:
            continue
        n = len(line.encode().split())
        chars = len(body)
        symbols = (chars - len(body.translate(_ASIDE))) / chars
        per = (chars - n + 1) / n
        rows.append((
            1, 0 < symbols <= 0.03, 0.03 < symbols <= 0.12, symbols > 0.12, 4 * body.count("|") > n, 4 * body.count("!") > n, body.isupper(), 5 * len(_DIGIT.findall(body)) > chars, per > 14, per < 3,
            n == 1, n < 5, n > 25, body[-1] not in ".!?:;\"')»”", body in seen, bool(_NOTICE.search(body)), bool(_LINK.search(body)),
        ))
        words.append(n)
        seen.add(body)
    x = np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))
    return x, np.array(words, dtype=np.int64)


def train_line_field(texts: list[str], good: list[bool], rounds: int = 80, l2: float = 1.0) -> LineField:
    """Maximum likelihood by gradient ascent with a step size for each weight."""
    spread = Counter(line for t in texts for line in {s.strip(SPACE) for s in t.split("\n")} if line)
    xs, bodies, words = [], [], []
    for t in texts:
        x, n = line_features(t.split("\n"))
        xs.append(x)
        words.append(n)
        bodies.append([s for s in (line.strip(SPACE) for line in t.split("\n")) if s])
    inside = {True: Counter(), False: Counter()}
    for x, g in zip(xs, good, strict=True):
        inside[g].update(row.tobytes() for row in x)
    ys = []
    for x, n, body, g in zip(xs, words, bodies, good, strict=True):
        shared = np.array([spread[s] >= SPREAD for s in body], dtype=bool) & (n <= SHORT)
        odd = np.array([not g and inside[False][r.tobytes()] > 2 * inside[True][r.tobytes()] for r in x], dtype=bool)
        ys.append((~shared & ~odd).astype(int))
    xs, ys = [x for x in xs if len(x)], [y for y in ys if len(y)]
    if not xs or len({int(v) for y in ys for v in set(y.tolist())}) < 2:
        return NEUTRAL
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    xs, ys = [xs[i] for i in order], [ys[i] for i in order]
    lengths = np.array([len(x) for x in xs])
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    x, y = np.concatenate(xs), np.concatenate(ys)
    alive = [int((lengths > t).sum()) for t in range(lengths[0])]  # documents with a line t are the first ones
    emit, move, start = np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)
    one = np.eye(2)[y]
    pair_seen = np.zeros((2, 2))
    for t in range(1, lengths[0]):
        np.add.at(pair_seen, (y[at[: alive[t]] + t - 1], y[at[: alive[t]] + t]), 1)
    emit_seen, start_seen = x.T @ one, one[at].sum(axis=0)
    steps = [np.zeros_like(w) for w in (emit, move, start)]
    for _ in range(rounds):
        e = x @ emit
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[at] = start + e[at]
        for t in range(1, lengths[0]):
            i = at[: alive[t]] + t
            f[i] = np.logaddexp(f[i - 1][:, :1] + move[0], f[i - 1][:, 1:] + move[1]) + e[i]
        for t in range(lengths[0] - 2, -1, -1):
            i = at[: alive[t + 1]] + t
            after = b[i + 1] + e[i + 1]
            b[i] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
        z = np.logaddexp(f[at, 0] + b[at, 0], f[at, 1] + b[at, 1])
        whole = np.repeat(z, lengths)[:, None]
        p = np.exp(f + b - whole)
        pair = np.zeros((2, 2))
        inner = np.concatenate([np.arange(a, a + n - 1) for a, n in zip(at, lengths, strict=True)]) if (lengths > 1).any() else np.empty(0, int)
        after = b[inner + 1] + e[inner + 1]
        for s in (0, 1):
            for d in (0, 1):
                pair[s, d] = np.exp(f[inner, s] + move[s, d] + after[:, d] - whole[inner, 0]).sum()
        grads = (emit_seen - x.T @ p - l2 * emit, pair_seen - pair - l2 * move, start_seen - p[at].sum(axis=0) - l2 * start)
        for w, g, h in zip((emit, move, start), grads, steps, strict=True):
            h += g * g
            w += 0.5 * g / np.sqrt(h + 1e-9)
    return LineField(emit, move, start)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", most_chars: int = SAMPLE_CHARS, most_lines: int = SAMPLE_LINES
) -> list[tuple[str, bool]]:
    """At most ``per_class`` texts of each quality, those with the smallest hash of the identifier.

    Only texts of at most ``most_chars`` characters and ``most_lines`` lines are drawn, so the sample and the training
    are bounded in bytes and steps; texts of all lengths are judged. Of several rows of an identifier the least text is
    taken, null counts as empty, so reruns agree. Identifiers without a text, and null ones, give nothing.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    known = known.filter((F.length("t") <= most_chars) & (F.length("t") - F.length(F.replace("t", F.lit("\n"))) < most_lines))
    picked = None
    for quality in (0, 1):
        part = labels.filter(F.col("quality") == quality).select(F.col(f"`{id_col}`").alias("id"), F.lit(quality).alias("quality")).distinct()
        part = part.join(known.select("id").hint("merge"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 x per_class identifiers, so broadcasting them is bounded.
    rows = known.join(F.broadcast(picked), "id").groupBy("id", "quality").agg(F.min("t").alias("t")).orderBy("id", "quality")
    return [(r["t"], r["quality"] == 1) for r in rows.collect()]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self) > MEMO:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHash()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc = acc * _STEP + h[i : i + n]
    order = np.argsort(acc, kind="stable")
    same = acc[order][1:] == acc[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None, field: LineField) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words in content lines, content lines."""
    text = text or ""
    words = text.encode().split()
    if not words:
        return (0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0, 0, 0)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(SPACE))
        else:
            seen.add(line)
    x, per_line = line_features(lines)
    content = field.decode(x) == 1
    return (len(words), len(text) - sum(text.count(c) for c in SPACE), sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), int(per_line[content].sum()), int(content.sum()))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "content_lines")


def _counted(own: Columns, field: LineField, text_col: str, least_words: int, most_repeated: int, least_content: float) -> DataFrame:
    """The table of ``own`` with counts, ``base_failed``, ``content_share`` and ``kept``."""
    ship(own.table.sparkSession)
    carried = own.table.columns
    text = carried.index(own.at(text_col))
    schema = own.table.schema[:]
    for name in _NAMES:
        schema = schema.add(name, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([measure(t.as_py(), field) for t in batch.column(text)], dtype=np.int64).reshape(-1, len(_NAMES))
            yield pa.record_batch([*batch.columns, *[pa.array(got[:, i]) for i in range(len(_NAMES))]], names=[*carried, *_NAMES])

    out = own.table.mapInArrow(count, schema)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("content_words") / F.greatest("n_words", F.lit(1))).otherwise(F.lit(0.0))
    return out.withColumns({"base_failed": failed, "content_share": share}).withColumn("kept", ~failed & (F.col("content_share") >= least_content))


def quality_rules(docs: DataFrame, field: LineField, text_col: str = "text", least_words: int = 20, most_repeated: int = 30, least_content: float = LEAST_CONTENT) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``content_share`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` per cent of
    them in repeated windows. ``kept``: not failed, and at least ``least_content`` of the
    words stand in content lines. Null and empty texts have no words and fail. Whole texts
    are read, however long. Nothing is compared between rows, so repeated rows and null
    identifiers are as any other. An empty table gives an empty result. Columns may have any names; those called like
    the added ones, in any case, are replaced.
    """
    added = (*_NAMES, "base_failed", "content_share", "kept")
    own = Columns(docs, added)
    return _counted(own, field, text_col, least_words, most_repeated, least_content).select(*own.own(), *added)


def clean_documents(docs: DataFrame, field: LineField, text_col: str = "text", least_words: int = 20, most_repeated: int = 30, least_content: float = LEAST_CONTENT) -> DataFrame:
    """The rows that :func:`quality_rules` keeps, with the columns of ``docs``."""
    own = Columns(docs)
    return _counted(own, field, text_col, least_words, most_repeated, least_content).filter("kept").select(*own.all())
