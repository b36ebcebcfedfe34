"""Every operator on tables with odd rows and clashing names, and the SQL of those that have some."""

import duckdb
import pytest
from pyspark.sql import functions as F

from findling.llm import oracles, packing, queries
from findling.llm.exact_dedup import exact_dedup, unique_documents
from findling.llm.knn_quality import fit_neighbours, score_quality
from findling.llm.mixing import mix_sources, mixed_documents
from findling.llm.near_dedup import distinct_documents, near_duplicates
from findling.llm.pii import find_personal_data
from findling.llm.quality_rules import NEUTRAL, clean_documents, quality_rules
from findling.llm.secrets import find_secrets
from findling.llm.sharding import shuffle_into_shards
from findling.llm.url_filter import filter_urls

from ..test_queries import canon
from .conftest import CLASHES

#: Operator, the columns that it adds.
ADDING = {
    "op1": (mix_sources, ("size", "source_size", "target", "taken")),
    "op3": (lambda d: quality_rules(d, NEUTRAL), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "content_lines", "base_failed", "content_share", "kept")),
    "op4": (near_duplicates, ("n_shingles", "component_id", "kept")),
    "op5": (lambda d: shuffle_into_shards(d, 3), ("shard", "slot")),
    "op6": (find_personal_data, ("spans",)),
    "op7": (lambda d: find_secrets(d, queries.SECRET_RULES), ("secrets",)),
    "op8": (exact_dedup, ("keep_id", "group_size", "kept")),
    "op9": (lambda d: filter_urls(d, queries.URL_RULES, "text"), ("host", "path", "rule", "verdict", "pattern")),
    "op10": (lambda d: score_quality(d, fit_neighbours(["good text."], [1], 0.5)), ("score",)),
}
#: Operators that return some of the rows, or copies of them.
CHOOSING = {"op1": mixed_documents, "op3": lambda d: clean_documents(d, NEUTRAL), "op4": distinct_documents, "op8": unique_documents}


@pytest.fixture(scope="module")
def clashing(odd):
    plain = odd.drop("kept", "size")
    return plain.filter("doc_id IS NULL OR doc_id <> 7").withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("op", ADDING)
def test_names_clash_with_none(clashing, op):
    run, added = ADDING[op]
    out = run(clashing)
    kept = [c for c in clashing.columns if c.lower() not in added]
    assert out.columns == [*kept, *added]
    rows = out.collect()
    assert len(rows) == clashing.count()
    own = [c for c in kept if c in CLASHES]
    assert all(r[kept.index(c)] == f"own {c}" for r in rows for c in own)
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows) == sorted((repr(r["doc_id"]), repr(r["text"])) for r in clashing.collect())
    assert run(clashing.limit(0)).columns == out.columns and run(clashing.limit(0)).count() == 0


@pytest.mark.parametrize("op", CHOOSING)
def test_chosen_rows_keep_their_columns(clashing, op):
    out = CHOOSING[op](clashing)
    assert out.columns == clashing.columns
    assert all(r[out.columns.index(c)] == f"own {c}" for r in out.collect() for c in CLASHES)
    assert CHOOSING[op](clashing.limit(0)).count() == 0


def test_pieces_of_clashing_columns(clashing):
    carry = tuple(c for c in CLASHES if c not in packing.PIECE)
    pieces = packing.tokenise_pieces(clashing, queries.word_tokenizer(), 64, carry=carry)
    rows = packing.pack_pieces(pieces, 64).collect()
    assert len(rows) == pieces.count() and all(r[c] == f"own {c}" for r in rows for c in carry)


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(oracles.ORACLES[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(map(canon, r))) for r in got.select(*cols).collect()) == sorted(repr(tuple(canon(r[i]) for i in order)) for r in want.fetchall())
