import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findling.functions import urls
from findling.operators import governance as gov
from findling.operators import text as op


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


@given(st.text(alphabet="ab. \n", max_size=200), st.integers(5, 40), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_recursive_chunks_keep_every_letter_in_order(text, size, overlap):
    got = op.recursive_chunks(text, size, overlap)
    letters = [c for c in text if c in "ab"]
    if overlap == 0:
        assert [c for c in "".join(got) if c in "ab"] == letters


def test_recursive_chunks_by_hand():
    assert op.recursive_chunks("aaaa. bbbb. cccc", 6, 0) == ["aaaa", "bbbb", "cccc"]
    assert op.recursive_chunks("abcdef", 4, 0) == ["abcd", "ef"]
    assert op.join_with_overlap(["aaaa", "bbbb"], 6, 1) == ["aaaa", "a bbbb"]
    assert op.join_with_overlap([], 6, 1) == []
    # The sentence of 43 characters, twice: pieces are filled up by words, joined again by a space while they fit.
    text = "This is a test text to be split into chunks" * 2
    assert op.recursive_chunks(text, 20, 0) == ["This is a test text", "to be split into", "chunksThis is a", "test text to be", "split into chunks"]
    # Paragraphs first; only the one that is too long goes to the finer separators. A piece keeps its separator while
    # pieces are filled up ("three " and "four " are 11), and what that leaves behind the last word is joined to it.
    assert op.recursive_chunks("one two\n\nthree four five six", 10, 0) == ["one two", "three", "four five", "six\n "]
    # A new chunk starts with the tail of the one before, unless that makes it too long.
    assert op.join_with_overlap(["aaaa", "bb", "cccccc"], 7, 2) == ["aaaa bb", "cccccc"]
    assert op.join_with_overlap(["aaaa", "bbb", "cccc"], 8, 2) == ["aaaa bbb", "bb cccc"]


def test_places_by_hand():
    """Each search begins one past the last start, or the overlap before the last end, whichever is later; what isn't found stays there."""
    assert op.locate_chunks("abcabcabc", ["abc", "abc", "abc"], 0) == [(0, 3), (3, 6), (6, 9)]
    assert op.locate_chunks("abcabcabc", ["abcab", "abca"], 2) == [(0, 5), (3, 7)]
    assert op.locate_chunks("aaaa", ["aa", "aa"], 5) == [(0, 2), (1, 3)]
    assert op.locate_chunks("ab cd", ["ab", "xx", "cd"], 0) == [(0, 2), (2, 4), (4, 6)]


def test_fixed_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2345))
    rows = op.fixed_windows(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x")], "doc_id long, text string"), 100, 30).orderBy("doc_id", "chunk_no").collect()
    own = [r for r in rows if r["doc_id"] == 1]
    assert all(r["content"] == text[r["start"] : r["end"]] for r in own) and own[-1]["end"] == 2345
    assert "".join(r["content"][: 70 if i < len(own) - 1 else None] for i, r in enumerate(own)) == text
    assert [r["content"] for r in rows if r["doc_id"] != 1] == ["x"]
    with pytest.raises(ValueError):
        op.fixed_windows(spark.range(1).withColumn("text", F.lit("a")), 10, 10)


def test_strip_controls_keeps_white_space(spark):
    assert one(spark, op.strip_controls(F.col("x")), x="a\x00b\tc\nd\re\x1f") == "ab\tc\nd\re"


@pytest.mark.parametrize(("path", "want"), [("a.prop", "v"), ("a.b.arr[1]", "2"), ("a.b.sub[0].name", "n"), ("a.nope", ""), ("a['prop']", "v")])
def test_json_value(spark, path, want):
    assert one(spark, gov.json_value(F.col("x"), path), x='{"a": {"prop": "v", "b": {"arr": [1, 2], "sub": [{"name": "n"}]}}}') == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://a.com/x", True), ("ftp://a.com", False), ("http://192.168.0.1", False), ("http://10.0.0.1/x", False), ("http://127.0.0.1:80", True), ("http://0.0.0.0", True), ("http://8.8.8.8", True), ("http://10.0.0.1000", True), ("http://user@172.16.0.1", False), ("https://random", True), ("http://123", True), ("mailto://www.a.com", False), ("nope", False), (None, False)],
)
def test_valid_url(spark, url, want):
    assert one(spark, urls.is_valid(F.col("x")), x=url) is want


def test_url_forms(spark):
    assert one(spark, urls.normalise(F.col("x")), x=" a.com/ ") == "https://a.com"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://m.youtube.com/shorts/abcdefghijk?x=1", "abcdefghijk"), ("youtu.be/abc_efgh-jk", "abc_efgh-jk"), ("https://music.youtube.com/watch?a=1&a=2&v=abcdefghijk&v=zz", "abcdefghijk"),
        ("http://www.youtube.com/live/abcdefghijk", "abcdefghijk"), ("youtube.com/abcdefghijk", "abcdefghijk"), ("https://youtube.com/embed/abcdefghijkl#t", "abcdefghijk"),
        ("https://example.com/watch?v=abcdefghijk", None), ("https://youtube.com/watch?v=short", None), ("ftp://youtu.be/abcdefghijk", None), ("https://youtu.be/abcdefghijk and", None), ("", None), (None, None),
    ],
)
def test_youtube_id(spark, url, want):
    assert one(spark, urls.youtube_id(F.col("x")), x=url) == want


def test_redaction_fails_closed_and_names_kinds(spark):
    got = one(spark, gov.redact(F.col("x")), x="mail a.b@c.org, call +1 (555) 123-4567, ip 10.1.2.3, card 4111 1111 1111 1111")
    assert got == "mail <EMAIL_ADDRESS>, call <PHONE_NUMBER>, ip <IP_ADDRESS>, card <CREDIT_CARD>"


WALLETS = ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4")
IBANS = ("GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606")


def test_checks_tell_planted_errors(spark):
    """Each identifier is found, and stays where one character is wrong."""
    for kind, good in (("<CRYPTO_WALLET>", WALLETS), ("<IBAN>", IBANS), ("<CREDIT_CARD>", ("4111 1111 1111 1111", "378282246310005")), ("<IP_ADDRESS>", ("10.1.2.255",))):
        for v in good:
            middle = len(v) // 2 + (v[len(v) // 2] == " ")
            wrong = v[:middle] + next(c for c in ("2", "3", "a", "Z") if c.lower() != v[middle].lower() and (c.isdigit() or not v.isdigit())) + v[middle + 1 :] if kind != "<IP_ADDRESS>" else "10.1.2.256"
            assert one(spark, gov.redact(F.col("x")), x=f"it is {v}, or {wrong}.") == f"it is {kind}, or {wrong}."
    found = one(spark, gov.detect(F.col("x")), x=" ".join([*WALLETS, *IBANS, "DE00370400440532013000", "111111111111111111111111111111"]))
    assert (tuple(found["CRYPTO_WALLET"]), tuple(found["IBAN_CODE"])) == (WALLETS, IBANS)


def test_redaction_of_long_runs(spark):
    for text in ("a@" + "b." * 200_000 + "c", "x" * 300_000 + "@", "1 " * 200_000, "A" * 300_000):
        got = one(spark, gov.redact(F.col("x")), x=text)
        assert got == ("<EMAIL_ADDRESS>" if text.startswith("a@") else text)


def test_intent_defaults(spark):
    assert tuple(one(spark, op.parse_intent(F.col("x")), x="x")) == ("FACTUAL", 0.5)
    assert tuple(one(spark, op.parse_intent(F.col("x")), x='<think>{"intent": "RESEARCH"}</think>{"intent": "code", "confidence": 3}')) == ("CODE_GENERATION", 1.0)


def test_router(spark):
    assert one(spark, op.route(F.col("x")), x="Compare the relationship between all themes") == "GRAPH"
    assert one(spark, op.route(F.col("x")), x="Define and explain step by step") == "VECTOR"
    assert one(spark, op.route(F.col("x")), x="hello") == "HYBRID"


def test_header(spark):
    args = (F.col("t"), F.col("p"), F.col("s"))
    assert one(spark, op.header(*args, prefix="q: "), t="T", p="", s="link://https://x") == "q: <document_metadata>\nsourceDocument: T\nsource: https://x\n</document_metadata>\n\n"
    assert one(spark, op.header(*args), t="", p=None, s="file://x") == ""


@pytest.mark.parametrize("strategy", ["sentence", "paragraph"])
def test_split_texts_holds_few_texts(spark, strategy):
    """A batch of many texts comes back in parts of a few, with the same chunks."""
    rows = spark.createDataFrame([(i, f"One {i}. Two.\n\nThree! " * 60) for i in range(1000)], "doc_id long, text string").coalesce(1)
    found = op.split_texts(rows, strategy, 1000, 200)
    assert found.groupBy("doc_id").count().filter("count > 0").count() == 1000
    given = pa.record_batch([pa.array(range(1000)), pa.array([f"One {i}. Two." for i in range(1000)])], names=["doc_id", "text"])
    parts = list(op.chunk_batches(iter([given]), lambda text: [text], 200))
    assert [p.num_rows for p in parts] == [op.TEXTS] * (1000 // op.TEXTS) + [1000 % op.TEXTS]
    assert pa.Table.from_batches(parts)["doc_id"].to_pylist() == list(range(1000))
