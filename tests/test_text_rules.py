"""Text functions on values worked out by hand from the rules."""

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.udfs import locate_quote


def values(spark, rows, expr, schema):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(expr).collect()]


def test_token_estimates(spark):
    rows = [("你好世界",), ("abcd",), ("abcde",), ("你a",), ("",), ("한글",), ("カナ！",), ("豈abcd",), (None,)]
    assert values(spark, rows, tx.estimate_tokens(F.col("t")), "t string") == [4, 1, 2, 2, 0, 1, 3, 2, 0]


def test_token_truncation(spark):
    rows = [("abcdefgh", 3), ("abcdefghijklmnop", 3), ("你好世界人", 3), ("aaaaaaaa\nbbbbbb", 3), ("a\nbbbbbbbbbbbbbbbbbbb", 1), ("你ab", 3), (None, 3), ("abc", 0), ("ab   cd", 1)]
    assert values(spark, rows, tx.truncate_to_tokens(F.col("t"), F.col("n")), "t string, n int") == ["abcdefgh", "abcdefghijkl", "你好世", "aaaaaaaa", "a\nbb", "你ab", "", "", "ab"]


def test_quote_places(spark):
    text = "a\n  brown\n"
    rows = [(text, " brown "), ("the quick brown fox", "quick   brown"), ("the quick, brown fox", "ＱＵＩＣＫ-brown"), ("first\nthe quick brown fox\nlast", "thx quick brown fox"), ("the quick brown fox", "nothing like it"), (text, "  ")]
    got = values(spark, rows, locate_quote(F.col("c"), F.col("q"), F.lit(100).cast("long"), F.lit(130).cast("long")), "c string, q string")
    assert [(r.start, r.end, r.quote, r.found) for r in got] == [(104, 109, "brown", True), (100, 130, "quick   brown", True), (100, 130, "ＱＵＩＣＫ-brown", True), (100, 130, "thx quick brown fox", True), (100, 130, "nothing like it", False), (100, 130, None, False)]


def test_sentence_windows(spark):
    rows = [("One. Two. Three.", "Two"), ("One. Two. Three.", "Three"), ("One. Two. Three.", "missing"), (None, "x"), ("甲。乙！丙", None), ("A; B; C; D", "D"), ("甲；乙；丙", "丙"), ("no end\n\nnext\t", "next")]
    assert values(spark, rows, tx.sentence_window(F.col("t"), F.col("a")), "t string, a string") == ["One.Two.Three.", "Two.Three.", "One.Two.", "", "甲。乙！", "C;D", "乙；丙", "no endnext"]


def test_previews_skip_blank_texts(spark):
    rows = [("\n", " a  b\tc "), ("\t \n", None), (None, None), ("q", "x")]
    assert values(spark, rows, tx.preview(F.col("q"), F.col("c")), "q string, c string") == ["a b c", "", "", "q"]


def test_types_and_enums(spark):
    assert values(spark, [(["A"], []), (["A", "B"], ["B"]), (["A"], ["C"]), ([], [])], tx.types_compatible(F.col("a"), F.col("b")), "a array<string>, b array<string>") == [True, True, False, True]
    assert values(spark, [(" Positive ",), ("neg",), ("other",), ("POS",)], tx.canonical(F.col("t"), ("positive", "negative"), {"pos": "positive", "neg": "negative"}), "t string") == ["positive", "negative", None, "positive"]


def test_quotes_keep_line_ends(spark, tmp_path):
    """The SQL of quote_localisation takes blanks only off a quote."""
    import duckdb

    from lodestone.plans.queries import ORACLE_SQL, QUERIES

    rows = [(1, 0, "Tion thea or rendon of.\nEnndre a thntatin this."), (2, 4, "Lee.\nTionchelle onierre, epaellele"), (3, 1, "one two three four five six")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["quote_localisation"](spark, str(tmp_path)).collect())) == sorted(c.sql(ORACLE_SQL["quote_localisation"]).fetchall())


def test_a_long_text_is_split_once(spark):
    """The anchor is worked out once a text, not once a sentence: 20,000 sentences took the square of that."""
    import time

    text = "Some words here. " * 20000 + "The last one."
    df = spark.createDataFrame([(text,)], "t string").select(tx.sentence_window(F.col("t"), F.split_part("t", F.lit(" "), F.lit(60002))).alias("w"))
    began = time.time()
    assert df.first().w == "Some words here.The last one." and time.time() - began < 60
