from pyspark.sql import functions as F

import brute
from unitquarry.functions import text

CASES = [
    "createJWT", "JWTToken", "snake_case_name", "kebab-name.dotted", "a b", "résuméParser", "HTTPServer2Go",
    "x", "", "the fix for AnError in getUserByID", "one two　three", "v1Beta2C", "__private__", "naïve café É",
]


def test_split_identifier_and_tokenize_follow_the_rules(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    for row in df.select("s", text.split_identifier(F.col("s")).alias("p"), text.tokenize(F.col("s")).alias("t")).collect():
        assert row.p == brute.pieces(row.s), row.s
        assert row.t == brute.tokens(row.s), row.s


def test_capitals_stay_whole_and_stopwords_only_leave_text(spark):
    df = spark.createDataFrame([("createJWT", "theFix"), ("JWTToken", "an_Issue")], "a string, b string")
    rows = df.select(text.split_identifier(F.col("a")), text.split_identifier(F.col("b")), text.tokenize(F.col("b"))).collect()
    assert [list(r) for r in rows] == [[["create", "jwt"], ["the", "fix"], []], [["jwttoken"], ["an", "issue"], []]]


def test_body_cap_counts_after_filtering(spark):
    long = "the a " * 600 + "word " * 499 + "inside outside"
    [row] = spark.createDataFrame([(long,)], "s string").select(
        text.body_tokens(F.col("s"), text.BODY_TOKEN_CAP).alias("capped"), text.body_tokens(F.col("s")).alias("all")).collect()
    assert len(row.capped) == 500 and row.capped[-1] == "inside"
    assert len(row.all) == 501 and row.all[-1] == "outside"


def test_estimate_key_and_labels(spark):
    df = spark.createDataFrame([("12345", "f.ts", "go", "Box"), ("", "f.ts", "go", None), ("1234", "f.ts", "go", "")],
                               "code string, file string, name string, cls string")
    rows = df.select(
        text.token_estimate(F.col("code")), text.unit_key(F.col("file"), F.col("name")),
        text.unit_label(F.col("cls"), F.col("name")),
        text.embedding_text(F.col("cls"), F.col("name"), F.col("code"))).collect()
    assert [tuple(r) for r in rows] == [
        (2, "f.ts:go", "Box.go()", "Box.go\n12345"), (0, "f.ts:go", "go()", "go\n"), (1, "f.ts:go", "go()", "go\n1234")]
