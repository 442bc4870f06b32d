"""Text rules on hand-written edge cases; expected values worked out by hand
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import papers as P
from papyra.schemas import RAW


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("A \\emph{bold} claim", "A claim"),
    ("energy $E=mc^2$ here", "energy here"),
    ("show $$x$$ now", "show x now"),                    # $...$ runs first, $$ rule never fires
    ("see http://a.b/c and https://x.y and www.z.org end", "see and and end"),
    ("mail me@example.com today", "mail today"),
    ("a b\t\tc\n d", "a b c d"),
    ("  padded  ", "padded"),
    (None, ""),
    ("awwwx y", "a y"),                                   # www matches inside words
    ("x @a b@ c@d", "x @a b@"),                           # only runs with an inner '@'
])
def test_clean_text(spark, raw, expected):
    assert one(spark, T.clean_text, raw) == expected


def test_strip_and_blank(spark):
    assert one(spark, T.strip, " \x1c a b 　") == "a b"
    assert one(spark, T.is_blank, " \t ") is True
    assert one(spark, T.is_blank, None) is True
    assert one(spark, T.is_blank, " x ") is False


@pytest.mark.parametrize("raw,expected", [
    ("cs.AI cs.LG cs.AI", ["cs.AI", "cs.LG"]),
    ("  math.CO\tMath.co ", ["math.CO", "Math.co"]),
    (None, []),
    ("", []),
])
def test_split_categories(spark, raw, expected):
    assert one(spark, T.split_categories, raw) == expected


def test_authors(spark):
    rows = [
        ([["Smith", "John"], ["Doe", ""], ["", "Ann"], ["Solo"], [" Lee ", " Kim "]], None,
         ["John Smith", "Doe", "Kim Lee"]),
        ([[f"L{i}", f"F{i}"] for i in range(12)], None, [f"F{i} L{i}" for i in range(10)]),
        ([["", ""], ["x"]], "A, B", []),                 # non-empty parsed list wins, even if all invalid
        (None, "Alice, Bob and Carol ,  , Dan", ["Alice", "Bob and Carol", "Dan"]),
        ([], "Eve", ["Eve"]),
        (None, None, []),
    ]
    df = spark.createDataFrame([(p, a) for p, a, _ in rows], "p array<array<string>>, a string")
    got = [r["y"] for r in df.select(T.parse_authors("p", "a").alias("y")).collect()]
    assert got == [e for _, _, e in rows]


@pytest.mark.parametrize("raw,expected", [
    ("2020-01-05", dt.datetime(2020, 1, 5)), ("2020-1-5", dt.datetime(2020, 1, 5)),
    ("2020-01-05T10:00:00", dt.datetime(2020, 1, 5)), ("bad", None), (None, None), ("", None),
])
def test_parse_date(spark, raw, expected):
    assert one(spark, T.parse_date, raw) == expected


@pytest.mark.parametrize("raw,extracted,valid", [
    ("0905.1234", "0905.1234", True),                        # four digits after the dot
    ("see 0905.1234 there", None, False),                    # only the whole text counts
    ("1912.00017v12", "1912.00017", True),                   # two-digit version
    ("arXiv:arXiv:1811.01001", "1811.01001", True),          # prefix twice
    ("hep-th/9901001v3", "hep-th/9901001", True),            # old style with version
    ("https://arxiv.org/abs/q-bio/0610017", "q-bio/0610017", True),
    ("12.3456", None, False), ("no digits", None, False), ("", None, False), (None, None, False),
])
def test_arxiv_ids(spark, raw, extracted, valid):
    got = one(spark, T.extract_arxiv_id, raw)
    assert got == extracted
    assert one(spark, T.validate_arxiv_id, got) is valid


def test_snippet_and_summary(spark):
    short = "Short abstract."
    assert one(spark, lambda c: T.snippet(c, None, 200), short) == short
    long_text = ("x" * 150) + ". " + ("y" * 100)
    assert one(spark, lambda c: T.snippet(c, None, 200), long_text) == ("x" * 150) + "."
    no_period = "z" * 250
    assert one(spark, lambda c: T.snippet(c, None, 200), no_period) == "z" * 200 + "..."
    early_period = "a." + "b" * 250                   # '.' before 70 % of the budget
    assert one(spark, lambda c: T.snippet(c, None, 200), early_period) == early_period[:200] + "..."
    assert one(spark, T.rule_summary, "One. Two two. Three. Four.") == "One. Two two. Three."
    assert one(spark, T.rule_summary, ("a" * 150) + ". " + ("b" * 60) + ".") == "a" * 150 + "."
    assert one(spark, T.rule_summary, ". lead") == "" + ". lead"          # blank first sentence -> fallback
    assert one(spark, T.rule_summary, "q" * 300) == "q" * 150 + "..."


@pytest.mark.parametrize("n,expected", [(0, "0B"), (1023, "1023.0 B"), (1024, "1.0 KB"),
                                        (1536, "1.5 KB"), (1088, "1.06 KB"), (5 * 1024 ** 3, "5.0 GB")])
def test_file_size(spark, n, expected):
    assert one(spark, T.format_file_size, n, "long") == expected


def test_formatters(spark):
    assert one(spark, T.format_authors, ["A", "B", "C", "D"], "array<string>") == "A, B, C, et al."
    assert one(spark, T.format_authors, [], "array<string>") == "Unknown authors"
    assert one(spark, T.format_categories, ["a", "b", "c", "d", "e"], "array<string>") == "a, b, c, +2 more"
    assert one(spark, T.format_categories, ["a"], "array<string>") == "a"
    assert one(spark, T.sanitize_filename, '..a<b>  c..') == "a_b__c"
    assert one(spark, T.sanitize_filename, ' a:b ') == "_a_b_"            # spaces become '_' first
    assert one(spark, T.display_text, "  a   b  " + "c" * 120) == ("a b " + "c" * 120)[:97] + "..."
    assert one(spark, T.score_band, 0.71, "double") == "High Match"
    assert one(spark, T.score_band, 7.5, "double") == "High Match"     # >1 is divided by 10
    assert one(spark, T.score_band, 0.5, "double") == "Fair Match"


def test_ingest_rules(spark):
    ok = "x" * 60
    rows = [
        ("1", "T", ok, "cs.AI", None, None, "2020-01-05", None, None, "J1"),
        ("", "T", ok, None, None, None, None, None, None, None),            # blank id
        (None, "T", ok, None, None, None, None, None, None, None),          # null id
        ("3", " ", ok, None, None, None, None, None, None, None),           # blank title
        ("4", "T", "y" * 49, None, None, None, None, None, None, None),     # 49 chars
        ("5", "T", "y" * 50, None, None, None, None, None, None, None),     # 50 chars
        ("6", "T", "y" * 2000, None, None, None, None, None, None, None),
        ("7", "T", "y" * 2001, None, None, None, None, None, None, None),
        ("8", "$x$", ok, None, None, None, None, None, None, None),         # title empty after cleaning: kept
    ]
    raw = spark.createDataFrame(rows, RAW)
    reasons = {r["id"]: r["reject_reason"] for r in P.with_reject_reason(raw).collect()}
    assert reasons == {"1": None, "": "missing_id", None: "missing_id", "3": "missing_title",
                       "4": "abstract_too_short", "5": None, "6": None, "7": "abstract_too_long", "8": None}
    papers = {r["id"]: r for r in P.build_papers(raw, language=None).collect()}
    assert papers["8"]["title"] == ""
    assert papers["1"]["journal_ref"] == "J1"
    assert papers["1"]["combined_text"] == "T. " + ok
    assert papers["1"]["word_count"] == 2
    counters = P.ingest_counters(raw, language=None).first()
    assert (counters["total"], counters["kept"], counters["skipped"]) == (9, 4, 5)
    empty = P.ingest_counters(raw.limit(0), language=None).first()
    assert empty["success_pct"] is None


def test_language_detection(spark):
    df = spark.createDataFrame([("The model and the data of this work are in the paper",),
                                ("Le modèle et les données de la thèse sont dans le texte",),
                                ("Der Text und die Daten sind nicht mit dem Modell",),
                                ("short",), ("zzz qqq vvv www xxx yyy",)], "t string")
    got = [r["d"] for r in df.select(P.detect_language(F.col("t")).alias("d")).collect()]
    assert got == ["en", "fr", "de", None, None]
    keep = [r["k"] for r in df.select(P.is_english(F.col("t")).alias("k")).collect()]
    assert keep == [True, False, False, True, True]
