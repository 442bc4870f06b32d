"""Language profiles of character trigrams."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import language as L
from papyra.operators import papers as P

SYLLABLES = {"de": ["schen", "ung", "ich", "ein", "keit", "ver"], "en": ["the", "ing", "tion", "er", "wh", "and"],
             "es": ["cion", "que", "los", "ado", "ez", "aja"]}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60))]
        out.append((i, " ".join(words), lang))
    return out


def test_held_out_agreement(spark):
    df = spark.createDataFrame(texts(900, 1), "id int, text string, lang string")
    profile = L.fit(df.where("id < 600"), "text", "lang")
    assert profile.languages == ("de", "en", "es") and len(profile.weights[0]) == L.BUCKETS
    got = df.where("id >= 600").select((L.detect("text", profile) == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok"))
    assert got.first()[0] > 0.98
    odd = spark.createDataFrame([("",), (None,), ("ab",), ("the",)], "text string")
    assert [r[0] for r in odd.select(L.detect("text", profile)).collect()][:3] == [None, None, None]
    none = L.fit(df.limit(0), "text", "lang")
    assert none.languages == () and df.limit(1).select(L.detect("text", none)).first()[0] is None


def test_language_filter_of_other_codes(spark):
    data = texts(300, 2)
    raw = spark.createDataFrame([(str(i), f"title {i}", t + " " + t, "cs.AI", lang) for i, t, lang in data],
                                "id string, title string, abstract string, categories string, lang string")
    profile = L.fit(raw, "abstract", "lang")
    flagged = P.with_reject_reason(raw, "es", profile=profile)
    rows = flagged.where("reject_reason IS NULL OR reject_reason = 'other_language'").collect()
    right = sum((r.reject_reason is None) == (r.lang == "es") for r in rows)
    assert right > 0.98 * len(rows) > 200
    german = P.with_reject_reason(raw.limit(1).withColumn("abstract", F.lit("der Hund und die Katze sind nicht von hier " * 3)), "de")
    assert german.first().reject_reason is None
    with pytest.raises(ValueError, match="no test for language 'xx'"):
        P.with_reject_reason(raw, "xx")
