"""Every word and phrase that keeps a capitalised pair whole, from the checks' own list."""

from pyspark.sql import functions as F

from catalog import expected as X
from ticketveil.functions.redaction import DEFAULT_TERMS, truncate_names


def shortened(spark, pairs):
    df = spark.createDataFrame([(f"met {p} today",) for p in pairs], "t string")
    return [p for p, r in zip(pairs, df.select(truncate_names(F.col("t")).alias("t")).collect()) if r.t != f"met {p} today"]


def test_each_word_in_either_place(spark):
    words = [w.capitalize() for w in (*X.WORDS, *X.NAMES) if len(w) > 1]
    assert shortened(spark, [f"{w} Jones" for w in words] + [f"Jones {w}" for w in words]) == []


def test_each_phrase(spark):
    assert shortened(spark, [p.title() for p in X.PHRASES]) == []


def test_names_of_people_are_shortened(spark):
    people = ["Caleb Franklin", "Andrew Stone", "Jeremy Murray", "Mary Jones"]
    assert shortened(spark, people) == people


def test_business_terms_stay(spark):
    kept = ["Cisco Catalyst", "Niagara Tower", "Unified Metro", "Verizon Metro", "Microsoft Corp", "Linux Ubuntu"]
    assert shortened(spark, kept) == []


def test_no_word_is_missing_or_added():
    assert set(DEFAULT_TERMS.words) == {*X.WORDS, *X.NAMES} and set(DEFAULT_TERMS.phrases) == set(X.PHRASES)
