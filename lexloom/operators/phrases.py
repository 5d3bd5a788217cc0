"""Phrases of any number found in texts, as an equality join of word n-grams with a phrase table.

A pattern of alternatives grows with the phrases and is tried at every character. Here a text gives its n-grams of the
lengths that phrases have, and each meets its phrase by equality: the table may have millions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, marks, digits and inner apostrophes make a word.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"


def phrase_words(text: Column) -> Column:
    """Words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def phrase_hits(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str) -> DataFrame:
    """(key, phrase_id, n, first_at): how often each phrase stands in each text, and the word it first begins at, from 0.

    Phrases and texts are compared word by word in lower case, whatever stands between the words. Phrases without words
    and null texts have no hits; phrases of equal words each count; rows that share a key count together. What moves is
    one row per n-gram of a length that phrases have; their lengths, a few small numbers, come to the driver.
    """
    table = phrases.select(F.col(phrase_id), phrase_words(F.col(phrase)).alias("_w")).where(F.size("_w") > 0)
    table = table.select(phrase_id, F.size("_w").alias("_n"), F.array_join("_w", " ").alias("_gram"))
    lengths = sorted(r["_n"] for r in table.select("_n").distinct().collect())
    worded = df.select(key, phrase_words(F.col(text)).alias("_w"))

    def grams(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_w", i + 1, F.lit(n)), " ").alias("gram")))

    none = F.array().cast("array<struct<at:int,gram:string>>")
    found = worded.select(key, F.explode(F.concat(none, *(grams(n) for n in lengths))).alias("_g"))
    met = found.select(key, F.col("_g.at").alias("_at"), F.col("_g.gram").alias("_gram")).join(table, "_gram")
    return met.groupBy(key, phrase_id).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first_at"))


def phrase_issues(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(key, rule, message) per worn phrase of a text, as the prose lint words it."""
    hits = phrase_hits(df, key, text, phrases.select(F.col(phrase).alias("_phrase")).distinct(), "_phrase", "_phrase")
    message = F.concat(F.lit('uses the worn phrase "'), "_phrase", F.lit('"'))
    return hits.select(key, F.lit("banned-phrase").alias("rule"), message.alias("message"))
