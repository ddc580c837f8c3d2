"""Word by word translation with a glossary. It is an aid to reading, shown with its coverage, and no translation to rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is never translated: addresses, links, numbers with their signs, words with a digit.
PROTECTED = r"^(?:https?://.*|www\..*|[^\s@]+@[^\s@]+|.*\p{N}.*)$"
#: Most entries of a glossary that is sent to every task; a larger one is joined by shuffling words.
SENT = 50_000


def tokens(text: Column) -> Column:
    """Words, and what is between them, in turns."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://\S+|[^\s@]+@[^\s@]+\.\w+|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def translated(docs: DataFrame, glossary: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, text, words, known, coverage. glossary: lang, word (lower case), meaning; of several meanings the first in the alphabet.

    Words that are not listed stay as they are. Protected words count neither as words nor as known. coverage is null without words.
    Keys are unique. Different words meet the glossary once each; a text is put together from a map of its own words.
    """
    t = docs.select(key, F.col(lang).alias("lang"), tokens(F.col(text)).alias("tokens"))
    word = lambda x: x.rlike(r"^[\p{L}\p{M}_]") & ~x.rlike(PROTECTED)
    own = t.select(key, "lang", F.explode(F.array_distinct(F.transform(F.filter("tokens", word), F.lower))).alias("word"))
    g = glossary.groupBy("lang", "word").agg(F.min("meaning").alias("meaning"))
    size = g.limit(SENT + 1).count()
    found = own.join(F.broadcast(g) if size <= SENT else g, ["lang", "word"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "meaning"))).alias("m"))
    j = t.join(found, key, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    words = F.filter("tokens", word)
    out = F.array_join(F.transform("tokens", lambda x: F.when(word(x), F.coalesce(F.try_element_at("m", F.lower(x)), x)).otherwise(x)), "")
    n, k = F.size(words), F.size(F.filter(words, lambda x: F.map_contains_key("m", F.lower(x))))
    return j.select(key, out.alias("text"), n.cast("long").alias("words"), k.cast("long").alias("known"), F.try_divide(k, n).alias("coverage"))
