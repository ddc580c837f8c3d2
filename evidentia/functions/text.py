"""Column functions over text: identifiers, normal forms, masks, URLs, scripts, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, in the subset of the syntax that Java and RE2 read alike.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PHONE = r"\+?[0-9][0-9 ()-]{7,14}[0-9]"
URL = r"https?://[A-Za-z0-9./?=_%&:#~-]+"
PATTERNS = {"email": EMAIL, "ip": IPV4, "url": URL}
#: Review categories and their words. Fixed values.
LEXICON = {"insult": ("idiot", "moron", "stupid", "loser", "clown"), "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting")}


def found(text: Column, kind: str) -> Column:
    """All identifiers of one kind, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def canonical_phone(text: Column) -> Column:
    """The last ten digits, if there are ten."""
    d = digits(text)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def normal_key(text: Column) -> Column:
    """Lower case, single blanks, nothing but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def script(text: Column) -> Column:
    """Script with most characters of Latin, Devanagari, Cyrillic, Arabic; ties to the first."""
    names = ("Latin", "Devanagari", "Cyrillic", "Arabic")
    counts = [F.length(F.regexp_replace(text, rf"[^\p{{Is{n}}}]", "")) for n in names]
    best = F.greatest(*counts)
    out = F.lit("none")
    for n, c in reversed(list(zip(names, counts, strict=True))):
        out = F.when((c == best) & (best > 0), n).otherwise(out)
    return out


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def redact(text: Column) -> Column:
    """Identifiers replaced by their kind."""
    for kind in ("url", "email", "ip"):
        text = F.regexp_replace(text, PATTERNS[kind], f"[{kind.upper()}]")
    return text


def pseudonym(value: Column, kind: str, salt: str = "case") -> Column:
    return F.concat(F.lit(f"{kind.upper()}-"), F.substring(F.upper(F.sha2(F.concat(F.lit(salt), value), 256)), 1, 8))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def words_of(text: Column) -> Column:
    """The different words of a text, a-z only; for flagged()."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "), " "))


def flagged(words: Column, category: str) -> Column:
    """How many words of the category's list are among words."""
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in LEXICON[category]])))
