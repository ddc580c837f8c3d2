"""Normal forms of identifiers and names, checks of their validity, and texts made comparable. Nulls stay null unless stated."""

from __future__ import annotations

import hashlib
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# First digits of the numeral blocks that count as digits (eleven scripts), and full-width digits.
DIGIT_BLOCKS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660, 0x06F0, 0xFF10)
# Characters that scanners confuse.
OCR_TO_DIGIT = ("OoQIl|iZSsBGb", "0001111255866")
OCR_TO_LETTER = ("015826", "OISBZG")
LEET = ("013457$@!", "oleastsai")
HONORIFICS = ("mr", "mrs", "ms", "shri", "smt", "sri", "dr", "sh", "kumari", "km", "alias", "urf", "s/o", "d/o", "w/o")
TITLES = r"(?i)^(?:(?:Mr|Mrs|Ms|Miss|Dr|Shri|Smt|Sri|Sh|Late|Kumari|Km)\.?\s+)+"
#: State and district, series, number; or the country-wide series.
REGISTRATION = "^(?:[A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{1,4}|[0-9]{2}BH[0-9]{4}[A-Z]{1,2})$"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """Lower case; all but a-z and 0-9 is one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def any_script_key(text: Column) -> Column:
    """Lower case letters, digits and combining marks of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]", "")


def safe_name(text: Column, most: int = 120) -> Column:
    """Usable as a file name: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.left(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit(most))


def ascii_digits(text: Column) -> Column:
    """Digits of other scripts as 0-9; the length stays."""
    return F.translate(text, "".join(chr(b + i) for b in DIGIT_BLOCKS for i in range(10)), "0123456789" * len(DIGIT_BLOCKS))


def ocr_digits(text: Column) -> Column:
    return F.translate(text, *OCR_TO_DIGIT)


def ocr_letters(text: Column) -> Column:
    return F.translate(text, *OCR_TO_LETTER)


def mobile(text: Column) -> Column:
    """Ten digits that begin with 6 to 9, without trunk and country prefixes; empty if it is no mobile number."""
    d = F.regexp_replace(ascii_digits(text), "[^0-9]", "")
    n, cut = F.length(d), lambda k: F.substring(d, k + 1, 20)
    d = F.when((n == 14) & d.startswith("0091"), cut(4)).when((n == 13) & d.startswith("091"), cut(3)).when((n == 12) & d.startswith("91"), cut(2)).when((n == 11) & d.startswith("0"), cut(1)).otherwise(d)
    return F.when(d.rlike("^[6-9][0-9]{9}$"), d).otherwise("")


def international(text: Column) -> Column:
    """+91 and the mobile number; empty if it is none. Double prefixes are not taken off."""
    d = F.regexp_replace(ascii_digits(text), "[^0-9]", "")
    n = F.length(d)
    d = F.when((n == 12) & d.startswith("91"), F.substring(d, 3, 20)).when((n == 11) & d.startswith("0"), F.substring(d, 2, 20)).otherwise(d)
    return F.when(d.rlike("^[6-9][0-9]{9}$"), F.concat(F.lit("+91"), d)).otherwise("")


def last_ten(text: Column) -> Column:
    d = F.regexp_replace(ascii_digits(text), "[^0-9]", "")
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise("")


def plate(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def plate_valid(text: Column) -> Column:
    return plate(text).rlike(REGISTRATION)


def _verhoeff() -> tuple[list[int], list[int]]:
    """Tables of the check digit: products in the dihedral group of ten elements, and powers of its permutation (158036427)(...)."""
    product = [(j + k) % 5 if j < 5 and k < 5 else 5 + (j + k) % 5 if j < 5 else 5 + (j - k) % 5 if k < 5 else (j - k) % 5 for j in range(10) for k in range(10)]
    step, powers, now = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [], list(range(10))
    for _ in range(8):
        powers += now
        now = [step[x] for x in now]
    return product, powers


def verhoeff_ok(text: Column) -> Column:
    """Twelve digits whose last is the check digit of the others."""
    product, powers = (F.array(*[F.lit(x) for x in t]) for t in _verhoeff())
    digits = F.reverse(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""))
    fits = F.coalesce(text.rlike("^[0-9]{12}$"), F.lit(False))
    numbered = F.transform(digits, lambda c, i: F.get(powers, (i % 8) * 10 + F.when(fits, c).otherwise("0").cast("int")))
    return fits & (F.aggregate(numbered, F.lit(0), lambda acc, x: F.get(product, acc * 10 + x)) == 0)


def handle_key(text: Column) -> Column:
    """Letters alone, after look-alike characters are read as letters."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *LEET), "[^a-z]", "")


def display_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\u0900-\\u097F]", "")


def without_titles(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), TITLES, "")


def person_key(text: Column) -> Column:
    """The name without titles, in lower case, with single blanks for all but letters, digits and Indic marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(without_titles(text)), r"[^\p{L}\p{N}_ऀ-෿؀-ۿ ]", " "), " +", " "))


def name_tokens(text: Column) -> Column:
    """Words without accents, punctuation and honorifics, sorted."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9\\s]", " "), "\\s+", " ")), " ")
    return F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*HONORIFICS)))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Letters without their accents."""
    return text.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).casefold())


def listed(kind: Column, value: Column) -> Column:
    """The form in which entries of a watch-list are compared, by kind."""
    v = F.trim(F.coalesce(value, F.lit("")))
    d = F.regexp_replace(v, "[^0-9]", "")
    phone = F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise(d)
    return F.when(kind == "phone", phone).when(kind == "vehicle", plate(v)).when(kind == "account", F.upper(F.regexp_replace(v, "[\\s-]", ""))).when(kind == "email", F.lower(v)).when(kind == "name", F.array_join(name_tokens(v), " ")).otherwise(F.trim(fold(F.regexp_replace(v, "\\s+", " "))))


def term(kind: Column, value: Column) -> Column:
    """The form in which watched terms of posts are compared, by kind."""
    v = F.trim(F.coalesce(value, F.lit("")))
    d = F.regexp_replace(v, "[^0-9]", "")
    phone = F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise(d)
    return F.when(kind == "handle", F.lower(F.regexp_replace(v, "^@+", ""))).when(kind == "hashtag", F.lower(F.regexp_replace(v, "^#+", ""))).when(kind == "phone", phone).when(kind == "url", url_key(v)).otherwise(F.lower(v))


def url_domain(url: Column) -> Column:
    """Host without scheme, user, port and leading www."""
    rest = F.regexp_replace(F.regexp_replace(url, "[.,;:!?)\"']+$", ""), "^(?i:https?)://", "")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", "")), "^www\\.", "")


def url_key(url: Column) -> Column:
    """Domain and lower-case path, without the slashes at the end."""
    rest = F.regexp_replace(F.regexp_replace(url, "[.,;:!?)]+$", ""), "^(?i:https?://)?(?i:www\\.)?[^/?#]+", "")
    return F.concat(url_domain(url), F.lower(F.regexp_replace(rest, "/+$", "")))


def plain_quotes(text: Column) -> Column:
    """Straight quotes, no invisible characters, runs of four equal characters and more cut to two, single blanks."""
    t = F.translate(F.coalesce(text, F.lit("")), "’‘“”", "''\"\"")
    t = F.regexp_replace(t, "[\\u200b\\u200c\\u200d\\u2060\\ufeff]", "")
    return F.regexp_replace(F.regexp_replace(t, "(.)\\1{3,}", "$1$1"), "[ \\t\\r\\f\\x0b]+", " ")


def words(text: Column) -> Column:
    """Lower-case words without links, mentions, tags, repost marks and punctuation."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+|www\.\S+|@[\p{L}\p{N}_]+|#[\p{L}\p{N}_]+|\brt\b\s*:?|[^\p{L}\p{N}_\sऀ-ॿ]", " ")
    return F.filter(F.split(t, "\\s+"), lambda w: w != "")


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct runs of k words; all words of a shorter text; none of an empty one."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - k, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, k), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def snippet(text: Column, needle: Column, width: int = 70) -> Column:
    """The first occurrence in either case with width characters on both sides; the beginning if there is none."""
    t = F.coalesce(text, F.lit(""))
    i = F.instr(F.lower(t), F.lower(needle)) - 1
    a, b = F.greatest(F.lit(0), i - width), F.least(F.length(t), i + F.length(needle) + width)
    some = F.concat(F.when(a > 0, "…").otherwise(""), F.substr(t, (a + 1).cast("int"), (b - a).cast("int")), F.when(b < F.length(t), "…").otherwise(""))
    return F.when(i < 0, F.left(t, F.lit(2 * width))).otherwise(some)


def ratio(a: str | None, b: str | None) -> float:
    """Share of matching characters after Ratcliff and Obershelp; 0 if either is empty."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def names_match(a: Column, b: Column, threshold: float = 0.88) -> Column:
    """Equal sorted tokens, or two tokens and more on either side that are similar enough."""
    ta, tb = name_tokens(a), name_tokens(b)
    na, nb = F.array_join(ta, " "), F.array_join(tb, " ")
    some = (F.size(ta) > 0) & (F.size(tb) > 0)
    return some & ((na == nb) | (F.size(ta) >= 2) & (F.size(tb) >= 2) & (similarity(na, nb) >= threshold))


def base58_payload(address: str) -> bytes | None:
    """25 bytes whose last four are the checksum of the others; none if the address isn't valid."""
    number = 0
    for c in address:
        digit = BASE58.find(c)
        if digit < 0:
            return None
        number = number * 58 + digit
    if number.bit_length() > 200:
        return None
    raw, zeros = number.to_bytes(25, "big"), len(address) - len(address.lstrip("1"))
    check = hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4]
    return raw if check == raw[-4:] and raw[:zeros] == bytes(zeros) else None


@F.pandas_udf(StringType())
def wallet_chain(address: pd.Series) -> pd.Series:
    """Chain of an address; null if it is none or its checksum is wrong."""

    def one(a):
        if not a:
            return None
        if a.startswith("0x") and len(a) == 42:
            return "Ethereum-style (0x)"
        if a.startswith("bc1"):
            return "Bitcoin (bech32)"
        raw = base58_payload(a)
        return None if raw is None else "Bitcoin" if raw[0] in (0, 5) else "TRON (USDT-TRC20 style)" if raw[0] == 0x41 else None

    return address.map(one)


def role_class(text: Column) -> Column:
    """Role of a person by words of its label, the first rule that fits; empty if it says nothing of this person."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", "_"))
    t = F.regexp_replace(t, "^_+|_+$", "")
    has = lambda *w: t.rlike("|".join(w))
    out = F.when((t == "") | has("unknown", "description", "vehicle") | t.isin("named_person", "person", "other", "officer"), "")
    for words_, role in ((("father_of", "relative", "mother_of"), "complainant_relative"), (("accused", "offender", "perpetrator", "arrested", "absconding"), "accused"), (("suspect",), "suspect"), (("victim",), "victim"), (("complainant", "informant"), "complainant"), (("witness",), "witness")):
        out = out.when(has(*words_), role)
    return out.otherwise("")


def parse_day(text: Column) -> Column:
    """A date written year first, or day first with slashes or dashes; null if it is none."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(t, F.lit(10)), "yyyy-MM-dd")), F.when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"), F.try_to_date(F.regexp_replace(t, "-", "/"), "d/M/yyyy")))


def deadline_state(due: Column, status: Column, today: Column) -> Column:
    left = F.datediff(due, today)
    return F.when(status.isin("done", "waived"), status).when(left < 0, "overdue").when(left <= 7, "at_risk").otherwise("on_track")


def saturated(x: Column, scale: float) -> Column:
    return 1.0 - F.exp(-F.greatest(x, F.lit(0.0)) / scale)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def valid_point(lat: Column, lon: Column) -> Column:
    """A position on earth other than the origin."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))
