"""Words of Indian scripts and of Urdu in Latin letters, as they sound, and keys by which spellings of one sound are equal."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# First code point of each script's block of 128; all blocks have one order of letters.
BLOCKS = {"deva": 0x0900, "beng": 0x0980, "guru": 0x0A00, "gujr": 0x0A80, "orya": 0x0B00, "taml": 0x0B80, "telu": 0x0C00, "knda": 0x0C80, "mlym": 0x0D00}
# Sounds in the order of the code points. Consonants from U+0915 and U+0958, vowels from U+0905, vowel signs from U+093E.
CONSONANTS = "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l zh v sh sh s h".split()
DOTTED = "q kh g z r rh f y".split()
VOWELS = "a a i i u u ri l e e e ai o o o au".split()
SIGNS = "a i i u u ri - e e e ai o o o au".split()
# Letters whose place in the block misleads.
OTHERWISE = {"য": "ज", "ৎ": "त", "ৰ": "र", "ৱ": "व", "ൺ": "ण्", "ൻ": "न्", "ർ": "र्", "ൽ": "ल्", "ൾ": "ळ्", "ൿ": "क्", "ஃ": "ः", "ੰ": "ं"}
# Letters of Urdu. The letters of v, y and e are consonants or vowels by their place.
URDU = {
    **dict(zip("ب پ ت ٹ ث ج چ ح خ د ڈ ذ ر ڑ ز ژ س ش ص ض ط ظ غ ف ق ک ك گ ل م ن ں ہ ه ة ۃ".split(), "b p t t s j ch h kh d d z r r z zh s sh s z t z gh f q k k g l m n n h h h h".split(), strict=True)),
}
URDU_VOWELS = {"ا": "a", "آ": "a", "أ": "a", "إ": "i", "ع": "a", "ئ": "i", "ے": "e", "ۓ": "e", "َ": "a", "ِ": "i", "ُ": "u"}
URDU_SILENT = "ءًٌٍّْٰ"
# Names whose usual spelling differs from their sound.
NAMES = {
    "सिंह": "Singh", "सिंग": "Singh", "कुमार": "Kumar", "शर्मा": "Sharma", "वर्मा": "Verma", "गुप्ता": "Gupta", "गुप्त": "Gupta", "यादव": "Yadav",
    "पांडेय": "Pandey", "पांडे": "Pandey", "पाण्डेय": "Pandey", "मिश्रा": "Mishra", "मिश्र": "Mishra", "अग्रवाल": "Agarwal", "अग्रवाला": "Agarwal", "राजपूत": "Rajput",
    "चौहान": "Chauhan", "चौधरी": "Chaudhary", "ठाकुर": "Thakur", "तिवारी": "Tiwari", "त्रिपाठी": "Tripathi", "दुबे": "Dubey", "जोशी": "Joshi",
    "पटेल": "Patel", "पाटील": "Patil", "शिंदे": "Shinde", "जाधव": "Jadhav", "पवार": "Pawar", "देशमुख": "Deshmukh", "कुलकर्णी": "Kulkarni",
    "गायकवाड": "Gaikwad", "मोरे": "More", "भोसले": "Bhosale", "कांबळे": "Kamble", "खान": "Khan", "अहमद": "Ahmad", "अली": "Ali",
    "हुसैन": "Hussain", "शेख": "Sheikh", "मोहम्मद": "Mohammad", "मुहम्मद": "Mohammad", "श्रीवास्तव": "Srivastava", "सक्सेना": "Saxena",
    "कपूर": "Kapoor", "मल्होत्रा": "Malhotra", "सिन्हा": "Sinha", "झा": "Jha", "राव": "Rao", "रेड्डी": "Reddy", "नायर": "Nair", "देवी": "Devi",
    "प्रसाद": "Prasad", "रामप्रसाद": "Ramprasad", "राम": "Ram", "श्याम": "Shyam", "कृष्ण": "Krishna", "लाल": "Lal", "चंद": "Chand", "चंद्र": "Chandra",
    "नाथ": "Nath", "दास": "Das", "घोष": "Ghosh", "बनर्जी": "Banerjee", "मुखर्जी": "Mukherjee", "चटर्जी": "Chatterjee", "बोस": "Bose", "सेन": "Sen",
    "राहुल": "Rahul", "अमित": "Amit", "सुनील": "Sunil", "अनिल": "Anil", "विनोद": "Vinod", "रमेश": "Ramesh", "सुरेश": "Suresh", "महेश": "Mahesh",
    "संजय": "Sanjay", "अजय": "Ajay", "विजय": "Vijay", "विक्रम": "Vikram", "आलोक": "Alok", "अशोक": "Ashok", "कमला": "Kamla", "सुनीता": "Sunita",
    "अनिता": "Anita", "श्रीमती": "Smt.", "श्री": "Shri", "कुमारी": "Kumari", "पुत्र": "S/o", "पुत्री": "D/o",
}

_SOUND = {0x0915 + i: c for i, c in enumerate(CONSONANTS)} | {0x0958 + i: c for i, c in enumerate(DOTTED)} | {0x090C: "l"}
_VOWEL = {0x0905 + i: v for i, v in enumerate(VOWELS) if i != 7}
_SIGN = {0x093E + i: v for i, v in enumerate(SIGNS) if v != "-"}
_HALT, _DOT, _DOUBLE = "्", "़", "ੱ"
_set = lambda codes: "[" + "".join(map(chr, codes)) + "]"
_LETTERS = _set(_SOUND)
#: One sounding unit: consonants joined by the halt sign and what follows them, a vowel of its own, or any other character.
_UNIT = re.compile(f"(?P<c>{_LETTERS}(?:{_HALT}{_LETTERS})*)(?:(?P<halt>{_HALT})|(?P<sign>{_set(_SIGN)}))?(?P<n>[ंँः]*)|(?P<v>{_set(_VOWEL)})(?P<m>[ंँः]*)|(?P<x>.)", re.S)
_STOPS = {"k": ("g", "g"), "ch": ("s", "j"), "t": ("d", "d"), "p": ("b", "b")}  # Tamil: after a vowel, after a nasal


def _script(c: str) -> str | None:
    o = ord(c)
    if 0x0900 <= o < 0x0D80:
        return next(s for s, b in BLOCKS.items() if b <= o < b + 128)
    if 0x0600 <= o <= 0x06FF or 0x0750 <= o <= 0x077F or 0xFB50 <= o <= 0xFDFF or 0xFE70 <= o <= 0xFEFF:
        return "arab"
    return "latn" if c.isascii() and c.isalpha() else None


def script_of(word: str) -> str | None:
    """The script of most of its letters, the first of equals."""
    seen = [s for s in map(_script, word) if s]
    return max(dict.fromkeys(seen), key=seen.count, default=None)


def _one_block(word: str) -> str:
    """The word in Devanagari letters, dots under consonants made part of them, doubled consonants spelled out."""
    out = "".join(OTHERWISE.get(c) or (c if c == _DOUBLE or _script(c) in (None, "arab", "latn") else chr(0x0900 + ord(c) % 128)) for c in word)
    out = re.sub(f"{_DOUBLE}({_LETTERS})", rf"\1{_HALT}\1", out).replace(_DOUBLE, "")
    for plain, dotted in zip("कखगजडढफय", range(0x0958, 0x0960), strict=True):
        out = out.replace(plain + _DOT, chr(dotted))
    return out.replace(_DOT, "").replace("ऽ", "")


def _indic(word: str, script: str) -> str:
    units = []  # consonants, vowel (None: the one that isn't written), mark after it, whether it stands alone or halts
    for m in _UNIT.finditer(_one_block(word)):
        if m["c"]:
            parts = m["c"].split(_HALT)
            sounds = [_SOUND[ord(p)] for p in parts]
            sounds = ["ksh"] if sounds == ["k", "sh"] else ["gy"] if parts == ["ज", "ञ"] else sounds
            units.append([sounds, "" if m["halt"] else _SIGN[ord(m["sign"])] if m["sign"] else None, m["n"][-1:], "halt" if m["halt"] else "sign" if m["sign"] else ""])
        elif m["v"]:
            units.append([[], _VOWEL[ord(m["v"])], m["m"][-1:], "vowel"])
        else:
            x = m["x"]
            units.append([None, str(ord(x) - 0x0966) if "०" <= x <= "९" else x, "", "other"])
    if script in ("deva", "beng", "guru", "gujr", "orya"):
        spoken = [u for u in units if u[0] is not None]
        for i in range(len(spoken) - 1, -1, -1):  # the unwritten vowel is silent at the end, and between spoken vowels
            u = spoken[i]
            if u[1] is not None or u[2]:
                continue
            if i == len(spoken) - 1:
                silent = i > 0 or len(u[0]) > 1
            else:
                after = spoken[i + 1]
                silent = i > 0 and after[3] not in ("vowel", "halt") and after[1] != "" and spoken[i - 1][1] != ""
            if silent:
                u[1] = ""
    out, open_, last = "", False, ""
    for i, (sounds, vowel, mark, kind) in enumerate(units):
        if sounds is None:
            out, open_, last = out + vowel, False, ""
            continue
        if script == "taml" and len(sounds) == 1 and sounds[0] in _STOPS and (open_ or last in ("n", "m")):
            sounds = [_STOPS[sounds[0]][0 if open_ else 1]]
        vowel = ("o" if script == "beng" else "a") if vowel is None else vowel
        out += "".join(sounds) + vowel
        if mark == "ः":
            out += "h"
        elif mark:
            after = units[i + 1][0] if i + 1 < len(units) else None
            lips = after[0][0] in "pbm" if after else script in ("telu", "knda", "mlym", "taml")
            out += "m" if lips else "n"
        open_ = vowel != ""
        last = "" if open_ or not sounds else sounds[-1]
    for long_, short in (("aa", "a"), ("ii", "i"), ("uu", "u")):
        out = out.replace(long_, short)
    return re.sub(r"(.)\1\1+", r"\1\1", out)


def _urdu(word: str) -> str:
    units: list[tuple[bool, str]] = []  # whether it is a consonant, sound
    for i, c in enumerate(word):
        follows = bool(units) and units[-1][0]
        if c == "ھ" and follows:
            units[-1] = (True, units[-1][1] + "h")
        elif c in URDU or c == "ھ":
            units.append((True, URDU.get(c, "h")))
        elif c in URDU_VOWELS:
            units.append((False, URDU_VOWELS[c]))
        elif c == "و":
            units.append((False, "u") if follows else (True, "v"))
        elif c in "یيى":
            units.append((False, "i") if follows or i == len(word) - 1 else (True, "y"))
        elif "٠" <= c <= "٩" or "۰" <= c <= "۹":
            units.append((False, str(ord(c) % 16)))
        elif c not in URDU_SILENT:
            units.append((False, c))
    nxt = [u[0] for u in units[1:]] + [False]
    return "".join(s + ("a" if hard and then else "") for (hard, s), then in zip(units, nxt, strict=True))


def sound(latin: str) -> str:
    """The consonants' classes: spellings of one sound are equal. sound_key() is the same for columns."""
    s = re.sub("[^bcdfgjklmnpqrstvxz]", "", latin.lower())
    return s.translate(str.maketrans("gqxczjdbfv", "kkkssstppp"))


def sound_key(latin: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce(latin, F.lit(""))), "[^bcdfgjklmnpqrstvxz]", ""), "gqxczjdbfv", "kkkssstppp")


@cache
def _spellings() -> dict[str, str]:
    """Sound -> spelling of the names, where one sound has one spelling."""
    by: dict[str, set[str]] = {}
    for name in NAMES.values():
        by.setdefault(sound(name), set()).add(name)
    return {k: (v := next(iter(s))) for k, s in by.items() if len(s) == 1 and len(v := next(iter(s))) >= 4 and not v.endswith(".") and "/" not in v}


def word_in_latin(word: str) -> str:
    """A word of any of the scripts; Latin words and numbers stay."""
    if word in NAMES:
        return NAMES[word]
    script = script_of(word)
    if script in (None, "latn"):
        return word
    out = _urdu(word) if script == "arab" else _indic(word, script)
    key = sound(out)
    return _spellings().get(key, out) if script != "deva" and len(key) >= 3 else out


_WORD = re.compile(r"[^\s,;:()\[\]{}\"'“”‘’|/\\]+")


def text_in_latin(text: str, capital: bool = True) -> str:
    """All words of other scripts than Latin, with capitals; everything else stays. A danda after a word becomes a dot."""

    def one(m: re.Match) -> str:
        core = m[0].rstrip(".،।")
        if script_of(core) in (None, "latn"):
            return m[0]
        out = word_in_latin(core)
        if capital:
            out = " ".join(w if w.endswith(".") or w in ("S/o", "D/o", "W/o") else w[:1].upper() + w[1:] for w in out.split(" "))
        return out + m[0][len(core) :].replace("।", ".")

    return _WORD.sub(one, text)


@F.pandas_udf(StringType())
def in_latin(text: pd.Series) -> pd.Series:
    """Null stays null."""
    return text.map(lambda t: None if t is None else text_in_latin(t))


def sound_alike(words: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """word, name, how: 'gazetteer' where the native word is listed, else 'sound' where exactly one name sounds like it.

    words: word, latin. gazetteer: native (may be null), name. Sounds of fewer than three consonants say nothing.
    """
    exact = gazetteer.where("native IS NOT NULL").groupBy(F.col("native").alias("word")).agg(F.min("name").alias("exact"))
    one = gazetteer.select(sound_key(F.col("name")).alias("k"), "name").distinct().groupBy("k").agg(F.count("*").alias("n"), F.min("name").alias("alike")).where("n = 1 AND length(k) >= 3")
    j = words.select("word", sound_key(F.col("latin")).alias("k")).distinct().join(exact, "word", "left").join(one.select("k", "alike"), "k", "left")
    return j.where("exact IS NOT NULL OR alike IS NOT NULL").select("word", F.coalesce("exact", "alike").alias("name"), F.when(F.col("exact").isNotNull(), "gazetteer").otherwise("sound").alias("how"))
