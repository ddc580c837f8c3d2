"""Flags of wording that deserves a human look: weighted rules, weakened by visible context. A flag is no finding."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flag_rules as r
from ..functions.normal import plain_quotes

FLAG = "array<struct<category string, severity string, score double, level string, rule string, lang string, phrase string, rules int, notes string>>"


def needed(pattern) -> frozenset[str] | None:
    """Strings of which every match holds at least one, as the parsed pattern tells; None if it tells nothing."""
    best, run = None, ""

    def take(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    for kind, arg in [*pattern, (None, None)]:
        if kind is sre.LITERAL:
            run += chr(arg)
            continue
        take(frozenset([run]) if run else None)
        run = ""
        if kind is sre.BRANCH:
            each = [needed(b) for b in arg[1]]
            take(frozenset().union(*each) if all(each) else None)
        elif kind is sre.SUBPATTERN:
            take(needed(arg[3]))
        elif kind is sre.MAX_REPEAT and arg[0] >= 1:
            take(needed(arg[2]))
    return best


def folded(text: str) -> str:
    """In one case, and for whatever letters a pattern of either case takes as equal."""
    return text.casefold().replace("ı", "i")


@cache
def _compiled():
    rules = []
    for name, w, p in r.RULES:
        need = needed(parser.parse(p, re.I))
        rules.append((name, w, re.compile(p, re.I), frozenset(map(folded, need or [""]))))
    dampers = [(name, f, set(c) or set(r.SEVERITY), re.compile(p, re.I)) for name, f, c, p in r.DAMPERS]
    return rules, sorted(set().union(*[x[3] for x in rules])), dampers, re.compile(r.NEGATION, re.I)


def flags_of(text: str, threshold: float = r.THRESHOLD) -> list[dict]:
    """Flags of a text whose quotes are plain: one for each category at or above the threshold, highest score first."""
    rules, strings, dampers, negation = _compiled()
    plain = folded(text)
    there = {s for s in strings if s in plain}
    hits: dict[str, list[tuple]] = {}
    for name, weight, rx, need in rules:
        if not there.isdisjoint(need) and (m := rx.search(text)):
            hits.setdefault(r.CATEGORY[name[:3]], []).append((weight, name, *m.span()))
    context = {name: rx.search(text) is not None for name, _, _, rx in dampers} if hits else {}
    out = []
    for category, found in hits.items():
        apart: list[tuple] = []  # what overlaps a heavier match is no evidence of its own
        for h in sorted(found, key=lambda x: -x[0]):
            if all(h[3] <= k[2] or k[3] <= h[2] for k in apart):
                apart.append(h)
        _, top, start, end = apart[0]
        firm = all(name in r.FIRM for _, name, *_ in apart)
        notes = [(name, f) for name, f, of, _ in dampers if context[name] and category in of and not (firm and name in r.BANTER)]
        if "quotation" not in dict(notes) and text.count('"', 0, start) % 2 and '"' in text[end:]:
            notes.append(("quoted", r.QUOTED))
        if category in r.NEGATABLE and negation.search(text[max(0, start - r.NEGATION_REACH) : start]):
            notes.append(("negated", r.NEGATED))
        score = round(float((1 - np.prod([1 - h[0] for h in apart])) * np.prod([f for _, f in notes])), 3)
        if score >= threshold:
            level = "high" if score >= r.HIGH else "medium" if score >= r.MEDIUM else "low"
            out.append({"category": category, "severity": r.SEVERITY[category], "score": score, "level": level, "rule": top, "lang": r.LANGUAGE[top.split("_")[1]], "phrase": text[start:end].strip(), "rules": len(apart), "notes": ",".join(n for n, _ in notes)})
    return sorted(out, key=lambda f: -f["score"])


def flags(posts: DataFrame, threshold: float = r.THRESHOLD) -> DataFrame:
    """uid, category, severity, score, level, rule, lang, phrase, rules, notes. posts: uid, text. One scan; texts without a flag give no row."""

    @F.pandas_udf(FLAG)
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: flags_of(t, threshold) if t and t.strip() else [])

    return posts.select("uid", F.explode(found(plain_quotes(F.col("text")))).alias("f")).select("uid", "f.*")
