"""PII: base patterns, and disguised identifiers found in a normalised text.

Small transducers rewrite parts of the source: homoglyphs and other scripts'
digits to ASCII, spelled digits in four languages to digits, at/dot disguises to
their signs. Every character they emit keeps the source characters it stands for,
so an identifier found in the normalised text maps back to offsets of the source.
Base spans always stay; a disguised span is added if it holds a rewritten
character and lies in no base span of its kind.

Every text is handled by itself in Arrow batches: no shuffle, memory of one batch.
All scans are linear in the text, also on hostile input (possessive patterns,
runs that are scanned once).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters that look like ASCII ones, each with its ASCII letter.
HOMOGLYPHS = (
    "а a е e о o р p с c у y х x і i ј j ѕ s ԁ d һ h ԛ q ԝ w ո n ս u ց g "
    "А A В B Е E К K М M Н H О O Р P С C Т T У Y Х X І I Ј J Ѕ S "
    "α a ο o ν v ι i κ k ρ p υ u τ t χ x γ y ω w "
    "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X ı i ɡ g ɑ a ℓ l"
).split()
# Digits as words, zero to nine, by language.
SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
# Words for the signs.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "ät", "chez"), ("dot", "punkt", "point", "punto"), ("plus", "más")

_DIGIT = {w: str(i) for words in SPELLED for i, w in enumerate(words.split())} | {"oh": "0"}
_GLYPH = dict(zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2], strict=True))
_ANY = lambda words: "|".join(sorted(words, key=len, reverse=True))
_TOKEN = rf"(?:{_ANY([*_DIGIT, *DOT_WORDS, *PLUS_WORDS])}|[0-9]++)"
#: Three or more spelled digits, digits and signs in a row.
_RUN = re.compile(rf"\b{_TOKEN}(?:[ ,-]{{1,3}}{_TOKEN}\b){{2,}}", re.I)
_RUN_TOKEN = re.compile(_TOKEN, re.I)
#: Where a text may hold a disguise at all.
_OPEN, _CLOSE = r"[(\[{<] ?", r" ?[)\]}>]"
_SIGN = re.compile(
    rf"(?<=[A-Za-z0-9])(?: ?{_OPEN}(?P<a>{_ANY(AT_WORDS)}|@){_CLOSE} ?| ?{_OPEN}(?P<d>{_ANY(DOT_WORDS)}|\.){_CLOSE} ?"
    rf"| (?P<wa>{_ANY(AT_WORDS)}) | (?P<wd>{_ANY(DOT_WORDS)}) | @ )(?=[A-Za-z0-9])",
    re.I,
)
_LABEL = re.compile(r"[A-Za-z0-9_%+.-]+")
_INVISIBLE = "​‌‍⁠﻿­"


def plain_of(char: str) -> str | None:
    """The ASCII character that ``char`` imitates, empty for an invisible one, else None."""
    if char in _GLYPH:
        return _GLYPH[char]
    if char in _INVISIBLE:
        return ""
    if unicodedata.decimal(char, None) is not None:
        return str(unicodedata.decimal(char))
    folded = unicodedata.normalize("NFKC", char)
    # compatibility forms of one ASCII sign (full width, mathematical, circled); letters with accents are no disguise
    return folded if len(folded) == 1 and "!" <= folded <= "~" else None


_plain: dict[str, str | None] = {}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each @ to both sides."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = at + 1  # no later match begins before this sign
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str, has_digit: bool = True) -> dict[str, list[tuple[int, int]]]:
    """The base spans of every kind."""
    return {k: list(find(text)) if has_digit or k == "email" else [] for k, find in _FINDERS.items()}


# --------------------------------------------------------------- transducers


def _glyph_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in re.finditer(r"[^\x00-\x7F]", text):
        c = m.group()
        if c not in _plain:
            _plain[c] = plain_of(c)
        if _plain[c] is not None:
            yield m.start(), m.end(), _plain[c]


def _sign_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """at/dot disguises. A bracketed sign stands alone; a bare word counts only in a
    chain with an at: labels and dot words between it and the at, and at least one
    disguised dot behind a bare at."""
    signs = list(_SIGN.finditer(text))
    for k, m in enumerate(signs):
        if m["d"]:
            yield m.start(), m.end(), "."
        elif m["a"]:
            yield m.start(), m.end(), "@"
        if m["d"] or m["wd"]:
            continue
        # the chain of dots behind the at
        behind, at, j = [], m.end(), k + 1
        while j < len(signs) and (signs[j]["d"] or signs[j]["wd"]) and (
            (label := _LABEL.match(text, at)) and label.end() == signs[j].start()
        ):
            behind.append(signs[j])
            at, j = signs[j].end(), j + 1
        spaced = not m["a"] and not m["wa"]  # a bare " @ "
        if m["wa"] and not behind:
            continue
        if spaced and not behind and "." not in ((label := _LABEL.match(text, at)) and label.group() or ""):
            continue
        if not m["a"]:
            yield m.start(), m.end(), "@"
        for dot in behind:
            if dot["wd"]:
                yield dot.start(), dot.end(), "."
        # and of bare dots before it
        to, j = m.start(), k - 1
        while j >= 0 and signs[j]["wd"] and (label := _LABEL.match(text, signs[j].end())) and label.end() == to:
            yield signs[j].start(), signs[j].end(), "."
            to, j = signs[j].start(), j - 1


def _digit_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits: words to digits, joined; words for dot and plus between them."""
    for run in _RUN.finditer(text):
        words = list(_RUN_TOKEN.finditer(text, run.start(), run.end()))
        if not any(w.group().lower() in _DIGIT for w in words):
            if not any(w.group().lower() in DOT_WORDS for w in words):
                continue
        for k, w in enumerate(words):
            word = w.group().lower()
            value = _DIGIT.get(word) or ("." if word in DOT_WORDS else "+" if word in PLUS_WORDS else None)
            if value:
                yield w.start(), w.end(), value
            if k and (value or not words[k - 1].group()[0].isdigit()):
                yield words[k - 1].end(), w.start(), ""  # the gap beside a rewritten word


def normalise(text: str) -> tuple[str, list[int], list[int], list[int]] | None:
    """The normalised text with source starts and ends of its characters and a running
    count of rewritten ones; None if there is nothing to rewrite."""
    edits = sorted({*_glyph_edits(text)} if not text.isascii() else set())
    base, back = (text, None) if not edits else _rewrite(text, edits)
    more = sorted({*_sign_edits(base), *_digit_edits(base)})
    if not edits and not more:
        return None
    starts, ends, changed = back or (list(range(len(text))), list(range(1, len(text) + 1)), [0] * len(text))
    if more:
        base, (s2, e2, c2) = _rewrite(base, more)
        touched = [0, *np.cumsum(changed).tolist()]
        changed = [int(c or touched[b] > touched[a]) for a, b, c in zip(s2, e2, c2, strict=True)]
        starts, ends = [starts[a] for a in s2], [ends[b - 1] for b in e2]
    return base, starts, ends, [0, *np.cumsum(changed).tolist()]


def _rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, tuple[list[int], list[int], list[int]]]:
    out, starts, ends, changed, at = [], [], [], [], 0
    gone: set[int] = set()  # places right behind something left out count as rewritten
    for a, b, new in edits:
        if a < at:
            continue  # the earlier of two overlapping edits holds
        out.append(text[at:a])
        starts.extend(range(at, a))
        ends.extend(range(at + 1, a + 1))
        changed.extend([0] * (a - at))
        if new:
            out.append(new)
            starts.append(a)
            ends.append(b)
            changed.append(1)
        else:
            gone.add(len(starts))
        at = b
    out.append(text[at:])
    starts.extend(range(at, len(text)))
    ends.extend(range(at + 1, len(text) + 1))
    changed.extend([0] * (len(text) - at))
    for k in gone:
        if k < len(changed):
            changed[k] = 1
    return "".join(out), (starts, ends, changed)


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of disguised identifiers, in offsets of the source."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    normal = normalise(text)
    if normal is None:
        return found
    plain, starts, ends, changed = normal
    for kind, find in _FINDERS.items():
        have = base[kind]
        firsts = [a for a, _ in have]
        for a, b in find(plain):
            if changed[b] == changed[a]:
                continue
            span = starts[a], ends[b - 1]
            k = bisect_right(firsts, span[0]) - 1
            if k < 0 or have[k][1] < span[1]:
                found[kind].append(span)
    return found


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and
    added) and n_added of every whole text.

    Input: columns doc_id (integer) and text; others are ignored. A null text is empty
    and has no spans; repeated rows give repeated results.
    """
    common.small_batches(docs.sparkSession)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, offsets = arrays.column_bytes(column)
            digits = np.append(0, np.cumsum((data >= 48) & (data < 58)))
            some = digits[offsets[1:]] > digits[offsets[:-1]]
            counts, hashes, spans, added = {k: [] for k in KINDS}, [], [], []
            for text, has_digit in zip(column.to_pylist(), some.tolist(), strict=True):
                base = base_spans(text, has_digit)
                more = added_spans(text, base)
                for k in KINDS:
                    counts[k].append(len(base[k]))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined({k: base[k] + more[k] for k in KINDS}))
                added.append(sum(map(len, more.values())))
            longs = [pa.array(counts[k], pa.int64()) for k in KINDS]
            values = [batch.column("doc_id"), *longs, pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(values, names=names)

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents", ["doc_id", "text"]))
