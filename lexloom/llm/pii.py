"""Personal data: fixed patterns, and a second look through transducers that undo disguises and keep source offsets."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from lexloom.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either matches from its start or not at all, so matches start where no digit stands before them.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
CARD_HINT = re.compile(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Characters that look like Latin letters, digits or marks (fixed values): Greek, Cyrillic, full-width and other forms.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
#: Spelled digits (fixed values) of the four languages of the corpus.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ONE = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Four or more spelled digits in a row stand for a number; fewer are words.
SPELLED_RUN = re.compile(rf"\b(?:plus[ -]+)?(?:{_ONE})(?:[ ,-]+(?:{_ONE})){{3,}}\b", re.I)
SPELLED_WORDS = frozenset(SPELLED)
BREAKS = str.maketrans(",-", "  ")
_IN_BRACKETS = r" ?[\[({<] ?(?:dot|punkt|point|punto|\.) ?[\])}>] ?"
_DOT = rf"(?:\.|{_IN_BRACKETS}| dot )"
#: A bracketed "at" before any domain; a bare one only before a domain whose dot is spelled, else it is a word.
AT = re.compile(rf"(?<=[A-Za-z0-9])(?: ?[\[({{<] ?(?:at|arroba|@) ?[\])}}>] ?(?=[A-Za-z0-9-]+{_DOT}[A-Za-z0-9])| at (?!(?:the|an?|this|that|my|our|your|his|her|its|their) )(?=[A-Za-z0-9-]+(?: dot |{_IN_BRACKETS})[A-Za-z0-9]))", re.I)
DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_IN_BRACKETS}| dot )(?=[A-Za-z0-9])", re.I)
#: Four numbers of up to three spelled or written digits with dots, spelled or not, between them.
_NUMBER = rf"(?:(?:{_ONE})(?:[ -]+(?:{_ONE})){{0,2}}|[0-9]{{1,3}})"
SPELLED_IP = re.compile(rf"(?<![\w.]){_NUMBER}(?:(?:\.|{_IN_BRACKETS}| (?:dot|punkt|point|punto) ){_NUMBER}){{3}}(?!\w)", re.I)
#: A text without any of these needs no second look but for odd characters and spelled digits; each at and dot disguise has one of them.
HINT = re.compile(r"[\[({<] ?(?:at|arroba|@|dot|punkt|point|punto|\.) ?[\])}>]| (?:dot|punkt|point|punto) ", re.I)
ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "！-～​-‍⁠﻿]")
ZERO_WIDTH = frozenset("​‌‍⁠﻿")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ is tried once, with the whole run of local characters before it: linear however long the runs are."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the four fixed patterns by kind, then start."""
    out = [("email", *s) for s in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
    if CARD_HINT.search(text):
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tape:
    """A text with, for every character, where it comes from in the source; transducers rewrite it and keep that."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, put) -> None:
        text, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = put(m)
            text += [self.text[last:a], new]
            start += self.start[last:a] + [self.start[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        if last:
            self.text, self.start, self.end = "".join([*text, self.text[last:]]), start + self.start[last:], end + self.end[last:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def plain(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    return chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else HOMOGLYPHS[c]


def digits_of(run: str) -> str:
    words = re.split(r"[ ,-]+", run.lower())
    return "".join("+" if w == "plus" else SPELLED[w] for w in words)


def ip_of(run: str) -> str:
    return "".join("." if w in ("dot", "punkt", "point", "punto", ".") else SPELLED.get(w, w) for w in re.findall(r"[^\W\d_]+|[0-9]+|\.", run.lower()))


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans, in source offsets, that the fixed patterns find only once disguises are undone."""
    odd, at = ODD.search(text), HINT.search(text)
    spelled = sum(map(SPELLED_WORDS.__contains__, text.lower().translate(BREAKS).split())) >= 4
    # digits may touch the dots, so an address in spelled digits is looked for with its own pattern
    address = SPELLED_IP.search(text) if at or text.count(".") >= 3 else None
    if not (odd or spelled or at or address):
        return []
    tape = Tape(text)
    if odd:
        tape.rewrite(ODD, lambda m: plain(m[0]))
    if address or odd:
        tape.rewrite(SPELLED_IP, lambda m: ip_of(m[0]))
    if spelled:
        tape.rewrite(SPELLED_RUN, lambda m: digits_of(m[0]))
    if at or odd:
        tape.rewrite(AT, lambda m: "@")
        tape.rewrite(DOT, lambda m: ".")
    return [(k, *tape.source(a, b)) for k, a, b in base_spans(tape.text)] if tape.text != text else []


def all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    more = [s for s in hidden_spans(text) if s not in base and not any(a < s[2] and s[1] < b for a, b in taken)]
    return base, more


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, their digest, and all spans with those found under disguise, for every row.

    A null text counts as empty: no spans, and the digest of the empty string. Offsets are code points of the source,
    end exclusive. A disguised span that overlaps a base span is dropped, so base spans stay as they are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def one(text: str | None) -> tuple:
            base, more = all_spans(text or "")
            return *[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)

        def apply(cols):
            rows = zip(*map(one, cols["text"].to_pylist()))
            return {"doc_id": cols["doc_id"]} | {n: list(v) for n, v in zip(("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden"), rows)}

        return apply

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long", make)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; null texts stay null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        def one(text: str | None) -> str | None:
            if not text:
                return text
            base, more = all_spans(text)
            out, last = [], 0
            for k, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
                if a >= last:
                    out += [text[last:a], f"<{k}>"]
                    last = b
            return "".join([*out, text[last:]])

        return lambda cols: cols | {"text": list(map(one, cols["text"].to_pylist()))}

    return map_batches(docs, schema, make)
