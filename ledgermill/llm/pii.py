"""Personal data by anchors: an automaton finds where something can begin, local parsers find how far it goes.

An Aho-Corasick automaton runs over the lower-cased text once and reports at-signs, plus signs, digits, URI schemes, written-out at-signs
and cues of identifiers. Each report goes to a parser that expands from there to both sides and validates.

Base kinds, each as the leftmost non-overlapping matches of its pattern, of which those that fail validation are dropped:
email (local part, at-sign, dotted domain), ip (four dotted numbers of at most 255), card (digits with single spaces or hyphens, 13 to 19, Luhn), phone (plus sign, 9 to 15 digits).
The method adds three kinds, which never change the base:
mail, an address with a bracketed or parenthesised at-sign and, maybe, dots (``name [at] host (dot) org``); address, what follows a personal scheme (tel, sip, sips, xmpp, skype, bitcoin) or
a URL with credentials (``scheme://user@host``); account, an identifier behind its cue: IBAN (mod 97), social security number (3-2-4 digits, no impossible group), bank account and
passport numbers (6 to 20 characters, a third of them digits at least).

Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no spans; texts of any length are read whole; each row has its own result, whatever ids
repeat or are null; an empty table gives an empty result; columns of other names play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import resident

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail", "address", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGITS = frozenset("0123456789")
DIALLED = frozenset(" ().0123456789-")
SCHEMES = ("tel:", "sip:", "sips:", "xmpp:", "skype:", "bitcoin:")
WRITTEN_AT = ("[at]", "(at)", "{at}")
WRITTEN_DOT = ("[dot]", "(dot)", "{dot}", ".")
#: Characters of an address behind a personal scheme.
LONGEST = 320
CUES = {"iban": "iban", "ssn": "ssn", "social security number": "ssn", "account number": "number", "account no": "number", "acct": "number", "passport number": "number", "passport no": "number"}

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _run(text: str, at: int, chars: frozenset) -> int:
    """Where the run of ``chars`` that begins at ``at`` ends."""
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def _run_back(text: str, at: int, chars: frozenset, floor: int = 0) -> int:
    """Where the run of ``chars`` that ends at ``at`` begins, ``floor`` at the least."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _domain(text: str, at: int) -> int | None:
    """The end of a dotted name that begins at ``at``; None if it has no dot."""
    end = _run(text, at, LABEL)
    if end == at:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = more, dots + 1
    return end if dots else None


class Anchored:
    """The spans of one text; each method takes an anchor and leaves how far its kind has come."""

    def __init__(self, text: str):
        self.text = text
        self.found: dict[str, list[Span]] = {k: [] for k in KINDS}
        self.past = dict.fromkeys(("email", "ip", "card"), 0)

    def at_sign(self, at: int) -> None:
        """Local part to the left, but not into the match before; domain to the right."""
        start = _run_back(self.text, at, LOCAL, self.past["email"])
        if start < at and (end := _domain(self.text, at + 1)):
            self.found["email"].append((start, end))
            self.past["email"] = end

    def digit(self, at: int) -> None:
        """A digit that no number before has taken begins a dotted and a spaced run."""
        if at >= self.past["ip"]:
            self._dotted(at)
        if at >= self.past["card"]:
            self._spaced(at)

    def _dotted(self, at: int) -> None:
        """Numbers joined by single dots, taken by fours from the left."""
        text = self.text
        ends = [(at, _run(text, at, DIGITS))]
        while (dot := ends[-1][1]) < len(text) and text[dot] == "." and (end := _run(text, dot + 1, DIGITS)) > dot + 1:
            ends.append((dot + 1, end))
        for k in range(0, len(ends) - 3, 4):
            four = ends[k : k + 4]
            if all(len(n := text[a:b].lstrip("0")) <= 3 and int(n or "0") <= 255 for a, b in four):
                self.found["ip"].append((four[0][0], four[3][1]))
        self.past["ip"] = ends[-1][1]

    def _spaced(self, at: int) -> None:
        text, end, length = self.text, at + 1, len(self.text)
        while True:
            if end < length and text[end] in DIGITS:
                end += 1
            elif end + 1 < length and text[end] in " -" and text[end + 1] in DIGITS:
                end += 2
            else:
                break
        self.past["card"] = end
        if end - at >= 13:
            digits = re.sub("[ -]", "", text[at:end])
            if 13 <= len(digits) <= 19 and luhn(digits):
                self.found["card"].append((at, end))

    def plus(self, at: int) -> None:
        """A digit, dialled characters and the last digit among them."""
        text = self.text
        if at + 1 < len(text) and text[at + 1] in DIGITS:
            end = _run_back(text, _run(text, at + 2, DIALLED), DIALLED - DIGITS, at + 2)
            if end >= at + 4 and 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                self.found["phone"].append((at, end))

    def written_at(self, begin: int, end: int) -> None:
        text = self.text
        right = begin
        while right > 0 and text[right - 1] == " " and begin - right < 2:
            right -= 1
        start = _run_back(text, right, LOCAL)
        at = end + _spaces(text, end)
        stop, dots = _run(text, at, LABEL), 0
        while stop > at:
            dot = stop + _spaces(text, stop)
            mark = next((d for d in WRITTEN_DOT if text[dot : dot + len(d)].lower() == d), None)
            if mark is None or (mark == "." and dot > stop):
                break
            after = dot + len(mark) + (0 if mark == "." else _spaces(text, dot + len(mark)))
            if (more := _run(text, after, LABEL)) == after:
                break
            stop, dots = more, dots + 1
        if start < right and dots:
            self.found["mail"].append((start, stop))

    def scheme(self, begin: int, end: int) -> None:
        """A personal scheme that begins a word: its address is what follows, six characters at least with a digit or an at-sign."""
        text = self.text
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in "+-."):
            return
        stop, most = end, min(len(text), end + LONGEST)
        while stop < most and (text[stop] in LOCAL or text[stop] in "@:()"):
            stop += 1
        stop = _run_back(text, stop, frozenset(".,:()-"), end)
        body = text[end:stop]
        if len(body) >= 6 and ("@" in body or sum(c in DIGITS for c in body) >= 3):
            self.found["address"].append((begin, stop))

    def credentials(self, begin: int, end: int) -> None:
        """``scheme://user@host``: letters to the left, a user and a dotted host to the right."""
        text = self.text
        start = _run_back(text, begin, LABEL - DIGITS - {"-"})
        at = _run(text, end, LOCAL | {":"})
        if start < begin and at > end and at < len(text) and text[at] == "@" and (stop := _domain(text, at + 1)):
            self.found["address"].append((start, stop))

    def cue(self, what: str, begin: int, end: int) -> None:
        text = self.text
        if begin and text[begin - 1].isalnum() or end < len(text) and text[end].isalnum():
            return
        at = end
        while at < len(text) and at - end < 4 and text[at] in " .:#=":
            at += 1
        stop = getattr(self, f"_{what}")(at) if at > end else None
        if stop:
            self.found["account"].append((at, stop))

    def _iban(self, at: int) -> int | None:
        """15 to 34 characters, in groups or not; the longest prefix of them whose remainder by 97 is 1."""
        text, stop, code, best = self.text, at, "", None
        while stop < len(text) and len(code) < 34:
            if text[stop].isascii() and text[stop].isalnum():
                code += text[stop].upper()
                stop += 1
                whole = stop == len(text) or not text[stop].isalnum()
                if whole and len(code) >= 15 and code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    best = stop
            elif text[stop] == " " and code:
                stop += 1
            else:
                break
        return best

    def _ssn(self, at: int) -> int | None:
        m = re.compile(r"(?!000|666|9)[0-9]{3}[- ]?(?!00)[0-9]{2}[- ]?(?!0000)[0-9]{4}(?![0-9])").match(self.text, at)
        return m.end() if m else None

    def _number(self, at: int) -> int | None:
        stop = _run(self.text, at, LABEL)
        code = self.text[at:stop]
        return stop if 6 <= len(code) <= 20 and 3 * sum(c in DIGITS for c in code) >= len(code) else None


def _spaces(text: str, at: int) -> int:
    """How many of the two characters at ``at`` are spaces to skip."""
    return 0 if text[at : at + 1] != " " else 1 + (text[at + 1 : at + 2] == " ")


class Finder:
    """The automaton of all anchors."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        anchors = {"@": "at_sign", "+": "plus", "://": "credentials"} | dict.fromkeys(DIGITS, "digit") | dict.fromkeys(SCHEMES, "scheme") | dict.fromkeys(WRITTEN_AT, "written_at") | {c: f"cue {k}" for c, k in CUES.items()}
        for anchor, parser in anchors.items():
            self.automaton.add_word(anchor, (parser, len(anchor)))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> dict[str, list[Span]]:
        """kind -> its spans in order."""
        text = text or ""
        found = Anchored(text)
        low = text.lower()
        if len(low) != len(text):  # a few letters get longer
            low = "".join(c.lower() if c.isascii() else c for c in text)
        for last, (parser, length) in self.automaton.iter(low):
            if length == 1:
                getattr(found, parser)(last)
            elif parser.startswith("cue"):
                found.cue(parser[4:], last + 1 - length, last + 1)
            else:
                getattr(found, parser)(last + 1 - length, last + 1)
        return {k: sorted(dict.fromkeys(v)) for k, v in found.found.items()}


def _told(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _report(text: str | None, finder: Finder) -> tuple:
    spans = finder.spans(text)
    return (*(len(spans[k]) for k in BASE), hashlib.sha256(_told(spans, BASE).encode()).hexdigest(), _told(spans, KINDS))


def personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with pii, an array of (kind, start, end), base kinds first."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = resident("pii", Finder)
        for batch in texts:
            yield pd.Series([[(k, a, b) for k, v in finder.spans(t).items() for a, b in v] for t in batch])

    return docs.withColumn("pii", found(F.col(text_col)))


def personal_data_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    ship(docs.sparkSession)
    columns = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def report(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = resident("pii", Finder)
        for batch in texts:
            yield pd.DataFrame([_report(t, finder) for t in batch], columns=columns)

    return docs.select(F.col(id_col).alias("id"), report(F.col(text_col)).alias("r")).select(F.col("id").alias(id_col), "r.*")
