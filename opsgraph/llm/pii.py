"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and stops at anchors only:
at-signs (plain or written out), plus signs, digits, ``://`` and identifier cues.  At
each anchor a parser reads the run of characters around it, settles where the address or number
begins and ends, and validates it:

* ``email``: the local part to the left of the at-sign, not before the end of the address
  before it, and at least two labels to the right;
* ``ip``: a chain of digit runs joined by dots, taken four by four, no run over 255;
* ``card``: a chain of digits with single spaces or hyphens between them, 12 to 19 digits, Luhn;
* ``phone``: a plus sign and a digit, then up to the last digit of what may stand in a
  number, 9 to 15 digits.

These are the *base* spans: the same as the leftmost non-overlapping matches of the four
patterns that ``op12`` names, from which failing ones are dropped.  Beyond them
(``base`` false, never inside a base span):

* ``card`` where a failing chain has several numbers: a piece between spaces, or four pieces of four digits;
* ``email`` written with ``[at]`` or ``(at)`` and plain, ``[dot]`` or ``(dot)`` dots;
* ``phone`` after a cue, 7 to 15 digits without a plus sign;
* ``iban`` and ``account`` after a cue, the first validated modulo 97, the second 6 to 20 digits; ``ssn``
  after a cue, as three, two and four digits outside the ranges that are never given;
* ``url`` with user information before its host.

Nothing is shuffled; a text is read left to right, every parser goes over a character
a bounded number of times.  Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans and stand in the result; very long texts are
read whole; repeated rows and rows with a null doc_id are searched one by one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

KINDS = ("email", "ip", "card", "phone", "iban", "account", "ssn", "url")
SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("base", T.BooleanType()))
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
    "tel": ("tel", "phone", "telefon", "teléfono", "téléphone", "mobile", "fax"),
    "at": ("[at]", "(at)"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_LABEL_RUN = re.compile(r"[A-Za-z0-9-]*")
_DIGIT_RUN = re.compile(r"[0-9]*")
_PHONE_RUN = re.compile(r"[ ().0-9-]*")
_AUTHORITY_RUN = re.compile(r"[^\s/?#\"'<>]*")
_SCHEME_RUN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_AFTER_CUE = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))? ?[:=#.]? ?", re.IGNORECASE)
_DOT = re.compile(r" ?[\[(]dot[\])] ?|\.", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])")
_LOCAL_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])+")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9])+(?![0-9A-Za-z])")


def automaton() -> ahocorasick.Automaton:
    """All anchors, each with its kind and length; cues in three spellings."""
    found = ahocorasick.Automaton()
    for c in "@+":
        found.add_word(c, (c, 1))
    for c in _DIGITS:
        found.add_word(c, ("0", 1))
    found.add_word("://", ("://", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) < 4 and int(value or 0) < 256


def _domain(text: str, at: int, dot=None) -> int:
    """End of at least two labels from ``at``, or 0."""
    end = _LABEL_RUN.match(text, at).end()
    labels = int(end > at)
    while labels:
        if dot is None:
            start = end + 1 if text.startswith(".", end) else 0
        else:
            m = dot.match(text, end)
            start = m.end() if m else 0
        after = _LABEL_RUN.match(text, start).end() if start else 0
        if after <= start:
            break
        end, labels = after, labels + 1
    return end if labels > 1 else 0


def _left(text: str, end: int, stop: int) -> int:
    """Start of the local part that ends before ``end``."""
    start = end
    while start > stop and text[start - 1] in _LOCAL:
        start -= 1
    return start


def _numbers(text: str, start: int, chain: str) -> Iterator[tuple[int, int]]:
    """Card numbers inside a chain that is none itself."""
    pieces = [(m.start(), m.group()) for m in re.finditer(r"[0-9-]+", chain)]
    plain = [p.replace("-", "") for _, p in pieces]
    for k, (at, piece) in enumerate(pieces):
        if 13 <= len(plain[k]) <= 19 and luhn(plain[k]):
            yield start + at, start + at + len(piece)
        elif [len(p) for p in plain[k : k + 4]] == [4] * 4 and luhn("".join(plain[k : k + 4])):
            yield start + at, start + pieces[k + 3][0] + len(pieces[k + 3][1])


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _after_cue(text: str, kind: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """What follows a cue that stands as a word of its own."""
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalpha():
        return
    at = _AFTER_CUE.match(text, end).end()
    if kind == "iban":
        m = _IBAN.match(text, at)
        while m and not _iban(m.group()):  # a group of letters after the number isn't part of it
            shorter = m.group().rpartition(" ")[0]
            m = _IBAN.fullmatch(shorter) if shorter else None
        if m:
            yield "iban", at, at + len(m.group())
    elif kind == "ssn" and (m := _SSN.match(text, at)):
        yield "ssn", m.start(), m.end()
    elif kind == "tel" and (m := _LOCAL_NUMBER.match(text, at)) and 7 <= sum(c in _DIGITS for c in m.group()) <= 15:
        yield "phone", m.start(), m.end()
    elif kind == "account" and (m := _ACCOUNT.match(text, at)) and 6 <= sum(c in _DIGITS for c in m.group()) <= 20:
        yield "account", m.start(), m.end()


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int, bool]]:
    """``(start, kind, end, base)`` of all spans of one text, in order of start and kind."""
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    email_from = ip_from = card_from = phone_from = 0
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "0":
            if at >= ip_from:
                runs = []
                start, end = at, _DIGIT_RUN.match(text, at).end()
                while True:
                    runs.append((start, end))
                    if not (text.startswith(".", end) and text[end + 1 : end + 2] in _DIGITS):
                        break
                    start, end = end + 1, _DIGIT_RUN.match(text, end + 1).end()
                for k in range(0, len(runs) - 3, 4):
                    if all(_octet(text[s:e]) for s, e in runs[k : k + 4]):
                        base.append((runs[k][0], 1, runs[k + 3][1]))
                ip_from = end
            if at >= card_from:
                end = _DIGIT_RUN.match(text, at).end()
                while end < len(text) and text[end] in " -" and text[end + 1 : end + 2] in _DIGITS:
                    end = _DIGIT_RUN.match(text, end + 1).end()
                if end - at >= 12:
                    chain = text[at:end]
                    digits = chain.replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append((at, 2, end))
                    else:
                        more.extend((s, 2, e) for s, e in _numbers(text, at, chain))
                card_from = end
        elif kind == "@":
            start = _left(text, at, email_from)
            if start < at and (end := _domain(text, at + 1)):
                base.append((start, 0, end))
                email_from = end
        elif kind == "+":
            if at >= phone_from and text[at + 1 : at + 2] in _DIGITS:
                end = _PHONE_RUN.match(text, at + 2).end()
                while end > at + 2 and text[end - 1] not in _DIGITS:
                    end -= 1
                if end >= at + 4:
                    phone_from = end
                    if 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                        base.append((at, 3, end))
        elif kind == "://":
            end = _AUTHORITY_RUN.match(text, at + 3).end()
            scheme = _SCHEME_RUN.search(text[max(0, at - 16) : at])
            user, sign, host = text[at + 3 : end].rpartition("@")
            if scheme and sign and user and host:
                more.append((at - len(scheme.group()), KINDS.index("url"), end))
        elif kind == "at":
            left = at - (at > 0 and text[at - 1] == " ")
            right = last + 1 + text.startswith(" ", last + 1)
            start = _left(text, left, max(0, left - 64))
            if start < left and (end := _domain(text, right, _DOT)) and text[end - 2 : end].isalpha():
                more.append((start, 0, end))
        else:
            more.extend((s, KINDS.index(name), e) for name, s, e in _after_cue(text, kind, at, last + 1))
    known = sorted(base)
    out = [(s, k, e, True) for s, k, e in known]
    for s, k, e in sorted(set(more)):
        if not any(a <= s and e <= b for a, _, b in known):
            out.append((s, k, e, False))
    return sorted(out)


def find_pii(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans``: kind, start, end and whether it is a base span, for every row."""
    schema = documents.select(key).schema.add("spans", SPANS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in find(t, anchors)] if t else [] for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[key, "spans"])

    return documents.select(key, "text").mapInArrow(run, schema)


def redact(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = []
            for t in (x.as_py() for x in batch.column(at)):
                out, done = [], 0
                for s, k, e, _ in find(t, anchors) if t else ():
                    if s >= done:
                        out += [t[done:s], f"[{KINDS[k]}]"]
                    done = max(done, e)
                texts.append("".join([*out, t[done:]]) if out else t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(base, partial(_is_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
