"""Personal data: patterns propose spans, checksums confirm them, words near by adjust their score.

Four base kinds are always reported once their own rule holds: email, ip (parts up to 255), card (14 to 19 digits,
Luhn) and phone (10 to 15 digits after a plus sign). Three more are proposed and reported if their score reaches
``threshold``: iban (mod 97), local_phone and national_id. A proposal scores 0.4; a passed checksum adds 0.6, a
fitting word within ``CONTEXT`` characters adds 0.4.

An iban is tried at every end of a word, longest first, as the words behind one look like part of it. The other
patterns are matched leftmost and without overlap per kind; each takes time in proportion to the text, also on
texts made to provoke backtracking. Offsets are code points.

Defined results: a null or empty text has no spans; repeated rows are reported each; ``redact`` keeps all columns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone", "national_id")
SPAN_TYPE = "array<struct<kind:string,begin:bigint,end:bigint,score:double>>"
CONTEXT = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match inside a run of digits would also match from the run's start, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
WORD = re.compile("[A-Za-z0-9]")
WORD_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGITS = re.compile("[0-9]+")

#: Words that make a kind likelier, in the corpus' languages.
NEAR = {
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|karte|kreditkarte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|handy|téléphone|teléfono|móvil)\b", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|kontakt|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse|dirección)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "national_id": re.compile(r"\b(?:ssn|social security|tax id)\b", re.I),
}
NEAR["local_phone"] = NEAR["phone"]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans of 15 to 34 characters that start as an IBAN, end with a word and pass mod 97: per start the longest, as
    words that follow an IBAN look like part of it. A span that fails takes no text from one that starts within it."""
    found, at = [], 0
    while m := IBAN.search(text, at):
        at = m.start() + 1
        for end in reversed([w.end() for w in WORD_END.finditer(text, m.start(), m.end())]):
            if (end == len(text) or not WORD.match(text, end)) and mod97(text[m.start() : end]):
                found.append((m.start(), end))
                at = end
                break
    return found


def emails(text: str) -> list[tuple[int, int]]:
    """For each ``@``: the run of name characters before it that is still free, and a domain behind it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def ip_holds(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, number of the kind, end) of the base kinds; a match that fails its rule is dropped, not retried."""
    found = [(b, 0, e) for b, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if ip_holds(m[0])]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def near(text: str, kind: str, begin: int, end: int) -> bool:
    return bool(NEAR[kind].search(text, max(0, begin - CONTEXT), begin) or NEAR[kind].search(text, end, end + CONTEXT))


def spans_of(text: str, threshold: float) -> list[dict]:
    """All spans by begin, then kind as listed."""
    base = base_spans(text)
    found = [(b, k, e, 1.0 if k == 2 or near(text, KINDS[k], b, e) else 0.9) for b, k, e in base]
    if DIGITS.search(text):
        taken = [(b, e) for b, _, e in base]
        for k, pattern in ((4, IBAN), (5, LOCAL_PHONE), (6, NATIONAL_ID)):
            for begin, end in ibans(text) if k == 4 else (m.span() for m in pattern.finditer(text)):
                score = 0.4 + 0.6 * (k == 4) + 0.4 * near(text, KINDS[k], begin, end)
                if score >= threshold and not any(b < end and begin < e for b, e in taken):
                    found.append((begin, k, end, min(1.0, score)))
    return [{"kind": KINDS[k], "begin": b, "end": e, "score": s} for b, k, e, s in sorted(found)]


ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document ``doc_id, spans``."""

    def search(batches: Batches) -> Batches:
        for batch in batches:
            found = [spans_of(t, threshold) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_SPANS)], ["doc_id", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}")


def redacted(text: str, spans: list[dict]) -> str:
    """Put ``[KIND]`` for each span; overlapping spans become one, named after the first."""
    out, done = [], 0
    for s in spans:
        if s["begin"] >= done:
            out += [text[done : s["begin"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join(out) + text[done:]


def redact(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents with spans replaced by their kind; other columns as they are, but ``n_chars`` follows the text."""

    def replace(batches: Batches) -> Batches:
        for batch in batches:
            out = [t and redacted(t, spans_of(t, threshold)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    out = docs.mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
