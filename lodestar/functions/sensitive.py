"""Patterns of personal and health data: counts and redaction by native expressions, spans by an Arrow UDF."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PII = {
    "credit_card": r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b",
    "email": r"\b[0-9A-Za-z%+._-]+@[0-9A-Za-z.-]+[.][A-Za-z]{2,}\b",
    "phone": r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
PHI = {
    "dob": r"(?i)\bDOB[\s:]*[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b",
    "mrn": r"(?i)\bMRN[\s:]*[0-9]{6,10}\b",
    "patient_name": r"\bPatient[:\s]*(?:[A-Z][a-z]+\s)+[A-Z][a-z]+",
}
SPANS = "array<struct<type:string,pattern:string,start:int,end:int>>"


def pattern_counts(text: Column) -> dict[str, Column]:
    return {name: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long") for name, p in (PII | PHI).items()}


def redacted(text: Column, patterns: dict[str, str] = PII) -> Column:
    """Every match replaced, pattern by pattern; exact where matches of different patterns don't overlap."""
    for pattern in patterns.values():
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def _spans(text: str | None, pii: bool, phi: bool) -> list[dict]:
    out = []
    for kind, on, patterns in (("pii", pii, PII), ("phi", phi, PHI)):
        for name, pattern in patterns.items() if on else ():
            out += [{"type": kind, "pattern": name, "start": m.start(), "end": m.end()} for m in re.finditer(pattern, text or "")]
    return sorted(out, key=lambda s: s["start"])


def spans(docs: DataFrame, pii: bool = True, phi: bool = True) -> DataFrame:
    """``docs`` with ``spans``: all matches, overlapping ones of different patterns too, by start; null texts have none."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _spans(t, pii, phi))

    return docs.withColumn("spans", found("text"))


#: Kinds of entities that count as personal data; all others, unknown ones too, count as health data.
PERSONAL = frozenset("PERSON EMAIL PHONE SSN ADDRESS CREDIT_CARD IP_ADDRESS URL USERNAME PASSWORD".split())


def _entities(text: str, reply: str) -> list[dict]:
    """Spans of a model's reply, a JSON array of {value, type, start} somewhere in it.

    The value is looked for within 20 characters of where it is said to be, else anywhere; what the text lacks is dropped.
    """
    a, b = reply.find("["), reply.rfind("]")
    try:
        listed = json.loads(reply[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        return []
    out = []
    for e in listed:
        value = str(e.get("value") or "") if isinstance(e, dict) else ""
        if not value:
            continue
        said = e.get("start")
        said = said if isinstance(said, int) and said >= 0 else None
        near = text.find(value, max(0, said - 20), said + len(value) + 20) if said is not None else -1
        at = near if near >= 0 else text.find(value)
        if at >= 0:
            kind = str(e.get("type") or "UNKNOWN").upper()
            out.append({"type": "pii" if kind in PERSONAL else "phi", "pattern": f"model_{kind.lower()}", "start": at, "end": at + len(value)})
    return out


def entity_spans(docs: DataFrame, load) -> DataFrame:
    """``docs`` (text, spans) with the spans of a plug-in model added: ``load() -> (text -> reply)``, once a worker; a failing model adds none."""

    @F.pandas_udf(SPANS)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()

        def one(text, own):
            try:
                more = _entities(text, model(text) or "") if text is not None else []
            except Exception:
                more = []
            return sorted([*map(dict, own), *more], key=lambda s: s["start"])

        for texts, spans_ in batches:
            yield pd.Series([one(t, o) for t, o in zip(texts, spans_)])

    return docs.withColumn("spans", found("text", "spans"))


def redact_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text, spans) with ``redacted``: distinct spans replaced from right to left, so overlaps go by that order."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, found):
            for start, end in sorted({(s["start"], s["end"]) for s in own}, key=lambda s: -s[0]) if text is not None else ():
                text = text[:start] + "[REDACTED]" + text[end:]
            out.append(text)
        return pd.Series(out)

    return docs.withColumn("redacted", cut("text", "spans"))
