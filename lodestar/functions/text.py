"""Tokenizers, sentence splitting and text scores as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN, COMPOUND = "[A-Za-z0-9]+", "[0-9A-Za-z]+(?:[_-][0-9A-Za-z]+)*"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GRAPH_STOPWORDS = "that this the and with from into also which uses should pattern category source brain mined python".split()
ABBREVIATIONS = "ref eq fig vol no ltd inc est dept approx al etc i.e e.g vs st jr sr prof ms mrs mr dr".split()


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits (lowered after they are cut)."""
    return F.transform(found(text, PLAIN), lambda t: F.lower(t))


def compound_tokens(text: Column) -> Column:
    """The same, with single hyphens and underscores inside: ``BM25-style`` is one token."""
    return F.transform(found(text, COMPOUND), lambda t: F.lower(t))


def long_tokens(text: Column) -> Column:
    """Tokens of two characters or more, of the lower-cased text."""
    return F.filter(found(F.lower(text), "[a-z0-9]+"), lambda t: F.length(t) > 1)


def graph_tokens(text: Column) -> Column:
    """Distinct tokens of four characters or more without the graph's stopwords."""
    own = found(F.lower(text), "[a-z0-9_]+")
    return F.array_distinct(F.filter(own, lambda t: (F.length(t) >= 4) & ~t.isin(*GRAPH_STOPWORDS)))


def expanding_tokens(text: Column, expansions: dict[str, list[str]], stopwords: list[str]) -> Column:
    """Tokens without stopwords, each followed by what its abbreviation stands for."""
    own = F.filter(found(F.lower(text), "[a-zA-Z0-9]+"), lambda t: ~F.array_contains(strings(stopwords), t))
    if not expansions:
        return own
    table = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), strings(v))])
    return F.flatten(F.transform(own, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def sentences(text: Column, boundary: str = r"(?<=[!?.])\s+") -> Column:
    """Trimmed, non-blank pieces between sentence boundaries."""
    return F.filter(F.transform(F.split(text, boundary), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: s != "")


def is_heading(line: Column) -> Column:
    """A line with ``#``, or a short one that starts with a capital or digit and has no closing punctuation."""
    bare = F.trim(line)
    titled = (F.length(bare) < 80) & ~F.substring(bare, -1, 1).isin(*".!?:;,") & bare.rlike(r"^[\p{Lu}\p{Nd}]")
    return (bare != "") & (bare.startswith("#") | titled)


def _abbreviated(text: Column) -> Column:
    """Whether a text ends with a known abbreviation or a single capital, and a period."""
    words = found(text, "[a-zA-Z][.a-zA-Z]*")
    last = F.rtrim(F.element_at(words, -1), F.lit("."))
    known = F.lower(last).isin(*ABBREVIATIONS) | last.rlike("^[A-Z]$")
    return text.endswith(".") & (F.size(words) > 0) & F.coalesce(F.when(F.size(words) > 0, known), F.lit(False))


def careful_sentences(text: Column) -> Column:
    """Sentences line by line; headings stay whole; splits after abbreviations and initials are undone, in one fold a line."""
    empty = F.array().cast("array<string>")

    def of_line(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, r"(?<=[!?.])\s+(?=[A-Z\d(\[\"'])"), lambda x: F.trim(x)), lambda s: s != "")

        def add(done: Column, part: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            glued = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), part)))
            return F.when((F.size(done) > 0) & _abbreviated(last), glued).otherwise(F.concat(done, F.array(part)))

        return F.when(line.startswith("#"), F.array(line)).otherwise(F.aggregate(parts, empty, add))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda s: s != "")
    return F.flatten(F.transform(lines, of_line))


def _ramp(value: Column, low: float, width: float) -> Column:
    """0 up to ``low``, then linear to 1 over ``width``."""
    return F.least(F.greatest((value - F.lit(low)) / F.lit(width), F.lit(0.0)), F.lit(1.0))


TECHNICAL = r"\b(?:[A-Z]?[a-z]+[A-Z][0-9A-Za-z]*|[a-zA-Z]+[0-9]+[a-zA-Z]*|[0-9]+[a-zA-Z]+[0-9a-zA-Z]*)\b"
CITED = r"\[[0-9]+\]|[(](?:[A-Z][a-z]+)(?:\s+et\s+al[.]?)?\s*,?\s*[0-9]{4}[)]"
LISTED = r"(?:\n|^)\s*(?:[*+-]|[0-9]+[).]\s)"
COMPLEXITY_WEIGHTS = dict(n_sentences=0.10, sentence_length=0.15, diversity=0.15, technical=0.20, citations=0.10, lists=0.10, numbers=0.20)


#: Classes of a word's characters: any but white space, and those that are no punctuation either.
_CHAR, _INNER = r"[^\s]", "[^\\s" + "".join("\\" + c for c in PUNCTUATION) + "]"


def complexity_parts(text: Column) -> dict[str, Column]:
    """The seven heuristics, each from 0 to 1.

    Words are runs between white space without the punctuation round them. All counts are those of one expression over
    the whole text each, so that no array of words is built but for the distinct ones, and nothing leaves generated code.
    """
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    tokens, n = count(f"{_CHAR}+"), count(f"{_INNER}{_CHAR}*")
    m = F.when(tokens > 0, 1 + count(r"(?<=[!?.])\s+(?=[^\s])")).otherwise(0)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({_INNER}(?:{_CHAR}*{_INNER})?)"), F.lit(1))))
    share = lambda some: F.when(n > 0, some / n).otherwise(0.0)
    return {
        "n_sentences": _ramp(m.cast("double"), 1.0, 9.0),
        "sentence_length": F.when(m > 0, _ramp(tokens / m, 8.0, 22.0)).otherwise(0.0),
        "diversity": F.when(n > 0, _ramp(distinct / n, 0.3, 0.6)).otherwise(0.0),
        "technical": _ramp(share(count(TECHNICAL) + count(f"{_INNER}{_CHAR}{{11,}}{_INNER}")), 0.0, 0.08),
        "citations": _ramp(share(count(CITED)), 0.0, 0.03),
        "lists": _ramp(share(count(LISTED)), 0.0, 0.05),
        "numbers": _ramp(share(count(rf"\p{{Nd}}{_CHAR}*")), 0.0, 0.20),
    }


def complexity(parts: dict[str, Column]) -> Column:
    """Weighted sum, 0 to 1, not rounded."""
    total = sum((F.coalesce(parts[k], F.lit(0.0)) * F.lit(w) for k, w in COMPLEXITY_WEIGHTS.items()), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def complexity_label(score: Column) -> Column:
    return F.when(score <= 0.33, "low").when(score <= 0.66, "medium").otherwise("high")


#: name: (weight in the panel's mean, weight in the storage score, words)
PANEL = {
    "accuracy_criticality": (1.25, 0.25, "compliance contraindicated critical must never safety security warning"),
    "context_sovereignty": (1.15, 0.10, "citation context evidence grounded provenance reference verified"),
    "emergence_leverage": (1.25, 0.15, "capability cascade emergent feedback leverage recursive synergy"),
    "methodology": (1.10, 0.20, "algorithm gate pipeline procedure protocol schema workflow"),
    "novelty": (1.15, 0.20, "alien breakthrough first-principles frontier novel unprecedented"),
    "reproducibility": (1.00, -0.30, "basic boilerplate default generic import standard template trivial"),
    "usability": (1.10, 0.0, "actionable command executable gate prompt score test validator"),
}


def panel_votes(text: Column) -> dict[str, Column]:
    """One vote from 0 to 1 for each expert: word hits over 5.

    The words of all experts are found in one pass; what is counted is the short array of hits.
    """
    words = sorted({w for _, _, own in PANEL.values() for w in own.split() if w.isalnum()})
    hits = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9])((?i:{'|'.join(words)}))(?![A-Za-z0-9])"), F.lit(1)), F.lower)
    vote = lambda found, own: F.least(F.size(F.filter(found, lambda t: t.isin(*own.split()))) / F.lit(5.0), F.lit(1.0))
    votes = F.transform(F.array(hits), lambda found: F.struct(*[vote(found, own).alias(name) for name, (_, _, own) in PANEL.items()]))[0]
    return {name: votes[name] for name in PANEL}


def panel_mean(votes: dict[str, Column]) -> Column:
    total = sum(w for w, _, _ in PANEL.values())
    return F.round(sum((votes[k] * F.lit(w) for k, (w, _, _) in PANEL.items()), F.lit(0.0)) / F.lit(total), 6)


def panel_storage(votes: dict[str, Column], complexity_score: Column) -> Column:
    return F.round(sum((votes[k] * F.lit(s) for k, (_, s, _) in PANEL.items()), F.lit(0.0)) + complexity_score * F.lit(0.10), 6)


def contract_tier(votes: dict[str, Column]) -> Column:
    accuracy = F.coalesce(votes["accuracy_criticality"], F.lit(0.0))
    return F.when(accuracy >= 0.6, "hard").when(accuracy >= 0.35, "medium").otherwise("soft")


def _first_role(votes: dict[str, Column], names: tuple[str, str, str, str]) -> Column:
    v = {k: F.coalesce(c, F.lit(0.0)) for k, c in votes.items()}
    frontier = (v["novelty"] >= 0.5) | (v["emergence_leverage"] >= 0.5)
    return F.when(v["context_sovereignty"] >= 0.45, names[0]).when(v["methodology"] >= 0.5, names[1]).when(frontier, names[2]).otherwise(names[3])


def concept_type(votes: dict[str, Column]) -> Column:
    return _first_role(votes, ("context_sovereignty_rule", "methodology", "frontier_concept", "operational_hint"))


def emergence_role(votes: dict[str, Column]) -> Column:
    return _first_role(votes, ("constrain", "route", "seed", "support"))


def routing_tag(complexity_score: Column, panel_score: Column) -> Column:
    """Missing scores count as 0.5."""
    c, p = F.coalesce(complexity_score, F.lit(0.5)), F.coalesce(panel_score, F.lit(0.5))
    return F.when((c > 0.66) | (p > 0.7), "deep").when((c <= 0.33) & (p <= 0.3), "fast").otherwise("standard")


def stable_id(source: Column, text: Column) -> Column:
    """``doc_`` and 16 hex digits of the SHA-256 of source, a zero byte, and text."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(F.encode(source, "UTF-8"), F.lit(b"\0"), F.encode(text, "UTF-8")), 256), 1, 16))


def markdown_title(text: Column, stem: Column) -> Column:
    """The first line that starts with ``# ``, else the file's stem."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\s*# (.*)$", 1)), F.lit("")), stem)


def parsed_title(text: Column, fallback: Column) -> Column:
    """A ``#`` line among the first 20, else the first of 10 lines longer than 3 characters; 120 characters at most."""
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x))
    marked = F.filter(F.slice(lines, 1, 20), lambda s: s.startswith("#"))
    bare = F.filter(F.transform(marked, lambda s: F.trim(F.ltrim(s, F.lit("#")))), lambda s: s != "")
    long = F.filter(F.slice(lines, 1, 10), lambda s: F.length(s) > 3)
    return F.substring(F.coalesce(F.try_element_at(bare, F.lit(1)), F.try_element_at(long, F.lit(1)), fallback), 1, 120)


def slug(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-"))


def squeezed(value: Column) -> Column:
    """Lower case, white space runs as one blank."""
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def item_text(text: Column, chunk_text: Column) -> Column:
    """Text of an item: its own, if it has one, else its chunk's, else empty."""
    return F.coalesce(text, chunk_text, F.lit(""))


def item_source(source: Column, chunk_source: Column, metadata: Column, document_id: Column, doc_id: Column, key: Column) -> Column:
    """Source of an item: the first that is not empty of its own, its chunk's, its metadata's (source, document_id, doc_id), and its ids."""
    kept = [F.try_element_at(metadata, F.lit(k)) for k in ("source", "document_id", "doc_id")]
    return _filled(source, chunk_source, *kept, *(c.cast("string") for c in (document_id, doc_id, key)))
