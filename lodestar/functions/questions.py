"""What a question asks for, and the search parameters that follow, as columns over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 10_000


def valid(question: str) -> str:
    """The stripped question; ValueError unless it is a string of 1 to 10,000 characters."""
    if not isinstance(question, str) or not question.strip():
        raise ValueError("a question must be a string that is not blank")
    if len(question.strip()) > MOST_CHARS:
        raise ValueError(f"a question has at most {MOST_CHARS} characters")
    return question.strip()


def marks(q: Column, mark: str) -> Column:
    return F.length(q) - F.length(F.replace(q, F.lit(mark), F.lit("")))


def any_in(q: Column, words: str) -> Column:
    """Whether any of the ``|``-separated phrases is a substring."""
    return q.rlike("|".join(words.split("|")))


def simple_type(question: Column) -> Column:
    """First of synthesis, specification, logic that applies, by phrases anywhere in the text; else summary."""
    q = F.lower(F.trim(question))
    return (
        F.when((marks(q, "?") > 1) | any_in(q, "compare|contrast|synthesi[sz]e|versus"), "synthesis")
        .when(q.rlike("^(what is|definition of|define|describe)"), "specification")
        .when(any_in(q, "because|cause|explain|how|reason|why"), "logic")
        .otherwise("summary")
    )


#: (kind, points, what is looked for). ``+`` rules give points for each phrase, ``~`` rules for a match, if also the guard holds.
SIGNALS: list[tuple[str, float, str, str]] = [
    ("synthesis", 3.0, "+", "and clinical|and emergency|and pharmacovigilance|as well as|across different|both|differ between|overall themes|themes across|versus|work together"),
    ("synthesis", 2.5, "words > 10 and not study", r"\bcompare\b"),
    ("logic", 2.0, "not study", r"\bcompare\b"),
    ("synthesis", 2.0, "words > 14", r"\bhow do\b"),
    ("synthesis", 2.5, "commas > 0", r"\bacross\b"),
    ("synthesis", 1.0, "words > 14", " and "),
    ("summary", 3.0, "+", "briefly|high level|main points|overview|summarize"),
    ("summary", 2.5, "+", "current evidence|the evidence on|what approaches|what are recent advances|what are the perspectives|what role does"),
    ("summary", 2.5, "", r"\bhow (?:are|is) .+ being\b"),
    ("summary", 1.5, "+", "advances in|applications|evidence for|evidence on|perspectives on|what is the current"),
    ("summary", 2.5, "words <= 5", r"^what is \w+\??$"),
    ("summary", 2.5, "words <= 4", r"^(?:describe|explain)(?:\s|$)"),
    ("logic", 3.0, "", r"\bwhy\b"),
    ("logic", 2.5, "words <= 14", r"\bhow does \w+ \w+\b"),
    ("logic", 2.5, "", r"\bhow do \w+ \w+ (?:assist|classify|detect|enhance|identify|improve|predict)\b"),
    ("logic", 2.5, "not being", r"\bhow are .+ (?:used|applied) to\b"),
    ("logic", 2.0, "+", "barriers|benefits and challenges|cause|challenges|connected|difference|effective for|explain the relationship|obstacles|preventing|what if"),
    ("logic", 2.0, "", r"\beffect\b"),
    ("logic", 1.5, "not being", r"\bhow does\b"),
    ("logic", 2.0, "words <= 8 and not being", r"\bhow are\b"),
    ("specification", 3.0, "+", "exact|how many|list|name the"),
    ("specification", 2.5, "", r"\bwhat (?:brain |clinical |data |retinal |specific |type of |types of )"),
    ("specification", 2.5, "study", ""),
    ("specification", 2.0, "", r"\bin what\b"),
    ("specification", 1.5, "words <= 10", r"^what is the \w+"),
    ("specification", 1.5, "+", "clause|code|detail|policy|procedure|section|specific|version"),
]
STUDY = r"\bthe (?:overview of|paper|randomized trial|review|study|systematic review|trial)\b"
KINDS = ("synthesis", "summary", "logic", "specification")


def signal_scores(question: Column, expected: list[str] | None = None) -> dict[str, Column]:
    """Points of each kind; kinds that the corpus' profile expects get half a point."""
    q = F.lower(F.trim(question))
    guards = {"words": F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")), "study": q.rlike(STUDY), "being": q.contains("being"), "commas": marks(q, ",")}

    def holds(guard: str) -> Column:
        out = F.lit(True)
        for part in filter(None, guard.split(" and ")):
            if part[:4] == "not ":
                out &= ~guards[part[4:]]
            elif " " in part:
                name, op, number = part.split()
                out &= {">": guards[name] > int(number), "<=": guards[name] <= int(number)}[op]
            else:
                out &= guards[part]
        return out

    scores = {k: F.lit(0.5 if expected and k in expected else 0.0) for k in KINDS}
    found: dict[str, list[Column]] = {k: [] for k in KINDS}
    for kind, points, guard, what in SIGNALS:
        if guard == "+":
            found[kind] += [F.when(q.contains(p), points).otherwise(0.0) for p in what.split("|")]
        else:
            found[kind].append(F.when(holds(guard) & (q.rlike(what) if what else F.lit(True)), points).otherwise(0.0))
    summary = sum(found["summary"], F.lit(0.0))
    found["specification"].append(F.when(q.rlike(r"^what(?:\s|$)") & (guards["words"] < 14) & (summary == 0), 1.0).otherwise(0.0))
    return {k: sum(found[k], scores[k]) for k in KINDS}


def best_kind(scores: dict[str, Column]) -> Column:
    """The kind of most points; ties go to synthesis, summary, logic, specification in that order."""
    most = F.greatest(*[scores[k] for k in KINDS])
    out = F.when(scores[KINDS[0]] == most, KINDS[0])
    for k in KINDS[1:]:
        out = out.when(scores[k] == most, k)
    return out


#: kind: document, paragraph and sentence weights; derivative multiplier; results a level
LEVELS = {"specification": (0.15, 0.30, 0.55, 1.8, 4), "summary": (0.55, 0.30, 0.15, 0.5, 2), "logic": (0.25, 0.40, 0.35, 1.5, 3), "synthesis": (0.35, 0.40, 0.25, 1.0, 3)}


def level_weights(kind: Column) -> Column:
    """Struct ``w2, w1, w0, deriv, k`` of a kind; null for others."""
    out = None
    for name, (w2, w1, w0, d, k) in LEVELS.items():
        row = F.struct(F.lit(w2).alias("w2"), F.lit(w1).alias("w1"), F.lit(w0).alias("w0"), F.lit(d).alias("deriv"), F.lit(k).alias("k"))
        out = F.when(kind == name, row) if out is None else out.when(kind == name, row)
    return out


#: kind: dense k, sparse k, dense and sparse weight, final k, diversity, least confidence
SEARCH = {
    "specification": (10, 20, 0.7, 0.3, 5, 0.0, 0.5),
    "summary": (20, 30, 0.6, 0.4, 10, 0.2, 0.35),
    "logic": (15, 25, 0.65, 0.35, 8, 0.1, 0.4),
    "synthesis": (30, 50, 0.5, 0.5, 15, 0.4, 0.3),
}


def search_params(kind: Column, question: Column, corpus_size: Column) -> dict[str, Column]:
    """Search depth and weights of each question; unknown kinds count as summary."""
    of = lambda i: F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in SEARCH.items()], F.lit(SEARCH["summary"][i]))
    larger = lambda k: F.when(corpus_size > 50, (k * F.lit(1.5)).cast("int")).otherwise(k)
    tiny = (corpus_size > 0) & (corpus_size < 10)
    several, long = marks(question, "?") > 1, F.length(question) > 100
    final = F.when(tiny, F.least(of(4), corpus_size)).otherwise(of(4)) + F.when(several, 5).otherwise(0)
    total = of(2) + of(3)
    return {
        "dense_k": (larger(of(0)) + F.when(several, 10).otherwise(0) + F.when(long, 5).otherwise(0)).cast("int"),
        "sparse_k": larger(of(1)).cast("int"),
        "dense_weight": F.round(of(2) / total, 6),
        "sparse_weight": F.round(of(3) / total, 6),
        "final_k": F.greatest(final, F.lit(3)).cast("int"),
        "diversity": F.round(F.least(F.greatest(of(5), F.lit(0.0)), F.lit(0.6)), 6),
        "min_confidence": F.round(F.least(F.greatest(of(6) - F.when(tiny, 0.1).otherwise(0.0), F.lit(0.2)), F.lit(0.8)), 6),
    }


DOMAINS = {
    "ai_clinical_decision": "clinical decision|clinical support|clinical workflow|diagnosis|ehr|electronic health record|emr|patient outcome|patient safety|triage",
    "ai_drug_discovery_pharma": "adverse drug|cytochrome|drug|drug discovery|drug metabolism|medication|pharmaceutical|pharmacogenomics|pharmacovigilance|therapeutic drug",
    "ai_public_health_tic": "epidemic|health informatics|pandemic|population health|public health|remote monitoring|surveillance|telehealth|telemedicine|wearable",
    "ai_radiology_pathology": "computer vision|ct scan|diagnostic imaging|fundus|histopathology|imaging|medical imaging|mri|pathology|radiograph|radiology|retinal|scan|x-ray",
    "ai_surgery_robotics": "haptic|laparoscopic|operative|robot-assisted|robotic|surgery|surgical|teleoperation",
    "nlp_medical": "bert|clinical notes|clinical text|information extraction|language model|medical text|named entity|natural language|nlp|text mining",
}
DOMAIN_ORDER = ("ai_radiology_pathology", "ai_clinical_decision", "ai_drug_discovery_pharma", "nlp_medical", "ai_surgery_robotics", "ai_public_health_tic")


def domain_hints(question: Column) -> Column:
    """Struct ``boost, targets``: 0.05 for a clear domain, 0.03 for each of several, null without a sign of any."""
    q = F.lower(question)
    hits = F.array(*[F.struct(F.size(F.filter(F.split(F.lit(DOMAINS[d]), r"\|"), lambda p: q.contains(p))).alias("n"), F.lit(-i).alias("at"), F.lit(d).alias("d")) for i, d in enumerate(DOMAIN_ORDER)])
    some = F.reverse(F.array_sort(F.filter(hits, lambda h: h["n"] > 0)))
    names = F.transform(some, lambda h: h["d"])
    clear = (some[0]["n"] >= 2) | (F.size(some) == 1)
    return F.when(F.size(some) == 0, F.lit(None)).when(clear, F.struct(F.lit(0.05).alias("boost"), F.slice(names, 1, 1).alias("targets"))).otherwise(F.struct(F.lit(0.03).alias("boost"), names.alias("targets")))


#: What a corpus' profile stands for: by complexity, accuracy, tolerance of invention, and priority.
PROFILE = {
    "complexity": dict(high=(80, 3, 0.40, 10, 4), medium=(120, 2, 0.25, 6, 3), low=(180, 1, 0.15, 3, 2)),
    "accuracy": dict(low=0.55, medium=0.65, high=0.72, critical=0.78),
    "invention": dict(high="creative", medium="balanced", low="strict", zero="strict"),
    "priority": dict(speed=(0.6, 1.3), balanced=(1.0, 1.0), precision=(1.6, 0.8)),
}


def profile_params(complexity: str = "medium", accuracy: str = "medium", invention: str = "medium", priority: str = "balanced") -> dict:
    """Chunk size, derivative depth, adapter strength, thresholds and biases of a profile; KeyError for unknown values."""
    size, depth, strength, metadata, k = PROFILE["complexity"][complexity]
    derivative, balance = PROFILE["priority"][priority]
    return {
        "chunk_size": size, "derivative_depth": depth, "most_sentences": 4 * depth, "adapter_strength": strength, "metadata_fields": metadata, "k_per_level": k,
        "threshold": PROFILE["accuracy"][accuracy], "mode": PROFILE["invention"][invention], "derivative_bias": derivative, "level_balance": balance,
    }
