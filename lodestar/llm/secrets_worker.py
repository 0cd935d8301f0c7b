"""Base rules for secrets, and a battery of randomness tests over other long tokens."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa

from .arrow import pieces

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The rules for keys and digits look at such runs only: a match of theirs that is long enough lies inside one.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: What the battery looks at; LEAST_BITS decides what is long enough.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{14,}")
KINDS = ("assign", "access", "hex", "random")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets by rising size, each in an order that keeps like characters together.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("lower36", LOWER + DIGITS),
    ("upper36", UPPER + DIGITS),
    ("letters", UPPER + LOWER),
    ("alnum", UPPER + LOWER + DIGITS),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("any", UPPER + LOWER + DIGITS + "+/-_="),
)
PLACES = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in ENCODINGS]
#: Bits that a token must be able to hold: below, no test has the power to tell chance from text.
LEAST_BITS = 80.0
#: Share of text among what is reported as random that is allowed for, and the level at which randomness is given up.
FDR, LEVEL = 0.05, 0.01

#: Text as the null hypothesis: shares of the letters a to z in Western European prose, in thousandths, and how classes
#: of characters (lower, upper, digit, other) follow one another in words, names, paths and numbered identifiers.
LETTERS = dict(zip(LOWER, (82, 14, 29, 43, 141, 17, 18, 40, 76, 3, 7, 42, 26, 75, 66, 24, 4, 66, 69, 79, 33, 11, 16, 3, 13, 3)))
FIRST = (0.60, 0.25, 0.13, 0.02)
FOLLOWS = ((0.88, 0.05, 0.03, 0.04), (0.70, 0.22, 0.04, 0.04), (0.10, 0.08, 0.70, 0.12), (0.50, 0.25, 0.20, 0.05))
CLASS = {c: i for i, chars in enumerate((LOWER, UPPER, DIGITS, "+/-_=")) for c in chars}
_SUM = sum(LETTERS.values())
SAID = {c: math.log(LETTERS[c.lower()] / _SUM) if c.isalpha() else -math.log(10 if c.isdigit() else 5) for c in CLASS}
LOG_FIRST, LOG_FOLLOWS = [math.log(x) for x in FIRST], [[math.log(x) for x in row] for row in FOLLOWS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, leftmost and without overlap within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in RUN.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(out)


def encoding(token: str) -> dict[str, int] | None:
    """Places of the smallest alphabet that holds a token with letters; None for numbers."""
    core = token.rstrip("=")
    if not any(c.isalpha() for c in core):
        return None
    used = set(core)
    return next((places for _, places in PLACES if used <= places.keys()), None)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    return normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(places: list[int], size: int) -> float:
    """The least of three p values, times 3: uniform use of the alphabet, runs about its middle, serial correlation."""
    n = len(places)
    groups = min(size, max(3, n // 5))
    counts, widths = [0] * groups, [0] * groups
    for p in places:
        counts[p * groups // size] += 1
    for p in range(size):
        widths[p * groups // size] += 1
    p_uniform = chi_squared_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths)), groups - 1)
    high = [2 * p >= size for p in places]
    ups = sum(high)
    downs = n - ups
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centre = sum(places) / n
    spread = sum((p - centre) ** 2 for p in places)
    lag = sum((a - centre) * (b - centre) for a, b in zip(places, places[1:]))
    p_serial = 2 * normal_tail(abs(lag / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial))


def text_odds(token: str, size: int) -> float:
    """Likelihood of a token as text over that as an even draw from an alphabet of the size, 1 at most.

    Of text, such a ratio is x or less with a chance of x at most (Markov's inequality), so it is a p value of the null
    hypothesis that the token is text.
    """
    kinds = [CLASS[c] for c in token]
    said = LOG_FIRST[kinds[0]] + sum(LOG_FOLLOWS[a][b] for a, b in zip(kinds, kinds[1:])) + sum(SAID[c] for c in token)
    return math.exp(min(0.0, said + len(token) * math.log(size)))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, end, length, p value of being text) of tokens outside the base spans whose randomness the battery doesn't give up.

    Spans are met in one pass along both lists, which are in order.
    """
    out = []
    at = reach = 0
    for run in TOKEN.finditer(text):
        a, b = run.span()
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][2])
            at += 1
        if reach > a:
            continue
        token = text[a:b].rstrip("=")
        places = encoding(token)
        if places and len(token) * math.log2(len(places)) >= LEAST_BITS:
            p = text_odds(token, len(places))
            if p < 1 and battery([places[c] for c in token], len(places)) >= LEVEL:
                out.append((a, b, len(token), p))
            else:
                out.append((a, b, len(token), 1.0))
    return out


def discoveries(tried: list[tuple[int, float]], rate: float = FDR) -> float:
    """Benjamini and Hochberg's cut over all of (length, p): what has p x mean length / length at or under it is reported.

    Long tokens, on which the tests have more power, weigh more; the weights come to 1 on average.
    """
    if not tried:
        return 0.0
    mean = sum(n for n, _ in tried) / len(tried)
    weighed = sorted(p * mean / n for n, p in tried)
    return max((p for i, p in enumerate(weighed, 1) if p <= rate * i / len(weighed)), default=0.0)


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tokens of one text, outside the base spans, that are found to be random among its own."""
    tried = candidates(text, taken)
    cut = discoveries([(n, p) for _, _, n, p in tried])
    mean = sum(t[2] for t in tried) / max(1, len(tried))
    return [(a, 3, b) for a, b, n, p in tried if p * mean / n <= cut]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_batches(batches):
    """Columns in: doc_id, text. Out: doc_id, counts and digest of the base spans, all spans and candidates by start, then kind (p is 0 for base spans)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("n", pa.int32()), ("p", pa.float64())]))
    for batch in pieces(batches):
        counts, digests, everything = ([], [], []), [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found = [(a, k, b, 0, 0.0) for a, k, b in base] + [(a, 3, b, n, p) for a, b, n, p in candidates(text, base)]
            everything.append([dict(zip(("start", "kind", "end", "n", "p"), x)) for x in sorted(found)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(everything, kind)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )
