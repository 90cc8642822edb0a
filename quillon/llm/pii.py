"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm them, nearby words adjust the score.

A kind is searched only in texts that can hold it (an "@", a "+", digits). Splitting a text at a pattern gives the gaps between its matches,
and running sums of gaps and matches, in a logarithmic number of rounds, give positions in code points. Patterns take their runs possessively and
start only at a run's beginning, so no text costs more than one pass a kind; this leaves the matches as they are. An IBAN's
length is that of its country, so its pattern has a branch for each length and does not run on into the next word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

_LOCAL = "[A-Za-z0-9._%+-]"
#: Characters of an IBAN by country (the SWIFT registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
# Codes that the registry lacks have no known length: the longest run counts.
_IBAN += rf"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+"
#: Kind: pattern, score of a confirmed match. The first four are the base kinds, in the contract's order.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", 0.8),
    "local_phone": (r"(?<![0-9+(])\(?+[0-9]{3}\)?+[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.3),
}
BASE = tuple(PATTERNS)[:4]
#: Words that make a kind likelier when they stand in the NEAR code points before it, and what they add; other spans need THRESHOLD.
CONTEXT = {
    "email": "e-?mail|mail|contact|write", "ip": "ip|host|server|address|login", "card": "card|visa|credit|debit|pay", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer", "local_phone": "phone|tel|call|mobile|fax",
}
NEAR, BONUS, THRESHOLD = 40, 0.3, 0.5


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    each = f"int(substring({digits}, length({digits}) - i, 1)) * (1 + i % 2)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + ({each}) - 9 * int(({each}) > 9)) % 10 = 0"


def _mod97(x: str) -> str:
    turned = f"concat(substring({x}, 5), substring({x}, 1, 4))"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0L, (a, c) -> (a * if(ascii(c) > 57, 100, 10) + if(ascii(c) > 57, ascii(c) - 55, ascii(c) - 48)) % 97) = 1"


_SQUEEZED = "replace(s.hit, ' ', '')"


def _valid(kind: str) -> str:
    digits = "regexp_replace(s.hit, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(s.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
        "card": f"case when length({digits}) between 12 and 19 then {_luhn(digits)} else false end",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"length(replace(s.hit, ' ', '')) between 15 and 34 and {_mod97(_SQUEEZED)}",
        "local_phone": "true",
    }[kind]


def _candidate(kind: str, text: str) -> str:
    """Cheap test of what a match of the kind cannot do without."""
    digit = f"{text} rlike '[0-9]'"
    return {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')", "ip": f"{digit} and {text} rlike '[0-9][.][0-9]'", "card": f"{digit} and {text} rlike '[0-9](?:[ -]?[0-9]){{11}}'", "iban": f"{digit} and {text} rlike '[A-Z]{{2}}[0-9]{{2}}'", "local_phone": f"{digit} and {text} rlike '[0-9]{{3}}[ .-][0-9]{{4}}'"}[kind]


def _prefix_sums(sizes: str) -> str:
    """Running sums of an array in log2(n) rounds: in each, every element adds the one twice as far back as in the round before. A fold that appends would copy its result n times."""
    step = "transform(x, (v, i) -> v + coalesce(get(x, i - cast(shiftleft(1, k) as int)), 0))"
    return f"if(size({sizes}) < 2, {sizes}, aggregate(sequence(0, cast(ceil(log2(greatest(size({sizes}), 2))) as int) - 1), {sizes}, (x, k) -> {step}))"


def _spans(kind: str, order: int, text: str) -> Column:
    pattern, score = PATTERNS[kind]
    p = _quoted(pattern)
    one = f"array(named_struct('gaps', split({text}, {p}, -1), 'hits', regexp_extract_all({text}, {p}, 0)))"
    ends = f"transform({one}, w -> named_struct('gaps', w.gaps, 'hits', w.hits, 'sizes', transform(w.hits, (h, i) -> length(w.gaps[i]) + length(h))))"
    ends = f"transform({ends}, w -> named_struct('gaps', w.gaps, 'hits', w.hits, 'ends', {_prefix_sums('w.sizes')}))"
    # What stands before a hit, an earlier hit of its kind included.
    before = f"right(concat(coalesce(right(get(w.gaps, i - 1), {NEAR}), ''), coalesce(right(get(w.hits, i - 1), {NEAR}), ''), right(w.gaps[i], {NEAR})), {NEAR})"
    place = f"named_struct('start', w.ends[i] - length(h), 'ord', {order}, 'end', w.ends[i], 'kind', '{kind}', 'hit', h, 'before', {before})"
    found = f"flatten(transform(filter({ends}, w -> size(w.hits) > 0), w -> transform(w.hits, (h, i) -> {place})))"
    scored = (
        f"transform(filter({found}, s -> {_valid(kind)}), s -> named_struct('start', s.start, 'ord', s.ord, 'end', s.end, 'kind', s.kind, "
        f"'score', {score}D + if(lower(s.before) rlike '(?:^|[^a-z])(?:{CONTEXT[kind]})[^a-z]', {BONUS}D, 0D)))"
    )
    if kind not in BASE:
        scored = f"filter({scored}, s -> s.score >= {THRESHOLD}D)"
    kinds = "array<struct<start: int, ord: int, end: int, kind: string, score: double>>"
    return F.expr(f"case when {_candidate(kind, text)} then {scored} else cast(array() as {kinds}) end")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (start, ord, end, kind, score), in order of start, then kind; every row of docs, whole texts.

    Positions are code points, end exclusive. A null or empty text has no spans. Ids, their order and other columns play no part;
    a null id stays null, rows that repeat give repeated rows, and no rows give none.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = d.select("doc_id", *[_spans(k, i, "text").alias(f"s{i}") for i, k in enumerate(PATTERNS)])
    return parts.select("doc_id", F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(PATTERNS))])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, digest of their list, all spans as text, and the highest score of a document's spans."""
    found = find(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))

