"""QA rules: each is a column of zero or more issues; together they are one array of (rule, severity, message)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

ISSUES = "array<struct<rule:string,severity:string,message:string>>"
def none() -> Column:
    return F.array().cast(ISSUES)

CRITICAL, MODERATE = "critical", "moderate"
# Words that may stay Latin where no list is given, and the rules that mark a text for review.
WHITELIST = ("hart", "atex", "iecex", "npt", "dc", "ac", "sst", "iib", "lcd", "led", "api", "ansi", "asme", "iso", "iec", "itp", "rok", "hts", "pdf")
FLAG_RULES = ("latin_words_in_output", "possibly_untranslated", "mixed_script_token", "low_confidence", "verification_unavailable")


def whitelist(words=WHITELIST) -> Column:
    return F.array(*[F.lit(w.lower()) for w in words])


def issue(rule: str, severity: str, message: Column | str = "") -> Column:
    m = F.lit(message) if isinstance(message, str) else F.coalesce(message.cast("string"), F.lit(""))
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), m.alias("message"))


def when(cond: Column, rule: str, severity: str, message: Column | str = "") -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(issue(rule, severity, message)).cast(ISSUES)).otherwise(none())


def each(items: Column, rule: str, severity: str, message) -> Column:
    return F.transform(items, lambda x: issue(rule, severity, message(x))).cast(ISSUES)


def missing_placeholder(missing: Column) -> Column:
    return when(F.size(missing) > 0, "missing_placeholder", CRITICAL, F.concat(F.lit("tokens lost or altered: "), F.array_join(missing, ", ")))


def leaked_placeholder(target: Column) -> Column:
    return when(target.rlike(T.LEAK), "leaked_placeholder", CRITICAL, "a placeholder is still in the output")


def chinese_mismatch(source: Column, target: Column) -> Column:
    return when(T.cjk_chars(source) != T.cjk_chars(target), "chinese_mismatch", CRITICAL, "Chinese characters differ from the source")


def protected_token_mismatch(source: Column, target: Column, toks: Column) -> Column:
    cjk = lambda t: t.rlike(f"[{T.CJK}]")
    kept = F.filter(F.array_distinct(toks), lambda t: ~t.startswith("⟦") & (t.rlike("[A-Za-z]") | cjk(t)))

    def differs(t):
        p = F.when(cjk(t), T.escaped(t)).otherwise(F.concat(F.lit("(?<![A-Za-z0-9_])"), T.escaped(t), F.lit("(?![A-Za-z0-9_])")))
        return F.regexp_count(source, p) != F.regexp_count(target, p)

    return each(F.filter(kept, differs), "protected_token_mismatch", CRITICAL, lambda t: F.concat(F.lit("changed, lost or doubled: "), t))


def numeric_mismatch(source: Column, target: Column, pattern: str = T.NUMBER) -> Column:
    a, b = T.numbers(source, pattern), T.numbers(target, pattern)
    lost, added = T.multiset_minus(a, b), T.multiset_minus(b, a)
    return when((F.size(lost) > 0) | (F.size(added) > 0), "numeric_mismatch", CRITICAL, F.concat(F.lit("lost: "), F.array_join(lost, ", "), F.lit("; added: "), F.array_join(added, ", ")))


def missing_glossary_term(target: Column, terms: Column) -> Column:
    """terms: array of structs with en_term and target_term."""
    absent = F.filter(terms, lambda t: (t["target_term"] != "") & ~T.term_present(t["target_term"], target))
    return each(absent, "missing_glossary_term", MODERATE, lambda t: F.concat(F.lit("expected: "), t["target_term"], F.lit(" for "), t["en_term"]))


def suspiciously_short_output(source: Column, target: Column) -> Column:
    n = F.length(F.regexp_replace(F.regexp_replace(source, r"(?U)[.\x{2026}_\s]{4,}", " "), r"(?U)^\s+|\s+$", ""))
    return when((F.length(F.regexp_replace(target, r"(?U)^\s+|\s+$", "")) < n * 0.3) & (n > 20), "suspiciously_short_output", CRITICAL, "far shorter than the source")


def suspiciously_long_output(source: Column, target: Column) -> Column:
    return when(F.length(target) > 6 * F.length(source) + 200, "suspiciously_long_output", CRITICAL, "far longer than the source")


def empty_output(target: Column) -> Column:
    return when(~target.rlike(r"(?U)\S"), "empty_output", CRITICAL, "nothing came back")


def possibly_untranslated(source: Column, target: Column, toks: Column, listed: Column) -> Column:
    def prose(s):
        bare = T.without(s, toks)
        return bare, F.filter(F.regexp_extract_all(bare, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.array_contains(listed, F.lower(w)))

    _, source_words = prose(source)
    bare, target_words = prose(target)
    long_ones = F.size(F.filter(source_words, lambda w: F.length(w) >= 4))
    # Cyrillic among letters, listed Latin words left out.
    latin = F.aggregate(target_words, F.lit(0), lambda n, w: n + F.length(w))
    cyr = F.regexp_count(bare, F.lit(r"[\p{L}&&[\x{0400}-\x{04ff}]]"))
    others = F.regexp_count(bare, F.lit(rf"[\p{{L}}&&[^A-Za-z{T.CJK}]]"))
    letters = latin + others
    ratio = F.when(letters == 0, F.lit(1.0)).otherwise(cyr / letters)
    return when((long_ones >= 3) & (ratio < 0.3), "possibly_untranslated", MODERATE, "little Cyrillic in the output")


def homoglyph_substitution(source: Column, target: Column) -> Column:
    return each(T.lookalikes(source, target), "homoglyph_substitution", CRITICAL, lambda c: F.concat(F.lit("look-alike letters in "), c))


def latin_words_in_output(target: Column, toks: Column, listed: Column) -> Column:
    left = T.latin_leftovers(target, toks, listed)
    return when(F.size(left) > 0, "latin_words_in_output", MODERATE, F.array_join(F.slice(left, 1, 6), ", "))


def mixed_script_token(target: Column) -> Column:
    first = T.mixed_script(target)
    return when(first.isNotNull(), "mixed_script_token", MODERATE, first)


def run_checks(source: Column, target: Column, missing: Column, terms: Column, toks: Column, listed: Column | None = None) -> Column:
    """All thirteen mechanical rules in their order."""
    listed = whitelist() if listed is None else listed
    return F.concat(
        missing_placeholder(missing), leaked_placeholder(target), chinese_mismatch(source, target), protected_token_mismatch(source, target, toks), numeric_mismatch(source, target),
        missing_glossary_term(target, terms), suspiciously_short_output(source, target), suspiciously_long_output(source, target), empty_output(target),
        possibly_untranslated(source, target, toks, listed), homoglyph_substitution(source, target), latin_words_in_output(target, toks, listed), mixed_script_token(target),
    )


def has_severity(issues: Column, *severities: str) -> Column:
    return F.exists(issues, lambda i: i["severity"].isin(*severities))


def has_rule(issues: Column, *rules: str) -> Column:
    return F.exists(issues, lambda i: i["rule"].isin(*rules))


def unusable(target: Column, issues: Column) -> Column:
    return target.rlike(T.LEAK) | has_severity(issues, CRITICAL)


def bad(target: Column, issues: Column) -> Column:
    return unusable(target, issues) | (target == "") | has_rule(issues, *FLAG_RULES)


def risky(issues: Column) -> Column:
    return has_rule(issues, *FLAG_RULES, "inconsistent_translation")


def severity_rank(issues: Column, from_ocr: Column) -> Column:
    """The shade of a row: critical, moderate, ocr or none."""
    return F.when(has_severity(issues, CRITICAL), "critical").when(has_severity(issues, MODERATE), "moderate").when(from_ocr, "ocr").otherwise("none")
