"""Text functions as column expressions: compression, similarity, redaction, sanitising and importance."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

# A word boundary of ASCII word characters, on either side of a pattern.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class LanguagePack:
    """Rules of one language for lossless compression."""

    fillers: tuple[str, ...] = ()
    abbreviations: tuple[tuple[str, str], ...] = ()
    pleasantry_line: str = "(?!)"
    trailing_thanks: str = "(?!)"
    leading_welcome: str = "(?!)"


# Phrase lists that results depend on.
EN = LanguagePack(
    ("well", "so basically", "you know", "i mean", "actually", "just to be clear", "like"),
    (("for example", "e.g."), ("that is", "i.e."), ("in other words", "i.e.")),
    r"^(?:thanks?|thank you|you'?re welcome|thanks so much|no problem|my pleasure|np|ty|thx)[\s!.]*$",
    r"\n*(?:thanks?|thank you)[!.]*\s*$",
    r"^(?:you'?re welcome|no problem|my pleasure)[!.]*\s*",
)
DE = LanguagePack(
    ("naja", "also", "eigentlich", "quasi", "sozusagen"),
    ((r"zum\s+Beispiel", "z. B."), (r"das\s+hei(?:ss|ß)t", "d. h."), (r"mit\s+anderen\s+Worten", "d. h.")),
    r"^(?:danke|danke\s+schön|danke\s+dir|danke\s+Ihnen|vielen\s+dank|bitte|gern\s+geschehen|keine\s+ursache|tschüss|tschüs)[\s!.]*$",
    r"\n*(?:danke|danke\s+schön|danke\s+dir|danke\s+Ihnen|vielen\s+dank)[!.]*\s*$",
    r"^(?:bitte|gern\s+geschehen|keine\s+ursache)[!.]*\s*",
)
MINIMAL = LanguagePack()
_PACKS: dict[str, LanguagePack] = {"en": EN, "de": DE, "minimal": MINIMAL}


def register_pack(tag: str, pack: LanguagePack) -> None:
    _PACKS[tag.lower()] = pack


def unregister_pack(tag: str) -> None:
    _PACKS.pop(tag.lower(), None)


def known_packs() -> list[str]:
    return sorted(_PACKS)


def resolve_pack(tag: str | None) -> LanguagePack:
    """The pack of a tag, of its base language, or English."""
    tag = (tag or "en").lower()
    return _PACKS.get(tag) or _PACKS.get(tag.split("-")[0]) or EN


def strip_fillers(text: Column, pack: LanguagePack = EN) -> Column:
    for phrase in pack.fillers:
        text = F.regexp_replace(text, f"(?i){_B}{phrase},?\\s+", " ")
    return text


def abbreviate(text: Column, pack: LanguagePack = EN) -> Column:
    for phrase, short in pack.abbreviations:
        text = F.regexp_replace(text, f"(?i){_B}{phrase}{_E}", short)
    return text


def collapse_space(text: Column) -> Column:
    """Lines trimmed and single-spaced; of blank lines in a row the first stays; outer space goes."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r\f\x0b")), r"\s+", " "))
    kept = F.filter(lines, lambda x, i: (x != "") | (i == 0) | (F.get(lines, i - 1) != ""))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \n\t\r\f\x0b"))


def drop_pleasantry_lines(text: Column, pack: LanguagePack = EN) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.btrim(x).rlike(f"(?i){pack.pleasantry_line}")), "\n")


@dataclass(frozen=True)
class Lossless:
    """Steps of lossless compression, each of which can be left out."""

    pack: LanguagePack = field(default=EN)
    fillers: bool = True
    abbreviations: bool = True
    space: bool = True
    pleasantries: bool = True

    def __call__(self, text: Column) -> Column:
        for on, step in ((self.fillers, lambda t: strip_fillers(t, self.pack)), (self.abbreviations, lambda t: abbreviate(t, self.pack)), (self.space, collapse_space), (self.pleasantries, lambda t: drop_pleasantry_lines(t, self.pack))):
            text = step(text) if on else text
        return text

    def without(self, step: str) -> Lossless:
        return replace(self, **{step: False})


def ascii_words(text: Column) -> Column:
    """Distinct lower-case words of a-z and 0-9."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))


def comparable(text: Column) -> Column:
    """Lower-case letters and digits of any script, single-spaced."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; both empty 1, one empty 0. Each array is evaluated once."""
    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.lit(1), F.size(x["a"]) + F.size(x["b"]) - both))

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), 0)


def word_similarity(a: Column, b: Column) -> Column:
    return set_similarity(ascii_words(a), ascii_words(b))


def text_similarity(a: Column, b: Column, long: int = 160) -> Column:
    """Of comparable texts: equal 1, one empty 0, short ones the better of words and edits, long ones words alone."""
    words = set_similarity(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    size = F.greatest(F.length(a), F.length(b))
    edits = 1 - F.levenshtein(a, b) / F.greatest(size, F.lit(1))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(size <= long, F.greatest(words, edits)).otherwise(words)


# Default patterns of observability redaction, in order.
REDACTIONS = (
    rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}",
    rf"(?i){_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_E}",
    rf"{_B}(?:\d{{4}}[-\s]?){{3}}\d{{4}}{_E}",
    rf"{_B}3[47]\d{{13}}{_E}",
)
# Default patterns of prompt injection, in order.
INJECTIONS = (
    rf"(?i){_B}ignore\s+all\s+previous\s+instructions{_E}",
    rf"(?i){_B}ignore\s+(?:any|all)\s+(?:previous\s+)?(?:instructions?|prompts?|rules?){_E}",
    rf"(?i){_B}disregard\s+(?:all|any|previous)\s+(?:instructions?|prompts?){_E}",
    rf"(?i){_B}you are now (?:in|a) ['\"]?DAN['\"]?{_E}",
    r"(?im)(?:^|\s)system\s*:\s*",
    r"(?i)\[INST\]",
    r"(?i)<\|im_start\|>",
    r"(?i)<\|im_end\|>",
)


def redact(text: Column, patterns: tuple[str, ...] = REDACTIONS, mark: str = "[REDACTED]") -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, mark.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def redact_all(value: Column, kind, **how) -> Column:
    """Strings anywhere inside a column of the given type; numbers and field names stay."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return redact(value, **how)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_all(x, kind.elementType, **how))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: redact_all(x, kind.valueType, **how))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_all(value[f.name], f.dataType, **how).alias(f.name) for f in kind]))
    return value


def sanitise(text: Column, patterns: tuple[str, ...] = INJECTIONS) -> Column:
    """Injection phrases become a space, then runs of spaces collapse."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, " ")
    return F.btrim(F.regexp_replace(text, r"\s{2,}", " "))


def sanitise_input(text: Column) -> Column:
    """Without control characters other than tab, newline and carriage return."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "")


def truncate_with_mark(text: Column, tokens: int, mark: str = "…[truncated]") -> Column:
    """A tool result cut to about this many tokens."""
    if tokens <= 0:
        return F.lit("")
    size = max(4, tokens * 4 - 16)
    return F.when(F.length(text) <= tokens * 4, text).otherwise(F.concat(F.substring(text, 1, size), F.lit(mark)))


def last_resort(text: Column, tokens: int) -> Column:
    """Cut to 4 characters a token, at the last space if that keeps over half, with an ellipsis."""
    size = max(0, tokens) * 4
    head = F.substring(text, 1, size)
    at = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    whole = (F.instr(F.reverse(head), " ") > 0) & (at > size * 0.5)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.when(whole, F.substring(head, F.lit(1), at)).otherwise(head), F.lit("…")))


def importance(text: Column) -> Column:
    """A structural score: names, numbers, code, links, lists, key-value pairs, length and diversity."""
    # Patterns and weights that results depend on.
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    names = F.regexp_count(text, F.lit(rf"{_B}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+{_E}"))
    fact = text.rlike(rf"{_B}\d{{2,}}{_E}") | text.rlike(rf"{_B}\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}{_E}") | text.rlike("\"[^\"]{2,}\"|'[^']{2,}'")
    code, link = text.rlike("```[\\s\\S]*?```|`[^`\n]+`"), text.rlike(r"https?://\S+")
    listed = text.rlike(r"(?m)^[\t ]*[-*•]\s|^\s*\d+[.)]\s")
    # from a word's first letter on and without going back into it, which finds the same pairs
    pairs = F.regexp_count(text, F.lit(r"(?<!\w)\w++\s*+[:=]\s*\S+"))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 1)
    diverse = F.get(F.transform(F.array(words), lambda w: (F.size(w) >= 5) & (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) >= 0.7)), 0)
    flag = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = names / F.greatest(size, F.lit(1)) * 200 + flag(fact, 1.0) + flag(code, 1.5) + flag(link, 1.0) + flag(listed, 1.0) + F.least(F.lit(1.5), pairs * 0.5) + F.least(F.lit(1.0), size / 500) + flag(diverse, 0.5)
    return F.when(size == 0, F.lit(0.0)).otherwise(score)
