"""Names, identifiers and text cleaning as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of internal vocabulary, phrases to review and secrets.
HARD_FAIL = (r"[Ss]ession\s*\d+", r"(?i)\b\w*\d+\.(?:png|jpe?g)\b", r"(?i)session\d+/")
REVIEW = (r"(?i)\bIn this conversation,",)
SECRET = r"(?i)(?:^|[^a-z0-9])(?:sk-|or-)[A-Za-z0-9_-]{16,}|Bearer\s+[A-Za-z0-9._-]+"
REDACT = r"(?i)(?:sk-|or-)[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._-]+"
NEGATIVE_ANSWER = r"(?i)\b(?:not\s+mentioned|not\s+specified|not\s+stated|unmentioned|not\s+clear|cannot\s+be\s+determined|no\s+mention|none|n/a|false|unknown)\b"
NAMED_FILES = r"(?i)\b(?:session\s*\d+|meeting\s*\d+|photo_\d+|section_\d+|\d+\.(?:png|jpe?g))\b"
REJECTED_WHOLE = ("no", "yes", "none", "n/a", "false", "true", "")
META_PREAMBLE = (
    r"(?i)\b(?:based\s+on|according\s+to|earlier\s+discussion|in\s+(?:the|this|a)\s+conversation|in\s+(?:the|this|a)\s+dialogue|"
    r"conversations?|how\s+are\s+the\s+images?|how\s+is\s+the\s+images?|does\s+the\s+images?\s+correspond|corresponds?\s+to\s+the\s+images?|"
    r"what\s+conclusion\s+did|problematic|question'?s?\s+(?:picture|image|photo)|which\s+picture|which\s+photo|which\s+image|"
    r"sent\s+the\s+image|the\s+image\s+sent|newly\s+learned|session\s+number|image\s+file\s+name|"
    r"chronological|arrange\s+the|referred\s+to\s+(?:and|or)\s+cited|referred\s+to|referenced)\b"
)
STROKES = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i"}
CJK = r"[㐀-鿿]"
#: Unicode's space separators, which are cut off both ends of a text.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def channel_id(path: Column) -> Column:
    family, number = (F.regexp_extract(path, r"([^/]+)/dialogue(\d+)/", k) for k in (1, 2))
    return F.concat(F.when(family == "multi-party", "multiparty").otherwise("dyadic"), F.lit("_d"), number.cast("int").cast("string"))


def session_number(path: Column) -> Column:
    return F.regexp_extract(path, r"/session(\d+)/[^/]+$", 1).cast("int")


def display_candidate(role: Column) -> Column:
    """A role without its letter prefix, camel case split; null for everyone."""
    return F.when(role != "Everyone", F.regexp_replace(F.regexp_replace(role, "^[A-E]_", ""), "(?<=[a-z])(?=[A-Z])", " "))


def sender_slug(name: Column) -> Column:
    spelled = F.replace(F.replace(F.lower(name), F.lit("."), F.lit(" dot ")), F.lit("'"), F.lit(" apostrophe "))
    slug = F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug != "", F.concat(F.lit("sender_"), slug)).otherwise(F.raise_error(F.lit("no ASCII id for a name")).cast("string"))


def substituted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rules, one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "), F.lit(SPACES))


@cache
def _capitals() -> dict[str, str]:
    """Capital of each letter that has one of a single code point: where upper case is longer, title case or none; the capital of ß is \u1e9e."""
    out = {"ß": "\u1e9e"}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))):
        big = c.upper() if len(c.upper()) == 1 else c.title()
        if big != c and len(big) == 1:
            out[c] = big
    return out


def capitalised(text: Column) -> Column:
    """The first code point as its capital, which is one code point, whatever the version of the JVM."""
    table = _capitals()
    return F.concat(F.translate(F.substring(text, 1, 1), "".join(table), "".join(table.values())), F.substring(text, 2, 1 << 30))


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Numbers of the patterns that match, as an array."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), k) for k, p in enumerate(patterns))))


def redacted(text: Column) -> Column:
    """Keys and bearer tokens of eight characters or more, wherever they stand. SECRET is the stricter test of traces."""
    return F.regexp_replace(text, REDACT, "[REDACTED]")


def rejected(text: Column, patterns: tuple[str, ...] = (NEGATIVE_ANSWER, NAMED_FILES)) -> Column:
    """Any of the patterns is found, or nothing is left but a bare yes, no or the like; a null text is rejected."""
    bare = F.lower(F.trim(text)).isin(*REJECTED_WHOLE)
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)) | bare, F.lit(True))


def rejection(question: Column, answer: Column) -> Column:
    """Why a question and its answer are not kept: `answer`, `preamble`, `vocabulary`; null for a pair that is. A null answer is rejected, a null question is an empty one."""
    asked, preamble, named = F.coalesce(question, F.lit("")), F.lit(META_PREAMBLE), F.lit(NAMED_FILES)
    return F.when(rejected(answer, (NEGATIVE_ANSWER,)), "answer").when(F.rlike(asked, preamble) | F.rlike(answer, preamble), "preamble").when(F.rlike(asked, named) | F.rlike(answer, named), "vocabulary")


def synonyms(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements of whole words, whatever their case."""
    return substituted(text, [(rf"(?i)\b(?:{word})\b", other) for word, other in rules])


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_occurrences(values: Column) -> Column:
    """A list without repeats, each value where it stood first."""
    return F.array_distinct(values)


def is_ascii_safe(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]|[<>&]")


def chunk_id(channel: Column, message_ids: Column) -> Column:
    """channel:first-last without the channel's prefix in the ids; channel:empty without messages."""
    bare = lambda x: F.when(F.startswith(x, F.concat(channel, F.lit(":"))), F.substr(x, F.length(channel) + 2)).otherwise(x)
    first, last = bare(F.element_at(message_ids, 1)), bare(F.element_at(message_ids, -1))
    return F.when(F.size(message_ids) == 0, F.concat(channel, F.lit(":empty"))).otherwise(F.concat(channel, F.lit(":"), first, F.lit("-"), last))


def _bases() -> dict[str, str]:
    """Small letters up to U+1FFF that Unicode decomposes into a letter and marks, with that letter."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if c == c.lower() and marks and all(unicodedata.category(m) == "Mn" for m in marks):
            out[c] = base
    return out | STROKES


def folded_accents(text: Column) -> Column:
    """Lower case without accents: letters become those they decompose to, marks of their own go."""
    table = _bases()
    return F.regexp_replace(F.translate(F.lower(text), "".join(table), "".join(table.values())), "[\u0300-\u036f]", "")


def any_accent(text: Column) -> Column:
    """A key for joins and groups that is equal for texts that differ in case and accents alone; rows keep their own spelling."""
    return F.collate(text, "UNICODE_CI_AI")
