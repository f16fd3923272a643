"""Scalar text functions as Columns: tokens, folding, transliteration, cleaning, snippets."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the language vote, fixed values by language.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was"],
    "de": ["der", "die", "und", "das", "von", "den", "ist", "mit", "ein", "nicht"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "est"],
    "es": ["el", "los", "las", "y", "que", "en", "por", "con", "una", "para"],
}

# Rewrites of canonical transliteration, in order (fixed values).
REWRITES = [
    ("sch", "s"), ("tsch", "c"), ("sh", "s"), ("sz", "s"), ("ch", "h"), ("kh", "h"), ("th", "t"),
    ("ph", "f"), ("ts", "c"), ("tz", "c"), ("q", "k"), ("w", "v"), ("y", "j"), ("x", "ks"),
]

#: Characters of one token of the token estimate.
CHARS_PER_TOKEN = 2.8


def words(text: Column, pattern: str = "[a-z]+") -> Column:
    """Lower-case words of ``text``; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def word_prefix_count(text: Column, prefix: str) -> Column:
    """Words that begin with ``prefix``, without regard to case."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?:^|[^a-z]){prefix}[a-z]*"))


@functools.cache
def _fold_map() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and the base letters, up to U+1FFF."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    """Text without accents: precomposed letters become their base, combining marks go. Case stays."""
    return F.regexp_replace(F.translate(text, *_fold_map()), r"\p{Mn}+", "")


def normalize_greek(text: Column) -> Column:
    return F.trim(F.translate(F.lower(fold_accents(text)), "ς", "σ"))


def normalize_hebrew(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("/"), F.lit("")), "[\\u0591-\\u05C7\\u05F3\\u05F4]", ""))


def normalize_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize(text: Column, language: Column) -> Column:
    """The fold of ``language``: Greek and Hebrew have their own, all others the words' fold."""
    return F.when(language == "grc", normalize_greek(text)).when(language == "hbo", normalize_hebrew(text)).otherwise(normalize_words(text))


def script(text: Column) -> Column:
    """hbo, grc or the default, by code points."""
    return F.when(text.rlike("[\\u0590-\\u05FF]"), "hbo").when(text.rlike("[\\u0370-\\u03FF\\u1F00-\\u1FFF]"), "grc").otherwise("pl")


def canonical_translit(text: Column) -> Column:
    """Plain letters only, rewritten in order, repeated letters once, no final h."""
    letters = F.regexp_replace(F.lower(fold_accents(F.lower(text))), "[^a-z]", "")
    rewritten = functools.reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), REWRITES, letters)
    return F.regexp_replace(F.regexp_replace(rewritten, r"(.)\1+", "$1"), "h$", "")


# Endings that a stem loses, in order (fixed values), and letters that it keeps.
STEM_ENDINGS, STEM = ("os", "on", "ou", "es", "is", "as", "a", "e", "o", "u", "y", "i"), 6


def translit_stem(key: Column, endings: tuple[str, ...] = STEM_ENDINGS, keep: int = STEM) -> Column:
    """``key`` without the first ending that leaves ``keep`` letters, or as it is; empty if it has fewer."""
    stem = F.when(F.length(key) >= keep, key).otherwise("")
    for end in reversed(endings):
        stem = F.when(key.endswith(end) & (F.length(key) - len(end) >= keep), F.left(key, F.length(key) - len(end))).otherwise(stem)
    return stem


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def language_hits(text: Column) -> Column:
    """Array of (n, lang) for every language, n the number of its stop words in ``text``.

    The words are cut once and all that are stop words of no language leave before they are counted.
    """
    every = sorted({w for stop in STOP_WORDS.values() for w in stop})
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zà-ÿœ]+")
    found = F.filter(tokens, lambda w: w.isin(every))

    def hits(words: Column, lang: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(STOP_WORDS[lang]))).alias("n"), F.lit(lang).alias("lang"))

    return let(found, lambda words: F.array(*(hits(words, lang) for lang in STOP_WORDS)))


#: Stop words that a text must have for its language to be told.
LEAST_HITS = 5


def detect_language(text: Column, ratio: float = 1.5, least: int = LEAST_HITS) -> Column:
    """The language with most stop words, ``least`` at least and ``ratio`` times the second's (or 1), else null; ties go to none."""
    ranked = F.array_sort(F.transform(language_hits(text), lambda e: F.struct((-e["n"]).alias("n"), e["lang"].alias("lang"))))
    return let(ranked, lambda r: F.when((-r[0]["n"] >= least) & (-r[0]["n"] >= ratio * F.greatest(-r[1]["n"], F.lit(1))), r[0]["lang"]))


def clean_text(text: Column) -> Column:
    """Words split at line ends joined, footnote numbers behind words left out (not those of references), blanks collapsed, at most one empty line, trimmed."""
    joined = F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    unmarked = F.regexp_replace(joined, r"(?<=[a-ząćęłńóśźż.)\]])[0-9]{1,3}(?=\s|$)", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(unmarked, "[ \t]+", " "), "\n{3,}", "\n\n"), F.lit(" \t\n\x0b\x0c\r"))


def snippet(text: Column, term: str, width: int = 220) -> Column:
    """``width`` characters around the first place of ``term`` (lower case), with ellipses where cut; null if absent."""
    at = F.locate(term, F.lower(text))
    start = F.greatest(at - width // 2, F.lit(1))
    cut = F.substr(text, start, F.lit(width))
    marked = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width - 1 < F.length(text), "…").otherwise(""))
    return F.when(at > 0, marked)


# Words of the original scripts (fixed values).
SCRIPT_WORDS = {"grc": "[Ͱ-Ͽἀ-῿]+", "hbo": "[֑-ת]+"}


@functools.cache
def _same_length_map() -> tuple[str, str]:
    """Small letters without marks for every letter that decomposes or has a small one, one for one."""
    pairs = []
    for code in range(0x41, 0x2000):
        plain = (unicodedata.normalize("NFKD", chr(code))[:1] or chr(code)).lower()
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_in_place(text: Column) -> Column:
    """``text`` in small letters without accents, each at its place."""
    return F.translate(text, *_same_length_map())


def hit_place(text: Column, targets: list[str], language: str, translits: list[str] = ()) -> Column:
    """Place (from 0) of the first word of ``language``'s script whose fold is among ``targets``, else of the first of ``translits`` in the text's fold, else null."""
    pattern = SCRIPT_WORDS[language]
    words, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    fold = normalize_greek if language == "grc" else normalize_hebrew
    hits = F.transform(words, lambda w: fold(w).isin(list(targets)))

    def length(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda total, p: total + F.length(p))

    at = let(F.array_position(hits, True).cast("int"), lambda i: F.when(i > 0, length(gaps, i) + length(words, i - 1)))
    low = fold_in_place(text)
    found = [F.nullif(F.locate(t.lower(), low), F.lit(0)) - 1 for t in translits]
    return F.coalesce(at, *found)


def snippet_at(text: Column, place: Column, width: int = 220) -> Column:
    """Half of ``width`` before a place and ``width`` behind it, trimmed, with ellipses where cut; the beginning where the place is null."""

    def cut(at: Column) -> Column:
        start, end = F.greatest(at - width // 2, F.lit(0)), F.least(F.length(text), at + width)
        part = F.btrim(F.substr(text, start + 1, end - start), F.lit(" \t\n\x0b\x0c\r"))
        return F.concat(F.when(start > 0, "… ").otherwise(""), part, F.when(end < F.length(text), " …").otherwise(""))

    return let(F.coalesce(place, F.lit(0)).cast("int"), cut)


def highlight_words(text: Column, words: list[str]) -> Column:
    """Escaped text with every match of each of ``words`` marked, one after the other."""
    shown = escape_html(text)
    for word in filter(None, words):
        escaped = word.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        shown = F.regexp_replace(shown, f"(?i)({re.escape(escaped)})", "<mark>$1</mark>")
    return shown


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(text: Column, term: str) -> Column:
    """Escaped text with every match of ``term`` marked."""
    return F.regexp_replace(escape_html(text), f"(?i)({re.escape(term)})", "<mark>$1</mark>")


def header_key(line: Column) -> Column:
    """Key of a running header: lower case, digits and white space as one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[0-9\s]+", " "))


def estimate_tokens(chars: Column) -> Column:
    return (F.floor(chars / CHARS_PER_TOKEN) + 1).cast("long")


def refusal(text: Column) -> Column:
    """Whether the first 400 characters refuse an answer."""
    return F.substr(text, F.lit(1), F.lit(400)).rlike("(?i)(no sources|cannot answer|do not contain|brak źródeł|nie zawieraj)")


def redact_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://[^\s)]+", "[url]")


def title_key(title: Column) -> Column:
    """Folded title up to its first full stop, words only."""
    return normalize_words(fold_accents(F.regexp_extract(title, r"^([^.]*)", 1)))


def strong_number(raw: Column) -> Column:
    """G or H, the number without leading zeros, a homograph letter in lower case; null if it is no such number."""
    head, number, tail = (F.regexp_extract(raw, r"^\s*([GHgh])0*([0-9]+)([A-Za-z]?)\s*$", i) for i in (1, 2, 3))
    return F.when(number != "", F.concat(F.upper(head), number, F.lower(tail)))


def seconds_mark(text: Column) -> Column:
    """Seconds of the first [h:mm:ss] or [mm:ss] mark, else null."""
    pattern = r"\[(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})\]"
    h, m, s = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return F.when(s != "", F.coalesce(F.try_to_number(h, F.lit("999")).cast("long"), F.lit(0)) * 3600 + m.cast("long") * 60 + s.cast("long"))


def license_label(text: Column) -> Column:
    """A Creative Commons label such as CC BY-NC, CC0, public domain, or null."""
    low = F.lower(text)
    parts = F.regexp_extract(low, r"cc[ -](by(?:-(?:nc|nd|sa))*)", 1)
    return F.when(low.rlike("cc0|cc zero"), "CC0").when(parts != "", F.concat(F.lit("CC "), F.upper(parts))).when(low.rlike("public domain"), "public domain")


def translation_allowed(label: Column, access: Column) -> Column:
    """Personal documents, the public domain, and Creative Commons without ND."""
    free = label.isin("CC0", "public domain") | (label.startswith("CC ") & ~F.array_contains(F.split(label, "[ -]"), "ND"))
    return F.coalesce((access == "personal") | free, F.lit(False))


def name_key(name: Column) -> Column:
    """Folded last name and first given name, for ``Last, First`` and ``First Last``."""
    clean = normalize_words(fold_accents(F.replace(name, F.lit(","), F.lit(" , "))))
    comma = F.instr(name, ",") > 0
    left, right = F.split(name, r"\s*,\s*")[0], F.split(name, r"\s*,\s*")[1]
    parts = F.split(clean, " ")
    given = F.split(normalize_words(fold_accents(right)), " ")[0]
    return F.when(comma, F.concat_ws("|", normalize_words(fold_accents(left)), given)).otherwise(F.concat_ws("|", F.element_at(parts, -1), parts[0]))


def json_block(text: Column) -> Column:
    """The outermost array or object of ``text``, code fences aside."""
    bare = F.regexp_replace(text, "```[a-z]*", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\]|\{.*\})", 1), F.lit(""))
