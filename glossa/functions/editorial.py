"""Editorial functions as Columns: morphology codes, original-script words, keys, citations, checks of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import fold_accents, normalize_greek, normalize_hebrew

# Codes of Greek morphology, place by place: person, tense, voice, mood, case, number, gender, degree (fixed values).
GREEK_PLACES = [
    {"1": "1st person", "2": "2nd person", "3": "3rd person"},
    {"P": "present", "I": "imperfect", "F": "future", "A": "aorist", "X": "perfect", "Y": "pluperfect"},
    {"A": "active", "M": "middle", "P": "passive"},
    {"I": "indicative", "D": "imperative", "S": "subjunctive", "O": "optative", "N": "infinitive", "P": "participle"},
    {"N": "nominative", "G": "genitive", "D": "dative", "A": "accusative", "V": "vocative"},
    {"S": "singular", "P": "plural"},
    {"M": "masculine", "F": "feminine", "N": "neuter"},
    {"C": "comparative", "S": "superlative"},
]
#: Order in which the places are told: tense, voice, mood, case, person, number, gender, degree.
GREEK_ORDER = (1, 2, 3, 4, 0, 5, 6, 7)
# Parts of speech of Greek codes and of lexicon codes (fixed values).
GREEK_POS = {
    "N-": "noun", "V-": "verb", "A-": "adjective", "D-": "adverb", "C-": "conjunction", "P-": "preposition", "RA": "article",
    "RD": "demonstrative pronoun", "RI": "interrogative pronoun", "RP": "personal pronoun", "RR": "relative pronoun", "X-": "particle", "I-": "interjection",
}
LEXICON_POS = {"N": "noun", "V": "verb", "A": "adjective", "Adv": "adverb", "Prep": "preposition", "Conj": "conjunction", "Part": "particle", "Pron": "pronoun", "Intj": "interjection"}
GENDER = {"M": "masculine", "F": "feminine", "N": "neuter", "B": "common"}
# Hebrew codes: part of speech, then its kind, then person, gender, number and state (fixed values).
HEBREW_POS = {"V": "verb", "N": "noun", "A": "adjective", "P": "pronoun", "S": "suffix", "T": "particle", "R": "preposition", "C": "conjunction", "D": "adverb"}
HEBREW_STEMS = {
    "q": "qal", "N": "niphal", "p": "piel", "P": "pual", "h": "hiphil", "H": "hophal", "t": "hithpael", "o": "polel", "O": "polal", "r": "hithpolel", "m": "poel", "M": "poal",
    "k": "palel", "K": "pulal", "Q": "qal passive", "l": "pilpel", "L": "polpal", "f": "hithpalpel", "D": "nithpael", "j": "pealal", "i": "pilel", "u": "hothpaal", "c": "tiphil",
    "v": "hishtaphel", "w": "nithpalel", "y": "nithpoel", "z": "hithpoel",
}
ARAMAIC_STEMS = {
    "q": "peal", "Q": "peil", "u": "hithpeel", "p": "pael", "P": "ithpaal", "M": "hithpaal", "a": "aphel", "h": "haphel", "s": "saphel", "e": "shaphel", "H": "hophal", "i": "ithpeel",
    "t": "hishtaphel", "v": "ishtaphel", "w": "hithaphel", "o": "polel", "z": "ithpoel", "r": "hithpolel", "f": "hithpalpel", "b": "hephal", "c": "tiphel", "m": "poel", "l": "palpel",
    "L": "ithpalpel", "O": "ithpolel", "G": "ittaphal",
}
HEBREW_VERBS = {
    "p": "perfect", "q": "sequential perfect", "i": "imperfect", "w": "sequential imperfect", "h": "cohortative", "j": "jussive", "v": "imperative",
    "r": "active participle", "s": "passive participle", "a": "infinitive absolute", "c": "infinitive construct",
}
HEBREW_KINDS = {
    "Nc": "common", "Ng": "gentilic", "Np": "proper", "Ac": "cardinal", "Ag": "gentilic", "Ao": "ordinal", "Pd": "demonstrative", "Pf": "indefinite", "Pi": "interrogative", "Pp": "personal", "Pr": "relative",
    "Sd": "directional he", "Sh": "paragogic he", "Sn": "paragogic nun", "Sp": "pronominal", "Ta": "affirmation", "Td": "definite article", "Te": "exhortation", "Ti": "interrogative", "Tj": "interjection",
    "Tm": "demonstrative", "Tn": "negative", "To": "direct object marker", "Tr": "relative", "Rd": "with article",
}
PROPER_KINDS = {"m": "man", "f": "woman", "l": "place", "t": "title"}
HEBREW_PERSON, HEBREW_GENDER = {"1": "1st person", "2": "2nd person", "3": "3rd person"}, {"m": "masculine", "f": "feminine", "b": "common", "c": "common"}
HEBREW_NUMBER, HEBREW_STATE = {"s": "singular", "p": "plural", "d": "dual"}, {"a": "absolute", "c": "construct", "d": "determined"}


def named(code: Column, names: dict[str, str]) -> Column:
    """The name of ``code``, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def greek_morphology(pos: Column, code: Column) -> Column:
    """Part of speech and what the eight places of ``code`` say, by commas; places that say nothing are left out."""
    filled = F.rpad(F.coalesce(code, F.lit("")), 8, "-")
    places = [named(F.substr(filled, F.lit(i + 1), F.lit(1)), GREEK_PLACES[i]) for i in GREEK_ORDER]
    return F.concat_ws(", ", named(pos, GREEK_POS), *places)


def hebrew_morphology(code: Column) -> Column:
    """Segments of a Hebrew or Aramaic code by " + ", what each says by commas; the first letter tells the language."""
    body = F.regexp_replace(F.coalesce(code, F.lit("")), "^[HA]", "")
    aramaic = F.coalesce(code, F.lit("")).startswith("A")

    def segment(s: Column) -> Column:
        pos, kind = F.substr(s, F.lit(1), F.lit(1)), F.substr(s, F.lit(2), F.lit(1))
        verb = pos == "V"
        proper = s.startswith("Np")
        tail = F.when(verb, F.substr(s, F.lit(4))).when(pos.isin("N", "A", "P", "S"), F.substr(s, F.lit(3))).otherwise("")
        at = [F.regexp_extract(F.when(proper, "").otherwise(tail), "^([123]?)([mfbc]?)([spd]?)([acd]?)", i) for i in range(1, 5)]
        stem = F.when(aramaic, named(kind, ARAMAIC_STEMS)).otherwise(named(kind, HEBREW_STEMS))
        third = F.substr(s, F.lit(3), F.lit(1))
        told = named(F.concat(pos, kind), HEBREW_KINDS)
        kinds = F.when(verb, F.concat_ws(", ", stem, named(third, HEBREW_VERBS))).when(proper, F.concat_ws(", ", told, named(third, PROPER_KINDS))).otherwise(told)
        return F.concat_ws(", ", named(pos, HEBREW_POS), F.nullif(kinds, F.lit("")), *(named(a, t) for a, t in zip(at, (HEBREW_PERSON, HEBREW_GENDER, HEBREW_NUMBER, HEBREW_STATE), strict=True)))

    told = F.array_join(F.filter(F.transform(F.split(body, "/"), segment), lambda x: x != ""), " + ")
    return F.when(code.startswith("A"), F.concat(F.lit("Aramaic: "), told)).otherwise(told)


def lexicon_pos(code: Column) -> Column:
    """Part of speech and gender of a lexicon code such as ``G:N-M``; names of places and persons by their own; else empty."""
    body = F.regexp_replace(code, "^[^:]*:", "")
    parts = F.split(body, "-")
    return F.when(body.startswith("N-L"), "place name").when(body.rlike("^N-.*-P$"), "proper name").otherwise(F.concat_ws(", ", named(F.get(parts, F.lit(0)), LEXICON_POS), named(F.get(parts, F.lit(1)), GENDER)))


def original_terms(text: Column, language: str) -> Column:
    """Different folded words of two letters or more in Greek (grc) or Hebrew (hbo) script, sorted."""
    pattern, fold = (r"[Ͱ-Ͽἀ-῿]{2,}", normalize_greek) if language == "grc" else (r"[֐-׿]{2,}", normalize_hebrew)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fold), lambda w: w != "")))


def wants(question: Column, starts: tuple[str, ...] = (), whole: tuple[str, ...] = ()) -> Column:
    """Whether a word of the folded question begins with one of ``starts`` or is one of ``whole``."""
    return question.rlike("(?i)(?:^|[^a-z])(?:(?:" + "|".join(starts or ("(?!)",)) + ")|(?:" + "|".join(whole or ("(?!)",)) + ")(?![a-z]))")


def is_heading(line: Column) -> Column:
    """A short line that begins with a capital or a number and does not end as a sentence does."""
    return (F.length(line) <= 80) & line.rlike(r"^(?:\d+(?:\.\d+)*\.?\s+)?\p{Lu}") & ~line.rlike(r"[.,;:!?]$")


def time_marks(text: Column) -> Column:
    """Seconds of all [h:mm:ss] and [mm:ss] marks, in order."""
    pattern = r"\[(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})\]"
    h, m, s = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(h.alias("h"), m.alias("m"), s.alias("s")), lambda z: F.coalesce(z["h"].try_cast("long"), F.lit(0)) * 3600 + z["m"].cast("long") * 60 + z["s"].cast("long"))


def metric_name(label: Column) -> Column:
    """``label`` with all but a-z, 0-9 as the hexadecimal of its UTF-8 bytes between underscores: different labels stay different."""
    return F.array_join(F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.when(c.rlike("^[a-z0-9]$"), c).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit("_")))), "")


def stable_id(*columns: str) -> Column:
    """sha256 of the columns as JSON: the same for the same case, whatever its place."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def citation(authors: Column, title: Column, journal: Column, year: Column, pages: Column) -> Column:
    """Authors, title in quotation marks, journal, year and pages, by commas; what is missing is left out."""
    return F.concat_ws(", ", F.nullif(F.array_join(authors, ", "), F.lit("")), F.concat(F.lit("“"), title, F.lit("”")), journal, year.cast("string"), F.concat(F.lit("p. "), pages))


def identity_key(name: Column) -> Column:
    """Key of an author: a readable part and a digest of the folded name."""
    folded = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.concat_ws("-", F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-")), F.left(F.sha2(folded, 256), F.lit(12)))


def direction(language: Column) -> Column:
    return F.when(language.isin("hbo", "arc", "he"), "rtl").otherwise("ltr")


def osis_range(ref: Column, order: Column, order_end: Column) -> Column:
    """(start, end) of ``Book.c.v``, ``Book.c`` or a range of such by "-", the order numbers of both books given; else null."""
    a, b = F.split_part(ref, F.lit("-"), F.lit(1)), F.when(F.contains(ref, F.lit("-")), F.split_part(ref, F.lit("-"), F.lit(2)))
    far = F.coalesce(b, a)

    def at(part: Column, i: int) -> Column:
        return F.split_part(part, F.lit("."), F.lit(i)).try_cast("long")

    start = order * 1_000_000 + at(a, 2) * 1_000 + F.coalesce(at(a, 3), F.lit(0))
    end = F.coalesce(order_end, order) * 1_000_000 + at(far, 2) * 1_000 + F.coalesce(at(far, 3), F.lit(999))
    return F.when(ref.rlike(r"^\w+(\.\d+){1,2}(-\w+(\.\d+){1,2})?$") & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def roman(text: Column) -> Column:
    """The value of a Roman numeral in small or large letters, else null: a smaller letter before a larger one counts against it."""
    value = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: named(c, {"i": "1", "v": "5", "x": "10", "l": "50", "c": "100", "d": "500", "m": "1000"}).cast("long"))
    total = F.aggregate(F.reverse(value), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("last")), lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))
    return F.when(text.rlike("(?i)^[ivxlcdm]+$"), total["sum"])


# Words of titles that a citation key leaves out, number words of volumes and parts, and what names stand for others (fixed values).
KEY_STOP = ("the", "and", "von", "der", "die", "das", "with", "from", "oraz", "jako")
PART = r"\b(?:czesc|cz|tom|vol|volume|part|ksiega|zeszyt)\.?\s*([ivxlc]+|[0-9]+)\b|\b([0-9]+)\b"
VARIANTS = ((r"(?i)\bmaryj\w*", "Maria Marii"),)


def slug(text: Column) -> Column:
    """Letters and digits of the folded text between hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(F.translate(F.coalesce(text, F.lit("")), "łŁ", "lL"))), "[^a-z0-9]+", "-"), "^-|-$", "")


def part_markers(title: Column) -> Column:
    """Numbers of volumes and parts that a title names, each once; titles that differ in them are different works."""
    folded = F.lower(fold_accents(F.translate(title, "łŁ", "lL")))
    found = [F.regexp_extract_all(folded, F.lit(PART), F.lit(i)) for i in (1, 2)]
    return F.array_sort(F.array_distinct(F.transform(F.arrays_zip(found[0].alias("a"), found[1].alias("b")), lambda z: F.when(z["a"] != "", z["a"]).otherwise(z["b"]))))


def canonical_name(name: Column) -> Column:
    """``Last, First`` of ``First Last`` or of a name already so; one word stays."""
    one = F.trim(F.regexp_replace(name, r"\s+", " "))
    last, first = F.trim(F.regexp_extract(one, "^([^,]*),", 1)), F.trim(F.regexp_extract(one, "^[^,]*,(.*)$", 1))
    tail = F.substring_index(one, " ", -1)
    given = F.trim(F.left(one, F.length(one) - F.length(tail)))
    joined = F.when(F.contains(one, F.lit(",")), F.struct(last.alias("l"), first.alias("f"))).otherwise(F.struct(tail.alias("l"), given.alias("f")))
    return F.when(joined["f"] != "", F.concat_ws(", ", joined["l"], joined["f"])).otherwise(joined["l"])


def citation_key(surname: Column, year: Column, title: Column) -> Column:
    """Letters of the surname (or ``anon``), the year, and the title's first word of four letters or more that says something (or ``work``)."""
    plain = lambda c: F.lower(fold_accents(F.translate(F.coalesce(c, F.lit("")), "łŁ", "lL")))
    words = F.filter(F.regexp_extract_all(plain(title), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*KEY_STOP))
    name = F.regexp_replace(plain(surname), "[^a-z]", "")
    return F.concat(F.when(name == "", "anon").otherwise(name), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(F.get(words, F.lit(0)), F.lit("work")))


def name_variants(question: Column) -> Column:
    """``question`` with what stands for names it has, once each."""
    return F.concat_ws(" ", question, *[F.when(question.rlike(pattern), F.lit(more)) for pattern, more in VARIANTS])


def clean_translation(text: Column, source: Column) -> Column:
    """A translation without a model's preface (a first line that ends in a colon and speaks of a translation) and, where the source has none, without stars of emphasis."""
    bare = F.regexp_replace(text, r"(?is)\A\s*(?:here is|below is|oto|poniżej)[^\n]*?(?:translation|przekład|tłumaczenie)[^\n]*:\s*\n+", "")
    plain = F.regexp_replace(bare, r"\*{1,2}([^*\n]+)\*{1,2}", "$1")
    return F.btrim(F.when(F.contains(F.coalesce(source, F.lit("")), F.lit("*")), bare).otherwise(plain), F.lit(" \t\n\r"))


# Rules of titles, in order (fixed values).
NOISE = r"(?i)sprawozdan|report from|konferencj|conference|walne zebranie|recenzje i sprawozdania|kościół w czasie pandemii|od redakcji|editorial|^wstęp$"
REVIEW = r"(?i)^(?:recenzja|review of|rec\.)|\(rec\.\)|\[review\]"


def rule_decision(title: Column, access: Column, duplicate_of: Column) -> Column:
    """(access, kind, reason) of an entry by the first rule that holds: left out already, a duplicate, a report by its title, a review by its title; else it keeps its access."""
    t = F.coalesce(title, F.lit(""))

    def decided(a: Column, kind: str | None, reason: Column) -> Column:
        return F.struct(a.alias("access"), F.lit(kind).cast("string").alias("kind"), reason.alias("reason"))

    skip = F.lit("skip")
    return (
        F.when(access == "skip", decided(skip, None, F.lit("left out")))
        .when(duplicate_of.isNotNull(), decided(skip, None, F.concat(F.lit("duplicate of "), duplicate_of.cast("string"))))
        .when(t.rlike(NOISE), decided(skip, "report", F.lit("title of a report")))
        .when(t.rlike(REVIEW), decided(access, "review", F.lit("title of a review")))
        .otherwise(decided(access, None, F.lit(None).cast("string")))
    )
