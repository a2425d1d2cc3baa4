"""Column functions on text: two notions of equality, tokens, sentences, part-of-speech guesses, entities.

Everything here is a built-in expression, evaluated in the JVM. Offsets and lengths count code points.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from .words import ADJECTIVE_SUFFIXES, NOUN_SUFFIXES, STOPWORDS, VERB_SUFFIXES

TOKEN = "[a-zA-Z0-9]+(?:['’][a-zA-Z]+)*"
MARKS = "[̀-ͯ]"


def _accents() -> tuple[str, str]:
    """Letters that decompose into one base letter and combining marks, and those base letters."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_accents(text: Column) -> Column:
    """Letters without their marks; ASCII texts are left as they are, which a byte count tells."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), MARKS, ""))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def normalize(text: Column) -> Column:
    """Equality for resolution: lower case, single spaces, no possessives, no accents, trimmed."""
    low = collapse(F.lower(text))
    return F.trim(strip_accents(F.when(F.contains(low, F.lit("'s")), F.regexp_replace(low, r"'s\b", "")).otherwise(low)))


def phrase_key(text: Column) -> Column:
    """Equality for feedback: lower case, trimmed, single spaces."""
    return F.trim(collapse(F.lower(text)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\.md$", ""), "/"), -1)


def normalized_basename(path: Column) -> Column:
    return normalize(basename(path))


def exact_match(phrase: Column, title: Column) -> Column:
    return normalize(phrase) == normalize(title)


def contains_title(phrase: Column, title: Column) -> Column:
    p, t = normalize(phrase), normalize(title)
    return p.contains(t) & (p != t)


def tokens(text: Column) -> Column:
    """Words in order; letters outside A-Z separate them."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences: split after .!? before white space, and at blank lines."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])(?=\s)|\n\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def corpus_sentences(text: Column) -> Column:
    """Sentences of abstracts: split after .!? before a space, line break, tab or the end only."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?=[ \n\r\t]|$)"), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: s != "")


def decode_entities(text: Column) -> Column:
    """Named and decimal or hexadecimal character references; unknown ones stay. Each is read once."""
    def one(part: Column) -> Column:
        body = F.regexp_extract(part, r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);", 1)
        named = F.create_map(*[F.lit(x) for pair in {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.items() for x in pair])
        hexa = F.conv(F.regexp_extract(body, "^#[xX](.+)$", 1), 16, 10)
        deci = F.regexp_extract(body, "^#([0-9]+)$", 1)
        code = F.coalesce(F.nullif(deci, F.lit("")), F.when(body.rlike("^#[xX]"), hexa)).cast("int")
        char = F.decode(F.encode(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), "UTF-8"), "UTF-8")
        rest = F.regexp_replace(part, r"^&[^;]*;", "")
        value = F.when(body.startswith("#") & (code <= 0x10FFFF), char).otherwise(F.element_at(named, body))
        return F.when(body == "", part).otherwise(F.coalesce(F.concat(value, rest), part))

    return F.array_join(F.transform(F.split(text, r"(?=&)"), one), "")


def ascii_ratio(text: Column) -> Column:
    """Share of ASCII characters among those that aren't white space (1 if there are none)."""
    solid = F.regexp_replace(text, r"(?U)\s", "")
    n = F.length(solid)
    return F.when(n == 0, 1.0).otherwise(F.length(F.regexp_replace(solid, r"[^\x00-\x7F]", "")) / n)


def count_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]", ""))


def is_stopword(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def guess_pos(word: Column) -> Column:
    """noun, adj, verb, adverb or unknown, by endings; the first rule that holds decides (their order is fixed:
    results depend on it)."""
    w = F.lower(word)
    n = F.length(w)
    ends = lambda s: w.endswith(s)
    any_of = lambda checks: F.array_contains(F.array(*checks), True)
    verb = any_of([ends(s) & (n > len(s) + 2) for s in VERB_SUFFIXES])
    first = F.substring(word, 1, 1)
    return (
        F.when(n <= 3, "unknown")
        .when(ends("ly") & (n > 4), "adverb")
        .when(ends("ing") & (n > 5), "noun")
        .when(verb, "verb")
        .when(any_of([ends(s) for s in NOUN_SUFFIXES]), "noun")
        .when(any_of([ends(s) for s in ADJECTIVE_SUFFIXES]), "adj")
        .when((first == F.upper(first)) & (first != F.lower(first)), "noun")
        .otherwise("unknown")
    )


def duration(seconds: Column) -> Column:
    """"45s", "2m 5s" or "1h 1m 0s" of a number of seconds, cut to whole ones; "?" for what is no length of time."""
    x = seconds.cast("double")
    s = F.floor(F.when((x >= 0) & (x < float("inf")), x))
    h, m, rest = (n.cast("string") for n in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))
    out = F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m "), rest, F.lit("s"))).when(s >= 60, F.concat(m, F.lit("m "), rest, F.lit("s")))
    return F.coalesce(out, F.concat(rest, F.lit("s")), F.lit("?"))


def pos_of(word: str) -> str:
    """guess_pos of a single word."""
    w = word.lower()
    n = len(w)
    if n <= 3:
        return "unknown"
    if w.endswith("ly") and n > 4:
        return "adverb"
    if w.endswith("ing") and n > 5:
        return "noun"
    if any(w.endswith(s) and n > len(s) + 2 for s in VERB_SUFFIXES):
        return "verb"
    if w.endswith(tuple(NOUN_SUFFIXES)):
        return "noun"
    if w.endswith(tuple(ADJECTIVE_SUFFIXES)):
        return "adj"
    return "noun" if word[0] != word[0].lower() else "unknown"


def is_noun_phrase(words: Column) -> Column:
    """No word guessed a verb or adverb, and the last one a noun or unknown."""
    pos = F.transform(words, guess_pos)
    return (F.size(words) > 0) & ~F.exists(pos, lambda p: p.isin("verb", "adverb")) & F.element_at(pos, -1).isin("noun", "unknown")
