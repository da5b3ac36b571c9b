"""Text normalisation as column expressions: tokens, phrases, token estimates, rarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval.
STOP_WORDS = [
    "a", "add", "agregar", "al", "and", "class", "con", "data", "de", "del", "el", "en", "existing", "existente", "for", "la", "las",
    "los", "maintain", "manager", "manteniendo", "of", "para", "por", "project", "projects", "proyecto", "proyectos", "service", "soporte",
    "support", "system", "the", "to", "un", "una", "y",
]

#: Words read as others. Two of them are stop words first and never reached.
SYNONYMS = {
    "analisis": "analysis", "analizador": "analyzer", "analizar": "analyzer", "arquitectura": "architecture", "extensible": "extension",
    "interfaz": "interface", "lenguaje": "language", "proyecto": "project", "soporte": "support",
}

#: UTF-16 units that count as one token.
TOKENS_PER_UNIT = 4


@lru_cache(1)
def accent_map() -> tuple[str, str]:
    """Accented characters of the basic plane and their bases, by rule: canonical
    decomposition without marks, where that leaves one character."""
    src, dst = [], []
    for c in map(chr, range(0x80, 0x10000)):
        if 0xD800 <= ord(c) < 0xE000 or unicodedata.category(c) == "Mn":
            continue
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if bare != c and len(bare) == 1:
            src.append(c)
            dst.append(bare)
    return "".join(src), "".join(dst)


def split_words(text: Column) -> Column:
    """Spaces at the seams of camel case and of acronyms."""
    acronyms = F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(acronyms, "([a-z0-9])([A-Z])", "$1 $2")


def strip_accents(text: Column) -> Column:
    src, dst = accent_map()
    return F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}+", "")


def raw_tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of two characters or more, in order, with repeats; null has none."""
    parts = F.split(F.lower(strip_accents(split_words(F.coalesce(text, F.lit(""))))), "[^a-zA-Z0-9]+")
    return F.filter(parts, lambda t: F.length(t) > 1)


def tokens(text: Column) -> Column:
    """Distinct sorted tokens: stop words go before and after synonyms are read."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    known = F.array_except(raw_tokens(text), stop)
    mapping = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    read = F.transform(known, lambda t: F.coalesce(F.try_element_at(mapping, t), t))
    return F.array_sort(F.array_except(read, stop))


def phrase(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; null and empty are 0."""
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) / TOKENS_PER_UNIT).cast("int")


def rarity_points(df: Column, n: Column, most: int = 4) -> Column:
    """Points of a term found in ``df`` of ``n`` documents; 0 for unseen terms or no documents."""
    seen = df.isNotNull() & (df > 0) & (n > 0)
    share = F.log((n + 1) / (df + 1)) / F.log(n + F.lit(1.0))
    return F.when(seen, F.least(F.greatest(F.round(share * most), F.lit(0)), F.lit(most))).otherwise(0).cast("int")


def ordinal_count(text: Column, value: Column) -> Column:
    """Occurrences of ``value`` that do not overlap; an empty value has none."""
    return F.when(F.length(value) > 0, ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("int")).otherwise(0)


def mentions(text: Column, identity: Column) -> Column:
    """Whether a text names an identity: equal phrases, or the identity's first
    occurrence, whatever case, stands between non-word characters and has two tokens or more."""
    at = F.instr(F.lower(text), F.lower(identity))
    before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise("")
    after = F.substr(text, at + F.length(identity), F.lit(1))
    edge = lambda c: ~c.rlike(r"^[\p{L}\p{N}_]$")
    inside = (F.size(tokens(identity)) >= 2) & (at > 0) & edge(before) & edge(after)
    same = (phrase(identity) != "") & (phrase(text) == phrase(identity))
    return F.coalesce(same | inside, F.lit(False))
