"""Titles, slugs and labels as Column expressions. `(?U)` gives Java's classes their Unicode meaning."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=None)
def _bases() -> tuple[str, str]:
    """Every accented character of the basic plane and its base character, from the Unicode database."""
    source, target = [], []
    for code in range(0x80, 0xD800):
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(code):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    """accents go, base letters stay, combining marks go."""
    return F.regexp_replace(F.translate(text, *_bases()), r"\p{Mn}", "")


def folded(text: Column) -> Column:
    """The text under a collation that ignores case and accents in every script: equal names join, group and compare equal."""
    return F.collate(text, "UNICODE_CI_AI")


def norm_key(text: Column) -> Column:
    """lower case, no accents, only a-z, 0-9 and single spaces; null becomes empty."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_bases())
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", ""), " +", " "))


def clean_title(title: Column) -> Column:
    """without what follows the last dash, bar or slash, and without parentheses."""
    head = F.regexp_replace(title, r"\s*[-|/–—][^-|/–—]*$", "")
    return F.btrim(F.regexp_replace(head, r"\s*\([^)]*\)", ""))


def title_slug(title: Column) -> Column:
    """no accents, a-z, 0-9 and hyphens for spaces."""
    kept = F.btrim(F.regexp_replace(strip_accents(F.lower(title)), "[^a-z0-9 ]", ""))
    return F.regexp_replace(kept, " +", "-")


def is_upper(text: Column) -> Column:
    """Whether a text has a cased letter and no lower-case one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def capitals(text: Column) -> Column:
    """Each run of letters with a capital at its head."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def title_case(text: Column) -> Column:
    """titles in capitals get title case; a letter alone after an apostrophe stays small, with a curly apostrophe."""
    cased = F.regexp_replace(capitals(F.lower(text)), r"(?U)['’](\p{Lu})\b", "’\u0000$1")
    pieces = F.split(cased, "\u0000", -1)
    mended = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""))
    return F.when(is_upper(text), mended).otherwise(text)


def word_case(text: Column) -> Column:
    """capitals at the head of words, but not after an apostrophe."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"((?U)['´’]?\w+|[^\w])"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^['´’]"), p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def indie_title(raw: Column, overrides: dict[str, str]) -> Column:
    """struct(title, is_indie): the festival's prefix and billing number go, capitals become word case."""
    inner = F.btrim(F.regexp_extract(F.btrim(raw), r"(?iu)^INDIE\s+(.+)\s+\d+$", 1))
    mended = F.when(F.upper(inner) == inner, word_case(F.replace(inner, F.lit("´"), F.lit("'")))).otherwise(inner)
    known = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[raw] if overrides else F.lit(None).cast("string")
    return F.when(known.isNotNull(), F.struct(known.alias("title"), F.lit(True).alias("is_indie"))).when(inner != "", F.struct(mended.alias("title"), F.lit(True).alias("is_indie"))).otherwise(
        F.struct(raw.alias("title"), F.lit(False).alias("is_indie"))
    )


def venue_slug(title: Column) -> Column:
    """capitals without accents, hyphens for everything else."""
    return F.regexp_replace(F.regexp_replace(strip_accents(F.upper(title)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")


def id_slug(text: Column, collapse: bool = False, length: int = 40) -> Column:
    """a-z and 0-9, underscores for the rest."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+" if collapse else "[^a-z0-9]", "_"), 1, length)


def capital_first(text: Column) -> Column:
    """F25."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


# The patterns and labels of the four functions that follow
def presence_label(text: Column) -> Column:
    """long lists of guests become one of two short labels."""
    low = F.lower(text)
    listed = low.rlike(r"(?U)presen[çc]a\s+d") & (text.contains(",") | (F.length(text) > 60))
    director = low.rlike(r"(?U)\brealizador\b") | low.rlike(r"(?U)\bdirector\b(?!\s+da\s+fotografia)")
    return F.when(listed & director, F.lit("Presença do realizador e equipa")).when(listed, F.lit("Presença da equipa e elenco")).otherwise(text)


def special_suffix(title: Column) -> Column:
    """struct(title, label) of a title that ends in `| sessão de …`; label null if it does not."""
    found = F.regexp_extract(title, r"(?iuU)\s*\|\s*(sess[ãa]o\s+[\w\s]+?)\s*$", 1)
    small = F.array(*[F.lit(w) for w in ("de", "do", "da", "dos", "das", "e", "em")])
    words = F.transform(F.split(F.btrim(F.lower(found)), r"\s+"), lambda w, k: F.when((k > 0) & F.array_contains(small, w), w).otherwise(capital_first(w)))
    head = F.btrim(F.regexp_replace(title, r"(?iuU)\s*\|\s*sess[ãa]o\s+[\w\s]+?\s*$", ""))
    return F.struct(F.when(found != "", head).otherwise(title).alias("title"), F.when(found != "", F.array_join(words, " ")).alias("label"))


def keyword_labels(line: Column) -> Column:
    """labels by what a line says."""
    rules = [(r"(?iu)with\s+english", "Legendas em inglês"), (r"(?iu)última\s+sess", "Última sessão"), (r"(?iu)sess[aã]o\s+especial", "Sessão especial")]
    return F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(label)) for p, label in rules]))


def info_label(text: Column) -> Column:
    """the label of an information line, or null: guests, introductions, live music, talks."""
    led = F.regexp_extract(text, r"(?iuU)^SESS[ÃA]O\s+(com\s+a\s+presen[çc]a\s+de\s+.+)", 1)
    plain = [r"(?iuU)^com\s+a\s+presen[çc]a\s+de\b", r"(?iuU)^sess[ãa]o\s+com\b", r"(?iuU)^com\s+acompanhamento\b", r"(?iuU)^(conversa|debate|seguida\s+de\s+(?:conversa|debate))\b"]
    kept = F.when(led != "", led)
    for pattern in plain:
        kept = F.coalesce(kept, F.when(text.rlike(pattern), text))
    return capital_first(kept)


def first_sentences(text: Column, n: int = 3) -> Column:
    """the first n sentences."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n), " ")


def last_segment(url: Column) -> Column:
    """the last path segment."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def absolute_url(link: Column, base: str) -> Column:
    """links from the root get the site's base."""
    return F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link)


def path_only(url: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")


def joined_names(*names: Column) -> Column:
    """names that are there, parted by commas; null if none."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(n, F.lit("")) for n in names]), F.lit(""))


def slug_title(slug: Column) -> Column:
    """a slug as a title."""
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def comma_parts(text: Column, most: int | None = None) -> Column:
    """trimmed parts that are not empty, the first `most` of them."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.btrim(p)), lambda p: p != "")
    return F.slice(parts, 1, most) if most else parts


def last_word_in(candidate: Column, expected: Column) -> Column:
    """Whether the last word of the expected name is in the candidate, accents and case aside."""
    plain = lambda c: strip_accents(F.lower(c))
    return plain(candidate).contains(F.element_at(F.split(F.btrim(plain(expected)), r"\s+"), -1))


def overruns(query: Column, candidate: Column, least: float = 0.6) -> Column:
    """The candidate merely begins with the query and is much longer."""
    q, c = norm_key(query), norm_key(candidate)
    return (q != c) & c.startswith(q) & (F.length(q) / F.length(c) < least)


def is_multi_title(title: Column) -> Column:
    """Several titles in one."""
    parts = F.transform(F.split(title, r"\s*\+\s*"), lambda p: F.btrim(p))
    return title.rlike(r"\s\|\s") | (title.contains(" + ") & (F.length(title) > 25) & F.forall(parts, lambda p: F.length(p) > 5))


#: Parts of poster addresses that mean there is no poster.
BAD_POSTERS = ("1920x1080", "1920%", "placeholder-2-i", "captura-de-ecra", "withoutlettering", "noltettering", "cdn.bndlyr.com")


def bad_poster(url: Column, tokens: tuple[str, ...] = BAD_POSTERS) -> Column:
    """The address has one of the tokens."""
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.lower(url).contains(t))
