"""Tokens, case-boundary splitting and snippets, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters that are an ASCII letter with one mark, and those letters. Letters with two marks, Cyrillic and sharp
    s are left alone."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            pairs.append((chr(cp), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
MARKS = "[̀-ͯ]"
NOT_TERM = "[^\\p{L}\\p{N}\\p{Co}]+"
NOT_WORD = "[^\\p{L}\\p{N}]+"
CASE_BOUNDARY = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
IDENTIFIER = "[A-Za-zА-ЯЁа-яё0-9]+"

# Words without weight in a query.
STOP_WORDS = tuple(
    """
    на в во с со к ко у о об от до из без при под над за перед через между около после против среди для по вне кроме вместо
    я ты он она оно мы вы они меня тебя его ее её нас вас их мне тебе ему ей нам вам им мой моя моё мои твой твоя твоё твои
    наш наша наше наши ваш ваша ваше ваши себя себе собой этот эта это эти тот та то те такой такая такое такие весь вся всё
    все что кто какой какая какое какие чей где куда откуда когда зачем почему сколько который которая которое которые
    бы же ли не ни лишь только даже вот вон ведь уж неужели разве будто
    а но да тоже также зато однако хотя чтобы чтоб так тогда потом
    a an the and or of in on at to for with by from is are was were be been being it its this that these those as not but if
    then else than so do does did will would can could should may might must i you he she we they them their his her our your
    my me us
    """.split()
)


def folded(text: Column) -> Column:
    """Lower case, without Latin accents and combining marks; a text in ASCII has none."""
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(text, MARKS, ""), ACCENTED, PLAIN)).otherwise(text))


def index_terms(text: Column) -> Column:
    """Terms of a text in order: runs of letters, numbers and private-use characters. Null has none."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), NOT_TERM), lambda t: t != "")


def pascal_parts(word: Column) -> Column:
    """``XMLParser`` gives XML, Parser; an empty word gives nothing."""
    return F.filter(F.split(word, CASE_BOUNDARY), lambda p: p != "")


def expanded(text: Column) -> Column:
    """The text, and a line with the parts of every identifier that has several."""
    many = F.filter(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0), pascal_parts), lambda p: F.size(p) > 1)
    lines = F.array_join(F.transform(many, lambda p: F.array_join(p, " ")), "\n")
    return F.when(F.size(many) > 0, F.concat(text, F.lit("\n"), lines)).otherwise(text)


def query_tokens(query: Column) -> Column:
    """Distinct lower-case tokens in order; stop words go if anything else is left."""
    tokens = F.array_distinct(F.transform(F.filter(F.split(expanded(F.coalesce(query, F.lit(""))), NOT_WORD), lambda t: t != ""), F.lower))
    strong = F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))
    return F.when((F.size(tokens) > 1) & (F.size(strong) > 0), strong).otherwise(tokens)


def raw_tokens(query: Column) -> Column:
    return F.filter(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def around(text: Column, token: Column, width: int = 120) -> Column:
    """The text around the first place of ``token``, a third before and two thirds behind; null where there is none."""
    at = F.instr(F.lower(text), F.lower(token)) - 1
    start, end = F.greatest(F.lit(0), at - width // 3), F.least(F.length(text), at + F.length(token) + width * 2 // 3)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at >= 0, stripped(cut))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def all_within(text: Column, tokens: Column) -> Column:
    return bound(F.lower(text), lambda low: F.forall(tokens, lambda t: F.contains(low, F.lower(t))))


def snippet(body: Column, title: Column, query: Column) -> Column:
    """Around the first token that is found in the body, else in the title, else the body's start, else the title."""
    tokens = raw_tokens(query)
    found = lambda text: bound(F.lower(text), lambda low: F.get(F.filter(tokens, lambda t: F.contains(low, F.lower(t))), F.lit(0)))
    first = lambda text: around(text, found(text))
    start = stripped(F.substring(body, 1, 120))
    return F.coalesce(first(body), first(title), F.when(start != "", start).otherwise(stripped(title)))
