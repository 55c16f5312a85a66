"""Text features as Column expressions: tokens, readability, style and quality measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.common import clamp, rnd

# Word lists, patterns.
STOP_WORDS = ["the", "and", "for", "that", "this", "with", "from", "your", "you", "are", "was", "were", "about", "into", "http", "https", "www", "com", "site", "page", "seo", "как", "это", "для", "что", "или", "при"]
FILLER_WORDS = ["very", "really", "basically", "actually", "simply", "just", "literally", "maybe", "perhaps", "просто", "очень", "как бы", "наверное", "возможно"]
TOXIC_WORDS = ["hate", "stupid", "idiot", "trash", "scam", "ненавижу", "тупой", "мусор"]
BOILERPLATE = ["©", "privacy", "terms", "contacts?", "subscribe", "read also", r"©\s*\d{4}", "политика", "условия", "контакты", "подписаться"]
HEDGES = ["maybe", "perhaps", "likely", "possibly", "generally", "often", "can", "возможно", "вероятно", "может", "обычно", "часто", "как правило"]
TEMPLATE_PHRASES = ["in today's world", "unlock the power", "seamless experience", "в современном мире", "лучшее решение", "высокое качество"]
AI_MARKERS = ["as an ai", "as a language model", "in conclusion", "it is important to note", "в заключение", "важно отметить", "как ии", "как языковая модель", "следует отметить", "подводя итог", "таким образом"]
TECH_MARKERS = ["ai", "chatgpt", "generated", "llm", "neural"]
LANGUAGE_CHARS = {
    "ru": "[а-яёА-ЯЁ]",
    "uk": "[іїєґІЇЄҐ]",
    "de": "[äöüßÄÖÜ]",
    "fr": "[àâçéèêëîïôùûüÿœæÀÂÇÉÈÊËÎÏÔÙÛÜŸŒÆ]",
    "es": "[ñ¿¡áéíóúÑÁÉÍÓÚ]",
    "it": "[àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ]",
    "pt": "[ãõçâêôàÃÕÇÂÊÔÀ]",
    "tr": "[çğıöşüÇĞİÖŞÜ]",
    "pl": "[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]",
}

RUN = r"[\p{L}\p{N}_]+"
PLAIN = "^[a-zA-ZЀ-ӿ0-9]+$"


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def in_list(x: Column, values: list[str]) -> Column:
    return x.isin(*values)


def tokens(text: Column) -> Column:
    """Runs of three letters or digits and more, lower case, without stop words."""
    return F.filter(all_of(F.lower(text), "[a-zA-ZЀ-ӿ0-9]{3,}"), lambda x: ~in_list(x, STOP_WORDS))


def words(text: Column) -> Column:
    """Whole words of Latin or Cyrillic letters and digits."""
    return F.filter(all_of(text, RUN), lambda x: x.rlike(PLAIN))


def has_any(text: Column, parts: list[str]) -> Column:
    """Whether one of the parts stands in a text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def has_word(text: Column, *whole: str) -> Column:
    """Whether one of the words stands in a text by itself; texts where none ends are told quicker than by a look at each place."""
    some = "|".join(whole)
    return text.rlike(rf"(?:{some})(?![\p{{L}}\p{{N}}_])") & text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({some})([^\p{{L}}\p{{N}}_]|$)")


def count_chars(text: Column, others: str) -> Column:
    """How many characters of a text the pattern of runs of others leaves; no array of them is made."""
    return F.length(F.regexp_replace(text, others, ""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "[.!?]+", -1), lambda x: x.rlike(r"\S"))


def total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, with b at least 1."""
    return a.cast("double") / F.greatest(F.lit(1), b).cast("double")


def occurrences(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping occurrences of each of the phrases, in all."""
    found = [(F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p) for p in phrases]
    return sum(found[1:], found[0]).cast("long")


def readability(words_: Column, sentences_: Column) -> Column:
    n = F.size(words_)
    per_sentence, per_word = ratio(n, F.size(sentences_)), ratio(total_length(words_), n)
    score = 100.0 - F.greatest(F.lit(0.0), (per_sentence - 14.0) * 2.2) - F.greatest(F.lit(0.0), (per_word - 5.5) * 8.0)
    return F.when(n == 0, 0.0).otherwise(rnd(clamp(score), 1))


def flesch(text: Column) -> Column:
    """Reading ease with vowel groups as syllables."""
    w = all_of(text, "[A-Za-zА-Яа-я0-9]+")
    n = F.size(w)
    syllables = F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(1), F.size(all_of(F.lower(x), "[aeiouyаеёиоуыэюя]+"))))
    score = 206.835 - 1.015 * ratio(n, F.greatest(F.lit(1), F.size(sentences(text)))) - 84.6 * ratio(syllables, n)
    return F.when(n == 0, 0.0).otherwise(rnd(clamp(score), 2))
