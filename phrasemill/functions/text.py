"""Column builders for cleaning and judging bibliographic phrases. White space is Unicode white space throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasemill.functions import words as lists

TRAILING = r"(?U)\s*[/:;.]\s*$"
TRAILING_OR_COMMA = r"(?U)\s*[/:;,.]\s*$"
#: list part, article, action, object
PATTERN = r"(?iudU)^(.+,\s*.+?)\s*,?\s+and\s+(a|an|the)\s+(.+?)\s+of\s+(.+)$"
PATTERN_THE = r"(?iudU)^(.+,\s*.+?)\s*,?\s+and\s+the\s+(.+?)\s+of\s+(.+)$"
_CUT = "\x1f"
#: All characters that are white space (``(?U)\\s``).
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"(?:\p{L}\.)+|[\p{L}\p{N}]+(?:['&-][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def words(c: Column) -> Column:
    """Words by white space; none for a blank text."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def last_word(c: Column) -> Column:
    return F.try_element_at(words(c), F.lit(-1))


def record_language(fixed: Column) -> Column:
    """Characters 36 to 38 of a record's fixed field, where it is long enough."""
    return F.when(F.length(fixed) >= 38, strip(F.substring(fixed, 36, 3)))


def is_english_record(lang: Column) -> Column:
    """Records without a language pass."""
    return F.coalesce(lang.isin("", "eng"), F.lit(True))


def edition_language(languages: Column) -> Column:
    """Of an array<struct<key>>, the first one's code; editions without one don't pass as English."""
    key = F.get(languages, F.lit(0)).getField("key")
    return F.when(key.startswith("/languages/"), F.element_at(F.split(key, "/"), -1))


def _long_enough(s: Column) -> Column:
    """The text if it has five characters, else null; the text is computed once."""
    return F.get(F.filter(F.array(s), lambda x: F.length(x) >= 5), F.lit(0))


def clean_record_subtitle(c: Column) -> Column:
    return _long_enough(strip(collapse(F.regexp_replace(strip(c), TRAILING, ""))))


def clean_edition_subtitle(c: Column) -> Column:
    """White space first, then the ending, which isn't trimmed again."""
    return _long_enough(F.regexp_replace(strip(collapse(strip(c))), TRAILING, ""))


def clean_title(c: Column) -> Column:
    return strip(F.regexp_replace(c, TRAILING, ""))


def normalize_lccn(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\-]", "")


def pick_isbn(isbn_13: Column, isbn_10: Column) -> Column:
    return strip(F.coalesce(F.get(isbn_13, F.lit(0)), F.get(isbn_10, F.lit(0))))


def may_match(c: Column) -> Column:
    """A cheap test that a text which fits the pattern passes."""
    return reduce(lambda a, b: a | b, (c.ilike(f"%, % and {a} % of %") for a in ("the", "a", "an")))


def is_noise(c: Column) -> Column:
    return F.lower(c).rlike("|".join(lists.NOISE))


def pattern_parts(c: Column) -> Column:
    """array of (list part, article, action, object), of another length where the text doesn't fit; the pattern is matched once."""
    return F.split(F.when(~F.contains(c, F.lit(_CUT)), F.regexp_replace(c, PATTERN, _CUT.join(("$1", "$2", "$3", "$4")))), _CUT)


def strip_ending(c: Column) -> Column:
    return strip(F.regexp_replace(c, TRAILING_OR_COMMA, ""))


def leading_article(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?iU)^(a|an|the)\s+", 1))


def without_article(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)^(?:a|an|the)\s+", "")


def list_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def join_initials(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)\b([A-Z])\.\s+([A-Z])\.?", "$1.$2.")
    return strip(F.regexp_replace(c, r"(?U)\b([A-Z])\.\s+([A-Z])\b", "$1.$2."))


def has_artifacts(c: Column) -> Column:
    return c.rlike("[¿�ÃÂÆ]|[^\\x00-\\x7FÀ-ɏ–—]")


def is_truncated(c: Column) -> Column:
    """More than one word, the last a lone capital or two letters in title case."""
    last = last_word(c)
    return F.coalesce((word_count(c) > 1) & last.rlike(r"^\p{Lu}(?:[^\p{Lu}])?$"), F.lit(False))


def is_weak(c: Column) -> Column:
    low = F.lower(strip(c))
    jargon = F.array(*map(F.lit, lists.JARGON))
    return low.isin(*lists.WEAK, *lists.JARGON) | F.arrays_overlap(words(low), jargon)


def is_shouting(word: Column) -> Column:
    return (F.length(word) >= 5) & (F.upper(word) == word) & (F.lower(word) != word)


def shouts(c: Column) -> Column:
    return F.exists(words(c), is_shouting)


def is_valid_action(c: Column) -> Column:
    head = last_word(F.lower(c))
    known = head.isin(*lists.ACTIONS) | head.rlike("(" + "|".join(lists.ACTION_ENDINGS) + ")$")
    return F.coalesce(word_count(c).between(1, 3) & ~shouts(c) & known, F.lit(False))


def is_clean(c: Column) -> Column:
    return (c != "") & ~has_artifacts(c) & ~is_truncated(c) & ~is_weak(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def guessed_tag(word: Column, low: Column | None = None) -> Column:
    """A tag for a word outside the lexicon; ``low`` is its lower case, where that is known."""
    low = F.lower(word) if low is None else low
    adjective = reduce(lambda a, b: a | b, (low.endswith(x) for x in ("ous", "ful", "ive", "able", "ible", "ish", "less")))
    by_ending = F.when(adjective, "ADJ").when(low.endswith("ly"), "ADV").otherwise("NOUN")
    return F.when(word.rlike(r"^\p{L}"), by_ending).when(word.rlike(r"^[^\p{L}\p{N}]$"), "PUNCT").when(word.rlike(r"^[\p{N}]+$"), "NUM").otherwise(by_ending)


def is_valid_item(c: Column, tokens: Column) -> Column:
    """``tokens``: array<struct<text, tag, ...>> of the phrase."""
    own = F.filter(tokens, lambda x: ~((x["tag"] == "PUNCT") & (x["text"] == "-")))
    ok = F.forall(own, lambda x: x["tag"].isin(*lists.ITEM_TAGS)) & F.exists(tokens, lambda x: x["tag"].isin(*lists.NOUN_TAGS))
    return word_count(c).between(1, 3) & ~c.rlike("[0-9]{4}") & ~shouts(c) & ok


def is_valid_object(c: Column, tokens: Column) -> Column:
    own = F.filter(tokens, lambda x: ~((x["tag"] == "PUNCT") & (x["text"] == "-")))
    ok = F.forall(own, lambda x: ~x["tag"].isin("PUNCT", *lists.REJECTED_TAGS)) & F.exists(tokens, lambda x: x["tag"].isin(*lists.NOUN_TAGS))
    return word_count(c).between(1, 5) & ~c.rlike("[0-9]{4}") & ~shouts(c) & ok


def title_case(c: Column) -> Column:
    """Words up, small words down unless first or last; a word with a capital inside stays."""

    def one(w: Column, at: Column, n: Column) -> Column:
        inner = w.rlike(r"^.+\p{Lu}") & (w != F.upper(w)) | w.rlike(r"^\p{Lu}{2,}$|^(?:\p{Lu}\.)+$")
        small = F.lower(w).isin(*lists.SMALL_WORDS) & (at > 0) & (at < n - 1)
        return F.when(inner, w).when(small, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))

    parts = F.split(c, " ")
    return F.array_join(F.transform(parts, lambda w, i: one(w, i, F.size(parts))), " ")


def a_or_an(article: Column, following: Column) -> Column:
    """``a`` or ``an`` by the sound of the next word; other articles as they are."""
    w = F.regexp_extract(following, r"^\S+", 0)
    low = F.lower(w)
    spelled = w.rlike(r"^\p{Lu}{2,}$|^(?:\p{Lu}\.)+$|^\p{Lu}$")
    an = (
        F.when(spelled, w.rlike("^[AEFHILMNORSX]")).when(low.rlike("^(" + "|".join(lists.SILENT_H) + ")"), True)
        .when(low.rlike(lists.CONSONANT_SOUND), False).otherwise(low.rlike("^[aeiou]"))
    )
    return F.when(article.isin("a", "an") & (w != ""), F.when(an, "an").otherwise("a")).otherwise(article)


def text_fillers(c: Column) -> Column:
    """The fillers of a finished text (``and the`` only), empty where it doesn't fit."""
    part = lambda k: F.regexp_extract(c, PATTERN_THE, k)
    cut = F.split(F.regexp_replace(c, PATTERN_THE, _CUT.join(("$1", "$2", "$3"))), _CUT)  # the pattern is matched once
    slow = F.array(F.array(part(1), part(2), part(3)))
    three = F.when(~F.contains(c, F.lit(_CUT)), F.filter(F.array(cut), lambda p: F.size(p) == 3)).when(c.rlike(PATTERN_THE), slow)
    found = F.transform(three, lambda p: F.concat(list_items(p[0]), F.array(strip(p[1]), strip_ending(p[2]))))
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def missing_sections(c: Column, required: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, required)), lambda h: ~F.contains(F.lower(c), F.lower(h)))


def drop_section(c: Column, heading: str) -> Column:
    return F.regexp_replace(c, r"(?is)\n?" + heading + r"\b.*?(?=\n## |\z)", "")


def cut_preamble(c: Column) -> Column:
    """From the first second-level heading on."""
    return F.when(F.instr(c, "## ") > 0, F.regexp_replace(c, r"(?s)\A.*?(?=## )", "")).otherwise(c)
