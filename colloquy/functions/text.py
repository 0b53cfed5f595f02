"""Words, edits, agreement, languages."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that vote for German and English.
GERMAN = (
    "der die das und ist nicht ich du wir ihr sie es ein eine einen dem den mit von für auf als auch aber wenn "
    "dann noch schon nur mal was wie wo ja nein doch beim vom zur zum über unter zwischen gegen ohne durch"
).split()
ENGLISH = (
    "the a an and is are was were not i you we they it this that of to in for on with as at by from but if "
    "then just only what how where yes no about into over under between against without through"
).split()
# Back-channels and hesitations, German and English together.
FILLERS = (
    "ach achso aha ah ahh aehm boah doch eben eh er err gell genau hah haha heh hehe hey hm hmm hmmm huh ja jaa jo "
    "kay mhm mhmm mm mmm na nah naja nee ne no nope oh ohh oi ok okay ooh right so sure tja uh uhh uhm um umm "
    "well wow yeah yea yeh yep yes yup äh ähm öh nö"
).split()
# Letters that one language alone writes.
EXCLUSIVE_LETTERS = {"cs": "ýčěřšůž", "es": "ñ", "pl": "ąćęłńśż", "pt": "ãõ", "tr": "ğış"}
# Languages that may be declared, in the order they are shown.
OFFERED = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "ru": "Russian", "uk": "Ukrainian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "tr": "Turkish", "sv": "Swedish", "da": "Danish", "no": "Norwegian", "fi": "Finnish", "cs": "Czech"}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised_words(text: Column) -> Column:
    """Upper-case words of letters, digits and apostrophes; what has none of them is no word."""
    words = F.split(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Z}\s]+", " ")), r"[^\p{L}\p{N}' ]", ""), " ")
    return F.filter(F.transform(words, F.upper), lambda w: w != "")


def split_words(text: Column) -> Column:
    """Words as white space cuts them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\p{Z}\s]+"), lambda w: w != "")


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters and apostrophes; digits are no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}'’]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """Letter words without the back-channels; repetitions stay."""
    fill = F.array(*(F.lit(w) for w in FILLERS))
    return F.filter(letter_words(text), lambda w: ~F.array_contains(fill, w))


def _coded(words: Column, dictionary: Column) -> Column:
    """One character a word: its place in ``dictionary``, as a code point from U+0400 up (below the surrogates)."""
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(dictionary, w) + F.lit(0x3FF)), 4, "0")), "UTF-16BE")), "")


def word_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays, in whole words.

    Each distinct word becomes one character, so the built-in distance on
    strings does the work; two texts may have 54 thousand distinct words.
    """
    pair = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("d"))
    return let(pair, lambda p: F.levenshtein(_coded(p["a"], p["d"]), _coded(p["b"], p["d"])))


def wer(heard: Column, truth: Column) -> Column:
    """Word edits by the reference's words; unbounded; null if the reference has none."""
    b = split_words(truth)
    return F.when(F.size(b) > 0, word_edits(split_words(heard), b) / F.size(b))


def edits(original: Column, corrected: Column) -> Column:
    """struct(edits, words): words are those of the longer text; null if nothing was left by the correction."""
    a, b = split_words(original), split_words(corrected)
    return F.when(F.size(b) > 0, F.struct(word_edits(a, b).cast("long").alias("edits"), F.greatest(F.size(a), F.size(b)).cast("long").alias("words")))


def agreement(a: Column, b: Column) -> Column:
    """1 less the share of normalised words that differ, 0 at least; two empty texts agree."""
    x, y = normalised_words(a), normalised_words(b)
    longer = F.greatest(F.size(x), F.size(y))
    return F.when(longer == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - word_edits(x, y) / longer))


def _votes(words: Column, stop: list[str]) -> Column:
    listed = F.array(*(F.lit(w) for w in stop))
    return F.size(F.filter(words, lambda w: F.array_contains(listed, w)))


def language_vote(text: Column) -> Column:
    """de, en, unclear or empty: an umlaut settles German, else stop words vote and a tie is unclear."""
    words = letter_words(text)
    de, en = _votes(words, GERMAN), _votes(words, ENGLISH)
    return F.when(F.size(words) == 0, "empty").when(F.lower(text).rlike("[äöüß]"), "de").when(de > en, "de").when(en > de, "en").otherwise("unclear")


def script_language(text: Column) -> Column:
    """ja, ko, uk, ru, zh, ar or el by writing system; else null.

    Two kana or hangul decide by presence; the others need a third of the letters.
    """
    n = lambda cls: F.regexp_count(text, F.lit(cls))
    letters = n(r"\p{L}")
    third = lambda cls: (letters > 0) & (n(cls) * 3 >= letters)
    cyrillic = r"[Ѐ-ӿ]"
    return (
        F.when(n(r"[぀-ヿㇰ-ㇿｦ-ﾝ]") >= 2, "ja")
        .when(n(r"[가-힯ᄀ-ᇿ]") >= 2, "ko")
        .when(third(cyrillic) & text.rlike("[їієґЇІЄҐ]"), "uk")
        .when(third(cyrillic), "ru")
        .when(third(r"[㐀-䶿一-鿿豈-﫿]"), "zh")
        .when(third(r"[؀-ۿ]"), "ar")
        .when(third(r"[Ͱ-Ͽ]"), "el")
    )


def diacritic_language(text: Column) -> Column:
    """The language that alone writes a letter of the text, if one does and the text has two words."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*(F.when(low.rlike(f"[{letters}]"), tag) for tag, letters in EXCLUSIVE_LETTERS.items())))
    return F.when((F.size(hits) == 1) & (F.size(letter_words(text)) >= 2), F.element_at(hits, 1))


def other_language(text: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    """A language besides German and English: by script, by letters, then by stop words (three votes, outright) if given."""
    found = F.coalesce(script_language(text), diacritic_language(text))
    if not stopwords:
        return found
    words = letter_words(text)
    mine = _votes(words, GERMAN) + _votes(words, ENGLISH)
    votes = F.array(*(F.struct(_votes(words, ws).alias("n"), F.lit(tag).alias("tag")) for tag, ws in stopwords.items()))
    best = F.array_max(votes)
    tied = F.size(F.filter(votes, lambda v: v["n"] == best["n"])) > 1
    short = (F.size(words) <= 4) & (best["n"] == 2) & (mine == 0)
    return F.coalesce(found, F.when(((best["n"] >= 3) | short) & (best["n"] > mine) & ~tied, best["tag"]))


def normalised_languages(tags: Column) -> Column:
    """Lower-case distinct tags in order; null if there are none or ``any`` is among them."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    return F.when((F.size(clean) > 0) & ~F.array_contains(clean, "any"), clean)


def unknown_languages(tags: Column) -> Column:
    """The tags that are not offered: not empty means that the caller must refuse."""
    return F.array_except(F.coalesce(normalised_languages(tags), F.array().cast("array<string>")), F.array(*(F.lit(t) for t in OFFERED)))


def corrected_words(before: Column, after: Column) -> Column:
    """Words of three letters or more that a correction added, in its spelling, once each."""
    strip = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}'-]+|[^\p{L}\p{N}'-]+$", "")
    had = F.transform(split_words(before), lambda w: F.lower(strip(w)))
    new = let(had, lambda h: F.filter(F.transform(split_words(after), strip), lambda w: (F.char_length(w) >= 3) & ~F.array_contains(h, F.lower(w))))
    return _first_spellings(new)


def _first_spellings(words: Column) -> Column:
    """Words once each, whatever their case, as first spelt."""
    both = F.struct(words.alias("w"), F.transform(words, lambda w: F.lower(w)).alias("low"))
    return let(both, lambda x: F.filter(x["w"], lambda w, i: F.array_position(x["low"], F.lower(w)) == i + 1))


def clean_terms(terms: Column) -> Column:
    """Terms of one to four words and 64 characters at most, with single spaces."""
    tidy = F.transform(terms, lambda t: F.trim(F.regexp_replace(t, r"[\p{Z}\s]+", " ")))
    return F.filter(tidy, lambda t: (t != "") & (F.size(F.split(t, " ")) <= 4) & (F.char_length(t) <= 64))


def effective_terms(user: Column, *automatic: Column, cap: int = 100) -> Column:
    """Terms in order of priority, once each whatever their case (the first spelling stays), ``cap`` at most."""
    every = F.filter(F.transform(F.concat(user, *automatic), lambda t: F.trim(t)), lambda t: t != "")
    return F.slice(_first_spellings(every), 1, cap)


def cjk_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring Han, kana or hangul characters, full-width forms folded."""
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[！-～]"), F.decode(F.unhex(F.lpad(F.hex(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xFEE0), 4, "0")), "UTF-16BE")).otherwise(c)), "")
    runs = F.regexp_extract_all(wide, F.lit(r"[぀-ヿ㐀-䶿一-鿿가-힯]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.array_distinct(pairs)


def grounded(answer: Column, source: Column) -> Column:
    """Whether an answer shares two content words, or three CJK pairs, with what it cites."""
    shared = F.size(F.array_intersect(content_words(answer), content_words(source)))
    return (shared >= 2) | (F.size(F.array_intersect(cjk_bigrams(answer), cjk_bigrams(source))) >= 3)


# Interrogatives, German and English, and how Japanese questions end.
INTERROGATIVES = "was wer wen wem wessen wann wo wohin woher wie warum wieso weshalb worueber worum wovon welche welcher welches welchen what who whom whose when where why how which".split()
JAPANESE_QUESTIONS = ("でしょうか", "ですか", "ますか", "かな", "か", "の")


def is_question(text: Column) -> Column:
    """Ends in a question mark, opens with an interrogative, or is Japanese and ends as questions do."""
    t = F.regexp_replace(text, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")
    folded = F.replace(F.replace(F.replace(F.replace(F.lower(t), F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")), F.lit("ß"), F.lit("ss"))
    first = F.regexp_extract(folded, r"([\p{L}\p{N}_'’]+)", 1)
    n = lambda cls: F.regexp_count(t, F.lit(cls))
    kana, han, letters = n(r"[぀-ヿㇰ-ㇿｦ-ﾝ]"), n(r"[㐀-䶿一-鿿豈-﫿]"), n(r"[\p{L}&&[^぀-ヿㇰ-ㇿｦ-ﾝ㐀-䶿一-鿿豈-﫿]]")
    japanese = (kana >= 2) | ((kana >= 1) & (han >= 1)) | ((han >= 1) & (letters == 0) & (kana == 0))
    ending = F.regexp_replace(t, r"[?？。.！!…、,」\"'\p{Z}\s]+$", "").rlike(f"(?:{'|'.join(JAPANESE_QUESTIONS)})$")
    return F.coalesce(t.rlike(r"[?？]$") | (japanese & ending) | first.isin(INTERROGATIVES), F.lit(False))


def words_in_common(a: Column, b: Column) -> Column:
    """struct(shared, score): distinct words that two arrays share, and their Jaccard index."""
    shared = F.size(F.array_intersect(a, b))
    return F.struct(shared.alias("shared"), (shared / F.greatest(F.lit(1), F.size(F.array_union(a, b)))).alias("score"))


# Phrases that undertake something, and phrases that take it back.
MODALS = (
    r"\bi'?ll\b|\bi will\b|\bi'?m (?:gonna|going to)\b|\bich (?:werde|schicke?|mache?|lade?|zeige?|bringe?|gebe?|hole?|baue?|kümmere?)\b"
    r"|\b(?:schick|mach|lad|zeig|bring|geb|hol|bau|schicke|mache|lade|zeige|bringe|gebe|hole|baue) ich\b|\bversprochen\b"
)
VETOES = (
    r"\b(?:probably|maybe|might|i guess|i think i|perhaps|possibly)\b|\b(?:vielleicht|wahrscheinlich|eventuell|villeicht|glaub ich|ich glaube?)\b"
    r"|\b(?:we should|you should|somebody should|let'?s)\b|\b(?:wir sollten|du solltest|man (?:sollte|müsste|könnte))\b"
    r"|\bif i (?:ever|get|can|had)\b|\bwenn ich (?:mal|jemals|irgendwann)\b"
    r"|\b(?:yesterday|already sent|already did|i sent you|i did that)\b|\b(?:gestern|schon geschickt|hab ich schon|hatte ich schon|bereits geschickt)\b"
)


def promises(text: Column) -> Column:
    """Whether a line undertakes something: a modal, no veto, not a question."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\p{Z}\s]+|[\p{Z}\s]+$", ""))
    unicode = "(?U)"
    return (t != "") & ~t.endswith("?") & ~t.rlike(unicode + VETOES) & t.rlike(unicode + MODALS)


def promise_confidence(has_due: Column, others: Column) -> Column:
    """0.25, and 0.08 for a due date, and 0.07 if one other voice alone is there to be owed."""
    return F.lit(0.25) + F.when(has_due, 0.08).otherwise(0.0) + F.when(others == 1, 0.07).otherwise(0.0)


def night_vote(night: Column, live: Column, canary: Column, tau: float, row_lang: Column, night_lang: Column, rule: str = "two_of_three", replace_allowed: bool = True) -> Column:
    """nothing, annotate or replace: may a later reading take the place of what is written?

    two_of_three: only if a second reader agrees with it and neither agrees with
    the text; night_wins: if it differs from the text; keep_live: never. It must
    have two words and read as the row's language.
    """
    empty = F.size(normalised_words(night)) == 0
    voted = F.coalesce((F.size(normalised_words(canary)) > 0) & (agreement(night, canary) >= tau) & (agreement(night, live) < tau) & (agreement(canary, live) < tau), F.lit(False))
    differs = agreement(night, live) < tau
    guards = F.coalesce((F.size(normalised_words(night)) >= 2) & (F.coalesce(night_lang, row_lang) == row_lang) & (language_vote(night) == row_lang), F.lit(False))
    may = {"two_of_three": voted, "night_wins": differs, "keep_live": F.lit(False)}[rule] & F.lit(replace_allowed)
    return F.when(empty, "nothing").when(may & guards, "replace").otherwise("annotate")


def find_in_text(text: Column, query: str) -> Column:
    """array<struct<start, end>> of a literal query in a text, whatever the case and marks of either: in code points, on grapheme boundaries."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"start": a, "end": b} for a, b in literal_matches(x or "", query)])

    return run(text)


def _folded(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")).lower()


def literal_matches(text: str, query: str) -> list[tuple[int, int]]:
    needle = _folded(query.strip())
    if not needle:
        return []
    folded, owner = [], []
    for m in regex.finditer(r"\X", text):
        part = _folded(m.group())
        folded.append(part)
        owner += [m.span()] * len(part)
    whole, at, out = "".join(folded), 0, []
    while (at := whole.find(needle, at)) >= 0:
        start, end = owner[at][0], owner[at + len(needle) - 1][1]
        if not out or start >= out[-1][1]:
            out.append((start, end))
        at += len(needle)
    return out


def graphemes(text: Column) -> Column:
    """How many user-perceived characters a text has; an icon may have two at most."""
    return F.regexp_count(text, F.lit(r"\X"))


def unroute_verdict(has_prior: Column, prior: Column, declared_elsewhere: Column, duration_s: Column, text: Column, floor_s: float = 1.0) -> Column:
    """no_prior, revert or keep: whether a rewrite by another decoder still stands by the rules that would route it today.

    Reverted: what was there is German, English or another clear language, or has
    fewer than two content words; the voice declared languages that none routes;
    the turn is under the floor; the rewrite is empty or weak.
    """
    worded = F.coalesce(F.trim(prior) != "", F.lit(False))
    readable = language_vote(prior).isin("de", "en") | other_language(prior).isNotNull()
    back = worded & (readable | (F.size(content_words(prior)) < 2))
    weak = weak_output(text, duration_s)
    gone = back | F.coalesce(declared_elsewhere, F.lit(False)) | (duration_s < floor_s) | (F.coalesce(text, F.lit("")) == "") | weak
    return F.when(~has_prior, "no_prior").when(gone, "revert").otherwise("keep")


#: Bounds of a decode that says something: letters, letters a second, distinct letters, Latin letters.
MIN_LETTERS, MIN_LETTERS_PER_S, MIN_DISTINCT, MAX_LATIN = 4, 1.0, 0.5, 1 / 3


def weak_output(text: Column, duration_s: Column) -> Column:
    """Too few letters for a sentence or for the audio's length, a loop of a few letters, or mostly Latin ones."""
    letters = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"), F.lit(0))
    n = F.size(letters)
    latin = F.size(F.filter(letters, lambda c: c.rlike("[A-Za-zÀ-ɏ]")))
    return (n < MIN_LETTERS) | (n < MIN_LETTERS_PER_S * F.greatest(duration_s, F.lit(0.0))) | (F.size(F.array_distinct(letters)) <= MIN_DISTINCT * n) | (latin > MAX_LATIN * n)


def iso_or_number_ns(value: Column) -> Column:
    """Nanoseconds of an ISO 8601 text or of a number: milliseconds below 1e15, else nanoseconds. Null if neither."""
    n = value.try_cast("decimal(20,0)")
    parsed = F.unix_micros(F.try_to_timestamp(value)) * 1000
    return F.when(n.isNotNull(), F.when(F.abs(n) < F.lit(10**15), n * 1_000_000).otherwise(n).cast("long")).otherwise(parsed)
