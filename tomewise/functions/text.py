"""Word splitting, stop words and plural reduction as built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The common English stop-word list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters that always part words.
BREAK_CHARS = ";@#$%&?!()[]{}<>\"\t\n\r\f\u000b\u00a0"
# Comma or colon unless a digit follows, dashes and dots in a row.
BREAK_PATTERN = r"[:,]([^0-9]|$)|--+|\.\.\.+"
# A full stop at the end of a word.
FULL_STOP_PATTERN = r"\.( |$)"
# Clitics that stand as their own token: don't -> do n't, book's -> book 's.
CLITIC_PATTERN = r"([^' ])(n't|'ll|'re|'ve|'s|'m|'d)( |$)"


def split_words(text: Column | str) -> Column:
    """Lower-case words without punctuation in order of appearance, with some empty ones between.

    Character maps do most of the work; the costly clitic pattern only sees texts with an apostrophe.
    """
    text = F.col(text) if isinstance(text, str) else text
    parted = F.translate(F.lower(text), BREAK_CHARS, " " * len(BREAK_CHARS))
    parted = F.regexp_replace(parted, BREAK_PATTERN, " $1")
    clitics = F.regexp_replace(F.regexp_replace(parted, FULL_STOP_PATTERN, " "), CLITIC_PATTERN, "$1 $2$3")
    parted = F.when(F.contains(text, F.lit("'")), clitics).otherwise(parted)
    return F.split(F.translate(parted, PUNCTUATION, ""), " ")


def tokens(text: Column | str) -> Column:
    """Array of lower-case words without punctuation; order and repeats kept."""
    return F.filter(split_words(text), lambda word: word != "")


def keep_word(word: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Condition for a word that is neither empty nor a stop word."""
    return ~word.isin("", *stop_words)


# Noun endings and what replaces them, and endings that are no plural.
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
KEPT_ENDINGS = ["ss", "us", "is"]


def singular_forms(word: Column) -> Column:
    """Array of what a word may be the plural of; empty for words of three letters or fewer."""
    kept = F.length(word) <= 3
    for ending in KEPT_ENDINGS:
        kept = kept | word.endswith(ending)
    forms = [
        F.when(word.endswith(old) & ~kept, F.concat(F.left(word, F.length(word) - len(old)), F.lit(new))) for old, new in NOUN_ENDINGS
    ]
    return F.array_compact(F.array(*forms))
