"""Regular expressions. Each reads a text once, whatever it holds: classes that
follow one another do not overlap, and repeats are possessive where Java would
otherwise step back or use its stack."""

from __future__ import annotations


# Blank characters: ASCII blanks, next-line and every Unicode separator.
BLANK = r"\t\n\x0B\f\r\x{85}\p{Z}"
ALNUM = r"\p{L}\p{N}"

# Endings that are words of their own, as in "nation's" and "doesn't": the word
# before them counts, the ending breaks the phrase.
CLITIC = rf"(?i)(?=['’n])(?<=[{ALNUM}])(['’](?:s|re|ve|ll|d|m)|n['’]t)(?![{ALNUM}])"
# A word with inner hyphens or apostrophes is one token; every other
# non-blank character is a token of its own.
# Possessive, so that Java needs no stack for a word of very many parts.
TOKEN = rf"[{ALNUM}]++(?:[-'’][{ALNUM}]++)*+|[^{BLANK}]"
# Group 1 is a token that is letters and digits, not digits alone; any other
# token leaves it empty. The space before a token is taken with it: a search
# that begins at the space would try every class on it, and fail.
WORD_OR_TOKEN = rf"\x20?+(?:(\p{{Nd}}*+\p{{L}}[\p{{L}}\p{{Nd}}]*+)(?![{ALNUM}]|[-'’][{ALNUM}])|{TOKEN})"
LETTERS_OR_DIGITS = r"^[\p{L}\p{Nd}]+$"
DIGITS = r"^\p{Nd}+$"

SENTENCE_END = "[.!?]"
BLANK_RUN = f"[{BLANK}]+"
# Starts only where a run starts, so a long run inside the text is read once.
TRAILING_BLANKS = f"(?<![{BLANK}])[{BLANK}]++$"


def at_least_words(n: int) -> str:
    """Matches text of n or more words. A leading blank counts as one empty
    word, as it does in ``word_count``."""
    if n <= 0:
        return ""
    if n == 1:
        return r"(?s)."
    return f"^[^{BLANK}]*+" + f"[{BLANK}]++[^{BLANK}]++" * (n - 2) + f"[{BLANK}]++[^{BLANK}]"


