"""Answer extraction from free-form solutions.

The cascade takes the first *matching* rule (a matched but empty box does not
fall through), reduces the text to its capital letters ``A``-``D`` and looks
that key up as ``KEY:`` in the question. All steps are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, lstrip, splitlines, strip

# Fixed values (patterns that decide which text counts as an answer).
# Boxed content: optional "$" around "\boxed{...}", one nested brace level.
# The quantifiers are possessive: same matches as the backtracking form, but
# Java does not recurse per character, so a 20 000-character box cannot
# overflow the executor's stack.
BOXED = r"\$?\\boxed\{((?:[^{}]++|\{[^{}]*+\})*+)\}\$?"
# "Conclusion" in any case, optional ":" or "-", then everything to the end.
CONCLUSION = r"(?isu)conclusion[:\-]?(.*)"
# End-of-proof marker, matched literally.
MARKER = "$\\blacksquare$"
# The option letters an extracted answer is reduced to.
ANSWER_LETTERS = "[A-D]"


def boxed(solution: Column | str) -> Column:
    """Stripped content of the first box, null when there is none."""
    s = col(solution)
    return F.when(s.rlike(BOXED), strip(F.regexp_extract(s, BOXED, 1)))


def after_conclusion(solution: Column | str) -> Column:
    """Stripped text after the first ``Conclusion``, null when absent."""
    s = col(solution)
    return F.when(s.rlike(CONCLUSION), strip(F.regexp_extract(s, CONCLUSION, 1)))


def before_marker(solution: Column | str) -> Column:
    """The (up to) two lines before the first end-of-proof marker, stripped."""
    s = col(solution)

    def last_two(lines: Column) -> Column:
        n = F.size(lines)
        joined = F.array_join(F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(2)), "\n")
        return F.when(n >= 1, strip(joined))

    return F.when(F.position(F.lit(MARKER), s) > 0,
                  let(splitlines(F.substring_index(s, MARKER, 1)), last_two))


def raw_answer(solution: Column | str) -> Column:
    """X4 first half: boxed, else conclusion, else marker lines, else null."""
    s = col(solution)
    return (F.when(s.rlike(BOXED), strip(F.regexp_extract(s, BOXED, 1)))
            .when(s.rlike(CONCLUSION), strip(F.regexp_extract(s, CONCLUSION, 1)))
            .when(F.position(F.lit(MARKER), s) > 0, before_marker(s)))


# Option ``strict_letter``: the whole answer is one letter, optionally in
# parentheses or followed by ".", ")" or ":".
STRICT_LETTER = r"^\(?([A-D])[.):]?$"


def letter_key(text: Column | str, strict: bool = False) -> Column:
    """All ``A``-``D`` characters of the text, or null when it has none.

    ``strict=True`` (quirk Q2 off) keeps only answers that are a single letter,
    so capitals inside words no longer form keys such as ``AB``.
    """
    t = col(text)
    if strict:
        return F.when(t.rlike(STRICT_LETTER), F.regexp_extract(t, STRICT_LETTER, 1))
    return F.when(t.rlike(ANSWER_LETTERS), F.regexp_replace(t, "[^A-D]", ""))


def lookup_option(question: Column | str, key: Column | str) -> Column:
    """``"KEY. rest of line"`` after the first ``KEY:`` in the question.

    Leading whitespace after the colon may cross line breaks; the value ends at
    the next ``\\n``. Null when the key is null or ``KEY:`` does not occur.
    """
    q = col(question)

    def found(k: Column) -> Column:
        needle = F.concat(k, F.lit(":"))

        def at(pos: Column) -> Column:
            rest = lstrip(q.substr(pos + F.length(needle), F.lit(2**31 - 1)))
            line = F.substring_index(rest, "\n", 1)
            return F.when(pos > 0, F.concat(k, F.lit(". "), strip(line)))

        return F.when(k.isNotNull(), let(F.position(needle, q), at))

    return let(col(key), found)


def extract_answer(solution: Column | str, question: Column | str,
                   strict_letter: bool = False) -> Column:
    """The extracted ``"KEY. option text"``, or null when nothing usable
    was found. Every stage is bound once, so each regex runs once per row."""
    return let(raw_answer(solution), lambda raw: let(letter_key(raw, strict_letter),
                                                     lambda k: lookup_option(question, k)))
