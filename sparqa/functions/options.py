"""Option rendering and answer labelling.

All operators are array higher-order functions evaluated inside the row's
projection; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, letter, strip

NONE_TEXT = "None"          # how a missing option value is rendered
MAX_LETTERS = 26            # letters A..Z available for choices


def seeded_hash(seed: int | str, key: Column, i: Column) -> Column:
    """md5 of ``seed|key|i``: a stable, engine-independent random order key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string")))


def shuffle_options(values: list[Column], answer: Column, seed: int | str,
                    row_key: Column) -> tuple[Column, Column]:
    """Seeded shuffle of ``values``; returns (options text, labelled answer).

    Options are ordered by ``md5(seed|row_key|original_index)`` and lettered
    ``A:``, ``B:``...; the answer label is the *last* position whose value equals
    the answer (a distractor equal to the answer moves the label).
    """
    keyed = F.transform(F.array(*values),
                        lambda x, i: F.struct(seeded_hash(seed, row_key, i).alias("h"), x.alias("v")))
    ordered = F.array_sort(keyed)
    text = F.array_join(
        F.transform(ordered, lambda s, i: F.concat(letter(i), F.lit(": "),
                                                   F.coalesce(s["v"], F.lit(NONE_TEXT)))), "\n")
    label_idx = F.array_max(F.transform(ordered, lambda s, i: F.when(s["v"] == answer, i)))
    return text, F.concat(letter(label_idx), F.lit(": "), answer)


def option_pieces(options: Column | str) -> Column:
    """Y2 parsing: ``"A)21"`` -> struct(l="A", v="21"), both stripped."""
    return F.transform(col(options), lambda o: F.struct(
        strip(F.substring_index(o, ")", 1)).alias("l"),
        strip(o.substr(F.position(F.lit(")"), o) + 1, F.lit(2**31 - 1))).alias("v")))


def options_well_formed(options: Column | str) -> Column:
    """Every option has a ``)`` separator (rows failing this are rejected)."""
    return F.forall(col(options), lambda o: F.position(F.lit(")"), o) > 0)


def format_option_list(options: Column | str, correct: Column | str) -> tuple[Column, Column]:
    """Y2: (``"A: 21\\nB: 21.5..."``, ``"E: 23"``); an unmatched answer letter stays bare."""
    both = option_list(options, correct)
    return both["text"], both["answer"]


def option_list(options: Column | str, correct: Column | str) -> Column:
    """Y2 as struct(text, answer), so that the options are taken apart once for both."""
    c = col(correct)

    def render(pieces: Column) -> Column:
        line = lambda p: F.concat(p["l"], F.lit(": "), p["v"])
        matched = F.try_element_at(F.transform(F.filter(pieces, lambda p: p["l"] == c), line), F.lit(1))
        return F.struct(F.array_join(F.transform(pieces, line), "\n").alias("text"), F.coalesce(matched, c).alias("answer"))
    return let(option_pieces(options), render)


def render_four(opa: Column, opb: Column, opc: Column, opd: Column) -> Column:
    """``A: ..\\nB: ..\\nC: ..\\nD: ..``; a missing value renders as ``None``."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{L}: "), F.coalesce(o, F.lit(NONE_TEXT)))
                               for L, o in zip("ABCD", (opa, opb, opc, opd))])


def answer_by_index(idx: Column, opa: Column, opb: Column, opc: Column, opd: Column) -> Column:
    """Index 0-3 -> ``"A: " + opa`` ...; null when out of range or the option is null."""
    opts = F.array(*[F.concat(F.lit(f"{L}: "), o) for L, o in zip("ABCD", (opa, opb, opc, opd))])
    return F.when((idx >= 0) & (idx <= 3), F.try_element_at(opts, idx + 1))


def with_options(question: Column | str, options_text: Column) -> Column:
    """Question, newline, options."""
    return F.concat(col(question), F.lit("\n"), options_text)


def cap_choices(choices: Column | str, limit: int = MAX_LETTERS) -> Column:
    """Keep the first ``limit`` choices (one letter each)."""
    return F.slice(col(choices), 1, limit)
