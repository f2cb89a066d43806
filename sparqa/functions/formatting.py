"""Training and evaluation text formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .options import MAX_LETTERS
from .text import WS_J, col, drop_trailing_dot, let, letter, strip

# The default end-of-sequence text (a tokenizer property; override per model).
EOS = "<|endoftext|>"
# Evaluation header and its default topic.
EVAL_HEADER = "The following are multiple choice questions (with answers) about {topic}.\n\n"
EVAL_TOPIC = "knowledge and skills in advanced master-level STEM courses"
# Default chat template (ChatML); one rendered block per message.
CHAT_TEMPLATE = "<|im_start|>{role}\n{content}<|im_end|>\n"

# A choice starts at any "A:".."E:"; it ends before "\nX:", "\n" + lower-case
# letter, "\n" + digit, or trailing whitespace at the end of the text.
_CHOICE_BODY = r"([A-E]):" + WS_J + r"*(.*?)(?=\n[A-E]:|\n[a-z]|\n\p{Nd}|" + WS_J + r"*\z)"
CHOICE = r"(?s)" + _CHOICE_BODY
CHOICE_START = r"[A-E]:"
# Option ``anchored`` (quirk Q8 off): a choice must start a line.
CHOICE_ANCHORED = r"(?s)(?<![^\n])" + _CHOICE_BODY
CHOICE_START_ANCHORED = r"(?m)^[A-E]:"


# --------------------------------------------------------------- G1

def format_answer_only(question: Column | str, answer: Column | str) -> Column:
    """G1: struct(text = question + "\\n" + answer, prompt_length_chars = len(question) + 1)."""
    q = col(question)
    return F.struct(F.concat(q, F.lit("\n"), col(answer)).alias("text"),
                    (F.length(q) + 1).cast("int").alias("prompt_length_chars"))


# ----------------------------------------------------------- G2-G7

def parse_choices(question: Column | str, anchored: bool = False) -> Column:
    """``["A. text", ...]`` for every lettered choice in the (stripped) question.

    ``anchored=True`` only accepts choices at the start of a line.
    """
    pattern = CHOICE_ANCHORED if anchored else CHOICE
    # One pass: each whole match is "L:" + blanks + text, so the letter is its
    # first character and the stripped remainder is the choice text.
    matches = F.regexp_extract_all(col(question), F.lit(pattern), 0)
    return F.transform(matches, lambda m: F.concat(m.substr(1, 1), F.lit(". "),
                                                   strip(m.substr(F.lit(3), F.lit(2**31 - 1)))))


def question_body(question: Column | str, anchored: bool = False) -> Column:
    """Text before the first choice, stripped (the whole text without choices)."""
    return strip(F.split(col(question), CHOICE_START_ANCHORED if anchored else CHOICE_START, 2)[0])


def build_prompt(body: Column, choices: Column) -> Column:
    """``body\\nA. ..\\nB. ..\\nAnswer:`` (``body\\n\\nAnswer:`` without choices)."""
    return F.concat(body, F.lit("\n"), F.array_join(choices, "\n"), F.lit("\nAnswer:"))


def gold_letter(answer: Column | str) -> Column:
    """Leading capital letter; else the upper-cased text, cut to its first
    character when longer than one and ending in ``.``."""
    def pick(a: Column) -> Column:
        u = F.upper(a)
        return (F.when(a.rlike("^[A-Z]"), a.substr(1, 1))
                 .when((F.length(u) > 1) & u.endswith("."), u.substr(1, 1))
                 .otherwise(u))
    return let(strip(answer), pick)


def build_response(gold: Column, reasoning: Column | str, eos: str = EOS) -> Column:
    """``" L<eos>"``, or ``" L\\nReasoning: ...<eos>"`` when the rationale is non-empty."""
    def resp(support: Column) -> Column:
        return F.when(support == "", F.concat(F.lit(" "), gold, F.lit(eos))) \
                .otherwise(F.concat(F.lit(" "), gold, F.lit("\nReasoning: "), support, F.lit(eos)))
    return let(strip(F.coalesce(col(reasoning), F.lit(""))), resp)


def format_with_rationale(question: Column | str, answer: Column | str,
                          reasoning: Column | str, eos: str = EOS, anchored: bool = False) -> Column:
    """struct(text, prompt_length_chars) = prompt(G2-G4) + response(G5-G6)."""
    def fmt(q: Column) -> Column:
        def with_prompt(prompt: Column) -> Column:
            return F.struct(F.concat(prompt, build_response(gold_letter(answer), reasoning, eos)).alias("text"),
                            F.length(prompt).cast("int").alias("prompt_length_chars"))
        return let(build_prompt(question_body(q, anchored), parse_choices(q, anchored)), with_prompt)
    return let(strip(question), fmt)


# --------------------------------------------------------------- G8

def render_chat(messages: list[tuple[str, Column]], template: str = CHAT_TEMPLATE) -> Column:
    """Concatenate ``template`` per (role, content) message, no generation prompt."""
    parts: list[Column] = []
    for role, content in messages:
        head, tail = template.split("{content}")
        parts += [F.lit(head.replace("{role}", role)), content, F.lit(tail.replace("{role}", role))]
    return F.concat(*parts)


# ------------------------------------------------------------ G9, G10

def eval_prompt(question: Column | str, choices: Column | str, topic: str = EVAL_TOPIC) -> Column:
    """G9 + Y6 + Y7: header, question, ``L. choice`` lines (first 26), ``Answer:``."""
    capped = F.slice(col(choices), 1, MAX_LETTERS)
    lines = F.transform(capped, lambda c, i: F.concat(letter(i), F.lit(". "), strip(c), F.lit("\n")))
    return F.concat(F.lit(EVAL_HEADER.format(topic=topic)), strip(question), F.lit("\n"),
                    F.array_join(lines, ""), F.lit("Answer:"))


def eval_continuations(choices: Column | str) -> Column:
    """``[" A", " B", ...]`` for the first 26 choices."""
    return F.transform(F.slice(col(choices), 1, MAX_LETTERS),
                       lambda c, i: F.concat(F.lit(" "), letter(i)))


def eval_gold(answer: Column | str, mode: str = "text") -> Column:
    """Strip, upper-case, drop one trailing ``.``.

    ``mode="letter"`` (quirk Q15 off) reduces the gold to its letter with G5,
    so ``"A: red"`` can match a predicted ``A``.
    """
    if mode == "letter":
        return gold_letter(answer)
    return drop_trailing_dot(F.upper(strip(answer)))
