"""Token ids, response boundary and loss-masked labels (K1-K6).

Default tokenizer: the text is cut into pieces that tile it exactly (a newline,
a run of blanks plus the next word, or a trailing run of blanks); the
end-of-sequence text is its own piece. A piece's id is ``2 +`` the first 28
bits of its md5, the end-of-sequence id is 1. Everything runs in the JVM, and
the same definition is plain SQL in DuckDB. An external tokenizer can be used
instead through ``sparqa.operators.tokenise.tokenise_with`` (Arrow batches).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formatting import EOS
from .text import BLANK_J, NOT_WS_J, WS_CHARS, _class, col, let

IGNORE = -100            # label value that the loss ignores
EOS_ID = 1               # id of the end-of-sequence piece
UNKNOWN_PAD = None       # no pad id: reuse end-of-sequence (then real ends are masked too)

_BLANK = _class(WS_CHARS.replace("\n", ""))                  # whitespace except newline
_WORD = "[^" + _class(WS_CHARS)[1:-1] + "<]"                  # neither whitespace nor "<"
_WORD_J = NOT_WS_J[:-1] + "<]"


def piece_pattern(eos: str = EOS, java: bool = False) -> str:
    """The piece regex. The portable form (Java and RE2) lists the whitespace
    code points; ``java=True`` gives the same language with Java's faster
    character classes (used on Spark)."""
    blank, word = (BLANK_J, _WORD_J) if java else (_BLANK, _WORD)
    return (re.escape(eos).replace("\\<", "<").replace("\\>", ">")
            + r"|\n|" + blank + "*" + word + "+|" + blank + "*<|" + blank + "+")


def pieces(text: Column | str, eos: str = EOS) -> Column:
    """K1 step 1: the list of pieces (their concatenation is the text)."""
    return F.regexp_extract_all(col(text), F.lit(piece_pattern(eos, java=True)), 0)


_LINE_ID = int(hashlib.md5(b"\n").hexdigest()[:7], 16) + 2


def piece_id(p: Column, eos: str = EOS) -> Column:
    """The id of a piece; the newline, a piece of its own in every text, has its known id without another md5."""
    return F.when(p == F.lit(eos), F.lit(EOS_ID)).when(p == F.lit("\n"), F.lit(_LINE_ID)).otherwise(
        (F.conv(F.substring(F.md5(p), 1, 7), 16, 10).cast("int") + 2))


def token_ids(text: Column | str, max_len: int, eos: str = EOS) -> Column:
    """K1: ids of the first ``max_len`` pieces (right truncation)."""
    return ids_of(F.slice(pieces(text, eos), 1, max_len), eos)


def ids_of(piece_list: Column, eos: str = EOS) -> Column:
    return F.transform(piece_list, lambda p: piece_id(p, eos))


def prompt_tokens(text: Column | str, prompt_chars: Column | str, eos: str = EOS) -> Column:
    """Number of pieces that start before ``prompt_chars`` (pieces tile the text,
    so this is the piece count of the prompt prefix)."""
    return F.size(pieces(col(text).substr(F.lit(1), col(prompt_chars)), eos))


def starts_before(piece_list: Column, limit: Column) -> Column:
    """How many pieces start before character ``limit`` (start offsets are the
    running sum of piece lengths; one linear pass, no offset array built)."""
    init = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("cnt"))
    return F.aggregate(piece_list, init,
                       lambda acc, p: F.struct((acc["pos"] + F.length(p)).alias("pos"),
                                               (acc["cnt"] + F.when(acc["pos"] < limit, 1).otherwise(0))
                                               .alias("cnt")),
                       lambda acc: acc["cnt"])


def _cut_in_eos(text: Column, limit: Column, eos: str) -> Column:
    """Whether some end-of-sequence text begins before character ``limit`` and ends behind it."""
    first = F.greatest(limit - (len(eos) - 2), F.lit(1))
    return F.position(F.lit(eos), text.substr(first, F.greatest(limit + len(eos) - first, F.lit(0)))) > 0


def pieces_before(text: Column | str, piece_list: Column, limit: Column, eos: str = EOS) -> Column:
    """``starts_before`` of the text's first pieces ``piece_list``, 0 for a null ``limit``.

    A prefix has a piece for each piece of the text that starts in it, unless
    it ends inside an end-of-sequence text; so it is cut into pieces once
    more, and only where it ends so are the pieces themselves walked.
    """
    limit = F.coalesce(limit, F.lit(0))
    n = F.when(_cut_in_eos(col(text), limit, eos), starts_before(piece_list, limit)).otherwise(
        F.least(F.size(pieces(col(text).substr(F.lit(1), limit), eos)), F.size(piece_list)))
    return F.coalesce(n, F.lit(0))


def response_start(n_prompt: Column, n_tokens: Column) -> Column:
    """K2: index of the first token starting at or after the prompt; 0 when
    truncation removed every such token (the whole row then stays unmasked)."""
    return F.when(n_prompt < n_tokens, n_prompt).otherwise(F.lit(0))


def mask_labels(ids: Column, start: Column, pad_id: int | None = UNKNOWN_PAD) -> Column:
    """K3: ids, with ``-100`` before the response start and wherever id == pad id."""
    pad = EOS_ID if pad_id is None else pad_id
    return F.transform(ids, lambda x, i: F.when((i < start) | (x == pad), F.lit(IGNORE)).otherwise(x))


def has_target(labels: Column) -> Column:
    """at least one label is not ignored."""
    return F.exists(labels, lambda x: x != IGNORE)


def pad_right(arr: Column, max_len: int, value: int) -> Column:
    """Right-pad an array to ``max_len`` with ``value``."""
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(F.lit(max_len) - F.size(arr), F.lit(0))))


def attention_mask(n_tokens: Column, max_len: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), n_tokens),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n_tokens, F.lit(0))))


def choice_slice(ids: Column, prompt_len: Column) -> Column:
    """K4: ids after the prompt's tokens."""
    return F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))


def log_softmax_at(logits: Column, target: Column) -> Column:
    """K5: ``logits[target] - logsumexp(logits)`` (stable: subtract the max first); null for a target outside the vector."""
    def at(v: Column) -> Column:
        def with_max(m: Column) -> Column:
            total = F.aggregate(v, F.lit(0.0), lambda a, q: a + F.exp(q - m))
            return F.when(target >= 0, F.try_element_at(v, target + 1)) - (m + F.log(total))
        return let(F.array_max(v), with_max)
    return let(col(logits).cast("array<double>"), at)


def sequence_logprob(rows: Column | str, targets: Column | str) -> Column:
    """K5 + K6: the summed log-probability of ``targets`` (array<int>) under one logit vector each (array<array<double>>).

    Minus infinity without targets, or with more or fewer vectors than targets; a
    null array counts as empty. Null for a target outside its vector.
    """
    def total(v: Column, t: Column) -> Column:
        logprobs = F.zip_with(v, t, log_softmax_at)
        return F.when((F.size(t) == 0) | (F.size(v) != F.size(t)), F.lit(float("-inf"))).otherwise(
            F.aggregate(logprobs, F.lit(0.0), lambda a, b: a + b))
    empty = lambda c, kind: F.coalesce(col(c), F.array().cast(kind))
    return let(F.struct(empty(rows, "array<array<double>>").alias("v"), empty(targets, "array<int>").alias("t")),
               lambda s: total(s["v"], s["t"]))


def shifted_rows(logits: Column | str, ids: Column | str, prompt_len: Column | str) -> Column:
    """The logit vectors that predict the ids after the prompt: the vector of a position predicts the id after it.

    ``logits`` has a vector for every id. Without prompt nothing predicts the first id, so there are no rows.
    """
    n = F.greatest(F.size(col(ids)) - col(prompt_len), F.lit(0))
    return F.when(col(prompt_len) > 0, F.slice(col(logits), F.greatest(col(prompt_len), F.lit(1)), n)).otherwise(
        F.array().cast("array<array<double>>"))


def settled_pieces(text: Column | str, eos: str = EOS) -> Column:
    """struct(pieces, chars): first pieces of the text that stay as they are whatever is appended, and their characters.

    A piece is decided by its own characters, the one after it, and where the
    end-of-sequence text may begin by as many characters as that has. So the
    text is cut that far from its end: all pieces before the cut but the last
    are settled. Where the cut lies inside an end-of-sequence text, none is taken.
    """
    def of_cut(cut: Column) -> Column:
        def but_last(p: Column) -> Column:
            return F.when((F.size(p) == 0) | _cut_in_eos(col(text), cut, eos),
                          F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("chars"))).otherwise(
                F.struct(F.slice(p, F.lit(1), F.size(p) - 1).alias("pieces"),
                         (cut - F.length(F.element_at(p, -1))).alias("chars")))
        return let(pieces(col(text).substr(F.lit(1), cut), eos), but_last)
    return let(F.greatest(F.length(col(text)) - len(eos), F.lit(0)), of_cut)
