"""Chat formatting by quotation linking.

A message's lines that begin with ``>`` marks are quotes; their number is the
level. Consecutive lines of one level form a passage, which is normalised
(lower case, one space between words) and hashed. A passage refers to the
earliest message of the conversation that has it as its whole own text, as one
of its lines or blocks (lines between blank ones), or as a run of consecutive
lines or blocks; only references to earlier turns count. Runs are as long as
the passages of the same conversation, in lines or in blocks, so a quote may
be wrapped anew as long as one of the two counts stays. A message
answers the latest message that its level-one passages refer to, else the
turn before its own. Lines that all begin with ``>>>`` alone are input of an
interpreter, no quotes. Conversations come out without quotes, every message after
the one it answers.

Originals are reduced to one row per conversation and hash before they are
joined, so each passage meets one row. Places come from range partitions over
(conversation, turn, row), so no conversation or turn is ordered in one task.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.operators.sampling import with_position

from .common import arrow_map, met_by_key, saved

#: Modulus of the hashes, a prime.
PRIME = (1 << 128) - 159
#: Parts into which a conversation's messages are dealt to have their runs hashed.
SALTS = 64

_PROMPT = re.compile(r"^[ \t]*>>>(?:[ \t]|$)")
_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"^\s*(?:on|am|le|el|il)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\b[^:\n]{0,80}:\s*$", re.I)
_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def _value(words: str) -> tuple[int, int]:
    """A normalised text and the space before it as a number modulo ``PRIME``, and how many bytes these are."""
    plain = b" " + words.encode("utf-8", "surrogatepass")
    return int.from_bytes(plain) % PRIME, len(plain)


def _name(value: int, size: int) -> str:
    return f"{value:032x}-{size}"


def digest(text: str) -> str:
    return _name(*_value(normal(text)))


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text) in order.

    A line that introduces a quote ("On ... wrote:") goes with the quote.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    quoted = False
    for marked, group in groupby((text or "").split("\n"), lambda line: bool(_MARKS.match(line))):
        some = list(group)
        before = next((line for line in reversed(own) if line.strip()), "")
        if not marked or (all(map(_PROMPT.match, some)) and not _INTRO.match(before)):
            own += some
            continue
        quoted = True
        while own and not own[-1].strip():
            own.pop()
        if own and _INTRO.match(own[-1]):
            own.pop()
        level = 0
        for line in some:
            m = _MARKS.match(line)
            depth = m[1].count(">")
            if depth != level:
                passages.append((depth, []))
                level = depth
            passages[-1][1].append(line[m.end():])
    body = "\n".join(own).strip("\n") if quoted else (text or "")
    return body, [(d, "\n".join(p)) for d, p in passages if normal("\n".join(p))]


def units(text: str) -> tuple[list[str], list[str]]:
    """The lines of a text that aren't blank, and its blocks of lines between blank ones."""
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.strip():
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    return [x for b in blocks for x in b], ["\n".join(b) for b in blocks if b]


def sizes(passage: str) -> list[int]:
    """Lengths of the runs that a passage may be, one left out."""
    return sorted({len(u) for u in units(passage)} - {0, 1})


def originals(text: str) -> list[str]:
    """Hashes of a message's own text, of its lines and of its blocks."""
    lines, blocks = units(text)
    return list(dict.fromkeys(digest(p) for p in (text, *lines, *blocks) if normal(p)))


def runs(text: str, lengths: list[int]) -> list[str]:
    """Hashes of the runs of consecutive lines and of consecutive blocks of the given lengths, each from the sums up to its ends."""
    found: dict[str, None] = {}
    for unit in units(text):
        sums, ends = [0], [0]
        for part in unit:
            value, size = _value(normal(part))
            sums.append((sums[-1] * pow(256, size, PRIME) + value) % PRIME)
            ends.append(ends[-1] + size)
        for n in lengths:
            for i in range(len(unit) - n + 1):
                size = ends[i + n] - ends[i]
                found[_name((sums[i + n] - sums[i] * pow(256, size, PRIME)) % PRIME, size)] = None
    return list(found)


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), position, parent_turn, n_quotes, quoted_turns of every message.

    ``quoted_turns`` lists the turns that the passages refer to, -1 for one
    that is not found. ``parent_turn`` is always an earlier turn (null for the
    first one). Null and empty texts are messages without words; texts of any
    length are read whole. Messages without conv_id form one conversation,
    those without turn come first in theirs. Messages of one turn are placed by
    role and text; repeated rows each keep a place and have the same parent.
    An empty table gives no rows. Other columns are not looked at.
    """
    def kernel(convs: list, turns: list, roles: list, texts: list) -> dict:
        out: dict[str, list] = {n: [] for n in ("conv_id", "turn", "role", "text", "levels", "hashes", "own", "sizes")}
        for conv, turn, role, text in zip(convs, turns, roles, texts):
            body, quotes = parse(text)
            row = (conv, turn, role, body, [d for d, _ in quotes], [digest(q) for _, q in quotes], originals(body),
                   sorted({n for _, q in quotes for n in sizes(q)}))
            for name, x in zip(out, row):
                out[name].append(x)
        return out

    base = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = arrow_map(base, kernel, "conv_id bigint, turn bigint, role string, text string, levels array<int>, hashes array<string>, own array<string>, sizes array<int>",
                       ["conv_id", "turn", "role", "text"])
    rows = saved(parsed.withColumn("key", F.coalesce("conv_id", F.lit(-1 << 62))).withColumn("at", F.coalesce("turn", F.lit(-1 << 62)))
                 .withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text", "hashes")).withColumn("uid", F.monotonically_increasing_id())
                 .withColumn("place", F.concat_ws("|", "key", "at")).withColumn("message", F.concat_ws("|", "key", "at", "mid")), "parsed")
    quoted = rows.where(F.size("hashes") > 0).select("key", "at", "message", F.posexplode(F.arrays_zip("levels", "hashes")).alias("no", "q")) \
        .select("key", "at", "message", "no", F.col("q.levels").alias("level"), F.col("q.hashes").alias("hash")).distinct()
    asked = quoted.select(F.col("key").alias("k"), F.col("hash").alias("x")).distinct()
    held = rows.select("key", "at", F.explode("own").alias("hash"))
    lengths = rows.select(F.col("key").alias("k"), F.explode("sizes").alias("size")).groupBy("k").agg(F.collect_set("size").alias("lengths"))
    if not lengths.isEmpty():  # a long conversation's messages meet one of SALTS copies of its lengths
        salted = rows.select("key", "at", "text", F.pmod("mid", F.lit(SALTS)).alias("salt"))
        copies = lengths.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s"))).select("key", "at", "text", "lengths")
        cut = arrow_map(met, lambda texts, wanted: {"run": [runs(t, n) for t, n in zip(texts, wanted)]}, "run array<string>", ["text", "lengths"], ["key", "at"])
        held = held.unionByName(cut.select("key", "at", F.explode("run").alias("hash")))
    known = held.groupBy("key", "hash").agg(F.min("at").alias("source")) \
        .join(asked, (F.col("key") == F.col("k")) & (F.col("hash") == F.col("x")), "left_semi")
    met = quoted.join(known, ["key", "hash"], "left").withColumn("source", F.when(F.col("source") < F.col("at"), F.col("source")))
    links = met.groupBy("message").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("source", F.lit(-1)).alias("s")))), lambda x: x["s"]).alias("quoted_turns"),
        F.max(F.when(F.col("level") == 1, F.col("source"))).alias("answered"))
    times = rows.where(F.size("hashes") > 0).groupBy("message").agg(F.count("*").alias("times"))
    plain = rows.where(F.size("hashes") == 0).withColumn("quoted_turns", F.array().cast("array<bigint>")).withColumn("answered", F.lit(None).cast("bigint"))
    linked = met_by_key(rows.where(F.size("hashes") > 0), saved(links.join(times, "message"), "links"), "message", "times")
    whole = linked.select(plain.columns).unionByName(plain)
    turns = saved(with_position(rows.groupBy("key", "at", "turn", "place").agg(F.count("*").alias("times")), "at", "no", order="key", by=("key",)), "turns")
    last = turns.select("key", (F.col("no") + 1).alias("no"), F.col("turn").alias("earlier"))
    earlier = saved(turns.join(last, ["key", "no"], "left").select("place", "times", "earlier"), "earlier")
    ordered = met_by_key(whole, earlier, "place", "times").withColumn("row", F.struct("at", "role", "mid", "uid")) \
        .select("conv_id", "turn", "role", "text", "key", "row", "answered", "earlier", F.size("hashes").alias("n_quotes"), "quoted_turns")
    return with_position(ordered, "row", "position", order="key", by=("key",)).select(
        "conv_id", "turn", "role", "text", F.col("position").cast("bigint").alias("position"),
        F.coalesce("answered", "earlier").alias("parent_turn"), "n_quotes", "quoted_turns")
