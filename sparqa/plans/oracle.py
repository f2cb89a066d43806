"""DuckDB SQL for every registered query: the independent correctness oracle.

Each string runs on DuckDB with the driver tables registered as views. The
source shapes of ``sparqa.sources.fixtures`` are repeated here as CTEs, written
from the same definitions, so both engines start from identical rows.
"""

from __future__ import annotations

from ..functions.answers import ANSWER_LETTERS
from ..functions.text import LINE_BREAK, WS, WS_CHARS, sql_chars
from ..operators.curate import TAG_DISTRACTOR, TAG_FOURCOL, TAG_OPTLIST

WS_SQL = sql_chars(WS_CHARS)
NL = "chr(10)"
BS = "chr(92)"

# RE2 forms of the extraction patterns (RE2 has no possessive quantifiers and
# never backtracks, so the plain form is safe there).
BOXED_RE2 = r"\$?\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}\$?"
CONCLUSION_RE2 = r"(?is)conclusion[:\-]?(.*)"
MARKER = "$\\blacksquare$"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def lstrip(x: str) -> str:
    return f"ltrim({x}, {WS_SQL})"


def md5_order(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


# ------------------------------------------------------------------ sources

FX_BOXED = f"""SELECT doc_id,
  CAST(doc_id AS VARCHAR) || ' ' || text || {NL} || 'A: a' || CAST(doc_id % 7 AS VARCHAR) || {NL}
    || 'B: b' || CAST(doc_id % 5 AS VARCHAR) || {NL} || 'C: c' || {NL} || 'D: d' AS problem,
  text || {NL} || CASE doc_id % 8
    WHEN 0 THEN 'So $' || {BS} || 'boxed{{' || {BS} || 'text{{B}}}}$ holds'
    WHEN 1 THEN 'step' || {NL} || 'conclusion: C'
    WHEN 2 THEN 'one' || {NL} || 'D is left' || {NL} || 'so $' || {BS} || 'blacksquare$'
    WHEN 3 THEN 'no final answer'
    WHEN 4 THEN {BS} || 'boxed{{{{x{{y}}}}}}'
    WHEN 5 THEN {BS} || 'boxed{{42}}'
    WHEN 6 THEN 'Conclusion - the Answer is B'
    ELSE {BS} || 'boxed{{A}} then ' || {BS} || 'boxed{{B}}' END AS solution,
  source FROM documents"""

FX_DISTRACTOR = """SELECT p_partkey, 'Which size fits ' || p_name || '?' AS question,
  CAST(p_size + 1 AS VARCHAR) AS distractor1, CAST(p_size + 2 AS VARCHAR) AS distractor2,
  CASE WHEN p_partkey % 50 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 3 AS VARCHAR) END AS distractor3,
  CAST(p_size AS VARCHAR) AS correct_answer,
  CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS support FROM part"""

FX_OPTLIST = """SELECT o_orderkey, 'Total of order ' || CAST(o_orderkey AS VARCHAR) || '?' AS question,
  list_value('A)' || CAST(o_custkey AS VARCHAR), 'B) ' || o_orderpriority,
             'C)f(' || CAST(o_orderkey % 9 AS VARCHAR) || ')', 'D)' || o_orderstatus, 'E)none') AS options,
  'because ' || o_orderpriority AS rationale,
  substr('ABCDE', CAST(o_orderkey % 5 + 1 AS INT), 1) AS correct FROM orders"""

FX_FOURCOL = """SELECT c_custkey, 'Segment of ' || c_name || '?' AS question, 'AUTO' AS opa, 'BUILD' AS opb,
  c_mktsegment AS opc, 'none' AS opd, CAST(c_custkey % 4 AS INT) AS cop,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'see ' || c_mktsegment END AS exp,
  CASE WHEN c_custkey % 5 = 0 THEN 'multi' ELSE 'single' END AS choice_type FROM customer"""

FX_TOKENS = """SELECT o_orderkey AS example_id, c.choice_idx, t.token_pos,
  CAST(-((o_orderkey * 7919 + c.choice_idx * 104729 + t.token_pos * 31) % 64) AS DOUBLE) / 8 AS logprob
  FROM orders, (SELECT unnest(range(4))::INT AS choice_idx) c, (SELECT unnest(range(2))::INT AS token_pos) t
  WHERE NOT (t.token_pos = 1 AND c.choice_idx = o_orderkey % 4)"""

FX_GOLD = """SELECT o_orderkey AS example_id,
  CASE WHEN o_orderkey % 3 = 0 THEN ' ' || lower(substr('ABCD', CAST(o_orderkey % 4 + 1 AS INT), 1)) || '.'
       ELSE substr('ABCD', CAST(o_orderkey % 4 + 1 AS INT), 1) END AS answer FROM orders"""

FX_PAIRS = """SELECT doc_id AS pair_id, source,
  CAST((doc_id * 7919) % 512 AS DOUBLE) / -4 AS chosen_logp,
  CAST((doc_id * 104729 + 7) % 512 AS DOUBLE) / -4 AS rejected_logp,
  CAST((doc_id * 31) % 512 AS DOUBLE) / -4 AS ref_chosen_logp,
  CAST((doc_id * 17 + 5) % 512 AS DOUBLE) / -4 AS ref_rejected_logp,
  CAST(doc_id % 16 + 1 AS INT) AS chosen_len, CAST(doc_id % 9 + 1 AS INT) AS rejected_len FROM documents"""

FX_SFT = """SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS target
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'"""


# ----------------------------------------------------------------- curation

def _boxed_pipeline(src: str) -> str:
    """CTE chain turning fx_boxed rows into canonical rows (answer may be null)."""
    lines = "__lines"
    return f"""bx0 AS ({src}),
bx1 AS (SELECT *,
  CASE WHEN regexp_matches(solution, '{BOXED_RE2}') THEN 1
       WHEN regexp_matches(solution, '{CONCLUSION_RE2}') THEN 2
       WHEN instr(solution, '{MARKER}') > 0 THEN 3 ELSE 0 END AS kind,
  CASE WHEN instr(solution, '{MARKER}') > 0
       THEN string_split_regex(substr(solution, 1, instr(solution, '{MARKER}') - 1), '{LINE_BREAK}') END AS pieces
  FROM bx0),
bx2 AS (SELECT *, CASE WHEN pieces[len(pieces)] = '' THEN pieces[1:len(pieces) - 1] ELSE pieces END AS {lines} FROM bx1),
bx3 AS (SELECT *, CASE kind
    WHEN 1 THEN {strip(f"regexp_extract(solution, '{BOXED_RE2}', 1)")}
    WHEN 2 THEN {strip(f"regexp_extract(solution, '{CONCLUSION_RE2}', 1)")}
    WHEN 3 THEN CASE WHEN len({lines}) >= 1
                     THEN {strip(f"array_to_string({lines}[greatest(len({lines}) - 1, 1):], {NL})")} END
  END AS raw FROM bx2),
bx4 AS (SELECT *, CASE WHEN regexp_matches(raw, '{ANSWER_LETTERS}') THEN regexp_replace(raw, '[^A-D]', '', 'g') END AS akey FROM bx3),
bx5 AS (SELECT *, instr(problem, akey || ':') AS apos FROM bx4),
bx6 AS (SELECT *, CASE WHEN akey IS NOT NULL AND apos > 0
    THEN akey || '. ' || {strip(f"split_part({lstrip('substr(problem, apos + length(akey) + 1)')}, {NL}, 1)")} END AS answer
  FROM bx5)"""


BOXED_SELECT = """SELECT doc_id * 4 AS row_id, problem AS question, solution AS reasoning, answer, source
  FROM bx6 WHERE answer IS NOT NULL AND problem IS NOT NULL AND solution IS NOT NULL"""


def _distractor_select(src: str) -> str:
    return f"""WITH dx0 AS ({src}),
dx1 AS (SELECT *, list_value(distractor1, distractor2, distractor3, correct_answer) AS vals FROM dx0
        WHERE question IS NOT NULL AND correct_answer IS NOT NULL),
dx2 AS (SELECT *, list_sort(list_transform(range(4), lambda i:
          {{'h': md5('42|' || CAST(p_partkey AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 'v': vals[i + 1]}})) AS ord
        FROM dx1)
SELECT p_partkey * 4 + 1 AS row_id,
  question || {NL} || array_to_string(list_transform(range(4), lambda i:
      chr(CAST(65 + i AS INT)) || ': ' || coalesce(ord[i + 1].v, 'None')), {NL}) AS question,
  support AS reasoning,
  chr(CAST(65 + list_max(list_transform(range(4), lambda i: CASE WHEN ord[i + 1].v = correct_answer THEN i END)) AS INT))
    || ': ' || correct_answer AS answer,
  '{TAG_DISTRACTOR}' AS source
FROM dx2"""


def _optlist_select(src: str) -> str:
    pieces = ("list_transform(options, lambda o: {'l': " + strip("split_part(o, ')', 1)")
              + ", 'v': " + strip("substr(o, instr(o, ')') + 1)") + "})")
    return f"""WITH ox0 AS ({src}),
ox1 AS (SELECT *, {pieces} AS pcs FROM ox0
        WHERE question IS NOT NULL AND options IS NOT NULL AND correct IS NOT NULL
          AND list_bool_and(list_transform(options, lambda o: instr(o, ')') > 0)))
SELECT o_orderkey * 4 + 2 AS row_id,
  question || {NL} || array_to_string(list_transform(pcs, lambda p: p.l || ': ' || p.v), {NL}) AS question,
  rationale AS reasoning,
  coalesce(list_transform(list_filter(pcs, lambda p: p.l = correct), lambda p: p.l || ': ' || p.v)[1], correct) AS answer,
  '{TAG_OPTLIST}' AS source
FROM ox1"""


def _fourcol_select(src: str, prefiltered: bool = False) -> str:
    render = f" || {NL} || ".join(f"'{L}: ' || coalesce({c}, 'None')"
                                  for L, c in zip("ABCD", ("opa", "opb", "opc", "opd")))
    answer = ("CASE cop WHEN 0 THEN 'A: ' || opa WHEN 1 THEN 'B: ' || opb "
              "WHEN 2 THEN 'C: ' || opc WHEN 3 THEN 'D: ' || opd END")
    where = "" if prefiltered else "WHERE exp IS NOT NULL AND choice_type = 'single'"
    return f"""WITH fx0 AS (SELECT * FROM ({src}) {where}),
fx1 AS (SELECT *, {answer} AS ans FROM fx0)
SELECT c_custkey * 4 + 3 AS row_id, question || {NL} || {render} AS question, exp AS reasoning,
  ans AS answer, '{TAG_FOURCOL}' AS source
FROM fx1 WHERE question IS NOT NULL AND ans IS NOT NULL"""


def sample_sql(src: str, key: str, n: int, seed: int = 42) -> str:
    return f"SELECT * FROM ({src}) ORDER BY {md5_order(key, seed)}, {key} LIMIT {n}"


def curate_boxed() -> str:
    return f"WITH {_boxed_pipeline(FX_BOXED)}\n{BOXED_SELECT}"


def curate_distractor() -> str:
    return _distractor_select(FX_DISTRACTOR)


def curate_optlist() -> str:
    return _optlist_select(FX_OPTLIST)


def curate_fourcol() -> str:
    return _fourcol_select(FX_FOURCOL)


def curate_union() -> str:
    four_src = f"SELECT * FROM ({FX_FOURCOL}) WHERE exp IS NOT NULL AND choice_type = 'single'"
    parts = [
        f"SELECT * FROM (WITH {_boxed_pipeline(FX_BOXED)}\n{BOXED_SELECT})",
        f"SELECT * FROM ({_distractor_select(FX_DISTRACTOR)})",
        f"SELECT * FROM ({_optlist_select(FX_OPTLIST)})",
        f"SELECT * FROM ({_fourcol_select(four_src, True)})",
    ]
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------- sampling

def sample_exact() -> str:
    return ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
            f"ORDER BY {md5_order('o_orderkey')}, o_orderkey LIMIT 10000")


def shuffle_rank() -> str:
    return (f"SELECT o_orderkey, row_number() OVER (ORDER BY {md5_order('o_orderkey')}, o_orderkey) - 1"
            " AS pos FROM orders")


def split_95() -> str:
    return f"""WITH p AS (SELECT o_orderkey,
    row_number() OVER (ORDER BY {md5_order('o_orderkey')}, o_orderkey) - 1 AS pos,
    count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos < CAST(floor(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM p"""


def shard_contiguous() -> str:
    return """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
    count(*) OVER () AS n FROM orders),
s AS (SELECT *, n // 10 AS q, n % 10 AS r FROM p)
SELECT o_orderkey, CASE WHEN pos < r * (q + 1) THEN pos // (q + 1)
                        ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END AS shard FROM s"""


def shard_exclude() -> str:
    return f"""SELECT o.o_orderkey, o_custkey, o_totalprice FROM orders o JOIN ({shard_contiguous()}) s ON o.o_orderkey = s.o_orderkey
WHERE shard <> 0"""


def split_stratified() -> str:
    return f"""WITH p AS (SELECT o_orderkey, o_custkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY {md5_order('o_orderkey')}, o_orderkey) - 1 AS pos,
    count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN pos < CAST(floor(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM p"""


# --------------------------------------------------------------- formatting

EOS = "<|endoftext|>"
CHOICE_RE2 = r"(?m)^([A-E]):" + WS + r"*(.*)$"


def _formatted_ctes(cu_sql: str) -> str:
    """CTEs ending in ``fr(row_id, source, text, prompt_length_chars)`` and ``fr2`` (parsed)."""
    return f"""cu AS ({cu_sql}),
fr0 AS (SELECT row_id, source, answer, reasoning, {strip('question')} AS q FROM cu),
fr1 AS (SELECT *, regexp_extract_all(q, '{CHOICE_RE2}', 1) AS ls, regexp_extract_all(q, '{CHOICE_RE2}', 2) AS ts,
               {strip("string_split_regex(q, '[A-E]:')[1]")} AS body FROM fr0),
fr2 AS (SELECT *, list_transform(range(len(ls)), lambda i: ls[i + 1] || '. ' || {strip('ts[i + 1]')}) AS choices FROM fr1),
fr3 AS (SELECT *, body || {NL} || array_to_string(choices, {NL}) || {NL} || 'Answer:' AS prompt,
               {strip('answer')} AS a, {strip("coalesce(reasoning, '')")} AS support FROM fr2),
fr4 AS (SELECT *, CASE WHEN regexp_matches(a, '^[A-Z]') THEN substr(a, 1, 1)
                       WHEN length(upper(a)) > 1 AND ends_with(upper(a), '.') THEN substr(upper(a), 1, 1)
                       ELSE upper(a) END AS g FROM fr3),
fr AS (SELECT row_id, source,
         prompt || CASE WHEN support = '' THEN ' ' || g || '{EOS}'
                        ELSE ' ' || g || {NL} || 'Reasoning: ' || support || '{EOS}' END AS text,
         CAST(length(prompt) AS INT) AS prompt_length_chars FROM fr4)"""


def format_answer_only() -> str:
    return f"""WITH cf AS ({curate_fourcol()})
SELECT row_id, source, question || {NL} || answer AS text,
       CAST(length(question) + 1 AS INT) AS prompt_length_chars FROM cf"""


def parse_choices() -> str:
    return f"WITH {_formatted_ctes(curate_union())}\nSELECT row_id, body, choices FROM fr2"


def format_rationale() -> str:
    return f"WITH {_formatted_ctes(curate_union())}\nSELECT row_id, source, text, prompt_length_chars FROM fr"


def length_profile() -> str:
    return f"""WITH {_formatted_ctes(curate_union())}
SELECT source, count(*) AS rows,
       CAST(quantile_disc(length(text), 0.5) AS INT) AS median_len,
       CAST(floor(quantile_cont(length(text), 0.9)) AS INT) AS p90_len,
       CAST(max(length(text)) AS INT) AS max_len
FROM fr GROUP BY ROLLUP (source)"""


def length_profile_merge() -> str:
    """Percentiles of all lengths at once, each length cut to its first eight bits."""
    bits = "CAST(len(bin(length(text))) - 8 AS INT)"
    return f"""WITH {_formatted_ctes(curate_union())},
b AS (SELECT source, length(text) AS n, CASE WHEN length(text) < 256 THEN length(text)
        ELSE (length(text) >> {bits}) << {bits} END AS bucket FROM fr)
SELECT source, count(*) AS rows, CAST(quantile_disc(bucket, 0.5) AS INT) AS median_len,
       CAST(floor(quantile_cont(bucket, 0.9)) AS INT) AS p90_len, CAST(max(n) AS INT) AS max_len
FROM b GROUP BY source"""


# ------------------------------------------------------------------- tokens

def _piece_re2() -> str:
    from ..functions.tokens import piece_pattern
    return piece_pattern(EOS)


def _tokenised_ctes(cu_sql: str | None = None) -> str:
    piece = _piece_re2()
    return f"""{_formatted_ctes(cu_sql or curate_union())},
tk0 AS (SELECT row_id, text, prompt_length_chars, regexp_extract_all(text, '{piece}') AS pcs FROM fr),
tk1 AS (SELECT *, list_transform(pcs, lambda p: CASE WHEN p = '{EOS}' THEN 1
                   ELSE CAST(('0x' || substr(md5(p), 1, 7)) AS INT) + 2 END) AS input_ids,
               len(regexp_extract_all(substr(text, 1, prompt_length_chars), '{piece}')) AS n_prompt FROM tk0),
tk2 AS (SELECT *, CAST(len(input_ids) AS INT) AS n_tokens FROM tk1),
tk3 AS (SELECT *, CAST(CASE WHEN n_prompt < n_tokens THEN n_prompt ELSE 0 END AS INT) AS response_start,
               n_prompt >= n_tokens AS boundary_lost FROM tk2),
tk AS (SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < response_start OR x = 1
                                                          THEN -100 ELSE x END) AS labels FROM tk3)"""


def tokenise_default() -> str:
    return f"WITH {_tokenised_ctes()}\nSELECT row_id, input_ids, n_tokens FROM tk"


def mask_labels() -> str:
    return f"WITH {_tokenised_ctes()}\nSELECT row_id, response_start, labels, boundary_lost FROM tk"


def label_filter() -> str:
    return (f"WITH {_tokenised_ctes()}\nSELECT row_id, n_tokens FROM tk "
            "WHERE len(list_filter(labels, lambda x: x <> -100)) > 0")


# --------------------------------------------------------------------- chat

def chat_render() -> str:
    return f"""SELECT conv_id, turn,
  '<|im_start|>user' || {NL} || prompt || '<|im_end|>' || {NL} ||
  '<|im_start|>assistant' || {NL} || target || '<|im_end|>' || {NL} AS text
FROM ({FX_SFT})"""


def chat_conversations() -> str:
    """Turns of one role after another are one message, joined by an empty line."""
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, lag(role) OVER w AS p, lead(role) OVER w AS f FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)),
b AS (SELECT *, p IS NULL OR p <> role AS opens, f IS NULL OR f <> role AS closes FROM n),
r AS (SELECT *, CASE WHEN opens THEN '<|im_start|>' || role || {NL} ELSE {NL} || {NL} END || text
               || CASE WHEN closes THEN '<|im_end|>' || {NL} ELSE '' END AS fragment FROM b)
SELECT conv_id, turn, role, CAST(sum(CAST(opens AS INT)) OVER w - 1 AS BIGINT) AS message,
       CAST(sum(length(fragment)) OVER w - length(fragment) AS BIGINT) AS char_start,
       CAST(length(fragment) AS BIGINT) AS n_chars, fragment
FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)"""


# --------------------------------------------------------------- evaluation

EVAL_TOPIC = "knowledge and skills in advanced master-level STEM courses"


def _eval_gold(x: str) -> str:
    g = f"upper({strip(x)})"
    return f"CASE WHEN ends_with({g}, '.') THEN substr({g}, 1, length({g}) - 1) ELSE {g} END"


def eval_prompt() -> str:
    header = f"'The following are multiple choice questions (with answers) about {EVAL_TOPIC}.' || {NL} || {NL}"
    return f"""WITH e AS (SELECT o_orderkey AS example_id, question,
    list_transform(options, lambda o: substr(o, instr(o, ')') + 1)) AS choices, correct AS answer
  FROM ({FX_OPTLIST}))
SELECT example_id,
  {header} || {strip('question')} || {NL}
    || array_to_string(list_transform(choices[1:26], lambda c, i: chr(CAST(64 + i AS INT)) || '. ' || {strip('c')} || {NL}), '')
    || 'Answer:' AS prompt,
  list_transform(choices[1:26], lambda c, i: ' ' || chr(CAST(64 + i AS INT))) AS continuations,
  {_eval_gold('answer')} AS gold,
  CAST(len(choices) AS INT) AS n_choices,
  len(choices) > 26 AS overflow
FROM e"""


def choice_scores() -> str:
    return f"SELECT example_id, choice_idx, sum(logprob) AS score FROM ({FX_TOKENS}) GROUP BY example_id, choice_idx"


def mcq_predict() -> str:
    return f"""WITH s AS ({choice_scores()}),
b AS (SELECT example_id, choice_idx AS pred_idx FROM
        (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, choice_idx) AS rn FROM s)
      WHERE rn = 1),
g AS (SELECT example_id, {_eval_gold('answer')} AS gold FROM ({FX_GOLD})),
p AS (SELECT g.example_id, coalesce(chr(CAST(65 + b.pred_idx AS INT)), 'NONE') AS pred, gold
      FROM g LEFT JOIN b ON g.example_id = b.example_id)
SELECT example_id, pred, gold, pred = gold AS correct, {strip('pred')} = {strip('gold')} AS correct_norm FROM p"""


def mcq_accuracy() -> str:
    return f"""WITH p AS ({mcq_predict()})
SELECT count(*) AS total, CAST(coalesce(sum(CAST(correct AS BIGINT)), 0) AS BIGINT) AS correct,
       CAST(coalesce(sum(CAST(correct_norm AS BIGINT)), 0) AS BIGINT) AS correct_norm,
       coalesce(sum(CAST(correct AS BIGINT)) / count(*), 0.0) AS accuracy,
       coalesce(sum(CAST(correct_norm AS BIGINT)) / count(*), 0.0) AS accuracy_norm FROM p"""


def token_logprob_gather() -> str:
    return """WITH e AS (SELECT vec_id, label, embedding, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings)
SELECT vec_id, label,
  round(CAST(embedding[label + 1] AS DOUBLE)
        - (m + ln(list_sum(list_transform(embedding, lambda q: exp(CAST(q AS DOUBLE) - m))))), 6) AS logprob
FROM e"""


def _ids(text: str) -> str:
    return (f"list_transform(regexp_extract_all({text}, '{_piece_re2()}'), lambda p: CASE WHEN p = '{EOS}' THEN 1 "
            "ELSE CAST(('0x' || substr(md5(p), 1, 7)) AS INT) + 2 END)")


#: Prompt and prompt + continuation are tokenised each for itself; logits as in ``fixtures.with_logits``.
def _scored_ctes(items: str) -> str:
    return f"""it AS ({items}),
ch AS (SELECT example_id, prompt, unnest(continuations) AS cont, unnest(range(len(continuations))) AS choice_idx FROM it),
rq AS (SELECT example_id, CAST(choice_idx AS INT) AS choice_idx, {_ids('prompt || cont')}[1:1024] AS ids,
              least(len({_ids('prompt')}), 1024) AS prompt_len FROM ch),
sz AS (SELECT count(*) AS n, max(len(embedding)) AS w FROM embeddings),
ps AS (SELECT example_id, choice_idx, ids, prompt_len, unnest(range(prompt_len, len(ids))) AS i FROM rq),
lg AS (SELECT example_id, choice_idx, i - prompt_len AS token_pos, ids[i + 1] % w AS target,
              CAST(list_sum(list_transform(ids[1:i], lambda x, k: CAST(x AS BIGINT) * k)) AS BIGINT) % n AS vec_id FROM ps, sz),
lm AS (SELECT example_id, choice_idx, token_pos, target, embedding, CAST(list_max(embedding) AS DOUBLE) AS m
       FROM lg JOIN embeddings USING (vec_id)),
lp AS (SELECT example_id, choice_idx, token_pos, CAST(embedding[target + 1] AS DOUBLE)
         - (m + ln(list_sum(list_transform(embedding, lambda q: exp(CAST(q AS DOUBLE) - m))))) AS logprob FROM lm)"""


def choice_loglik() -> str:
    items = f"""SELECT doc_id AS example_id, coalesce(text, '') || {NL} || 'Source:' AS prompt,
  [' ' || source || ' in ' || lang, '', '-' || source, {NL} || lang || ' <' || source || '>'] AS continuations FROM documents"""
    return f"""WITH {_scored_ctes(items)},
k AS (SELECT example_id, choice_idx, count(*) AS n, sum(logprob) AS s FROM lp WHERE example_id % 11 <> 0 OR token_pos <> 0 GROUP BY ALL)
SELECT example_id, choice_idx, CAST(greatest(len(ids) - prompt_len, 0) AS INT) AS n_targets, CAST(coalesce(n, 0) AS INT) AS n_rows,
  CASE WHEN n = len(ids) - prompt_len THEN round(s, 6) ELSE CAST('-inf' AS DOUBLE) END AS loglik
FROM rq LEFT JOIN k USING (example_id, choice_idx)"""


def mcq_eval() -> str:
    items = f"SELECT example_id, prompt, continuations FROM ({eval_prompt()})"
    return f"""WITH {_scored_ctes(items)},
k AS (SELECT example_id, choice_idx, sum(logprob) AS s FROM lp GROUP BY ALL),
b AS (SELECT example_id, chr(CAST(65 + arg_max(choice_idx, (s, -choice_idx)) AS INT)) AS pred FROM
        (SELECT example_id, choice_idx, coalesce(s, CAST('-inf' AS DOUBLE)) AS s FROM rq LEFT JOIN k USING (example_id, choice_idx)) GROUP BY example_id),
p AS (SELECT coalesce(pred, 'NONE') AS pred, gold FROM ({eval_prompt()}) LEFT JOIN b USING (example_id)),
f AS (SELECT pred = gold AS correct, {strip('pred')} = {strip('gold')} AS correct_norm FROM p)
SELECT count(*) AS total, CAST(coalesce(sum(CAST(correct AS BIGINT)), 0) AS BIGINT) AS correct,
       CAST(coalesce(sum(CAST(correct_norm AS BIGINT)), 0) AS BIGINT) AS correct_norm,
       coalesce(sum(CAST(correct AS BIGINT)) / count(*), 0.0) AS accuracy,
       coalesce(sum(CAST(correct_norm AS BIGINT)) / count(*), 0.0) AS accuracy_norm FROM f"""


def preference_accuracy() -> str:
    return f"""WITH p AS ({FX_PAIRS}), m AS (SELECT unnest(['none', 'sum', 'avg']) AS mode)
SELECT mode, source, count(*) AS pairs,
  avg(CAST(CASE mode
        WHEN 'none' THEN (chosen_logp - ref_chosen_logp) > (rejected_logp - ref_rejected_logp)
        WHEN 'sum' THEN chosen_logp > rejected_logp
        WHEN 'avg' THEN chosen_logp / chosen_len > rejected_logp / rejected_len END AS DOUBLE)) AS accuracy
FROM p, m GROUP BY mode, source"""


# ---------------------------------------------------------------- retrieval

WORD_RE2 = r"[\p{L}\p{Nd}_]+"


def chunk_documents(size: int = 512) -> str:
    return f"""WITH d AS (SELECT doc_id, {strip('text')} AS s FROM documents),
w AS (SELECT doc_id, CASE WHEN s = '' THEN []::VARCHAR[] ELSE string_split_regex(s, '{WS}+') END AS words FROM d),
c AS (SELECT doc_id, words, unnest(range(CAST(ceil(len(words) / {size}) AS BIGINT))) AS i FROM w)
SELECT doc_id, CAST(i AS INT) AS chunk_idx,
       CAST(len(words[i * {size} + 1 : i * {size} + {size}]) AS INT) AS n_words,
       array_to_string(words[i * {size} + 1 : i * {size} + {size}], ' ') AS text
FROM c"""


def chunk_first_n(n: int = 500) -> str:
    return f"SELECT * FROM ({chunk_documents()}) ORDER BY doc_id, chunk_idx LIMIT {n}"


def _vector_topk(fn: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
    round({fn}(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, similarity FROM r WHERE rank <= 2"""


def retrieve_cosine() -> str:
    return _vector_topk("list_cosine_similarity")


def retrieve_dot() -> str:
    return _vector_topk("list_inner_product")


def retrieve_jaccard() -> str:
    return f"""WITH ch AS ({chunk_documents()}),
ct AS (SELECT doc_id, chunk_idx, list_distinct(regexp_extract_all(lower(text), '{WORD_RE2}')) AS toks FROM ch),
qt AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD_RE2}')) AS toks FROM benchmark),
s AS (SELECT qt.item_id AS query_id, ct.doc_id, ct.chunk_idx,
             len(list_intersect(qt.toks, ct.toks)) AS inter, len(qt.toks) AS qn, len(ct.toks) AS cn
      FROM qt, ct),
j AS (SELECT query_id, doc_id, chunk_idx, round(inter / (qn + cn - inter), 6) AS similarity FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id, chunk_idx) AS rank FROM j)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_idx, similarity FROM r WHERE rank <= 2"""


# -------------------------------------------------------------------- sinks

def write_read_roundtrip() -> str:
    return f"""WITH u AS ({curate_union()}),
p AS (SELECT *, row_number() OVER (ORDER BY {md5_order('row_id')}, row_id) - 1 AS pos,
             count(*) OVER () AS n FROM u)
SELECT row_id, question, reasoning, answer, source,
       CASE WHEN pos < CAST(floor(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM p"""


def source_counts() -> str:
    return f"SELECT source, count(*) AS rows FROM ({curate_union()}) GROUP BY source"


def _training_rows(split: str) -> str:
    rows = f"SELECT row_id, question, reasoning, answer, source FROM ({write_read_roundtrip()}) WHERE split = '{split}'"
    return (f"WITH {_tokenised_ctes(rows)}\nSELECT row_id, input_ids, labels, n_tokens FROM tk "
            "WHERE len(list_filter(labels, lambda x: x <> -100)) > 0")


def training_rows() -> str:
    return _training_rows("train")


def training_rows_test() -> str:
    return _training_rows("test")


def tokenise_padded(n: int = 1024) -> str:
    """Ids and labels of texts cut to n tokens and padded: 1 is the padding id, -100 its label."""
    return f"""WITH {_tokenised_ctes()},
cut AS (SELECT row_id, input_ids[1:{n}] AS ids, n_prompt FROM tk2),
lab AS (SELECT row_id, ids, CAST(len(ids) AS INT) AS n, CASE WHEN n_prompt < len(ids) THEN n_prompt ELSE 0 END AS rs FROM cut),
pad AS (SELECT row_id, n, list_concat(ids, list_transform(range({n} - n), lambda i: 1)) AS input_ids,
               list_concat(list_transform(range(n), lambda i: 1), list_transform(range({n} - n), lambda i: 0)) AS mask,
               list_concat(list_transform(ids, lambda x, i: CASE WHEN i - 1 < rs OR x = 1 THEN -100 ELSE x END),
                           list_transform(range({n} - n), lambda i: -100)) AS labels FROM lab)
SELECT row_id, n AS n_tokens, CAST(len(input_ids) AS INT) AS width, md5(array_to_string(input_ids, ',')) AS input_ids,
       md5(array_to_string(mask, ',')) AS attention_mask, md5(array_to_string(labels, ',')) AS labels FROM pad"""


def stage_counts() -> str:
    answer = ("CASE cop WHEN 0 THEN opa WHEN 1 THEN opb WHEN 2 THEN opc WHEN 3 THEN opd END")
    return f"""WITH {_boxed_pipeline(FX_BOXED)},
data AS (SELECT * FROM ({write_read_roundtrip()})),
kept_rows AS (SELECT row_id FROM ({label_filter()})),
tagged AS (
  SELECT 'curate' AS stage, '' AS split, source, CASE WHEN problem IS NULL OR solution IS NULL THEN 'null_input'
    WHEN answer IS NULL THEN 'no_answer' ELSE 'kept' END AS outcome FROM bx6
  UNION ALL SELECT 'curate', '', '{TAG_DISTRACTOR}', CASE WHEN question IS NULL OR correct_answer IS NULL THEN 'null_input'
    ELSE 'kept' END FROM ({FX_DISTRACTOR})
  UNION ALL SELECT 'curate', '', '{TAG_OPTLIST}', CASE WHEN question IS NULL OR options IS NULL OR correct IS NULL THEN 'null_input'
    WHEN NOT list_bool_and(list_transform(options, lambda o: coalesce(instr(o, ')'), 0) > 0)) THEN 'malformed_options'
    ELSE 'kept' END FROM ({FX_OPTLIST})
  UNION ALL SELECT 'curate', '', '{TAG_FOURCOL}', CASE WHEN exp IS NULL THEN 'no_explanation'
    WHEN choice_type IS DISTINCT FROM 'single' THEN 'not_single' WHEN question IS NULL THEN 'null_input'
    WHEN {answer} IS NULL THEN 'no_answer' ELSE 'kept' END FROM ({FX_FOURCOL})
  UNION ALL SELECT 'split', split, source, 'kept' FROM data
  UNION ALL SELECT 'label', split, source, CASE WHEN row_id IN (SELECT row_id FROM kept_rows) THEN 'kept' ELSE 'no_target' END FROM data)
SELECT stage, split, source, outcome, CAST(4 - grouping(split) - grouping(source) - grouping(outcome) AS INT) AS level,
       count(*) AS rows_in, count(*) FILTER (outcome = 'kept') AS rows_kept, count(*) FILTER (outcome <> 'kept') AS rows_removed
FROM tagged GROUP BY GROUPING SETS ((stage), (stage, split), (stage, split, source), (stage, split, source, outcome))"""
