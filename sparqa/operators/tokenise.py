"""Tokenisation with loss masking over a formatted table (K1-K3, F4, entry point B)."""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..functions import tokens as tk
from ..functions.text import bind_column, let

# Maximum sequence lengths of the two training formats.
MAX_LEN_RATIONALE = 1024
MAX_LEN_ANSWER_ONLY = 256


def format_rows(df: DataFrame, mode: str = "rationale", eos: str = fmt.EOS,
                keep: tuple[str, ...] = ("row_id", "source")) -> DataFrame:
    """G1 or G7 over a canonical table -> (keep..., text, prompt_length_chars)."""
    if mode == "rationale":
        s = fmt.format_with_rationale("question", "answer", "reasoning", eos)
    elif mode == "answer_only":
        s = fmt.format_answer_only("question", "answer")
    else:
        raise ValueError(f"unknown format mode {mode!r}")
    cols = [c for c in keep if c in df.columns]
    # bound once: selecting both struct fields must not copy the formatter into each
    d = bind_column(df.select(*cols, "question", "answer", "reasoning"), s, "__f")
    return d.select(*cols, "__f.text", "__f.prompt_length_chars")


def tokenise(df: DataFrame, max_len: int | None = None, text: str = "text",
             prompt_chars: str = "prompt_length_chars", eos: str = fmt.EOS,
             pad_id: int | None = tk.UNKNOWN_PAD, pad: bool = False) -> DataFrame:
    """K1-K3: add ``input_ids, n_tokens, response_start, labels, boundary_lost``.

    Whole texts by default; ``max_len`` cuts longer ones on demand.

    Arrays are stored unpadded unless ``pad=True`` (then ``input_ids`` and
    ``labels`` are padded to ``max_len`` and ``attention_mask`` is added),
    which keeps shuffles and files small. ``boundary_lost`` marks rows whose
    response was truncated away (they keep an unmasked prompt).
    """
    def per_row(kept: Column) -> Column:
        n = F.size(kept)

        def with_ids(ids: Column) -> Column:
            def with_prompt(n_prompt: Column) -> Column:
                start = tk.response_start(n_prompt, n)
                return F.struct(ids.alias("input_ids"), n.alias("n_tokens"),
                                start.alias("response_start"),
                                tk.mask_labels(ids, start, pad_id).alias("labels"),
                                (n_prompt >= n).alias("boundary_lost"))
            return let(tk.pieces_before(text, kept, F.col(prompt_chars), eos), with_prompt)

        return let(tk.ids_of(kept, eos), with_ids)

    if pad and max_len is None:
        raise ValueError("pad needs max_len")
    every = tk.pieces(text, eos)
    kept = every if max_len is None else F.slice(every, 1, max_len)
    d = bind_column(df, let(kept, per_row), "__tok")
    out = d.select(*[c for c in df.columns], "__tok.*")
    if pad:
        pad_value = tk.EOS_ID if pad_id is None else pad_id
        out = out.select(*[c for c in out.columns if c not in ("input_ids", "labels")],
                         tk.pad_right(F.col("input_ids"), max_len, pad_value).alias("input_ids"),
                         tk.attention_mask(F.col("n_tokens"), max_len).alias("attention_mask"),
                         tk.pad_right(F.col("labels"), max_len, tk.IGNORE).alias("labels"))
    return out


def label_filter(df: DataFrame, labels: str = "labels",
                 observation: Observation | None = None,
                 drop_boundary_lost: bool = False) -> DataFrame:
    """keep rows with at least one unmasked label; count the removed ones.

    ``drop_boundary_lost=True`` (quirk Q9 off) also removes rows whose response
    was truncated away, which otherwise survive with an unmasked prompt.
    """
    keep = tk.has_target(F.col(labels))
    if drop_boundary_lost:
        keep = keep & ~F.col("boundary_lost")
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows_in"),
                        F.sum(F.when(keep, 0).otherwise(1)).alias("rows_removed"))
    return df.where(keep)


def tokenise_with(df: DataFrame, make_encoder: Callable[[], Callable], max_len: int,
                  text: str = "text", prompt_chars: str = "prompt_length_chars",
                  pad_id: int = 0) -> DataFrame:
    """K1-K3 with an external tokenizer, in Arrow batches (``mapInPandas``).

    ``make_encoder()`` runs once per task and returns ``encode(list[str]) ->
    list[(ids, starts)]`` (token ids and start character offsets). The
    response start is the first token whose start offset reaches the prompt
    length, exactly as with offset mappings.
    """
    import pandas as pd

    from ..session import ship_package
    ship_package(df.sparkSession)
    schema = (df.schema.simpleString()[len("struct<"):-1] +
              ",input_ids:array<int>,n_tokens:int,response_start:int,labels:array<int>,boundary_lost:boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for b in batches:
            enc = encode(b[text].tolist())
            ids_col, n_col, rs_col, lab_col, lost_col = [], [], [], [], []
            for (ids, starts), plen in zip(enc, b[prompt_chars].tolist()):
                ids, starts = list(ids[:max_len]), list(starts[:max_len])
                rs = next((i for i, s in enumerate(starts) if s >= plen), None)
                lost = rs is None
                rs = 0 if rs is None else rs
                ids_col.append(ids)
                n_col.append(len(ids))
                rs_col.append(rs)
                lab_col.append([-100 if (i < rs or x == pad_id) else x for i, x in enumerate(ids)])
                lost_col.append(lost)
            yield b.assign(input_ids=ids_col, n_tokens=n_col, response_start=rs_col,
                           labels=lab_col, boundary_lost=lost_col)

    return df.mapInPandas(run, schema)


def hf_encoder(spark, tokenizer_json: str, add_special_tokens: bool = False) -> Callable[[], Callable]:
    """An encoder factory for ``tokenise_with`` from a Hugging Face
    ``tokenizer.json`` (its text). The JSON is broadcast once; every task
    builds the tokenizer and encodes whole Arrow batches with
    ``encode_batch``, returning ids and character start offsets."""
    bc = spark.sparkContext.broadcast(tokenizer_json)

    def make() -> Callable:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(bc.value)

        def encode(texts: list[str]):
            encs = tok.encode_batch(texts, add_special_tokens=add_special_tokens)
            return [(e.ids, [start for start, _ in e.offsets]) for e in encs]
        return encode
    return make
