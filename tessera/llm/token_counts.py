"""Token counts: one histogram of encoded lengths answers totals, quantiles and truncated totals for every context limit.

Documents are encoded once and only (length, number of documents) is shuffled, after a partial count in each
task. Suffix sums over the histogram are formed in two levels (within blocks of lengths, then over blocks), so no
task gets the whole histogram. A null text counts as an empty one; an empty table gives an empty histogram.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ChunkCoder, map_texts, materialise, table

_coders: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level BPE files cut texts (fixed value of that format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of a plain byte-level BPE file whose merges stand in the order of their ids; None for any other file.

    For such a file a rank encoder gives the ids that the file's own library gives, in a fraction of its time.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) and spec.get("normalizer") is None
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [ranks.get(bytes(byte_of[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
    return ranks if all(a is not None and b is not None and a < b for a, b in zip(merged, merged[1:])) and len(ranks) == len(merged) + 256 else None


def encode_all(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids, as little-endian unsigned 32-bit numbers, by a byte-level tokenizer file; loaded once in each worker process."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode_many(chunks: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        fast = encode_many
        if ranks := byte_ranks(path):
            import tiktoken

            encode = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            fast = lambda chunks: [array("I", encode(c)).tobytes() for c in chunks]
        _coders[path] = ChunkCoder(fast, limit=200_000), encode_many, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    coder, slow, special = _coders[path]
    whole = [i for i, t in enumerate(texts) if any(s in t for s in special)]  # special tokens may span chunks
    if not whole:
        return coder.encode(texts)
    out = coder.encode(["" if any(s in t for s in special) else t for t in texts])
    for i in whole:
        out[i] = slow([texts[i]])[0]
    return out


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of every document."""

    def run(texts: list) -> list:
        return [[len(c) // 4 for c in encode_all(tokenizer, [t or "" for t in texts])]]

    return map_texts(docs, ["doc_id"], run, "n_tokens long")


def count_lengths(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: a row for each length, written out because the sums read it more than once."""
    return materialise(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-counts")


def length_histogram(counts: DataFrame, block: int = 1024) -> DataFrame:
    """A row for each length: n_tokens, n_docs, and over all documents of at most / at least this length the sums that answer any limit.

    docs_upto, tokens_upto: documents of at most n_tokens tokens and their tokens.
    docs_over: documents of more tokens. truncated_total: all tokens if documents are cut to n_tokens.
    For a limit between two lengths, add (limit - n_tokens) * docs_over to the lower one's truncated_total.
    A quantile q is the first length with docs_upto >= q * (docs_upto + docs_over).
    """
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block))
    sums = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    coarse = sums.withColumn("group", F.floor(F.col("block") / block))
    over_groups = coarse.groupBy("group").agg(F.sum("d").alias("gd"), F.sum("t").alias("gt"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # lengths of 2**20 and more apiece: a few rows
    every = Window.partitionBy(F.lit(0))
    over_groups = over_groups.select("group", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("gd", "gt")), F.sum("gd").over(every).alias("all_docs"))
    in_group = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.join(over_groups, "group").select(
        "block", "all_docs", *((F.coalesce(F.sum(c).over(in_group), F.lit(0)) + F.col(f"g{c}_before")).alias(f"{c}_before") for c in ("d", "t"))
    )
    in_block = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.join(coarse, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(in_block) + F.col("d_before")).alias("docs_upto"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(in_block) + F.col("t_before")).alias("tokens_upto"),
        "all_docs",
    )
    over = F.col("all_docs") - F.col("docs_upto")
    return upto.select("n_tokens", "n_docs", "docs_upto", "tokens_upto", over.alias("docs_over"), (F.col("tokens_upto") + over * F.col("n_tokens")).alias("truncated_total"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(count_lengths(encoded_lengths(table(spark, sf_dir, "documents"), default_tokenizer())))
