"""Mixing sources to target weights by systematic sampling.

Texts that occur under several ids are one text. The total size is the largest one at which
every source can give exactly its share without using a text more often than allowed; a
source's rate is its share of that total over its own size, in tokens. Within a source the
expected copies are summed up in a fixed order (size, then a hash), one random offset is
added, and a text comes out once per integer boundary its interval crosses, that is the rate
rounded down or up times. Ordering by size spreads the rounding evenly over long and short
texts, which keeps the token shares close.

The running sum is taken in two levels - totals of blocks, then rows within a block - in exact
decimals, so a source with a third of all rows is spread over its blocks and the borders agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallygrid.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Blocks that a size class of a source is cut into.
SUB_BLOCKS = 64
_EXACT = "decimal(38,18)"


#: How byte-level BPE cuts a text before merging (the public pattern of the vocabulary).
SPLIT = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _counter(tokenizer: str):
    """Number of tokens of a text, by a rank file (``.tiktoken``) or a tokenizer file (``.json``)."""
    if tokenizer.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        coder = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text))
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer)
    coder.encode_special_tokens = True
    return lambda text: len(coder.encode(text, add_special_tokens=False))


def token_counts(df: DataFrame, keep: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns, ``digest`` (SHA-256 of the text) and ``n_tokens int`` of every non-null
    text, by a public tokenizer file; markup of special tokens is ordinary text."""
    schema = df.select(*keep).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for frame in frames:
            counts = [count(t) for t in frame.pop("body")]
            frame["n_tokens"] = pd.Series(counts, dtype="int32", index=frame.index)
            yield frame

    body = F.col(f"`{text}`")
    rows = df.filter(body.isNotNull()).select(*keep, F.sha2(body, 256).alias("digest"), body.alias("body"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.mapInPandas(run, f"{names}, digest string, n_tokens int")


def plan_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_texts, n_tokens, rate`` per target source.

    ``rate`` is exact to 18 decimals and at most ``max_repeats``. Sources without tokens have
    rate 0 and don't limit the total."""
    own = sized.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").cast("long").alias("n_tokens"))
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").select(
        "source", F.col("target_share").cast("double").alias("target_share"), "max_repeats"
    )
    plan = wanted.join(own, "source", "left").fillna(0, ["n_texts", "n_tokens"])
    total = plan.filter("n_tokens > 0").agg(
        F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share")).alias("total")
    )
    rate = F.when(
        F.col("n_tokens") > 0,
        F.least(F.col("target_share") * F.col("total") / F.col("n_tokens"), F.col("max_repeats").cast("double")),
    ).otherwise(0.0)
    return plan.join(F.broadcast(total), how="left").withColumn("rate", rate.cast(_EXACT)).drop("total")


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    seed: int = 42,
    tokenizer: str = TOKENIZER,
    sub_blocks: int = SUB_BLOCKS,
) -> DataFrame:
    """``doc_id, source, n_tokens int, copy int``: the mixed set, one row per use of a text.

    ``documents``: ``doc_id, text, source``; ``targets``: ``source, target_share, max_repeats``.
    Of equal texts the one with the smallest id stands for all and its source counts; so no
    text is used more than its source's ``max_repeats`` in all. Null texts, null sources,
    sources without a target and texts of no tokens (empty ones) are left out. Ties in size are
    broken by a hash of id and seed. Without targets or texts the result is empty.
    """
    sized = cut_lineage(
        token_counts(documents.select("doc_id", "source", "text"), ["doc_id", "source"], "text", tokenizer)
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("one"))
        .select("one.*")
        .filter("doc_id is not null and source is not null and n_tokens > 0")
    )
    plan = F.broadcast(cut_lineage(plan_rates(sized, targets)).select("source", "rate"))  # a row per target
    rows = (
        sized.join(plan, "source")
        .filter("rate > 0")
        .withColumn("mark", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("size_class", F.floor(F.log2(F.col("n_tokens").cast("double"))).cast("int"))
        .withColumn("sub", F.pmod("mark", F.lit(sub_blocks)).cast("int"))
    )
    block = ["source", "size_class", "sub"]
    # At most (size classes x sub_blocks) rows per source.
    starts = (
        rows.groupBy(*block)
        .agg(F.sum("rate").cast(_EXACT).alias("sum"))
        .withColumn(
            "start",
            F.coalesce(
                F.sum("sum").over(
                    Window.partitionBy("source").orderBy("size_class", "sub").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).cast(_EXACT),
        )
        .drop("sum")
    )
    inside = Window.partitionBy(*block).orderBy("n_tokens", "mark", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # One offset in [0, 1) per source.
    offset = (F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003)).cast(_EXACT)
    ends = (
        rows.withColumn("upto", F.sum("rate").over(inside).cast(_EXACT))
        .join(starts, block)
        .withColumn("hi", (F.col("start") + F.col("upto") + offset).cast(_EXACT))
        .withColumn("lo", (F.col("hi") - F.col("rate")).cast(_EXACT))
        .withColumn("copies", (F.floor("hi") - F.floor("lo")).cast("int"))
        .filter("copies > 0")
    )
    return ends.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: the target, tokens and texts used, uses, and the share reached."""
    used = mixed.groupBy("source").agg(
        F.count("*").alias("n_uses"),
        F.sum((F.col("copy") == 1).cast("long")).alias("n_texts"),
        F.max("copy").alias("most_repeats"),
        F.sum("n_tokens").cast("long").alias("n_tokens"),
    )
    out = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").fillna(
        0, ["n_uses", "n_texts", "most_repeats", "n_tokens"]
    )
    total = out.agg(F.sum("n_tokens").alias("total"))
    return out.join(F.broadcast(total), how="left").select(
        "source", "target_share", "max_repeats", "n_texts", "n_uses", "most_repeats", "n_tokens",
        F.when(F.col("total") > 0, F.col("n_tokens") / F.col("total")).alias("share"),
    )
