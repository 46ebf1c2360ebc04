"""Sources mixed to target weights (problem 9), by systematic sampling.

Every record of a source is expected the same number of times, its source's share of the
greatest total that no cap forbids. Expected copies are summed along the records of the
source in order of size; one random offset is added, and a record is emitted once for
every integer its stretch crosses. Ordering by size makes the sample a stratified one, so
that not only records but tokens meet the target. The running sums come from counts of
small cells (source, size, bucket of the key), never from one task that walks a source.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64 << 20
_encoders: dict[int, object] = {}


def _vocabulary(path: str) -> tuple[str, bytes]:
    """The split pattern and the ranks of a vocabulary, read once where the plan is made and sent to the tasks.

    Without the package that holds the pattern there is no token count: another pattern
    would count other tokens.
    """
    from public_tokenizers import PATTERN

    if (size := os.path.getsize(path)) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to be sent to every task")
    with open(path, "rb") as f:
        return PATTERN, f.read()


def _encoder(pattern: str, ranks: bytes):
    if (key := hash((pattern, ranks))) not in _encoders:
        import tiktoken

        pairs = (x.split() for x in ranks.splitlines() if x)
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encoders[key]


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key, the kept columns and n_tokens; null and empty texts have 0 tokens. Texts are encoded whole."""
    columns = [key, *keep]
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    kinds = ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoder(*shared.value)
        for b in batches:
            yield b[columns].assign(n_tokens=[len(e.encode_ordinary(t)) if t else 0 for t in b["__text"]])

    # Columns travel as text, since a null among whole numbers would make them floats.
    out = docs.select(*(F.col(c).cast("string").alias(c) for c in columns), F.col(text).alias("__text")).mapInPandas(run, f"{kinds}, n_tokens bigint")
    return out.withColumns({c: F.col(c).cast(docs.schema[c].dataType) for c in columns})


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, cell_rows: int = 20_000, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies) for every record with a target; copies may be 0.

    ``targets``: source, target_share, max_repeats; few rows, one per source. Sources
    without a positive share, and records with a null source, are left out. A source with
    a target but without tokens can give nothing; the others then keep their targets' ratio.
    Records with the same key, or with a null key, are records of their own.
    """
    aims = targets.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats")
    sized = token_counts(docs.where(F.col("source").isNotNull()), "doc_id", "text", ["source"], vocabulary)
    sized = cut_lineage(sized.withColumn("spread", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    # As many rows as there are targets: the total is the greatest that every source can carry.
    plan = aims.join(sums, "source", "left").withColumn("can", F.coalesce("tokens", F.lit(0)) * F.col("max_repeats") / F.col("target_share"))
    plan = plan.where("can > 0")
    plan = plan.withColumn("total", plan.agg(F.min("can")).scalar())
    plan = plan.select("source", F.least(F.col("target_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double")).alias("expected"))

    cell = ["source", "n_tokens", "bucket"]
    # So many buckets that a cell stays small even if one source and size held all records; null keys are spread too.
    buckets = max(1, -(-sized.count() // cell_rows))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(buckets)))
    counts = rows.groupBy(cell).agg(F.count("*").alias("n"))
    # Two levels of running sums, each over at most a few thousand rows a group.
    levels = counts.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.withColumn("at_size", F.coalesce(before, F.lit(0))).drop("n")
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("at_bucket", F.coalesce(before, F.lit(0))).join(levels, ["source", "n_tokens"])
    starts = starts.select(*cell, (F.col("at_size") + F.col("at_bucket")).alias("start"))
    rank = F.row_number().over(Window.partitionBy(cell).orderBy("doc_id"))
    rows = rows.withColumn("rank", rank).join(starts, cell).join(F.broadcast(plan), "source")
    offset = (F.pmod(F.xxhash64(F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    end = F.floor((F.col("start") + F.col("rank")) * F.col("expected") + offset)
    begin = F.floor((F.col("start") + F.col("rank") - 1) * F.col("expected") + offset)
    return rows.select("doc_id", "source", "n_tokens", (end - begin).cast("int").alias("copies"))


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """What a mix reached, per source with a target: records, copies, tokens, share and the most often a record is used."""
    by = selection.groupBy("source").agg(
        F.count_if(F.col("copies") > 0).alias("records"),
        F.sum("copies").alias("copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
        F.max("copies").alias("most_used"),
    )
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").withColumn("total", by.agg(F.sum("tokens")).scalar())
    return out.select("source", "target_share", "max_repeats", "records", "copies", "tokens", "most_used", F.try_divide("tokens", "total").alias("reached_share"))
