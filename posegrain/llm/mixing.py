"""Mixing sources to target weights.

Each source is an endless stream of its documents (in hash order, again and again up to its cap), cut into blocks
of tokens.  What a source gives follows from its exact share (a fraction, never rounded to a grid); its blocks are
scheduled the Pfair way: of n blocks in a schedule of T, block k is released at slot floor(k T / n) and due at slot
ceil((k + 1) T / n); among the released blocks the one with the earliest deadline gets the slot.  So at any slot a
source is less than one block away from its share.  A mix has at most ``max_blocks`` blocks (a mix too large for them
gets larger blocks), so its schedule is bounded whatever the data's size; it is computed by a task of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAX_BLOCKS = 1_000_000
DEFAULT_BLOCK_TOKENS = 4_096
BUCKET_DOCS = 20_000
TOKENIZERS_CONF = "posegrain.tokenizers"
# Fixed value: the split of texts into pieces that belongs to the byte-level vocabulary.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Path:
    """A vocabulary file below the folder that the session's ``posegrain.tokenizers`` names, else below /opt/tokenizers."""
    path = Path(spark.conf.get(TOKENIZERS_CONF, "/opt/tokenizers")) / name
    if not path.is_file():
        raise FileNotFoundError(f"no vocabulary {path}: set {TOKENIZERS_CONF} to the folder of the public tokenizers, or give vocabulary=")
    return path


def count_tokens(docs: DataFrame, id_col: str, text: str, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """(id, keep..., n_tokens) of a byte-level BPE given as rank file ``vocabulary``.  Null and empty texts have 0 tokens.

    The file is read once on the driver and broadcast (under 1 MB); whole texts are counted, in Arrow batches.  Texts
    that repeat within a batch are counted once.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(vocabulary or tokenizer_path(spark)).read_bytes())
    kept = docs.select(id_col, *keep, F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        code = tiktoken.Encoding("mix", pat_str=PIECE_PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            known: dict[str, int] = {}
            counts = []
            for t in batch.column(len(keep) + 1).to_pylist():
                n = known.get(t) if t else 0
                if n is None:
                    n = known[t] = len(code.encode_ordinary(t))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 1)), pa.array(counts, pa.int64())], names=[id_col, *keep, "n_tokens"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [id_col, *keep]) + ", n_tokens bigint")


def pfair_period(weights: list[int]) -> list[tuple[int, int]]:
    """(source, block) in slot order over one period of sum(weights) slots: release times, deadlines, earliest deadline first."""
    slots = sum(weights)
    release = [(0, s, 0) for s in range(len(weights)) if weights[s]]
    heapq.heapify(release)
    ready: list[tuple[int, int, int]] = []
    out = []
    for now in range(slots):
        while release and release[0][0] <= now:
            _, s, k = heapq.heappop(release)
            heapq.heappush(ready, (-(-(k + 1) * slots // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < weights[s]:
            heapq.heappush(release, ((k + 1) * slots // weights[s], s, k + 1))
    return out


def plan(spark: SparkSession, sizes: DataFrame, targets: DataFrame, block_tokens: int = DEFAULT_BLOCK_TOKENS, total_tokens: int | None = None, max_targets: int = 100_000, max_blocks: int = MAX_BLOCKS) -> list[dict]:
    """One dict a mix and source: number of the mix and of the source in it, share, tokens it has, quota to draw, cap, size and number of its blocks.

    Sources without tokens, with a null, NaN or non-positive share, or with max_repeats below 1 are left out; the other
    shares of the mix are scaled to 1.  The mix is as large as it can be with every share met and no source read
    more than max_repeats times (null: no cap; if no source has one, as large as the sources together), or
    ``total_tokens`` if that is less.  Shares are exact fractions: a quota is cut by less than one token, however small
    the share.  The targets are a small table by nature; more than ``max_targets`` rows are an error.
    """
    rows = targets.join(sizes, "source").where("tokens > 0 and target_share > 0 and not isnan(target_share) and coalesce(max_repeats, 1) >= 1").limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    mixes: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.mix_name is None, r.mix_name, r.source)):
        mixes.setdefault(r.mix_name, []).append(r)
    out = []
    for number, (mix, members) in enumerate(mixes.items()):
        whole = sum(Fraction(r.target_share) for r in members)
        share = [Fraction(r.target_share) / whole for r in members]
        caps = [r.max_repeats * r.tokens / w for r, w in zip(members, share, strict=True) if r.max_repeats is not None]
        total = min(caps) if caps else sum(r.tokens for r in members)
        total = min(total, total_tokens) if total_tokens is not None else total
        size = max(block_tokens, -(-int(total) // max_blocks))
        for i, (r, w) in enumerate(zip(members, share, strict=True)):
            quota = int(total * w)
            out.append({"mix": number, "mix_name": mix, "source": r.source, "at": i, "target_share": float(w), "tokens": r.tokens, "quota": quota, "max_repeats": r.max_repeats, "block_tokens": size, "blocks": -(-quota // size)})
    return out


PLAN_SCHEMA = "mix int, mix_name string, source string, at int, target_share double, tokens bigint, quota bigint, max_repeats int, block_tokens bigint, blocks bigint"


def plan_table(spark: SparkSession, plans: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(x[c] for c in names) for x in plans], PLAN_SCHEMA)


def schedule(spark: SparkSession, plans: list[dict]) -> DataFrame:
    """(mix, at, block_no, slot): the slot of every block of every mix; one task computes a mix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        order = pfair_period(pdf["blocks"].tolist())
        got = pd.DataFrame(order, columns=["i", "block_no"])
        return pd.DataFrame({"mix": pdf["mix"].iloc[0], "at": pdf["at"].to_numpy()[got["i"].to_numpy(dtype=int)], "block_no": got["block_no"], "slot": range(len(got))})

    return plan_table(spark, plans).groupBy("mix").applyInPandas(run, "mix int, at int, block_no bigint, slot bigint")


def stream_positions(counted: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds ``start``: the tokens of the document's source before it, in hash order.

    Prefix sums in two steps (within a bucket of about ``BUCKET_DOCS`` documents, then over buckets), so that a source
    with a third of all rows is spread over as many tasks as it has buckets.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    n = counted.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BUCKET_DOCS).alias("nb"))
    d = counted.withColumn("h", h).join(n, "source").withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * F.col("nb")).cast("int"))
    # h as an unsigned number keeps buckets and hash order alike
    order = [F.shiftrightunsigned("h", 11), F.col("h"), F.col(id_col)]
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    base = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    d = d.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, ["source", "bucket"])
    return d.withColumn("start", F.col("base") + F.col("inside")).drop("h", "nb", "bucket", "inside", "base")


def draw(spark: SparkSession, counted: DataFrame, plans: list[dict], id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """(mix_name, source, id, repeat_no, n_tokens, block_no, slot): every drawn document with its block's slot.

    A document is drawn while its stream position is below the source's quota, so a source overshoots by less than one
    document.  Ordering by (mix_name, slot, block_no, id) gives the interleaved mix.
    """
    p = plan_table(spark, plans).select("mix", "mix_name", "source", "at", "tokens", "quota", "block_tokens")
    d = stream_positions(counted.where("source is not null"), id_col, seed).join(F.broadcast(p), "source")  # at most max_targets rows
    d = d.where("start < quota").withColumn("repeat_no", F.explode(F.expr("sequence(0L, (quota - start - 1) div tokens)")))
    d = d.withColumn("block_no", F.expr("(start + repeat_no * tokens) div block_tokens"))
    d = d.join(schedule(spark, plans), ["mix", "at", "block_no"])
    return d.select("mix_name", "source", id_col, F.col("repeat_no").cast("int"), "n_tokens", "block_no", "slot")


def shares(drawn: DataFrame, spark: SparkSession, plans: list[dict]) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, n_docs, n_tokens, reached_share, repeats): what the draw reached."""
    got = drawn.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat_no") + 1).alias("repeats"))
    p = plan_table(spark, plans).select("mix_name", "source", "target_share", "max_repeats")
    total = Window.partitionBy("mix_name")  # one row a source
    out = p.join(got, ["mix_name", "source"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    return out.select("mix_name", "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "n_tokens", (F.col("n_tokens") / F.sum("n_tokens").over(total)).alias("reached_share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
