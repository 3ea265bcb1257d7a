"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Documents with equal texts are a group, and a group is placed whole: each goes where the dot product of its (bytes, tokens, rows)
with the shard's residual capacity is highest, largest groups first. Only a group that exceeds a shard's fair share of a measure
is cut, into chunks by a hash of the key. To place billions of groups, small groups are first packed by the same rule into bundles,
in independent buckets; bundles and large groups, whose number is bounded whatever the corpus size, are placed last. The rows of
large groups are numbered by chunk, whether these are placed together or not.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.frames import small_batches, staged, without

SHARDS = 16
PIECES = 64                 # a group above 1/PIECES of a shard in any measure is large: placed on its own, its rows dealt into chunks below that
BUCKET_GROUPS = 20_000      # small groups that one task packs ...
MOST_BUCKETS = 4_096        # ... until there are so many buckets; fewer buckets make more, smaller bundles each
FINENESS = 64
SLOT_ROWS = 50_000          # rows that one task numbers
MEASURES = ["bytes", "tokens", "rows"]


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each vector: largest first, each where its dot product with the residual capacity is highest.

    Bins that can take all of the vector come first, then those that can take its first measure, then the one with most of that
    left: a whole group heavy in one measure only would else pull the first one apart. Capacities are scaled to 1 in each
    measure. Residuals may go below zero: nothing is left out.
    """
    scaled = vectors / np.maximum(capacity[0], 1e-12)
    residual = capacity / np.maximum(capacity[0], 1e-12)
    bins = np.empty(len(vectors), dtype=np.int32)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        takes = residual >= scaled[i] - 1e-9
        for fits in (takes.all(axis=1), takes[:, 0]):
            if fits.any():
                at = int(np.argmax(np.where(fits, residual @ scaled[i], -np.inf)))
                break
        else:
            at = int(np.argmax(residual[:, 0]))
        bins[i] = at
        residual[at] -= scaled[i]
    return bins


def _capacity(vectors: np.ndarray, shards: int) -> np.ndarray:
    return np.tile(vectors.sum(axis=0) / shards, (shards, 1))


def _pack_bucket(bundles: int):
    def pack(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("group", kind="stable")
        vectors = groups[MEASURES].to_numpy(dtype=float)
        return groups.assign(bundle=place(vectors, _capacity(vectors, bundles)))
    return pack


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Append size (UTF-8 bytes of the text plus 1), shard (0 to shards - 1) and slot (gapless from 0 in its shard) to every row.

    Equal texts share a shard unless their group exceeds the fair share of one, total / shards, in bytes, tokens or rows. A null text is a text of no bytes; rows that repeat a key
    and text stay together and get slots of their own; a null key is dealt like any other; an empty table gives an empty result;
    columns that carry one of the names are replaced.
    """
    spark = small_batches(docs.sparkSession)
    base = without(docs, ["size", "shard", "slot"])
    content = F.coalesce(F.col(text), F.lit(""))
    tokens = F.size(F.split(content, " ")).cast("long")
    sized = base.withColumns({"size": F.octet_length(content).cast("long") + 1, "__group": F.xxhash64(content)})
    groups = staged(sized.withColumn("__tokens", tokens).groupBy(F.col("__group").alias("group")).agg(
        F.sum("size").alias("bytes"), F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("groups")).first()
    share = [max(total[m] / shards, 1.0) for m in MEASURES]
    limit = [max(x / PIECES, 1.0) for x in share]

    # Large groups: at most 3 * shards * PIECES of them, whatever the input.
    ratio, shares = [F.greatest(*[F.col(m) / bound for m, bound in zip(MEASURES, bounds, strict=True)]) for bounds in (limit, share)]
    large = F.broadcast(staged(groups.filter((ratio > 1) & (F.col("rows") > 1)).select(F.col("group").alias("__large"), F.ceil(ratio).alias("__chunks"), (shares > 1).alias("__cut"))))
    chunk = F.when(F.col("__chunks").isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.col("__chunks"))).otherwise(F.lit(0).cast("long"))
    chunked = sized.join(large, F.col("__group") == F.col("__large"), "left").withColumn("__chunk", chunk)
    pieces = chunked.filter("__chunks IS NOT NULL").groupBy("__group", "__chunk", "__cut").agg(
        F.sum("size").alias("bytes"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("rows")).toPandas()

    # Small groups: bundles by bucket.
    buckets = int(min(max(total["groups"] // BUCKET_GROUPS, 1), MOST_BUCKETS))
    small = groups.join(large, F.col("group") == F.col("__large"), "left_anti").withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    bundled = staged(small.groupBy("bucket").applyInPandas(_pack_bucket(shards * max(MOST_BUCKETS // buckets // FINENESS, 1)), "group long, bytes long, tokens long, rows long, bucket long, bundle int"))
    bundles = bundled.groupBy("bucket", "bundle").agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy("bucket", "bundle").toPandas()

    # At most shards * MOST_BUCKETS bundles and 6 * shards * PIECES chunks are placed here, the chunks of a group that is not cut as one.
    pieces = pieces.sort_values(["__group", "__chunk"])
    unit = pieces.groupby([pieces["__group"], pieces["__chunk"].where(pieces["__cut"].astype(bool), 0)], sort=True).ngroup().to_numpy()
    units = pieces[MEASURES].groupby(unit).sum()
    vectors = np.concatenate([units.to_numpy(dtype=float), bundles[MEASURES].to_numpy(dtype=float)])
    bins = place(vectors, _capacity(vectors, shards)) if len(vectors) else np.zeros(0, dtype=np.int32)
    at_bundle = spark.createDataFrame(pd.DataFrame({"bucket": bundles["bucket"].astype("int64"), "bundle": bundles["bundle"].astype("int32"), "shard": bins[len(units):]}),
                                      "bucket long, bundle int, shard int")
    at_piece = spark.createDataFrame(pd.DataFrame({"group": pieces["__group"].astype("int64"), "chunk": pieces["__chunk"].astype("int64"),
                                                   "rows": pieces["rows"].astype("int64"), "shard": bins[unit]}), "group long, chunk long, rows long, shard int")
    placed = bundled.join(F.broadcast(at_bundle), ["bucket", "bundle"]).select("group", F.lit(0).cast("long").alias("chunk"), "rows", "shard").unionByName(at_piece)

    # Slots: parts of a shard are numbered on their own, behind all rows of the parts before; a part holds whole pieces.
    parts = int(max(total["rows"] // (shards * SLOT_ROWS), 1) * 4)
    placed = staged(placed.withColumn("part", F.pmod(F.xxhash64("group", "chunk"), F.lit(parts)).cast("int")))
    before = pd.DataFrame(placed.groupBy("shard", "part").agg(F.sum("rows").alias("rows")).collect(), columns=["shard", "part", "rows"]).astype("int64").sort_values(["shard", "part"])
    before["before"] = before.groupby("shard")["rows"].cumsum() - before["rows"]
    offsets = spark.createDataFrame(before[["shard", "part", "before"]], "shard long, part long, before long")
    placed = placed.join(F.broadcast(offsets), ["shard", "part"]).select(F.col("group").alias("__group"), F.col("chunk").alias("__chunk"), "shard", F.col("part").alias("__part"), F.col("before").alias("__before"))
    found = chunked.join(placed, ["__group", "__chunk"])
    by = Window.partitionBy("shard", "__part").orderBy(F.col(key), "__group")
    numbered = found.withColumn("slot", F.col("__before") + F.row_number().over(by) - 1)
    return numbered.select(*[F.col(f"`{c}`") for c in base.columns], "size", "shard", "slot")
