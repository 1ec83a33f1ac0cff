"""Documents into containers of fixed capacity by sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.tokens import TOKENIZERS, with_tokens
from tracegrid.runtime import bounded_rows, columns_named, materialise

#: Documents that one packing run places, and the number of tasks from which on several runs share one.
SHARD, MOST_TASKS = 25_000, 1 << 15


class SquaresPacker:
    """Online packing: each item goes to the fill level that minimises the squared counts of open containers.

    ``count[h]`` is the number of open containers filled to ``h``; moving one from
    h to h + s changes the sum of squares by 2 (count[h + s] - count[h] + 1), and
    opening one by 2 count[s] + 1; full containers leave the array.  Of equal
    choices the fullest open container wins.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.containers = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill before) for an item of ``size`` tokens, 1 <= size <= capacity."""
        c, n = self.capacity, self.count
        top = c - size
        level, best = 0, 2 * n[size] + 1 if size < c else 0
        if top > 0:
            after, before = n[size + 1 : c + 1], n[1 : top + 1]
            cost = 2 * (after - before) + 2
            cost[-1] = 1 - 2 * before[-1]  # level capacity counts nothing
            cost[before == 0] = np.iinfo(np.int64).max
            k = top - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                level = k + 1
        if level:
            n[level] -= 1
            box = self.open[level].pop()
        else:
            box, self.containers = self.containers, self.containers + 1
        if level + size < c:
            n[level + size] += 1
            self.open.setdefault(level + size, []).append(box)
        return box, level


def _pieces(sizes: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(container, capacity, doc_id, piece, tokens): a document above the capacity is cut into full pieces and a rest."""
    box = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(int(c)).cast("bigint").alias("capacity")) for n, c in capacities])).alias("box")
    s = sizes.select("doc_id", "tokens", box).select("box.container", "box.capacity", "doc_id", "tokens")
    last = F.expr("(tokens - 1) div capacity")
    s = s.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return s.select("container", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"))


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, folder: str = TOKENIZERS, shard: int = SHARD) -> DataFrame:
    """(container, bin, doc_id, piece, at, tokens): where each document lies in containers of each capacity.

    ``bin`` names a container of the kind, ``at`` is the fill before the piece.  A
    document is split only if it alone exceeds the capacity, into full containers
    and a rest that is packed like any document.  Rests and short documents are
    spread at random over runs of about ``shard`` documents, each packed online by
    one task, so that the number of tasks follows the data.

    A NULL doc_id, a NULL or empty text and a container without a positive
    capacity take no part; equal documents are packed each for itself; repeated
    rows of one doc_id count once; an empty table gives an empty result.
    """
    capacities = [(r[0], r[1]) for r in bounded_rows(columns_named(pack_sizes, "container", "capacity_tokens").dropna().where("capacity_tokens > 0").distinct().orderBy("container", "capacity_tokens"), 1000, "pack_sizes")]
    schema = "container string, bin string, doc_id bigint, piece bigint, at bigint, tokens bigint"
    if not capacities:
        return documents.sparkSession.createDataFrame([], schema)
    sizes = with_tokens(documents.where("doc_id is not null"), "doc_id", folder=folder).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")
    sizes = materialise(sizes, "sizes")
    pieces = _pieces(sizes, capacities)
    full = pieces.where("tokens = capacity").select("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin"), "doc_id", "piece", F.lit(0).cast("bigint").alias("at"), "tokens")
    loose = pieces.where("tokens < capacity")
    runs = max(1, -(-sizes.count() // shard))
    loose = loose.withColumn("run", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(runs)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer = None, None
        for b in batches:
            names, caps, docs, piece, tokens, run = (b.column(c).to_pylist() for c in ("container", "capacity", "doc_id", "piece", "tokens", "run"))
            bins, at = [], []
            for n, c, r, t in zip(names, caps, run, tokens, strict=True):
                if key != (n, c, r):
                    key, packer = (n, c, r), SquaresPacker(c)
                box, fill = packer.place(t)
                bins.append(f"{c}-{r}-{box}"), at.append(fill)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bins, pa.string()), pa.array(docs, pa.int64()), pa.array(piece, pa.int64()), pa.array(at, pa.int64()), pa.array(tokens, pa.int64())], names=["container", "bin", "doc_id", "piece", "at", "tokens"])

    order = F.xxhash64(F.lit(11), "doc_id")
    # A fixed number of partitions, since the runs are long work over few bytes that must not be put together.
    lines = loose.repartition(min(runs * len(capacities), MOST_TASKS), "container", "capacity", "run").sortWithinPartitions("container", "capacity", "run", order, "doc_id")
    return full.unionByName(lines.mapInArrow(pack, schema))


def packing_report(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(container, capacity_tokens, bins, tokens, documents, split_documents, used_share) of a packing."""
    by = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"))
    use = by.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    docs = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("pieces")).groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("pieces") > 1).cast("bigint")).alias("split_documents"))
    size = columns_named(pack_sizes, "container", "capacity_tokens").distinct()
    return size.join(use, "container").join(docs, "container").select("container", "capacity_tokens", "bins", "tokens", "documents", "split_documents", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("used_share"))
