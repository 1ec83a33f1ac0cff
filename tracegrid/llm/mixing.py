"""Documents of several sources mixed to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.tokens import TOKENIZERS, with_tokens
from tracegrid.runtime import bounded_rows, broadcast_if_small, columns_named, materialise

#: Buckets of equal depth into which the sampling keys of a source fall (a power of two), and the precision of their bounds.
BUCKETS, PRECISION = 512, 10_000
#: Characters that hardly stand in prose.
MARKS = "[]{}|=<>*#_~\\^"
#: Rows of the two tables that are read on the driver at most.
MOST_TARGETS = 10_000


def source_key(c):
    """A source name without regard to case, outer blanks, ``-`` and ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), "[-_]", "")


def _weighted(documents: DataFrame, folder: str) -> DataFrame:
    """(doc_id, source, tokens, weight): the quality weight, 0.1 to 1, of a document's prose.

    It grows with the characters per token, since ordinary prose has four to five
    in a vocabulary made from such prose and markup, numbers and gibberish have
    fewer, and falls with the share of characters that only markup uses.
    """
    text = F.col("text")
    d = columns_named(documents, "doc_id", "source", "text").where("doc_id is not null")
    d = d.withColumn("marks", F.length(text) - F.length(F.translate(text, MARKS, "")))
    d = with_tokens(d, "doc_id", "source", "marks", folder=folder)
    d = d.groupBy("doc_id").agg(F.min(source_key("source")).alias("source"), F.max("tokens").alias("tokens"), F.max("n_chars").alias("n_chars"), F.max("marks").alias("marks"))
    dense, plain = (F.col("n_chars") / F.col("tokens") - 2) / 2.5, 1 - 3 * F.col("marks") / F.col("n_chars")
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.1), dense)) * F.greatest(F.lit(0.1), plain)
    return d.where("tokens > 0 and source is not null").select("doc_id", "source", "tokens", F.greatest(F.lit(0.1), quality).alias("weight"))


def plan_mixture(totals: DataFrame, mix_targets: DataFrame) -> list[dict]:
    """Budget, complete epochs and rest of each source with documents, from its token total (source, tokens).

    The whole is as large as the scarcest source allows when used max_repeats
    times; shares of targets without documents are spread over the others in
    proportion, since nothing can fill them.
    """
    wanted = columns_named(mix_targets, "source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    targets = {}
    for source, share, most in sorted(map(tuple, bounded_rows(wanted.select(source_key("source"), "target_share", "max_repeats").distinct(), MOST_TARGETS, "mix_targets"))):
        targets[source] = (share, most)
    have = {r[0]: r[1] for r in bounded_rows(totals, MOST_TARGETS, "sources with a target")}
    usable = {s: t for s, t in targets.items() if have.get(s)}
    whole = sum(share for share, _ in usable.values())
    size = min((have[s] * most * whole / share for s, (share, most) in usable.items()), default=0.0)
    plan = []
    for s, (share, most) in sorted(targets.items()):
        tokens = have.get(s, 0)
        budget = size * share / whole if s in usable else 0.0
        epochs = min(int(budget // tokens), most) if tokens else 0
        plan.append({"source": s, "target_share": share, "max_repeats": most, "available": int(tokens), "budget": budget, "epochs": epochs, "rest": max(0.0, budget - epochs * tokens) if epochs < most else 0.0})
    return plan


def with_bucket(keyed: DataFrame) -> DataFrame:
    """``keyed`` (source, key, ...) plus ``bucket``: the keys of each source in ``BUCKETS`` buckets of equal depth, in order.

    The bounds are quantiles from a mergeable sketch of each source, so that the
    buckets are as deep as each other whatever the weights; a row finds its own by
    bisection.  The sources are those of the targets, whose number is checked when
    they are read, so the bounds are broadcast.
    """
    bounds = keyed.groupBy("source").agg(F.percentile_approx("key", [(i + 1) / BUCKETS for i in range(BUCKETS - 1)], PRECISION).alias("bounds"))
    steps = BUCKETS.bit_length() - 1
    lower = f"aggregate(sequence(1, {steps}), 0, (at, i) -> if(element_at(bounds, at + shiftright({BUCKETS}, i)) < key, at + shiftright({BUCKETS}, i), at))"
    return keyed.join(F.broadcast(bounds), "source").withColumn("bucket", F.expr(lower)).drop("bounds")


def mix_sources(documents: DataFrame, mix_targets: DataFrame, folder: str = TOKENIZERS, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document enters the mixture.

    Every source makes up its target share of the total tokens, as far as whole
    documents allow, and no document is used more than max_repeats times.
    Complete epochs of a source come first; the rest of its budget is a weighted
    sample without replacement: every document draws an exponential key divided by
    its quality weight, and the documents with the smallest keys are taken up to
    the budget, the last one if more than half of it fits.

    The prefix sums run over buckets of equal depth first; only the one bucket of
    a source in which its budget ends is put in order, so no source, however
    large, is sorted in one task.  Documents of a source without target, with NULL
    source or doc_id or an empty text are not used; repeated rows of one doc_id
    count once; the keys depend on doc_id and ``seed`` only; ties go by doc_id; an
    empty table gives an empty result.
    """
    docs = materialise(_weighted(documents, folder), "mix-documents")
    plan = plan_mixture(docs.join(broadcast_if_small(_known(mix_targets)), "source").groupBy("source").agg(F.sum("tokens").alias("tokens")), mix_targets)
    spark = documents.sparkSession
    if not plan:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, repeats int")
    # One row per target: bounded by the size check of plan_mixture.
    rows = spark.createDataFrame([(p["source"], p["epochs"], float(p["rest"])) for p in plan], "source string, epochs int, rest double")
    d = docs.join(F.broadcast(rows), "source")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    d = d.withColumn("key", -F.log(u) / F.col("weight"))
    d = materialise(with_bucket(d), "mix-keys")
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", "t", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("before"))
    # At most BUCKETS rows for each target, whose number plan_mixture checked.
    d = d.join(F.broadcast(sums), ["source", "bucket"])
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = d.where(ends_here).withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    taken = (F.col("before") + F.col("within") + F.col("tokens") / 2 <= F.col("rest")).cast("int")
    clear = d.where(~ends_here).withColumn("taken", (F.col("before") + F.col("t") <= F.col("rest")).cast("int"))
    shown = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("taken")).alias("repeats")]
    return clear.select(*shown).unionByName(cut.withColumn("taken", taken).select(*shown)).where("repeats > 0")


def _known(mix_targets: DataFrame) -> DataFrame:
    return mix_targets.select(source_key("source").alias("source")).where("source is not null").distinct()


def mixture_report(mixture: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_repeats, max_repeats) per target.

    A target without documents has reached share 0.
    """
    got = mixture.groupBy(source_key("source").alias("key")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = mixture.agg(F.sum(F.col("tokens") * F.col("repeats"))).scalar()
    t = columns_named(mix_targets, "source", "target_share", "max_repeats").distinct().withColumn("key", source_key("source"))
    out = t.join(got, "key", "left")
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
