"""Records of several sources mixed to target shares of the total size.

Weighted fair queueing: the records of a source are shuffled and queued; each copy of a
record gets a virtual finish time, the tokens of its source up to and with it divided by
the source's weight. In the order of finish times all sources advance in proportion to
their weights; a source whose records are used max_repeats times drops out and the rest
keep their proportions. The order is cut at the total budget.

No source is put into one task: the running sums are made of sums over slices of the
shuffled order and of sums within a slice, and there are as many slices as keep one of
them at SLICE records. The cut is found from histograms of finish times, each over the
bin of the one before in which the budget ends, until that bin holds EDGE copies at most;
only these are put in order. Copies are made only up to the cut.

Defined results: sources are compared without letter case, blanks for underscores; NULL
sources and sources without a target are left out; records without tokens are left out;
a target without records reaches 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflow.session import written

SLICE = 20_000
BINS = 4096
EDGE = 100_000


def source_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)[\s\p{Z}_-]+", " ")), " ", "_"))


def queued(docs: DataFrame, targets: DataFrame, seed: int = 23, slices: int | None = None, max_targets: int = 10_000) -> DataFrame:
    """(doc_id, source, tokens, w, k, supply, run) of every record: the tokens of its source up to and with it.

    docs: doc_id, source, tokens. targets: source, target_share, max_repeats; at most max_targets rows.
    """
    if targets.limit(max_targets + 1).count() > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("w"), F.col("max_repeats").alias("k"))
    slices = slices or max(16, docs.count() // SLICE)
    own = docs.where("tokens > 0 and source is not null").select("doc_id", source_key(F.col("source")).alias("source"), "tokens")
    own = own.join(F.broadcast(t), "source").withColumn("at", F.xxhash64("doc_id", F.lit(seed))).withColumn("slice", F.pmod("at", F.lit(slices)))
    sums = own.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"))
    over = Window.partitionBy("source").orderBy("slice")
    whole = Window.partitionBy("source")
    before = sums.select("source", "slice", (F.sum("in_slice").over(over) - F.col("in_slice")).alias("before"), F.sum("in_slice").over(whole).alias("supply"))
    within = Window.partitionBy("source", "slice").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumn("run", F.sum("tokens").over(within)).join(before.hint("merge"), ["source", "slice"])
    return run.select("doc_id", "source", "tokens", "w", "k", "supply", (F.col("before") + F.col("run")).alias("run"))


def copies(queue: DataFrame, until: float | None = None) -> DataFrame:
    """(doc_id, source, copy, tokens, finish) of the copies that a source may give, of finish times up to one."""
    last = F.col("k") - 1
    if until is not None:  # one more than the division says, against its rounding; the finish time decides
        last = F.least(last, F.floor((F.lit(until) * F.col("w") - F.col("run")) / F.col("supply")).cast("int") + 1)
    made = queue.where(last >= 0).select("doc_id", "source", "tokens", "w", "supply", "run", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    made = made.select("doc_id", "source", "copy", "tokens", ((F.col("copy") * F.col("supply") + F.col("run")) / F.col("w")).alias("finish"))
    return made.where(F.col("finish") <= until) if until is not None else made


def mixed(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 23, edge: int = EDGE) -> DataFrame:
    """(doc_id, source, copy, tokens, finish): the selection, up to the total budget in tokens.

    budget: by default the tokens of all records of the sources with a target.
    """
    queue = written(queued(docs, targets, seed), "queue")
    ends = queue.agg(F.max(F.col("k") * F.col("supply") / F.col("w")).alias("last"), F.sum("tokens").alias("once"), F.sum(F.col("tokens") * F.col("k")).alias("all")).first()
    if ends["last"] is None or ends["all"] <= (ends["once"] if budget is None else budget):
        return copies(queue)
    budget = ends["once"] if budget is None else budget
    low, high, filled = 0.0, float(ends["last"]), 0
    while True:
        width = (high - low) / BINS
        inside = copies(queue, high).where(F.col("finish") > low)
        bins = inside.groupBy(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.ceil((F.col("finish") - low) / width) - 1)).alias("bin")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        for r in bins.orderBy("bin").collect():  # BINS rows at most
            if filled + r["tokens"] > budget:
                break
            filled += r["tokens"]
        # a little wider than the bin, against rounding; what lies before it is counted again below
        found, low, high = r["n"], low + r["bin"] * width, low + (r["bin"] + 1) * width
        if found <= edge or high - low <= abs(high) * 1e-12:
            break
    low, high = low - width * 1e-6, high + width * 1e-6
    done = copies(queue, low)
    filled = done.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    order = Window.partitionBy(F.lit(1)).orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    last = copies(queue, high).where(F.col("finish") > low).withColumn("sum", F.sum("tokens").over(order)).where(F.col("sum") <= budget - filled).drop("sum")
    return done.union(last)


def share_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, records, copies, tokens, actual_share) of every target."""
    got = selection.groupBy("source").agg(F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).alias("records"), F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left")
    t = t.select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("records", "copies", "tokens")))
    return t.withColumn("actual_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0.0)))
