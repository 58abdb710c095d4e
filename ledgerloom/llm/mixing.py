"""Mixing sources to target weights [native]: temperature mixing.

A source's share of the tokens is raised to an exponent and normalised. The exponent is found by
bisection: as near to 1 as a target entropy asks, but never so small that a source would repeat
more than the limit. Without a total budget the mixture is scaled so that the source with the
lowest weight against its share is used exactly once: nothing is dropped, other sources repeat.
With one, a source gets its weight of the total, which may be less than all of it.

A source's budget is realised by block permutations: rows fall into BLOCKS blocks of a source
by hash; every epoch visits the blocks in an order of its own. Full epochs take each row once;
the last, partial epoch takes whole blocks while they fit the rest of the budget, and of the
first block that does not fit the rows, by hash, that do: that block is cut into BLOCKS parts by further bits of the hash,
whose sums tell which part the budget ends in, and only the rows of that part (one in BLOCKS^2 of a source) are put in
order. So a source is within one row of its budget, and no task holds a source or a block, however hot.

What is small: one row per source and block (sources x BLOCKS, pre-aggregated before its
shuffle) and one array over sources, on which the bisection runs as a SQL fold (some 40 bytes a source; for
sources by the million, group them first).

Cases: a null source is a source of its own; a null or empty text has no tokens and goes
with the full epochs alone (a source without tokens is used once); repeated rows are mixed one
by one, ties of the hash are broken by doc_id, then tokens and text; an empty table gives an empty result; other
columns are kept by `mix`, whatever their names: its own columns come last, named _epoch, _block and _block_key, with
more underscores where docs has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.columns import unused
from ledgerloom.llm.sharding import hash32
from ledgerloom.session import written

BLOCKS = 4096
TARGET_ENTROPY = 0.92
MAX_REPEATS = 2.0
STEPS = 50
#: Blocks of all sources that may be broadcast to the rows; beyond, rows and blocks are shuffled.
BROADCAST_ROWS = 400_000


def n_tokens(text: Column) -> Column:
    """Tokens by spaces: a cheap stand-in that is in proportion to words. Pass a column of
    token counts where there is one."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.lit(0)).otherwise(
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def rank(key: Column, seed: int = 0) -> Column:
    """The place of a row in its source's permutation: 32 bits; the high ones give the block."""
    return hash32(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def block_of(r: Column) -> Column:
    return (r / (2**32 // BLOCKS)).cast("int")


def part_of(r: Column) -> Column:
    """The part of its block that a row is in."""
    return (r % (2**32 // BLOCKS) / (2**32 // BLOCKS // BLOCKS)).cast("int")


def block_key(seed: int, source: Column, epoch: Column, block: Column) -> Column:
    """Blocks of an epoch are visited in ascending order of this."""
    return hash32(
        F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("\0")), epoch.cast("string"), block.cast("string"))
    )


def weights(
    blocks: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    total_tokens: int | None = None,
) -> DataFrame:
    """(source, tokens, share, exponent, weight, budget): one row per source."""
    per = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    one = per.where(F.col("tokens") > 0).agg(F.sort_array(F.collect_list(F.struct("tokens", "source"))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    one = one.select(F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["tokens"].alias("tokens"), (x["tokens"] / total).alias("share"))).alias("s"))

    def powers(a: Column) -> Column:
        return F.transform("s", lambda x: F.pow(x["share"], a))

    def summed(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def entropy(a: Column) -> Column:
        # of p^a / z: log z - a * sum(p^a log p) / z
        logs = F.transform("s", lambda x: F.pow(x["share"], a) * F.log(x["share"]))
        z = summed(powers(a))
        return F.log(z) - a * summed(logs) / z

    def repeats(a: Column) -> Column:
        low = F.array_min(F.transform("s", lambda x: x["share"]))
        high = F.array_max(F.transform("s", lambda x: x["share"]))
        return F.pow(low / high, a - 1)

    def largest(ok) -> Column:
        """The largest exponent in [0, 1] at which ok still holds, if ok holds below it."""
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)),
            F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
            lambda b, _: F.when(
                ok((b["lo"] + b["hi"]) / 2), F.struct(((b["lo"] + b["hi"]) / 2).alias("lo"), b["hi"].alias("hi"))
            ).otherwise(F.struct(b["lo"].alias("lo"), ((b["lo"] + b["hi"]) / 2).alias("hi"))),
            lambda b: b["lo"],
        )

    goal = F.lit(float(target_entropy)) * F.log(F.size("s").cast("double"))
    by_entropy = F.when(entropy(F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(largest(lambda a: entropy(a) >= goal))
    by_repeats = F.when(repeats(F.lit(0.0)) <= max_repeats, F.lit(0.0)).otherwise(
        largest(lambda a: repeats(a) > max_repeats)
    )
    one = one.select("s", F.greatest(by_entropy, by_repeats).alias("a"))
    one = one.select("s", "a", summed(powers(F.col("a"))).alias("z"), F.array_max(F.transform("s", lambda x: x["share"])).alias("top"))
    each = one.select(F.explode("s").alias("x"), "a", "z", "top")
    weight = F.pow(F.col("x.share"), F.col("a")) / F.col("z")
    if total_tokens is None:
        # rounded, so that a budget does not hang on the last bit of a power
        budget = F.floor(F.col("x.tokens") * F.round(F.pow(F.col("x.share") / F.col("top"), F.col("a") - 1), 6))
    else:
        budget = F.floor(F.lit(float(total_tokens)) * F.round(weight, 9))
    return each.select(
        "x.source", "x.tokens", "x.share", F.col("a").alias("exponent"), weight.alias("weight"), budget.cast("long").alias("budget")
    )


def block_plan(blocks: DataFrame, per_source: DataFrame, seed: int = 0) -> DataFrame:
    """What becomes of each block: full epochs, and of the partial one all, nothing or `rest`
    tokens (a block that is cut)."""
    b, s = blocks.alias("b"), per_source.alias("s")
    j = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")), "left").select(
        "b.source", "b.block", F.col("b.tokens").alias("tokens"), F.col("s.tokens").alias("all"), "s.budget"
    )
    # a source without tokens has no weight: it is used once
    epochs = F.coalesce(F.floor(F.col("budget") / F.col("all")), F.lit(1)).cast("int")
    j = j.withColumn("epochs", epochs).withColumn("rest", F.coalesce(F.col("budget") % F.col("all"), F.lit(0)))
    j = j.withColumn("key", block_key(seed, F.col("source"), F.col("epochs") + 1, F.col("block")))
    order = W.partitionBy("source").orderBy("key", "block").rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumn("upto", F.sum("tokens").over(order))
    before = F.col("upto") - F.col("tokens")
    cut = (F.col("upto") > F.col("rest")) & (before < F.col("rest"))
    return j.select(
        "source",
        "block",
        "epochs",
        ((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).cast("int").alias("extra"),
        F.when(cut, F.col("rest") - before).alias("rest"),
    )


def mix(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    total_tokens: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    tokens: Column | None = None,
) -> DataFrame:
    """docs, each row once per epoch that takes it, with its epoch, block and the block's key as last columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    epoch, block, key, n, place, copies, source, at, cut, part, of, of_block, of_part, fits, left, run = unused(
        docs, "_epoch", "_block", "_block_key", "_tokens", "_rank", "_copies", "_source", "_at", "_cut", "_part", "_of", "_of_block",
        "_of_part", "_fits", "_left", "_run",
    )
    by_source, by_id = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    tokens = n_tokens(F.col("text")) if tokens is None else tokens
    based = docs.withColumns({n: F.coalesce(tokens.cast("long"), F.lit(0)), place: rank(by_id, seed)})
    based = based.withColumn(block, block_of(F.col(place))).withColumn(part, part_of(F.col(place)))
    blocks = based.groupBy(by_source.alias("source"), F.col(block).alias("block")).agg(F.sum(n).alias("tokens"))
    blocks = written(blocks, "mix-blocks")
    plan = written(block_plan(blocks, weights(blocks, target_entropy, max_repeats, total_tokens), seed), "mix-plan")
    small = plan.count() <= BROADCAST_ROWS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    named = plan.select(
        F.col("source").alias(source), F.col("block").alias(at), (F.col("epochs") + F.col("extra")).alias(copies), F.col("rest").alias(cut)
    )
    planned = based.join(side(named), (F.col(block) == F.col(at)) & by_source.eqNullSafe(F.col(source)))
    # one block a source at most is cut, into BLOCKS parts at most
    parts = planned.where(F.col(cut).isNotNull()).groupBy(source, at, part).agg(F.sum(n).alias("tokens"), F.min(cut).alias("rest"))
    upto = F.sum("tokens").over(W.partitionBy(source).orderBy(part).rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    parts = written(
        parts.select(
            F.col(source).alias(of), F.col(at).alias(of_block), F.col(part).alias(of_part), (F.col("upto") <= F.col("rest")).alias(fits),
            F.when((F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest")), F.col("rest") - F.col("before")).alias(left),
        ),
        "mix-parts",
    )
    same = (F.col(block) == F.col(of_block)) & (F.col(part) == F.col(of_part)) & by_source.eqNullSafe(F.col(of))
    told = planned.join(side(parts), same, "left")
    whole = told.where(F.col(left).isNull()).withColumn(copies, F.col(copies) + F.coalesce(F.col(fits).cast("int"), F.lit(0)))
    ties = [F.xxhash64("text")] if "text" in docs.columns else []
    order = W.partitionBy(source).orderBy(F.col(place), by_id, F.col(n), *ties).rowsBetween(W.unboundedPreceding, 0)
    last = planned.join(side(parts.where(F.col(left).isNotNull())), same).withColumn(run, F.sum(n).over(order))
    last = last.withColumn(copies, F.col(copies) + (F.col(run) <= F.col(left)).cast("int"))
    both = whole.select(*own, block, copies).unionByName(last.select(*own, block, copies)).where(F.col(copies) > 0)
    out = both.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*own, epoch, block, block_key(seed, by_source, F.col(epoch), F.col(block)).alias(key))
