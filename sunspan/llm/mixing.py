"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

Time is a row of slots, each with room for one block. A source of weight w releases its k-th block (from 0) at slot
floor(k / w) and wants it placed before slot ceil((k + 1) / w); in each slot the released block with the earliest
deadline goes next. Weights are whole parts of SLOTS, and release times and deadlines are exact whole-number arithmetic,
so at every slot each source has less than one block more or less than its weight asks for. The schedule is as long as
the sources last, up to SLOTS, where every source has had exactly its parts; a longer stream repeats it from there, so
that however long it is, nothing adds up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that all weights add up to, and the slots of a whole schedule; it bounds what is broadcast.
SLOTS = 100_000
#: Sources of a mix. Each slot looks at all of them.
MOST_SOURCES = 4096
#: Slots that are folded at once.
FOLD = 500
#: Rows that a range of a source is to hold; ranges number the rows of a source in parallel.
RANGE_ROWS, LEAST_RANGES = 20_000, 64


def _source_key(source: Column) -> Column:
    """A source as a key that is never null: null is the empty string, others start with =."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def parts(counts: DataFrame, power: float = 0.5, targets: dict[str, float] | None = None, parts_of: int = SLOTS) -> DataFrame:
    """key, n_rows and part from rows (key, n): each source's target weight in whole parts, ``parts_of`` for all.

    Target weights are ``targets`` by source name or, without it, the number of rows to ``power``. A source whose
    weight is missing, 0 or less than 2 parts has one part, so that all rows get a slot; the others divide the rest by
    their weights, by largest remainders, ties to the lesser key. Without any weight all sources weigh the same. More
    than MOST_SOURCES sources raise an error; a null key is a source; no rows give no parts.
    """
    rows = counts.groupBy("key").agg(F.sum("n").alias("n_rows"))
    if targets is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(float(power)))
    elif targets:
        weight = F.coalesce(F.create_map(*[F.lit(x) for s, w in targets.items() for x in ("=" + s, float(w))])[F.col("key")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    every = Window.partitionBy(F.lit(1))  # a row per source, MOST_SOURCES at most
    n, total = F.count(F.lit(1)).over(every), F.sum("weight").over(every)
    asked = F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0) / n) * parts_of
    rows = rows.withColumn("weight", weight).withColumn("asked", asked).withColumn("large", F.col("asked") >= 2)
    left = F.lit(parts_of) - F.count_if(~F.col("large")).over(every)
    rows = rows.withColumn("share", F.when(F.col("large"), F.col("asked") * left / F.sum(F.when(F.col("large"), F.col("asked"))).over(every)).otherwise(1.0))
    rows = rows.withColumn("part", F.floor("share").cast("long"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("share") - F.col("part")), "key")
    part = F.col("part") + F.when(F.row_number().over(order) <= F.lit(parts_of) - F.sum("part").over(every), 1).otherwise(0)
    few = F.when(n <= MOST_SOURCES, part).otherwise(F.raise_error(F.lit(f"more than {MOST_SOURCES} sources")).cast("long"))
    return rows.select("key", "n_rows", few.cast("long").alias("part"))


def schedule(weighed: DataFrame, block_rows: int = 16, slots: int = SLOTS) -> DataFrame:
    """key, n_rows, k, slot, quota and length: the slot of each source's k-th block, from parts of ``slots``.

    In each slot, of the blocks that are released, that with the earliest deadline is placed, ties to the lesser key.
    length is the number of slots, enough for all rows of each source but ``slots`` at most, and quota the number of
    blocks that a source has in them; with ``slots`` slots these are the parts. The slots are folded in one row, over an
    array with an entry per source; both are bounded. Without sources there are no slots.
    """
    blocks = F.ceil(F.col("n_rows") / block_rows)
    whole = F.sum("part").over(Window.partitionBy(F.lit(1)))
    asked = weighed.withColumn("asked", F.ceil(blocks * whole / F.col("part")).cast("long")).withColumn("whole", whole)
    listed = asked.groupBy("whole").agg(
        F.sort_array(F.collect_list(F.struct("key", "n_rows", F.col("part").alias("p")))).alias("all"), F.least(F.max("asked"), F.lit(slots).cast("long")).alias("length")
    )
    step = """
        aggregate(sequence(o * {fold}L, least(length, (o + 1L) * {fold}L) - 1L),
            named_struct('done', acc.done, 'picked', cast(array() as array<bigint>)),
            (one, t) -> transform(
                array(array_min(transform(
                    filter(sequence(0, size(all) - 1), i -> one.done[i] * whole < (t + 1L) * all[i].p),
                    i -> struct(cast(ceil(((one.done[i] + 1L) * whole) / all[i].p) as bigint) as due, i as i))).i),
                j -> named_struct('done', transform(one.done, (d, i) -> if(i = j, d + 1L, d)), 'picked', concat(one.picked, array(one.done[j] * 65536L + j))))[0])
    """.format(fold=FOLD)
    fold = f"""
        aggregate(sequence(0L, cast(ceil(length / {FOLD}D) as bigint) - 1L),
            named_struct('done', transform(all, x -> 0L), 'picked', cast(array() as array<array<bigint>>)),
            (acc, o) -> transform(array({step}), r -> named_struct('done', r.done, 'picked', concat(acc.picked, array(r.picked))))[0])
    """
    folded = listed.select("all", "length", F.expr(fold).alias("f"))
    rows = folded.select("all", "length", "f.done", F.posexplode(F.flatten("f.picked")).alias("slot", "code"))
    rows = rows.select(F.expr("all[cast(code % 65536 as int)]").alias("s"), F.expr("done[cast(code % 65536 as int)]").alias("quota"), "length", F.col("slot").cast("long").alias("slot"), F.expr("code div 65536").alias("k"))
    return rows.select("s.key", "s.n_rows", "k", "slot", "quota", "length")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = 16,
    power: float = 0.5,
    targets: dict[str, float] | None = None,
    seed: int = 0,
    slots: int = SLOTS,
) -> DataFrame:
    """``df`` with mix_slot and mix_pos: a block's place in the interleaved order, and a row's place in its block.

    Rows of a source are put in the order of a digest of id and seed and cut into blocks of ``block_rows``. No row is
    dropped: where a source has run out its slots stay empty, and the others keep their weights to each other.
    mix_exact says whether the slot lies before the first empty one, so that the stream up to it follows the target
    weights with less than one block's deviation, whatever its length. A null id is an id of its
    own; rows that repeat an id stay rows, in any order among themselves; a null source is a source; input columns of
    these names are replaced, others pass through; an empty table stays empty. Rows are moved once, to the tasks that
    number the rows of one range of one source; a source with a third of all rows has as many ranges as its rows ask
    for.
    """
    kept = [c for c in df.columns if c not in ("mix_slot", "mix_pos", "mix_exact")]
    ranges = max(LEAST_RANGES, -(-df.select(F.lit(1)).count() // RANGE_ROWS))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    part = F.floor(F.conv(F.substring(F.col("_mix_key"), 1, 8), 16, 10).cast("long") * ranges / float(1 << 32)).cast("long")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], _source_key(F.col(f"`{source_col}`")).alias("_mix_source"), digest.alias("_mix_key"))
    rows = rows.withColumn("_mix_range", part)

    counts = rows.groupBy(F.col("_mix_source").alias("key"), F.col("_mix_range").alias("range")).agg(F.count(F.lit(1)).alias("n"))
    plan = schedule(parts(counts, power, targets, slots), block_rows, slots)
    blocks = F.ceil(F.col("n_rows") / block_rows)
    empty = F.when(F.col("k") == blocks % F.col("quota"), F.floor(blocks / F.col("quota")) * F.col("length") + F.col("slot"))
    plan = plan.withColumn("empty", F.min(empty).over(Window.partitionBy(F.lit(1))))
    places = plan.select(F.col("key").alias("_mix_source"), F.col("k").alias("_mix_k"), F.col("slot").alias("_mix_in_cycle"), F.col("empty").alias("_mix_empty"), F.col("length").alias("_mix_length"))
    ahead = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_mix_ahead"))
    offsets = offsets.join(F.broadcast(plan.where("k = 0").select("key", F.col("quota").alias("_mix_quota"))), "key")
    offsets = offsets.withColumnsRenamed({"key": "_mix_source", "range": "_mix_range"})

    within = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_key", F.col(f"`{id_col}`"))
    placed = rows.withColumn("_mix_rank", F.row_number().over(within) - 1).join(offsets, ["_mix_source", "_mix_range"])
    placed = placed.withColumn("_mix_number", F.col("_mix_ahead") + F.col("_mix_rank"))
    placed = placed.withColumn("_mix_block", F.floor(F.col("_mix_number") / block_rows))
    placed = placed.withColumn("_mix_k", F.col("_mix_block") % F.col("_mix_quota"))
    placed = placed.join(F.broadcast(places), ["_mix_source", "_mix_k"])  # a row per slot, SLOTS at most
    slot = (F.floor(F.col("_mix_block") / F.col("_mix_quota")) * F.col("_mix_length") + F.col("_mix_in_cycle")).cast("long")
    return placed.select(
        *[F.col(f"`{c}`") for c in kept],
        slot.alias("mix_slot"),
        (F.col("_mix_number") % block_rows).cast("long").alias("mix_pos"),
        (slot < F.coalesce(F.col("_mix_empty"), F.lit(0))).alias("mix_exact"),
    )


def in_mix_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of mix() in files and rows of the mixed order: range-partitioned by slot and sorted within.

    Rows of one slot and place (of repeated ids none are) stay next to each other in any order; an empty table stays empty.
    """
    key = ["mix_slot", "mix_pos"]
    spread = mixed.repartitionByRange(partitions, *key) if partitions else mixed.repartitionByRange(*key)
    return spread.sortWithinPartitions(*key)
