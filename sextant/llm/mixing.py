"""Mixing sources to target weights: blocks of words, drawn by source and shard, joined by index.

Every source's documents lie end to end, in an order of hashes, and are cut into blocks of `block` words; the last
may be shorter. A source's target says how many of its blocks the mix takes. The output is a row of slots, `shard` to a
shard. Each shard draws its sources' counts from the multinomial of their shares. Draws miss the targets by the square
root of what they take, so then the totals are settled: of sources drawn too often, slots chosen by a pseudorandom
permutation pass to sources drawn too seldom, and each source comes out at its target exactly.

A source's slots are numbered through the shards; the n-th reads the block that a pseudorandom permutation of the
source's indices gives for n, another permutation for each time through, and the blocks are joined by that index.

All of it is DataFrame and SQL functions. Running sums are taken in levels, so no task orders more than a few thousand
rows of a source, however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pieces

#: Rows that one task sums up at a level, and the fan-out of the levels above.
LEVEL_ROWS, FAN = 500, 1024
#: Most steps of a walk that seeks its way back into the range. The grid that is permuted has at most 2 * sqrt(n) + 1
#: cells too many; a walk that long has a chance of (2 / sqrt(n)) ** 64 for n over 1000 and doesn't exist below.
WALK = 64


def permuted(x: str, n: str, seed: str) -> Column:
    """A keyed permutation of 0..n-1, at x: a balanced Feistel network on a square grid, walked until inside."""
    side = f"cast(ceil(sqrt({n})) as bigint)"
    turn = (
        "aggregate(array(1, 2, 3, 4), named_struct('l', {v} div {s}, 'r', {v} % {s}), "
        "(a, i) -> named_struct('l', a.r, 'r', (a.l + pmod(xxhash64({k}, i, a.r), {s})) % {s}), a -> a.l * {s} + a.r)"
    )
    first = turn.format(v=f"({x})", s=side, k=seed)
    again = turn.format(v="v", s=side, k=seed)
    return F.expr(f"aggregate(sequence(2, {WALK}), {first}, (v, step) -> if(v < {n}, v, {again}))")


def running(df: DataFrame, values: dict[str, str], within: list[str], part: str, parts: int, order: list[Column]) -> DataFrame:
    """Sums of values (by name) over the rows before, in order of part (0 to parts - 1) and then of order: inside parts, and
    over the parts in levels of FAN until few are left."""
    sums = df.groupBy(*within, part).agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in values.items()))
    base = {f"_base_{n}": f"_sum_{n}" for n in values}
    if parts > 4 * FAN:
        sums = running(sums.withColumn(f"_{part}", F.expr(f"{part} div {FAN}")), base, within, f"_{part}", parts // FAN + 1, [F.col(part)])
    else:
        over = (Window.partitionBy(*within).orderBy(part) if within else Window.orderBy(part)).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("*", *(F.coalesce(F.sum(v).over(over), F.lit(0)).alias(n) for n, v in base.items()))
    inner = Window.partitionBy(*within, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_own_{n}") for n, v in values.items()))
    out = out.join(sums.select(*within, part, *base), [*within, part])
    return out.select(*df.columns, *((F.col(f"_base_{n}") + F.col(f"_own_{n}")).alias(n) for n in values))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sid, source, source_size, target for rows of (source, size): sid ranks the sources by code point, null last.

    The share of all sizes goes by weight, which repeats along the ranks; a source stops at `most` times its size and
    the excess is shared again by weight until none is above.
    """
    by = [F.col("source").isNull(), F.col("source")]
    n = pieces(sizes.sparkSession)
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = cut(s.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1)))
    s = running(s, {"sid": "one"}, [], "part", n, by)
    pick = F.expr(f"element_at(array({', '.join(f'{float(w)}D' for w in weights)}), cast(sid % {len(weights)} as int) + 1)")
    s = cut(s.select(F.col("sid").cast("long"), "source", "source_size", "part", pick.alias("weight")))
    total = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, cap = 0.0, F.col("source_size") * float(most)
    while True:  # a level at which no more sources are full: the level only rises, and with it their number
        full = F.col("weight") * level > cap
        a = s.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not a["open"]:
            break
        new = (total - a["full"]) / a["open"]
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("weight") * level, cap))


def _covered(points: DataFrame, spans: DataFrame, total: int, cells: int) -> DataFrame:
    """points (at, ...) with the sid of the span (sid, low, n) that holds at; spans don't overlap and lie in 0..total - 1.

    Both are dealt to equal cells of the line, and joined by cell."""
    width = max(1, -(-total // cells))
    s = spans.filter("n > 0").selectExpr("sid", "low", "low + n AS high", f"explode(sequence(low div {width}, (low + n - 1) div {width})) AS cell")
    p = points.withColumn("cell", F.expr(f"at div {width}"))
    return p.join(s, "cell").filter("low <= at AND at < high").drop("cell", "low", "high", "at")


def drawn_slots(s: DataFrame, slots: int, sources: int, shard: int) -> DataFrame:
    """shard, sid, number, blocks of each slot, for sources s (sid, part, taken, first, blocks), the running sum of taken being
    first: multinomial counts of each shard, settled to the sources' totals. A source's numbers are 0 to taken - 1."""
    n, cells = pieces(s.sparkSession), sources + 4096
    # a slot's source is drawn as one of all tickets, of which a source has as many as it is to be taken
    points = s.sparkSession.range(0, slots, 1, n).selectExpr(f"id div {shard} AS shard", f"pmod(xxhash64('draw', id), {max(1, slots)}L) AS at")
    drawn = cut(_covered(points, s.selectExpr("sid", "first AS low", "taken AS n"), slots, cells).groupBy("sid", "shard").agg(F.count("*").alias("slots")))
    totals = s.select("sid", "part", "taken", "blocks").join(drawn.groupBy("sid").agg(F.sum("slots").alias("drawn")), "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    totals = totals.selectExpr("*", "greatest(drawn - taken, 0L) AS over", "greatest(taken - drawn, 0L) AS under")
    line = cut(running(totals, {"over_low": "over", "under_low": "under"}, [], "part", n, [F.col("sid")]))
    moved = int(line.agg(F.sum("over")).first()[0] or 0)
    # numbers go through the shards in an order of hashes, so the last ones, which pass to other sources, are of any shards
    parts = max(1, slots // shard // LEVEL_ROWS + 1)
    before = running(drawn.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts))), {"before": "slots"}, ["sid"], "part", parts, [F.xxhash64("shard"), F.col("shard")])
    known = before.drop("part").repartition(n, "sid", "shard").join(line.select("sid", "taken", "blocks", "over_low"), "sid")
    number = known.withColumn("number", F.expr("explode(sequence(before, before + slots - 1))"))
    given = number.filter("number >= taken").select("shard", (F.col("over_low") + F.col("number") - F.col("taken")).alias("at"))
    passed = _covered(given.withColumn("unit", F.col("at")), line.selectExpr("sid", "under_low AS low", "under AS n"), moved, cells)
    passed = passed.join(line.select("sid", "drawn", "blocks", "under_low"), "sid").select("shard", "sid", (F.col("drawn") + F.col("unit") - F.col("under_low")).alias("number"), "blocks")
    return number.filter("number < taken").select("shard", "sid", "number", "blocks").unionByName(passed)


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = 64, shard: int = 1024, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source): placed documents, and the slots.

    placed: doc_id, size, sid, source_size, target, start (words of its source before it) and the columns named in keep,
    by which rows of equal doc_id and size are placed in turn. slots: shard, sid, block, the block's index in its source.

    Sizes are words; null and empty texts have none and are in no block. A null source is a source. Rows are documents
    each, whatever their doc_id; an empty table gives empty results.
    """
    sizes = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep))
    # rows alike in all of these change places freely: they are placed as one
    distinct = cut(sizes.groupBy("source", "doc_id", "size", *keep).agg(F.count("*").alias("copies")))
    rows = distinct.count()
    s = targets(sizes, list(weights), share, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    full = F.floor(F.col("target") / F.col("source_size")).cast("long")
    rest = F.round((F.col("target") - full * F.col("source_size")) * blocks / F.col("source_size")).cast("long")
    s = s.withColumn("blocks", blocks).withColumn("taken", F.when(F.col("source_size") > 0, F.least(full * blocks + rest, F.floor(blocks * float(most)).cast("long"))).otherwise(F.lit(0).cast("long")))
    s = cut(running(s, {"first": "taken"}, [], "part", pieces(docs.sparkSession), [F.col("sid")]))
    slots, sources = (int(x or 0) for x in s.agg(F.sum("taken"), F.count("*")).first())

    keyed = distinct.join(s.select("sid", F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    parts = rows // LEVEL_ROWS + 1
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", *keep), F.lit(parts))).withColumn("all", F.col("size") * F.col("copies"))
    placed = running(keyed, {"begin": "all"}, ["sid"], "bucket", parts, [F.col("doc_id"), F.col("size"), *map(F.col, keep)])
    placed = placed.withColumn("start", F.expr("explode(transform(sequence(0L, copies - 1), i -> begin + i * size))")).drop("bucket", "all", "copies", "begin")

    index = permuted("number % blocks", "blocks", "sid, number div blocks")
    return placed, drawn_slots(s, slots, sources, shard).select("shard", "sid", index.alias("block"))


def _cover(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in."""
    return placed.filter("size > 0").withColumn("block", F.expr(f"explode(sequence(start div {block}, (start + size - 1) div {block}))"))


def mixed_words(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = 64, shard: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs: the words that the mix of mixed_blocks takes.

    Null and empty texts take no words; null sources are one source, null doc_ids are documents like others, and rows alike
    in doc_id, size and source are each counted, in no order among each other. A text of any length is counted whole. An
    empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    placed, slots = mixed_blocks(docs, weights, share, most, block, shard)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    part = _cover(placed, block).withColumn("words", F.expr(f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block})"))
    key = ["sid", "start", "doc_id", "size", "source_size", "target"]
    got = part.join(times, ["sid", "block"], "left").groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = got.unionByName(placed.filter("size = 0").select(*key).withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_spans(docs: DataFrame, key: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = 64, shard: int = 1024) -> DataFrame:
    """key, size, spans for the rows of docs that the mix of mixed_blocks takes words of; key tells rows apart.

    spans: (first, stop) in words of the row. The words that lie in drawn blocks come as often as these are drawn; of the
    blocks drawn n times or more, those that adjoin in a row of docs are one span for each n.
    """
    placed, slots = mixed_blocks(docs, weights, share, most, block, shard, (key,))
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    part = _cover(placed, block).join(times, ["sid", "block"]).selectExpr(
        key, "size", f"greatest(start, block * {block}) - start AS first", f"least(start + size, (block + 1) * {block}) - start AS stop", "explode(sequence(1L, times)) AS nth"
    )
    before = F.sum(F.col("stop") - F.col("first")).over(Window.partitionBy(key, "nth").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    runs = part.withColumn("run", F.col("first") - F.coalesce(before, F.lit(0))).groupBy(key, "size", "nth", "run").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    return runs.groupBy(key, "size").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
