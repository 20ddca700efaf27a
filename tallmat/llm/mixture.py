"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallmat.llm.common import saved, word_count
from tallmat.operators.ordering import number_rows

SEED = "mixture"
# A document is taken so many times at most, and a source so many times its size.
MOST = 3
WEIGHTS = (1, 2, 3)
# Longer documents are drawn less often: expected copies go with words to this power.
POWER = -0.25
# Different documents of one source that are ordered in one task, and the parts that a larger range of ranks is cut into.
BUCKET_ROWS, PARTS = 2_000, 64


def _uniform(id_column: Column, text: Column) -> Column:
    """A number in (0, 1) from the id and the text: reruns agree, and equal rows get equal numbers."""
    parts = [F.lit(SEED), F.coalesce(id_column.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    first = F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 13), 16, 10).cast("double")
    return (first + 0.5) / float(1 << 52)


def _measures(id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col)
    return [
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        _uniform(F.col(id_col), text).alias("uniform"),
    ]


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *_measures(id_col, text_col, source_col))


def source_targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, n_rows, source_size, target)`` from ``(source, size)``.

    Sources in code point order, null last, get the weights in turn. All words are shared by weight; what a
    source would get above ``most`` times its size is shared again among the others. One row per source, saved;
    the driver handles two sums a round.
    """
    sums = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    numbered = number_rows(sums, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = saved(numbered.select("source", "n_rows", "source_size", weight.cast("double").alias("weight")))
    ceiling = (F.col("source_size") * most).cast("double")
    totals = sources.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weight")).first()
    level = (totals["words"] or 0.0) / (totals["weight"] or 1.0)
    while True:
        above = F.col("weight") * level > ceiling
        left = sources.agg(
            F.sum(F.when(above, ceiling)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("open")
        ).first()
        if not left["open"] or left["capped"] is None:
            break
        after = (totals["words"] - left["capped"]) / left["open"]
        if after <= level:
            break
        level = after
    target = F.when(F.col("weight") * level > ceiling, ceiling).otherwise(F.col("weight") * level)
    return sources.select("source", "n_rows", "source_size", target.alias("target"))


def _expected(rate: Column, size: Column, most: int) -> Column:
    """Expected copies of a document; a null rate takes all there may be."""
    copies = F.least(F.lit(float(most)), rate * F.pow(size.cast("double") + 1.0, F.lit(POWER)))
    return F.coalesce(copies, F.lit(float(most)))


def _rates(measured: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Add ``rate`` per source, so that expected copies times sizes add up to its target."""
    weigh = F.pow(F.col("size").cast("double") + 1.0, F.lit(POWER))
    sizes = measured.withColumn("weigh", weigh)
    mass = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("weigh")).alias("mass"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    first = targets.join(mass, same(targets, mass)).select(targets["*"], F.try_divide("target", "mass").alias("rate"))
    now = saved(first.withColumn("moved", F.lit(True)))
    while now.where("moved").limit(1).count():
        joined = sizes.join(now, same(sizes, now)).select(now["source"], "size", "weigh", "rate")
        full = F.col("rate") * F.col("weigh") >= most
        part = joined.groupBy("source").agg(
            F.sum(F.when(full, F.col("size") * most).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("weigh"))).alias("open"),
        )
        after = F.when(F.col("open") > 0, F.try_divide(F.col("target") - F.col("full"), F.col("open")))
        moved = F.col("after").isNotNull() & (F.col("after") > F.col("rate") * (1 + 1e-12))
        now = saved(
            now.join(part, same(now, part))
            .select(now["*"], after.alias("after"))
            .select("source", "n_rows", "source_size", "target", F.when(moved, F.col("after")).otherwise(F.col("rate")).alias("rate"), moved.alias("moved"))
        )
    done = F.col("target") >= F.col("source_size") * most
    return now.select("source", "n_rows", "source_size", "target", F.when(~done, F.col("rate")).alias("rate"))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Add ``whole`` (certain copies) and ``rank``: random odds over inclusion odds, null where nothing is drawn."""
    expected = _expected(F.col("rate"), F.col("size"), most)
    share = F.col("expected") - F.col("whole")
    odds = F.try_divide(F.col("uniform"), 1 - F.col("uniform"))
    rank = F.when((share > 0) & (F.col("size") > 0), odds / F.try_divide(share, 1 - share))
    return (
        rows.withColumn("expected", expected)
        .withColumn("whole", F.floor("expected").cast("long"))
        .withColumn("rank", rank)
        .drop("expected")
    )


def _crossing(steps: DataFrame) -> DataFrame:
    """``(of, low, high, before)``: per source the range of ranks, ``low`` excluded, in which its words exceed what is missing.

    ``before`` are the words up to ``low``; ``high`` is null where all words fit. A round cuts the range into parts by
    quantiles of the ranks that lie in it and keeps the part that holds the crossing, so the bounds follow the data.
    One saved row per source; a range has ``BUCKET_ROWS`` rows at most, or ranks that are all equal.
    """
    bounds = steps.groupBy(F.col("source").alias("of")).agg(
        F.first("missing").alias("missing"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most")
    )
    fits = F.col("words") <= F.col("missing")
    now = saved(
        bounds.select(
            "of",
            "missing",
            F.lit(float("-inf")).alias("low"),
            F.when(~fits, F.col("most")).alias("high"),
            F.lit(0).cast("long").alias("before"),
            (~fits & (F.col("n") > BUCKET_ROWS) & (F.col("least") < F.col("most"))).alias("wide"),
        )
    )
    while now.where("wide").limit(1).count():
        kept = (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))
        wide = now.where("wide").select("of", "low", "high", "before")
        within = steps.join(wide, F.col("source").eqNullSafe(F.col("of"))).where(kept)
        quantiles = F.percentile_approx("rank", [i / PARTS for i in range(1, PARTS)], 100 * PARTS)
        grid = saved(within.groupBy(F.col("of").alias("in")).agg(quantiles.alias("grid")))
        placed = within.join(grid, F.col("of").eqNullSafe(F.col("in"))).withColumn(
            "part", F.size(F.filter("grid", lambda g: g < F.col("rank")))
        )
        parts = placed.groupBy("of", "part").agg(
            F.first("missing").alias("missing"),
            F.first("low").alias("low"),
            F.first("before").alias("before"),
            F.sum("size").alias("words"),
            F.count(F.lit(1)).alias("n"),
            F.min("rank").alias("least"),
            F.max("rank").alias("most"),
        )
        earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        run = parts.select(
            "of",
            "missing",
            F.coalesce(F.max("most").over(earlier), F.col("low")).alias("low"),
            F.col("most").alias("high"),
            (F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("before"),
            "words",
            ((F.col("n") > BUCKET_ROWS) & (F.col("least") < F.col("most"))).alias("wide"),
        )
        over = run.where(F.col("before") + F.col("words") > F.col("missing"))
        narrower = F.min(F.struct("low", "high", "before", "missing", "wide")).alias("at")
        found = over.groupBy("of").agg(narrower).select("of", "at.missing", "at.low", "at.high", "at.before", "at.wide")
        now = saved(now.where("NOT wide").unionByName(found))
    return now.select("of", "low", "high", "before")


def plan(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One saved row per source: ``source_size``, ``target``, ``rate``, ``cut`` and ``closing``.

    A document is taken ``floor`` of its expected copies for certain, and once more if its ``(rank, uniform)`` is
    at most ``cut``: documents enter by rank while the words they bring stay within the target. ``closing`` is the
    document outside that comes nearest to what is still missing, if it brings the sum nearer. The range of ranks that
    holds the cut is narrowed, all sources together, until so few documents are left in it that one task may order them.
    """
    rates = saved(_rates(measured, source_targets(measured, weights, most), most))
    base = rates.select("source", "n_rows", "target", "rate")
    rows = _ranked(measured.join(base, measured["source"].eqNullSafe(base["source"])).drop(measured["source"]), most)
    missing = saved(
        rows.groupBy(F.col("source").alias("of")).agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("missing"))
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    drawn = saved(
        rows.where("rank IS NOT NULL").select("source", "size", "uniform", "rank").join(missing, same).select("source", "size", "uniform", "rank", "missing")
    )
    # Copies, which share id and text, are one step.
    steps = drawn.groupBy("source", "rank", "uniform", "missing").agg(F.sum("size").alias("size"))
    edge = _crossing(saved(steps.select("source", "rank", "uniform", "missing", "size")))
    ranged = drawn.join(edge, same)
    below = ranged.where(F.col("high").isNull() | (F.col("rank") <= F.col("low")))
    filled = below.groupBy(F.col("source").alias("to")).agg(F.max(F.struct("rank", "uniform")).alias("filled"))
    inside = ranged.where((F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "uniform"))
    once = inside.groupBy("source", "rank", "uniform", "missing", "before").agg(F.sum("size").alias("size"))
    fitting = once.select("source", "rank", "uniform", (running + F.col("before")).alias("sum"), "missing")
    last = fitting.where(F.col("sum") <= F.col("missing")).groupBy("source").agg(F.max(F.struct("rank", "uniform")).alias("last"))
    marked = edge.select("of").join(filled, F.col("of").eqNullSafe(F.col("to")), "left")
    cuts = marked.join(last, same, "left").select("of", F.greatest("filled", "last").alias("cut"))
    within = F.struct("rank", "uniform") <= F.col("cut")
    cut_rows = drawn.join(saved(cuts), same).withColumn("in", F.coalesce(within, F.lit(False)))
    gaps = saved(
        cut_rows.groupBy(F.col("source").alias("to"), F.col("cut"))
        .agg((F.first("missing") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
    )
    outside = cut_rows.where("NOT in").drop("cut").join(gaps, F.col("source").eqNullSafe(F.col("to")))
    off = F.abs(F.col("size") - F.col("gap"))
    closing = (
        outside.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "uniform")).alias("closing"))
    ).withColumnRenamed("source", "at")
    named = gaps.join(closing, F.col("to").eqNullSafe(F.col("at")), "left").select(
        "to", "cut", F.when(F.col("closing").isNotNull(), F.struct("closing.rank", "closing.uniform")).alias("closing")
    )
    return saved(rates.join(named, F.col("source").eqNullSafe(F.col("to")), "left").drop("to", "n_rows"))


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Add ``copies`` to rows that carry their source's plan."""
    key = F.struct("rank", "uniform")
    once = F.coalesce(key <= F.col("cut"), F.lit(False)) | F.coalesce(key == F.col("closing"), F.lit(False))
    drawn = F.col("rank").isNotNull() & once
    return _ranked(rows, most).withColumn("copies", F.col("whole") + drawn.cast("long"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``: one row per document.

    ``size`` counts words; a null or empty text has 0 and is taken with its certain copies, which add
    nothing. A null source is a source of its own, the last. Rows that repeat both id and text are decided
    together, null ids too. An empty table gives no rows. Other columns are not read.
    """
    measured = saved(_measured(docs, id_col, text_col, source_col))
    sources = plan(measured, weights, most).withColumnRenamed("source", "of")
    rows = _copies(measured.join(sources, F.col("source").eqNullSafe(F.col("of"))), most)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixed documents with their columns, each repeated as often as the mix takes it.

    Only the small table of sources is joined, so texts are not shuffled.
    """
    measured = saved(_measured(docs, id_col, text_col, source_col))
    sources = plan(measured, weights, most)
    rows = docs.select(F.struct("*").alias("row"), *_measures(id_col, text_col, source_col))
    joined = rows.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    taken = _copies(joined, most).where("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
