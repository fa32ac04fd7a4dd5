"""Sequence plane: runs, neighbours, tails, votes, medians over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import geometry as g
from lamella.functions import text as t


def after_cuts(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """is_cut, and whether a row is the neighbour of a cut one, or in the tail behind the first cut; cut rows are neither."""
    w = Window.partitionBy(*by).orderBy(order)
    cut = rows.withColumn("is_cut", t.is_cut(F.col(text)))
    seen = F.max("is_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("neighbour", F.coalesce(F.lag("is_cut").over(w), F.lit(False)) & ~F.col("is_cut")).withColumn("tail", seen & ~F.col("is_cut"))


def cascade_vote(rows: DataFrame, by: list[str], order: str, source: str, translated: str) -> DataFrame:
    """Share of translated rows behind the first cut whose length fits the source before better than their own; 0 for under two rows."""
    w = Window.partitionBy(*by).orderBy(order)
    err = lambda s: F.abs(F.ln((F.length(translated) + 1) / (F.length(s) + 1)))
    first_cut = F.max(t.is_cut(F.col(translated))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    scored = rows.withColumn("__behind", F.coalesce(first_cut, F.lit(False))).withColumn("__prev", F.lag(source).over(w))
    counts = scored.where(F.col("__behind") & ~t.is_blank(F.col(translated)) & F.col("__prev").isNotNull())
    voted = counts.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(err(F.col("__prev")) < err(F.col(source))).alias("wins"))
    return voted.withColumn("vote", F.when(F.col("total") < 2, 0.0).otherwise(F.col("wins") / F.col("total")))


def runs(rows: DataFrame, by: list[str], order: str, continues: Column, name: str = "run") -> DataFrame:
    """Gaps and islands: a new run number wherever ``continues`` is not true."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = rows.withColumn("__new", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1))
    return starts.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def page_shape(images: DataFrame, least: int = 3, tolerance: float = 2) -> DataFrame:
    """strip or paged by the longest run of flush images of one width (host, ordinal, natural_width, box)."""
    w = Window.partitionBy("host").orderBy("ordinal")
    flush = (F.lag("natural_width").over(w) == F.col("natural_width")) & (F.abs(F.lag(g.bottom(F.col("box"))).over(w) - F.col("box")["y"]) <= tolerance)
    lengths = runs(images, ["host"], "ordinal", flush).groupBy("host", "run").agg(F.count("*").alias("n"))
    return lengths.groupBy("host").agg(F.max("n").alias("longest"), F.when(F.max("n") >= least, "strip").otherwise("paged").alias("shape"))


def run_length(slices: DataFrame, most: int = 6) -> DataFrame:
    """Slices joined from each slice on (run, idx, spans): two, plus one for each spanning slice between, capped; 0 if the run goes on past the end."""
    w = Window.partitionBy("run").orderBy("idx")
    ahead = Window.partitionBy("run").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    stop = F.min(F.when(~F.col("spans"), F.col("idx"))).over(ahead)
    last = F.max("idx").over(Window.partitionBy("run"))
    length = F.when(stop.isNotNull(), F.least(F.lit(most), stop - F.col("idx") + 1))
    full = F.when(stop.isNull() & (F.lit(most) + F.col("idx") - 1 <= last), F.lit(most)).otherwise(length)
    has_next = F.lead("idx").over(w).isNotNull()
    return slices.withColumn("length", F.when(has_next, F.coalesce(full, F.lit(0))).otherwise(0))


def run_edges(index: Column, length: Column) -> Column:
    """Edges of a slice that matter within a joined run."""
    return F.when(index == 0, F.array(F.lit("bottom"))).when(index == length - 1, F.array(F.lit("top"))).otherwise(F.array(F.lit("top"), F.lit("bottom")))


def composite_offsets(slices: DataFrame) -> DataFrame:
    """Upper edge of each slice in the composite of its run."""
    w = Window.partitionBy("run").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("offset", F.coalesce(F.sum("height").over(w), F.lit(0)))


def into_image(y: Column, crop_y: Column, offset: Column) -> Column:
    return y - crop_y + offset


def weighted_lower_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Least value at which the running weight reaches half of the total; groups without weight take the upper middle value."""
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    r = rows.withColumn("__cum", F.sum(weight).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("__total", F.sum(weight).over(whole))
    r = r.withColumn("__at", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(whole))
    hit = F.when(F.col("__total") > 0, 2 * F.col("__cum") >= F.col("__total")).otherwise(F.col("__at") == F.floor(F.col("__n") / 2))
    return r.where(hit).groupBy(*by).agg(F.min(value).alias("median"))


def middle_median(values: Column) -> Column:
    """Integer median of an array: the middle, or the floor of the mean of the two middles."""
    s, n = F.array_sort(values), F.size(values)
    odd = F.element_at(s, F.floor(n / 2).cast("int") + 1)
    even = F.floor((F.element_at(s, F.floor(n / 2).cast("int")) + odd) / 2)
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, odd).otherwise(even)


def upper_median(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1))


def median_colour(pixels: DataFrame, by: str) -> DataFrame:
    """Channel-wise median of pixels (r, g, b)."""
    return pixels.groupBy(by).agg(*[middle_median(F.collect_list(c)).alias(c) for c in ("r", "g", "b")])


def uniform_colour(pixels: DataFrame, by: str, tolerance: int = 12, share: float = 0.9, least: int = 64) -> DataFrame:
    """Median colour of a region where enough of its pixels lie within a tolerance of it, else null."""
    m = median_colour(pixels, by).select(by, *[F.col(c).alias(f"m{c}") for c in ("r", "g", "b")])
    near = F.greatest(*[F.abs(F.col(c) - F.col(f"m{c}")) for c in ("r", "g", "b")]) <= tolerance
    agg = pixels.join(m, by).groupBy(by, "mr", "mg", "mb").agg(F.count("*").alias("n"), F.count_if(near).alias("near"))
    ok = (F.col("n") >= least) & (F.col("near") >= share * F.col("n"))
    return agg.select(by, F.when(ok, F.array("mr", "mg", "mb")).alias("colour"))


def text_colour(pixels: DataFrame, by: str) -> DataFrame:
    """Median of the quarter of foreground pixels farthest from the background's median colour."""
    back = median_colour(pixels.where("NOT foreground"), by).select(by, *[F.col(c).alias(f"m{c}") for c in ("r", "g", "b")])
    far = sum((F.pow(F.col(c) - F.col(f"m{c}"), F.lit(2)) for c in ("r", "g", "b")), F.lit(0.0))
    fore = pixels.where("foreground").join(back, by).withColumn("__d", far)
    w = Window.partitionBy(by)
    ranked = fore.withColumn("__rn", F.row_number().over(w.orderBy(F.desc("__d"), "r", "g", "b"))).withColumn("__n", F.count("*").over(w))
    return median_colour(ranked.where(F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 4))), by)


def running_peaks(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Running maxima of measured sizes."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"peak_{c}": F.max(c).over(w) for c in columns})


def close_gaps(rows: DataFrame, by: str, order: str, value: str, most: int) -> DataFrame:
    """Runs of zeros of at most ``most`` between non-zeros become filled."""
    w = Window.partitionBy(by).orderBy(order)
    r = runs(rows, [by], order, (F.col(value) == 0) == (F.lag(value).over(w) == 0))
    whole = Window.partitionBy(by, "run")
    ends = Window.partitionBy(by)
    inner = (F.min(order).over(whole) > F.min(order).over(ends)) & (F.max(order).over(whole) < F.max(order).over(ends))
    return r.withColumn("closed", (F.col(value) != 0) | (inner & (F.count("*").over(whole) <= most))).drop("run")


def prevailing_sizes(texts: DataFrame, ratio: float = 1.25) -> DataFrame:
    """Texts (page, ord, size, chars) with sizes capped by the page's prevailing size; interjections are left out of it."""
    plain = texts.where(~F.col("interjection"))
    base = weighted_lower_median(plain, ["page"], "size", "chars").withColumnRenamed("median", "base")
    least = plain.groupBy("page").agg(F.min("size").alias("least"))
    out = texts.join(base, "page", "left").join(least, "page", "left")
    ceiling = g.size_ceiling(F.col("least"), F.col("base"), F.lit(ratio))
    return out.withColumn("capped", F.when(F.col("base").isNull(), F.col("size")).otherwise(F.least(F.col("size"), ceiling))).drop("base", "least")


def lookahead(rows: DataFrame, by: str, order: str, reached: str, ahead: int = 2) -> DataFrame:
    """Items admitted: up to the high-water mark of what was reached, plus ``ahead``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mark", F.max(reached).over(w)).withColumn("admit_through", F.col("mark") + ahead)


def emitted_lines(rows: DataFrame, quiet: int = 30, least: int = 5, step: int = 10) -> DataFrame:
    """Progress rows (task, seq, at, percent or null, last) that are put out: the first, the last, after ``quiet`` seconds,
    or after ``least`` seconds with an unknown size or ``step`` more points than the row put out before."""
    item = F.struct("seq", "at", "percent", "last")
    lists = rows.groupBy("task").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("percent"), F.slice(F.transform("items", lambda i: i["seq"]), 1, 0).alias("out"))

    def step_(s, i):
        gone = i["at"] - s["at"]
        grown = i["percent"].isNull() | s["percent"].isNull() | (i["percent"] >= s["percent"] + step)
        emit = s["at"].isNull() | i["last"] | (gone >= quiet) | ((gone >= least) & grown)
        return F.when(emit, F.struct(i["at"].cast("long").alias("at"), i["percent"].cast("double").alias("percent"), F.array_append(s["out"], i["seq"]).alias("out"))).otherwise(s)

    return lists.select("task", F.explode(F.aggregate("items", none, step_)["out"]).alias("seq"))
