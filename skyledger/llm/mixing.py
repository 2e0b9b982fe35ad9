"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The mix is a row of slots of equally many words. Slot t lies at the golden-ratio point frac(t * phi), and the source whose
interval of cumulative target shares holds the point fills the slot; so every stretch of the mix, not only the whole, is
near the target weights. The k-th slot of a source takes the k-th block of that source: its documents in a shuffled order,
laid end to end and cut into equal blocks, once over and then again up to ``epochs`` times.

Ranks and running totals of a source are found in buckets (of the shuffle's hash, of the slots' numbers): totals by bucket
first, then within a bucket. No task gets a source as a whole, however large its share is.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, packed, spread, unpacked, whole_text, written

#: A fixed value: sources in order of their names weigh these, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this many words for each word there is, and no more than CAP times the words of a source.
SHARE, CAP = 1.5, 2
#: Slots of the schedule at least; with more documents than that, one for each.
LEAST_SLOTS = 131_072
#: Rows of a bucket, about.
BUCKET = 1024
_LOW = 1 << 20


def _golden() -> tuple[float, float]:
    """frac(phi) and frac(2**20 * phi): slot numbers are split at 2**20, so that the point keeps its precision however large they get."""
    getcontext().prec = 60
    phi = (Decimal(5).sqrt() - 1) / 2
    return float(phi), float(phi * _LOW % 1)


def sizes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size (words) of every row."""
    words = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    return spread(df).select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"))


def _before(rows: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """rows with the sums of columns (name: column) over all rows before, in an order without ties.

    Rows are dealt by ranges of the order; what meets in one task are the totals of the ranges, one row for each.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), label)
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("range").alias("_range"), *[F.coalesce(F.sum(f"{n}_all").over(earlier), F.lit(0)).alias(f"{n}_base") for n in sums])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"{n}_in": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    joined = dealt.join(F.broadcast(totals), F.col("range") == F.col("_range"))  # as many rows as there are shuffle partitions, at most
    return joined.withColumns({n: F.col(f"{n}_base") + F.col(f"{n}_in") for n in sums}).select(*rows.columns, *sums)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: src (its place by name, null last), source, docs, source_size, target, lo and hi (its interval of shares).

    Targets share ``share`` times all words by weight, but stop at ``cap`` times the source's size; what is over goes to the
    others by weight until none is above. In closed form: target = min(cap * size, level * weight), the level being the
    first in order of cap * size / weight at which the sources from there on can take what those before leave. There may be
    any number of sources: only sums over all of them come to the driver.
    """
    one = F.lit(1).cast("long")
    found = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"), F.max(one).alias("one"))
    found = _before(found, [F.col("source").asc_nulls_last()], {"src": "one"}, "mix-by-name").drop("one")
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    found = found.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    found = _before(found, [F.col("ratio"), F.col("src")], {"most_before": "most", "weight_before": "weight"}, "mix-by-ratio")
    words, every = found.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    found = found.withColumn("level", (share * (words or 0.0) - F.col("most_before")) / ((every or 0.0) - F.col("weight_before")))
    first = found.filter("level <= ratio").agg(F.min(F.struct("ratio", "src", "level")).alias("first")).first()["first"]
    reached = F.col("most") if first is None else F.least("most", F.lit(first["level"]) * F.col("weight"))
    # shares are summed in whole 1024ths of a word, so that one interval ends exactly where the next begins
    found = found.withColumn("target", reached).withColumn("units", F.rint(F.col("target") * 1024).cast("long"))
    found = _before(found.select("src", "source", "docs", "source_size", "target", "units"), [F.col("src")], {"before": "units"}, "mix-by-place")
    total = found.agg(F.sum("units")).first()[0] or 0
    part = lambda x: x / F.lit(float(total)) if total else F.lit(0.0)
    return found.select("src", "source", "docs", "source_size", "target", part(F.col("before")).alias("lo"), part(F.col("before") + F.col("units")).alias("hi"))


def _running(rows: DataFrame, group: str, bucket: str, order: list[str | Column], value: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of value over the rows of the group that come before."""
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = rows.join(totals, (rows[group] == totals["_g"]) & (rows[bucket] == totals["_b"]))
    return joined.withColumn(name, F.col("_base") + F.col("_in")).drop("_g", "_b", "_base", "_in")


class Mix:
    """A mix of the rows of df. What it derives from the texts (doc_id, source, size) is written once to the shared folder.

    A null text has no words; null sources are a source, the last; ids may be null or repeat, rows that agree in everything
    are taken in either order. Sources without words have target 0. An empty table gives an empty mix.
    """

    def __init__(self, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int | None = None, seed: int = 17):
        self.spark, self.epochs, self.seed = df.sparkSession, cap, seed
        self.sized = written(sizes(df, id_col=id_col, text_col=text_col, source_col=source_col), "mix-sizes")
        self.sources = written(targets(self.sized, weights, share, cap), "mix-sources")
        n, docs, words = self.sources.agg(F.count(F.lit(1)), F.sum("docs"), F.sum("target")).first()
        self.n_sources, self.docs, self.words = n, docs or 0, words or 0.0
        self.block = block_words or max(1, math.ceil(self.words / max(LEAST_SLOTS, self.docs)))
        self.slots = math.ceil(self.words / self.block)

    def schedule(self) -> DataFrame:
        """One row per slot of the mix: slot, src, epoch, block (the source's block that fills it)."""
        one, low = _golden()
        t = F.col("slot")
        point = (F.floor(t / _LOW) * low) % 1 + (t % _LOW * one) % 1
        cells = max(1024, 4 * self.n_sources)
        slots = self.spark.range(self.slots).withColumnRenamed("id", "slot").withColumn("x", point % 1)
        slots = slots.withColumn("cell", F.floor(F.col("x") * cells))
        held = self.sources.filter("hi > lo").withColumn("hi", F.when(F.col("hi") >= 1 - 1e-12, F.lit(2.0)).otherwise(F.col("hi")))
        held = held.select("src", "lo", "hi", F.ceil(F.col("source_size") / self.block).alias("blocks"))
        held = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1.0)) * cells))))
        filled = slots.join(held, (slots["cell"] == held["cell"]) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
        filled = filled.select("slot", "src", "blocks", F.floor(t / BUCKET).alias("stretch"), F.lit(1).cast("long").alias("one"))
        ranked = _running(filled, "src", "stretch", ["slot"], "one", "rank")
        ranked = ranked.filter(F.col("rank") < F.col("blocks") * self.epochs)
        return ranked.select("slot", "src", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"))

    def documents(self) -> DataFrame:
        """doc_id, source, size, src, source_size, target, start: where the document's words begin in its source's shuffled order."""
        bits = max(1, math.ceil(math.log2(max(2, self.docs / BUCKET))))
        known = self.sources.select(F.col("source").alias("_source"), "src", "source_size", "target")
        rows = self.sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        rows = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(self.seed))).withColumn("stretch", F.shiftrightunsigned("draw", 64 - bits))
        return _running(rows, "src", "stretch", ["draw", "doc_id", "size"], "size", "start").drop("draw", "stretch")

    def taken(self) -> DataFrame:
        """One row per input row: doc_id, size, source_size, target, taken (words of it in the mix, repeats counted)."""
        b = self.block
        docs = self.documents()
        keys = ["doc_id", "size", "src", "source_size", "target", "start"]
        parts = docs.filter("size > 0").select(*keys, F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
        parts = parts.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b))
        times = self.schedule().groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
        got = parts.join(times, ["src", "block"], "left").groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        return got.select(*columns).unionByName(docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def mixed_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of df as often as the mix takes them, with all their columns: as many whole copies as the words taken come nearest to. Columns of df may have any names."""
    mix = Mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = mix.taken().groupBy("doc_id", "size").agg((F.sum("taken") / F.count(F.lit(1)) / F.greatest(F.col("size"), F.lit(1))).alias("_copies"))
    copies = copies.select(F.col("doc_id").alias("_id"), F.col("size").alias("_words"), F.floor(F.col("_copies") + 0.5).cast("int").alias("_copies")).filter("_copies > 0")
    words = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    rows = df.select(packed(df).alias("row"), F.col(id_col).alias("id"), words.alias("words"))
    rows = rows.join(copies, F.col("id").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_words")))
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), "_copies"))), df)
