"""Mixing sources to target weights by thresholds on a hash, found in histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_prefix, written

#: Bits of the 32-bit hash that each round of histograms resolves.
ROUNDS = (12, 10, 10)
SALT = 16


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def id_hash(col: Column, text: Column) -> Column:
    """The first 32 bits of the MD5 of the value as text, or for a null of the document's text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), text, F.lit(""))), 1, 8), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, in order of code points, null last; no task sees more than a range of the sources."""
    nulls = F.col("source").isNull()
    ranged = written(sources.repartitionByRange(nulls, F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before, start = 0, []
    for row in ranged.groupBy("part").count().orderBy("part").collect():
        start.append((row["part"], before))
        before += row["count"]
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in start for x in pair]) if start else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(nulls, "source"))
    return ranged.withColumn("place", (F.element_at(offsets, F.col("part").cast("long")) + within - 1).cast("long")).drop("part")


def targets(sources: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    The total, ``share`` times all sizes, is shared by weight; a source stops at
    ``cap`` times its size and the excess is shared by weight among the others,
    again and again, until none is above.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(_ranked(sources).withColumn("weight", cycle.cast("long")), "weighted")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, fixed, free = 0.0, 0, 1
    capped = F.lit(False)
    while True:
        fixed, free = rows.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if not free:
            return rows.withColumn("target", cap * F.col("source_size"))
        rest = total - cap * fixed
        if rest / free <= level:
            break
        level = rest / free
        capped = cap * F.col("source_size") <= F.col("weight") * F.lit(level)
    fits = F.col("weight") * F.lit(float(rest)) / F.lit(float(free))
    return rows.withColumn("target", F.when(capped, cap * F.col("source_size")).otherwise(fits).cast("double"))


def _thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the hash ``bound`` below which documents are taken, and whether those at it are (``also``).

    ``goals`` has key and goal (words to take).  Documents are taken in order of
    their hash while their words fit; those at the bound if that comes nearer
    to the goal.  Each round sums words by source and bucket, keeps whole
    buckets below the goal, and looks closer at the one bucket that crosses it.
    """
    done, rows = None, sized
    left = goals.select("key", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("have"), "goal")
    shift = 32
    for bits in ROUNDS:
        shift -= bits
        bucket = F.shiftright("hash", shift)
        hist = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        crossed = (
            hist.join(left, "key").withColumn("upto", F.col("have") + upto).where("upto > goal")
            .groupBy("key").agg(F.min(F.struct("bucket", F.col("upto").alias("upto"), "words", "goal")).alias("at"))
            .select("key", F.col("at.bucket").alias("low"), (F.col("at.upto") - F.col("at.words")).alias("have"), F.col("at.goal").alias("goal"), F.col("at.words").alias("words"))
        )
        left = done = written(crossed, "crossed")
        if shift:
            left = left.drop("words")
            here = left.select("key", F.col("low").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
            salted = rows.withColumn("salt", (F.col("hash") % SALT).cast("int")).withColumn("bucket", bucket)
            rows = salted.join(here, ["key", "bucket", "salt"], "left_semi").drop("salt", "bucket")
    return done.select("key", F.col("low").alias("bound"), (2 * F.col("have") + F.col("words") <= 2 * F.col("goal")).alias("also"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """How often the mix takes each document: 0 times to ``cap`` times (a whole number).

    Sources in order of code points, null last, have ``weights`` in turn;
    :func:`targets` says what each gives.  Every document of a source is taken
    as often as its whole size fits into the target, and once more if its hash
    is below the bound of the rest.  The hash is of the id, so reruns agree;
    rows of one id are taken together, as are equal texts without an id.  Null
    texts have size 0; a source of size 0 has target 0; an empty table gives no rows.  Other
    columns are ignored.  Returns doc_id, size, source_size, target, taken.

    The text is read once; what is kept of it is one narrow row per document.
    Only histograms are shuffled, pre-aggregated; joins to per-source rows are
    salted, so that a hot source is spread over many tasks.
    """
    sized = _sized(df, id_col, text, source)
    out = _with_plan(sized, _plan(sized, weights, share, cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``df`` as :func:`mix_sources` takes them, each as often as it says, with all their columns, whatever their names.

    Texts without words, null ones too, are taken as their hash says; an empty table gives no rows.
    """
    own = free_prefix(df)
    plan = _plan(_sized(df, id_col, text, source), weights, share, cap)
    rows = df.withColumn(f"{own}key", _key(F.col(f"`{source}`").cast("string"))).withColumn(f"{own}hash", id_hash(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")))
    taken = _with_plan(rows, plan, f"{own}key", f"{own}hash", own)
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{own}copies").cast("int")))
    return taken.where(f"{own}copies > 0").withColumn(f"{own}copy", copies).select(*[F.col(f"`{c}`") for c in df.columns])


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _sized(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    sized = df.select(id_hash(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")).alias("hash"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size"))
    return written(sized.withColumn("key", _key(F.col("source"))), "sizes")


def _plan(sized: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Per source how often each of its documents is taken (``times``) and the bound below which once more, in SALT rows."""
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("times", times).withColumn("key", _key(F.col("source"))).withColumn("goal", F.col("target") - F.col("times") * F.col("source_size"))
    per = written(per, "targets")
    bounds = _thresholds(sized.select("key", "hash", "size"), per.select("key", "goal"))
    return written(per.join(bounds, "key", "left").select("key", "source_size", "target", "times", "bound", "also"), "plan")


def _with_plan(rows: DataFrame, plan: DataFrame, key: str = "key", hashed: str = "hash", own: str = "") -> DataFrame:
    """Adds source_size, target and copies, after ``own``, to rows; the join is salted."""
    k, t, b, a, s = (f"{own}_{x}" for x in ("key", "times", "bound", "also", "salt"))
    plan = plan.select(F.col("key").alias(k), F.col("source_size").alias(f"{own}source_size"), F.col("target").alias(f"{own}target"), F.col("times").alias(t), F.col("bound").alias(b), F.col("also").alias(a), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(s))
    more = F.when(F.col(b).isNull(), 0).when((F.col(hashed) < F.col(b)) | ((F.col(hashed) == F.col(b)) & F.col(a)), 1).otherwise(0)
    out = rows.join(plan, (F.col(key) == F.col(k)) & ((F.col(hashed) % SALT).cast("int") == F.col(s)))
    return out.withColumn(f"{own}copies", F.col(t) + more)
