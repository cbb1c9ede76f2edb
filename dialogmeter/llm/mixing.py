"""Operator 1: mix sources to target weights, with DataFrame functions only.

Every source gets a share of all words by its weight, but at most ``most`` times its own size; what
is above is shared again. A source is taken whole as often as it fits into its target; the rest is
filled by Efraimidis-Spirakis sampling: a document's key is an exponential variable divided by its
quality weight, and documents are taken in the order of their keys until the words are used up.
Documents are taken whole: the one at the end is taken if that brings the source nearer to its target.

Keys come from a digest of the id, so reruns agree whatever the partitions. Only the documents
around the end of a source's words are sorted: sums over key ranges tell where the end lies.

A null or empty text has size 0 and is taken 0 times. A null source is a source of its own, the
last one. Rows with the same id share a key and come in the order of their sizes; where the words end
among rows of one id and size, all of them are taken or none. Empty tables give empty results; other columns pass through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmeter.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Quality weights by `labels.quality`; rows without label have weight 1.
QUALITY = {1: 2.0, 0: 0.5}
#: Rows of a key range, roughly.
RANGE_ROWS = 5000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """-log(u) / weight with u in (0, 1) from a digest of the id."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return -F.log((digits.cast("double") + 0.5) / float(1 << 52)) / weight


def with_quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ``mix_weight`` by the row's quality label; several labels of an id count as the best one."""
    if labels is None:
        return docs.withColumn("mix_weight", F.lit(1.0))
    quality = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("mix_label_id")).agg(
        F.max("quality").alias("mix_quality")
    )
    weight = F.lit(1.0)
    for value, w in QUALITY.items():
        weight = F.when(F.col("mix_quality") == value, w).otherwise(weight)
    # Labels grow with the documents: one plan at every size.
    joined = docs.join(quality.hint("merge"), docs["doc_id"] == quality["mix_label_id"], "left")
    return joined.withColumn("mix_weight", weight).drop("mix_label_id", "mix_quality")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target from (source, source_size, n): one row per source, so one small window.

    With the sources in the order of their limit over weight, a source is at its limit exactly when
    the words left by those before it, shared by weight, exceed it.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * most
    before = W.orderBy(limit / F.col("w"), "place").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0)
    full = F.col("left_words") / F.col("left_weight") > limit / F.col("w")
    rate = F.col("open_words") / F.col("open_weight")
    return (
        sizes.withColumn("w", weight).withColumn("place", place)
        .withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), zero))
        .withColumn("left_weight", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero))
        .withColumn("full", full)
        .withColumn("open_words", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), limit)).over(whole), zero))
        .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
        .select("source", "source_size", "n", F.when(F.col("full"), limit.cast("double")).otherwise(rate * F.col("w")).alias("target"))
    )


def source_plan(rows: DataFrame) -> DataFrame:
    """One row per source of (source, size, key): target, whole epochs, and where sampling ends.

    Documents that come before (``end_key``, ``end_size``) are taken once more; those at it if ``end_taken``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sizes)
    # Targets are met to the word below; a hair is added so that rounding does not lose one.
    words = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    plan = (
        plan.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.floor(F.col("n") / RANGE_ROWS) + 1)
    )
    plan = stored(plan.coalesce(1), "mix-sources")
    p = plan.select(F.col("source").alias("p_source"), "rest", "ranges").where("rest > 0")
    ranged = rows.join(p, rows["source"].eqNullSafe(p["p_source"])).withColumn(
        "range", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")), F.col("ranges") - 1)
    )
    sums = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
    along = W.partitionBy("source").orderBy("range")
    up_to = F.sum("words").over(along)
    last = sums.withColumn("up_to", up_to).where("up_to >= rest and up_to - words < rest").select(
        F.col("source").alias("e_source"), F.col("range").alias("e_range"), (F.col("rest") - F.col("up_to") + F.col("words")).alias("still")
    )
    # The few thousand rows of the range in which each source ends.
    inside = ranged.join(last, ranged["source"].eqNullSafe(last["e_source"]) & (ranged["range"] == last["e_range"]))
    groups = inside.groupBy("source", "key", "size", "still").agg(F.sum("size").alias("words"))
    along = W.partitionBy("source").orderBy("key", "size")
    # Nearer with the group than without it; at the same distance it is left.
    nearer = F.col("up_to") - F.col("still") < F.col("still") - (F.col("up_to") - F.col("words"))
    ends = groups.withColumn("up_to", F.sum("words").over(along)).where("up_to >= still and up_to - words < still").select(
        F.col("source").alias("e_source"), F.col("key").alias("end_key"), F.col("size").alias("end_size"), nearer.alias("end_taken"))
    return stored(
        plan.join(ends, plan["source"].eqNullSafe(ends["e_source"]), "left").select(
            F.col("source").alias("plan_source"), "source_size", "target", "epochs", "end_key", "end_size", "end_taken"
        ).coalesce(1),
        "mix-plan",
    )


def times_taken() -> Column:
    """How often the mix takes a row joined to its source's plan."""
    here = (F.col("key") == F.col("end_key")) & (F.col("size") == F.col("end_size"))
    before = (F.col("key") < F.col("end_key")) | ((F.col("key") == F.col("end_key")) & (F.col("size") < F.col("end_size")))
    more = F.when(F.col("end_key").isNotNull() & (before | (here & F.col("end_taken"))), 1).otherwise(0)
    return (F.col("epochs") + more).cast("int")


def measured(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, source, size, key of every row."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return with_quality(sized, labels).select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("mix_weight")).alias("key"))


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    rows = stored(measured(docs, labels), "mix-rows")
    plan = source_plan(rows)
    return rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).select(
        "doc_id", "source", "size", "source_size", F.col("target"), (F.col("size") * times_taken()).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row for each time a document is taken, its text whole.

    A document of size 0 is not taken.
    """
    plan = source_plan(stored(measured(docs, labels).select("source", "size", "key"), "mix-rows"))
    sized = docs.select(F.struct("*").alias("x_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = with_quality(sized, labels).withColumn("key", sampling_key(F.col("doc_id"), F.col("mix_weight")))
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["plan_source"])).withColumn("times", times_taken())
    return joined.where("size > 0 and times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("x_row.*")


SQL = f"""
with quality as (select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id),
rows_ as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / case q.quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as key
  from documents d left join quality q on d.doc_id = q.doc_id),
sizes as (select source, sum(size)::bigint as s from rows_ group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as place from sizes),
weighed as (select *, [5.0, 2.0, 1.0][(place % 3 + 1)::int]::double as w, sum(s) over () as total from ranked),
steps as (
  select *,
    (total - coalesce(sum({MOST} * s) over before, 0))::double
      / (sum(w) over () - coalesce(sum(w) over before, 0)) > {MOST} * s / w as is_full
  from weighed
  window before as (order by {MOST} * s / w, place rows between unbounded preceding and 1 preceding)),
aims as (
  select source, s, case when is_full then ({MOST} * s)::double else
    (total - coalesce(sum({MOST} * s) filter (is_full) over (), 0))::double / (sum(w) filter (not is_full) over ()) * w end as target
  from steps),
plan as (
  select *, case when s > 0 then floor(target + 1e-6)::bigint // s else 0 end as epochs, floor(target + 1e-6)::bigint as words
  from aims),
along as (
  select r.*, p.s, p.target, p.epochs, p.words - p.epochs * p.s as rest,
    sum(r.size) over (partition by r.source order by r.key, r.size range between unbounded preceding and current row) as up_to,
    sum(r.size) over (partition by r.source, r.key, r.size) as here
  from rows_ r join plan p on r.source is not distinct from p.source)
select doc_id, source, size, s as source_size, round(target, 6) as target,
  (size * (epochs + case when up_to <= rest then 1 when up_to - here < rest and up_to - rest < rest - (up_to - here) then 1 else 0 end))::bigint as taken
from along
"""
