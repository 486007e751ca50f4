"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key -ln(u) / w, u from a hash of its id and w its quality weight; sorted by key
within its source, documents are taken until the prefix sum of their sizes reaches what the source's target leaves
after complete epochs. The prefix sum is never taken over a whole source: keys fall into 1024 buckets whose sums are
added up first; the bucket in which a source's budget ends is cut the same way until it is small, and only its rows are
sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 1 << 10
#: Rows of the bucket in which a budget ends, at most, unless they share one key.
EDGE_ROWS = 1000
SEED = "mix-1"
#: Characters that prose seldom has; the quality weight of a text falls with their share.
NOISE = r"[^#*$%&|<>{}\[\]\\^~=+_@!]+"


def quality_weight(text):
    """Between 0.05 and 1: one less five times the share of noise characters; 1 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * F.length(F.regexp_replace(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, target; one row per source, null last by rank.

    The words shared out are share * all sizes. A target stops at cap * source_size; the excess goes to the others by
    weight until none is above. That is one water level: with sources ordered by cap * size / weight, the first whose
    share of what the earlier ones leave is no more than its cap gives the level.
    """
    everything = Window.partitionBy()
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "rank")
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights)).cast("double"))
    s = s.withColumn("most", F.col("source_size").cast("double") * cap).withColumn("room", F.col("most") / F.col("weight"))
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("place", F.row_number().over(by_room)).withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / ahead)
    first = F.min(F.when(F.col("level") <= F.col("room"), F.struct("place", "level"))).over(everything)
    return s.select("source", "source_size", F.least("most", F.coalesce(first["level"] * F.col("weight"), F.col("most"))).alias("target"))


def _edges(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source the bucket in which its budget ends: source, words before it, its least and greatest key, its rows.

    rows has source, bucket, size, key and goal source, budget and before, the words ahead of all its rows. Sources whose
    budget outlasts their rows are left out.
    """
    words = [F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")]
    sums = rows.groupBy("source", "bucket").agg(*words)
    small = broadcast_if_small(goal.select(F.col("source").alias("s"), "budget", "before"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ended = sums.withColumn("end", upto).join(small, F.col("source").eqNullSafe(F.col("s"))).where("before + end > budget")
    first = F.min(F.struct("bucket", (F.col("before") + F.col("end") - F.col("words")).alias("before"), "low", "high", "n"))
    return ended.groupBy("source").agg(first.alias("e")).select("source", "e.before", "e.low", "e.high", "e.n")


def mix_sources(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken; one row per row of docs.

    size counts the runs without ASCII white space (null or empty text: 0); taken is the words the mix takes of the
    row: size times the complete epochs of its source, and size once more if the fractional selection has it. A row is
    selected if its middle lies within the budget, so a source misses its target by half a document at most. Ties of
    keys go by doc_id and size; rows alike in both are interchangeable. Rows without doc_id hash as the text 'null';
    a null source is a source of its own, last in order. Other columns, whatever their names, are left out. A text of any
    length is one row with its size. An empty table gives no rows. Targets are worked out in one task, from one narrow
    row per source.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    size = F.size(words_of(F.col("text"))).cast("long").alias("size")
    base = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size, (-F.ln(u) / quality_weight(F.col("text"))).alias("key")), "mix")
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = durable(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    share_of = F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)
    edge = durable(_edges(base.withColumn("bucket", F.least(F.lit(BUCKETS - 1), share_of).cast("int")), goal.withColumn("before", F.lit(0))), "mix-edges")
    # the bucket in which a budget ends is cut again until few rows are left in it, or all of them have one key
    while not edge.where((F.col("n") > EDGE_ROWS) & (F.col("low") < F.col("high"))).isEmpty():
        within = broadcast_if_small(edge.select(F.col("source").alias("s"), "low", "high"))
        rows = base.join(within, F.col("source").eqNullSafe(F.col("s")) & F.col("key").between(F.col("low"), F.col("high")))
        part = F.floor(F.try_divide(F.col("key") - F.col("low"), F.col("high") - F.col("low")) * BUCKETS)
        rows = rows.withColumn("bucket", F.coalesce(F.least(F.lit(BUCKETS - 1), part), F.lit(0)).cast("int"))
        ends = edge.select(F.col("source").alias("t"), "before").join(goal.select("source", "budget"), F.col("t").eqNullSafe(F.col("source"))).select("source", "budget", "before")
        edge = durable(_edges(rows.select("source", "bucket", "size", "key"), ends), "mix-edges")
    goal = goal.join(edge.select(F.col("source").alias("es"), "before", "low", "high"), F.col("source").eqNullSafe(F.col("es")), "left").drop("es").withColumnRenamed("source", "s")
    goal = broadcast_if_small(durable(goal, "mix-goals"))
    rows = base.join(goal, F.col("source").eqNullSafe(F.col("s")))
    at_edge = F.coalesce(F.col("key").between(F.col("low"), F.col("high")), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    clear = rows.where(~at_edge).withColumn("picked", F.col("low").isNull() | (F.col("key") < F.col("low")))
    split = rows.where(at_edge).withColumn("picked", F.sum("size").over(order) - F.col("size") / 2 + F.col("before") <= F.col("budget"))
    taken = (F.col("size") * (F.col("epochs") + F.col("picked").cast("int"))).cast("long").alias("taken")
    out = ["doc_id", "size", "source_size", "target", taken]
    return clear.select(*out).union(split.select(*out))


ORACLE = """
with d as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
      / greatest(0.05, 1.0 - 5.0 * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>{}\\[\\]\\\\^~=+_@!]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size, ([3.0, 1.0, 2.0])[(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::double as weight,
    row_number() over (order by source asc nulls last) as rank from d group by source),
l as (
  select *, source_size::double * 2 as most, row_number() over (order by source_size * 2 / weight, rank) as place from s),
v as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(most) over (order by place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by place rows between current row and unbounded following) as level from l),
t as (
  select source, source_size, least(most, coalesce((select level from v where level <= most / weight order by place limit 1) * weight, most)) as target from v),
g as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
k as (
  select d.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as budget,
    sum(d.size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row) - d.size / 2.0 as middle
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (epochs + (middle <= budget)::int))::bigint as taken from k
"""
