"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item is the set of its word shingles; a document contains it when all of them stand there in a row.
Shingles are ordered by rarity in the documents, and for containment of the whole window its rarest shingle is the
necessary prefix: only that one is joined. Offset and length bounds drop places where the window cannot fit, and the
words of each remaining place are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh_names

SHINGLE = 3
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII; A-Z, and nothing else, is lowered."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, GAP), "")


def _shingles(words: str, size: str, k: int) -> Column:
    """Hashes of the k-word shingles by position."""
    one = F.transform(F.sequence(F.lit(0), F.greatest(F.col(size) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]))
    return F.when(F.col(size) >= k, one).otherwise(F.array().cast("array<long>"))


def windows(items: DataFrame, length: int) -> DataFrame:
    """item_id, win (array of words), m (its length), wid (its hash), k (words of its shingles)."""
    w = items.select("item_id", tokens(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0").withColumn("m", F.least("n", F.lit(length)))
    w = w.select("item_id", "m", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1), lambda s: F.slice("w", s, F.col("m")))).alias("win"))
    return w.select("item_id", "win", "m", F.xxhash64("m", "win").alias("wid"), F.least("m", F.lit(SHINGLE)).alias("k"))


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t")]


def hit_documents(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """d, t (id and hash of the text), n_hit and ids (of the items, as strings) of the rows of docs with a window."""
    win = durable(windows(items, length), "windows")
    one = durable(win.dropDuplicates(["wid", "win"]).drop("item_id"), "window-kinds")
    kinds = sorted(r.k for r in one.select("k").distinct().collect())  # three at most
    words = docs.select(*_key(), tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))

    def places(k: int) -> DataFrame:
        return words.select("d", "t", "n", F.posexplode(_shingles("w", "n", k)).alias("pos", "h")).withColumn("k", F.lit(k))

    none = words.limit(0).select("d", "t", F.lit(0).alias("start"), F.lit(0).alias("m"), F.lit(0).cast("long").alias("wid"))
    found = []
    for k in kinds:
        mine = one.where(F.col("k") == k).withColumn("n", F.size("win")).select("wid", "win", "m", F.posexplode(_shingles("win", "n", k)).alias("off", "h"))
        seen = places(k).join(broadcast_if_small(mine.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("df"))
        rare = mine.join(seen, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        least = rare.groupBy("wid", "win", "m").agg(F.min(F.struct("df", "h", "off")).alias("r")).where("r.df > 0")
        prefix = durable(least.select("wid", "m", "r.h", "r.off"), "prefixes")
        at = places(k).join(broadcast_if_small(prefix), "h").where("pos >= off and pos - off + m <= n")
        found.append(at.select("d", "t", (F.col("pos") - F.col("off")).alias("start"), "m", "wid"))
    found = durable(reduce(DataFrame.union, found or [none]).distinct(), "places")
    texts = found.join(one.select("wid", "m", "win"), ["wid", "m"]).groupBy("d", "t").agg(F.collect_set(F.struct("start", "m", "wid", "win")).alias("c"))
    # only documents with a place to look at are shuffled with their words
    flagged = words.join(broadcast_if_small(found.select("d", "t").distinct()), ["d", "t"], "left_semi")
    equal = F.filter("c", lambda c: F.slice("w", c["start"] + 1, c["m"]) == c["win"])
    checked = flagged.dropDuplicates(["d", "t"]).join(texts, ["d", "t"]).select("d", "t", "n", equal.alias("c"))
    spans = F.array_sort(F.transform("c", lambda c: F.struct(c["start"].alias("s"), (c["start"] + c["m"]).alias("e"))))

    def longer(a: Column, x: Column) -> Column:
        """The end of the words seen so far and their number, with those of a span more."""
        more = F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))
        return F.struct(F.greatest(a["e"], x["e"]).alias("e"), (a["n"] + more).alias("n"))

    hit = F.aggregate(spans, F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")), longer, lambda a: a["n"])
    named = F.transform("c", lambda c: F.struct(c["wid"].alias("wid"), c["win"].alias("win")))
    checked = durable(checked.where(F.size("c") > 0).select("d", "t", hit.alias("n_hit"), named.alias("c")), "hits")
    ids = checked.select("d", "t", F.explode(F.array_distinct("c")).alias("x")).select("d", "t", "x.wid", "x.win").join(win, ["wid", "win"])
    ids = ids.groupBy("d", "t").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    return checked.select("d", "t", "n_hit").join(ids, ["d", "t"])


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated; one row per row of docs.

    A window is `length` consecutive words of an item, or the whole item if it has fewer (but some). n_hit counts the
    words of the document inside any occurrence of any window; n_items the items with one; items_sha256 is the digest of
    their ids, sorted as strings and joined by commas (of the empty string if there are none). Null and empty texts
    have no words; an empty benchmark hits nothing; repeated rows are judged alike, and an item told twice under one id
    is one item. Rows without doc_id are judged by their texts, items without item_id hit but are not listed. Other
    columns, whatever their names, are left out. A very long text is one row of words like any other.
    """
    hits = hit_documents(docs, items, length)
    n_words = F.size(tokens(F.col("text"))).cast("long").alias("n_words")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), n_words).join(hits, ["d", "t"], "left")
    listed = F.array_sort(F.coalesce("ids", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all their columns, whatever their names.

    Null, empty and wordless texts have no window and stay; repeated rows and rows without doc_id go by their texts.
    """
    names = fresh_names(docs, "d", "t")
    hits = durable(hit_documents(docs, items, length).select("d", "t").toDF(*names), "contaminated")
    own = [c.alias(n) for c, n in zip(_key(), names, strict=True)]
    return docs.select("*", *own).join(broadcast_if_small(hits), names, "left_anti").select(*docs.columns)


ORACLE = """
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (
  select item_id, m, w[s + 1 : s + m] as win from (select item_id, w, m, unnest(range(0, len(w) - m + 1)) as s from (select *, least(len(w), 10) as m from i where len(w) > 0))),
pos as (
  select doc_id, s, m, w[s + 1 : s + m] as win from (select doc_id, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) as s from d, (select distinct m from win))),
hit as (select pos.doc_id, pos.s, pos.m, win.item_id from pos join win using (m, win)),
n_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from hit) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join n_hit using (doc_id) left join ids using (doc_id)
"""
