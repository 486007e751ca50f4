"""Rule-based quality filter: counts, and the divergence of a text's histograms from its language's.

Character classes and common words of a text are counted; the same counts summed over all documents of a language are
that language's reference. A text is rejected when the Jensen-Shannon distance of one of its two histograms from the
reference is too large, unless it is too short for the histogram to mean anything. DataFrame functions only; one pass
over the texts writes a narrow table, from which everything else is computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, words_of

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_CLASS_DISTANCE = 0.30
#: The bound of the word distance is BASE + SLACK / sqrt(words): short texts scatter more around their reference.
WORD_DISTANCE_BASE, WORD_DISTANCE_SLACK = 0.20, 1.2
#: Shorter texts are not held against the reference of characters or of words.
MIN_CHARS = 200
MIN_COMMON = 100

# Very common words of each language.
COMMON = {
    "en": "the of and to a in is that for it with as be by on at this from are was".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
N_COMMON = 20
#: Character classes, in the order in which they are taken out of the text.
CLASSES = ("lower", "space", "beyond_ascii", "upper", "digit", "mark", "symbol")


def _get(a: str, k) -> Column:
    return F.get(F.col(a), k)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, language, the counts of op1 and the two histograms of each row; a null text counts as empty."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("lang").isin(*COMMON), F.col("lang")).alias("language"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))
    # a word triple that occurs twice stands beside its equal when (hash, position) are sorted
    d = d.withColumn("triples", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0))), lambda i: F.xxhash64(_get("words", i), _get("words", i + 1), _get("words", i + 2)))).otherwise(F.array().cast("array<long>")))
    again = F.size(F.array_distinct("triples")) < F.size("triples")
    d = d.withColumn("placed", F.when(again, F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    twice = F.transform("placed", lambda x, k: F.when((x["h"] == _get("placed", k - 1)["h"]) | (x["h"] == _get("placed", k + 1)["h"]), x["i"]))
    at = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    # each class is counted by what its removal takes away; the rest gets short after the first two
    d = d.withColumn("r1", F.regexp_replace("text", r"[a-z]+", "")).withColumn("r2", F.regexp_replace("r1", r"[\x20\x09-\x0D]+", "")).withColumn("r3", F.regexp_replace("r2", r"[^\x00-\x7F]+", ""))
    d = d.withColumn("r4", F.regexp_replace("r3", r"[A-Z]+", "")).withColumn("r5", F.regexp_replace("r4", r"[0-9]+", "")).withColumn("r6", F.regexp_replace("r5", r"[.,;:'\"?!()\-]+", ""))
    lengths = [F.length(c) for c in ("text", "r1", "r2", "r3", "r4", "r5", "r6")]
    classes = F.array(*[a - b for a, b in zip(lengths, lengths[1:], strict=False)], lengths[-1])
    known = sorted({w for ws in COMMON.values() for w in ws})
    plain = F.transform("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    d = d.withColumn("common", F.filter(plain, lambda w: w.isin(*known)))
    table = F.create_map(*[x for k, ws in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    counts = F.transform(F.coalesce(F.get(F.array(table), F.lit(0))[F.col("language")], F.array().cast("array<string>")), lambda w: F.size("common") - F.size(F.array_remove("common", w)))
    return d.select(
        "doc_id", "language", F.col("n_words").cast("long").alias("n_words"), (lengths[0] - (lengths[1] - lengths[2])).cast("long").alias("word_chars"),
        (F.length("r3") - F.length(F.regexp_replace("r3", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), classes.alias("classes"), counts.alias("counts"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, to base 2, of two histograms (arrays of double) of counts; null if
    one is empty."""

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    share_p, share_q = F.transform(p, lambda v: v / total(p)), F.transform(q, lambda v: v / total(q))
    divergence = total(F.zip_with(share_p, share_q, lambda a, b: part(a, b) + part(b, a))) / 2
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda v: v.cast("double"))


def _with_rest(counts: Column, words: Column) -> Column:
    """The counts of the common words and, last, those of all other words."""
    return F.concat(counts, F.array(F.greatest(F.lit(0.0), words - F.aggregate(counts, F.lit(0.0), lambda a, v: a + v))))


def with_distances(table: DataFrame) -> DataFrame:
    """Adds class_distance and word_distance; '*' is the reference of all documents, for those of no known language."""
    sums = [F.array(*[F.coalesce(F.sum(F.get("classes", F.lit(k))), F.lit(0)).cast("double") for k in range(len(CLASSES))]).alias("ref_classes")]
    sums += [F.array(*[F.coalesce(F.sum(F.get("counts", F.lit(k))), F.lit(0)).cast("double") for k in range(N_COMMON)]).alias("ref_counts"), F.sum("n_words").cast("double").alias("ref_words")]
    each = table.where("language is not null").groupBy(F.col("language").alias("ref")).agg(*sums)
    refs = F.broadcast(each.union(table.agg(*sums).select(F.lit("*").alias("ref"), "ref_classes", "ref_counts", "ref_words")))  # five rows at most
    d = table.join(refs, F.coalesce("language", F.lit("*")) == F.col("ref"), "left").withColumn("own_classes", _doubles(F.col("classes"))).withColumn("own_counts", _doubles(F.col("counts")))
    d = d.withColumn("own_counts", _with_rest(F.col("own_counts"), F.col("n_words"))).withColumn("ref_counts", _with_rest(F.col("ref_counts"), F.col("ref_words")))
    word = F.when(F.col("language").isNotNull(), js_distance(F.col("own_counts"), F.col("ref_counts")))
    return d.withColumn("class_distance", js_distance(F.col("own_classes"), F.col("ref_classes"))).withColumn("word_distance", word)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance; one row per row of docs.

    base_failed: fewer than 50 words, or over half of them in word triples that recur. kept: not base_failed, and both
    distances within bounds. The character histogram counts from 200 characters on, the word histogram from 100 words
    on and only for the four languages with word lists; other or null languages are held against all documents'
    characters alone. Null and empty texts have no words and fail. Repeated rows are judged alike.
    """
    d = with_distances(durable(features(docs), "quality"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    chars = reduce(lambda a, b: a + b, [_get("classes", k) for k in range(len(CLASSES))])
    odd = (chars >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_COMMON) & (F.col("word_distance") > WORD_DISTANCE_BASE + WORD_DISTANCE_SLACK / F.sqrt("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(odd, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))).alias("kept"), "class_distance", "word_distance")
