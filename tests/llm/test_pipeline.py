"""The pipeline against its stages in plain Python."""

import random

import brute
import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from tidemark.llm import factorization, mixing

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_end_with_the_mix():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]


def test_run_equals_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in factorization.score(docs, factorization.train(docs, labels)).where("predicted = 1").collect()}
    texts = brute.line_dedup([(d, rows[d]["text"]) for d in good])
    texts = {d: t for d, t in texts.items() if brute.words(t) or t == rows[d]["text"]}
    groups = brute.components(list(texts.items()), 5, 80, 100)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    texts = {d: t for d, t in texts.items() if not brute.hits(t, items)[-1]}
    left = spark.createDataFrame([(d, t, rows[d]["source"]) for d, t in texts.items()], "doc_id long, text string, source string").toPandas()
    con = duckdb.connect()
    con.register("documents", left)
    expected = sorted(map(tuple, con.execute(mixing.ORACLE).fetchall()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == expected


def test_stages_take_any_row(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties and columns with the operators' own names."""
    words = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ran tel vis som dar pel".split()]
    prose = lambda k, n: " ".join(random.Random(k).choices(words, k=n))
    rows = [(i, prose(i, 80), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [rows[3], (3, "another text under this id " + prose(77, 60), "en", None, 1), (None, None, None, None, None), (None, prose(5, 80), None, "s1", 1), (None, prose(88, 70), None, None, 0)]
    rows += [(40, "", "en", "s", 0), (41, " \n\t", "en", "s", 3), (42, "\n".join(prose(k, 40) for k in range(200, 900)), "de", "s", None), (43, "w" * 300_000, "de", "s", 1), (44, "\n" * 50_000, "de", "s", 1), (45, prose(9, 80), "en", "s0", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for c in ("d", "t", "gone", "n_removed", "N_LINES", "row", "node", "size", "score", "component"):
        docs = docs.withColumn(c, F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(2, 30)), (None, prose(4, 20)), (2, None), (3, "")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and 0 < got.count() <= len(rows), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == len(rows) and last(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_jaccard(spark, docs, str(tmp_path)).collect()}
    # the copies of document 5 and 9 go, each text of document 3 stays once
    assert kept == {(d, t) for d, t, *_ in rows} - {(None, prose(5, 80)), (45, prose(9, 80))}
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.count() == len(rows) - 2 and clean.where("doc_id in (2, 4)").count() == 0
