"""Places where an operator once did less than the whole job."""

import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, line_dedup, queries, repeated_bytes, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def saved(spark, tmp_path):
    """A folder with the texts given as its documents."""

    def save(texts):
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return save


def test_short_lines_that_repeat_go(spark, saved):
    texts = ["All rights reserved.\none two three four five\n\nx", "all  rights RESERVED.\nX\n \nnew line", None, "all rights kept.\nx\none two three four six\n"]
    rows = list(enumerate(texts))
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), least=1)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.line_dedup(rows) == {0: texts[0], 1: " \nnew line", 2: None, 3: "all rights kept.\n"}
    assert {r["doc_id"]: r["n_removed"] for r in queries.op3_line_dedup(spark, saved(texts)).collect()} == {0: 0, 1: 2, 2: 0, 3: 2}


def test_bound_grows_with_the_line(spark, saved):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(n)] for n in (4, 5, 12, 19, 20, 21, 29, 30, 45, 60, 90, 150)]
    lines = [list(x) for x in base]
    for x in base:
        for edits in (1, 2, 2, 3, 4, len(x) // 10, len(x) // 10 + 1):
            y = list(x)
            for _ in range(edits):
                at = rng.randrange(len(y))
                y[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(words)], [rng.choice(words)]])
            lines.append(y or ["w"])
    rng.shuffle(lines)
    texts = ["\n".join(" ".join(x).upper() if i % 5 == 0 else " ".join(x) for i, x in enumerate(lines[k : k + 3])) for k in range(0, len(lines), 3)]
    expected = brute.near_lines(enumerate(texts))
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS), 1, 10)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected.get(i, ())) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_removed"] for r in queries.op3_line_dedup(spark, saved(texts)).collect()} == {i: len(expected.get(i, ())) for i in range(len(texts))}


def test_within_edits():
    rng, pairs = random.Random(8), []
    for _ in range(3000):
        x = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
        y = list(x)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["b"]])
        y = y or ["a"]
        pairs.append((" ".join(x).upper(), "  ".join(y)))
        assert line_dedup.within_edits(" ".join(x), " ".join(y), 5) == (brute.distance(x, y) <= max(1, min(len(x), len(y)) // 5))
    assert list(line_dedup.near_pairs(*map(pa.array, zip(*pairs, strict=True)), 5)) == [line_dedup.within_edits(a, b, 5) for a, b in pairs]


STORY = "<p>" + "some words of the story " * 12 + "</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-comments", "page-menu", "main social"])
def test_layout_wrappers_keep_the_article(name):
    assert html_text.main_text(f"<body><div class='{name}'><article><p>the text</p><div class='ad'>buy</div></article></div><div>short</div></body>") == "the text"
    by_density = html_text.main_text(f"<body><div class='{name}'><div>{STORY * 3}</div></div><div class='comments'><p>{STORY}</p></div></body>")
    assert len(by_density.split("\n\n")) == 3
    assert len(html_text.main_text(f"<body><div class='{name}'>{STORY * 3}</div><div>short</div></body>").split("\n\n")) == 3


def test_only_attributes_hide():
    assert html_text.main_text("<article><p title='a hidden gem' data-x='display:none'>x</p><p hidden>y</p><p style='display: none'>z</p></article>") == "x"
    assert html_text.main_text("<article><p>the text of it</p></article><div class='related'><article><p>the teaser</p></article></div>") == "the text of it"
    assert html_text.main_text(f"<div>{STORY}</div><div class='comments'><div>{STORY * 3}</div></div>").count("story") == 12


def test_texts_without_id_whose_short_hashes_collide(spark):
    """Among 300,000 texts several pairs share a hash of 32 bits; each text keeps its own spans."""
    text = F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("-"), F.sha2(F.concat(F.lit("x"), "id"), 256))
    pairs = spark.range(300_000).select(text.alias("text")).groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("texts")).where(F.size("texts") > 1).limit(1)
    one, two = pairs.first()["texts"][:2]
    rows = [(None, one), (None, two), (1, one[:60]), (2, two[70:])]
    got = repeated_bytes.remove_repeats(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS), 40, 8).collect()
    expected = brute.repeated_bytes([(i, t.encode()) for i, (_, t) in enumerate(rows)], 40)
    assert sorted((bytes(r["kept"]), len(r["spans"])) for r in got) == sorted(expected.values())


def test_lines_of_repeated_words_make_no_pairs(spark, monkeypatch):
    """Words that lines repeat an even number of times leave no parity; such lines share a passage and are not near each other."""
    counts, write = {}, line_dedup.durable

    def durable(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "durable", durable)
    lines = [f"{'x%d ' % i * 20}we share this passage all of us {'y%d ' % i * 20}" for i in range(60)]
    lines += [lines[5] + "more", lines[7].replace("share", "shared"), lines[9].replace("x9", "z", 6)]
    rows = [(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.line_dedup(rows)
    assert sum(brute.near_lines(rows).get(60, ())) == 1  # lines 0 and 1 of the last text; line 2 has six edits
    assert sum(n for name, n in counts.items() if name.endswith("-pairs")) < 20


def test_near_copies_far_from_the_first_make_few_pairs(spark, monkeypatch):
    """The first lines of a group are too far from the others, which are near each other: not all of its pairs may be made."""
    pairs, write = {}, line_dedup.durable

    def durable(df, name):
        out = write(df, name)
        if name.endswith("-pairs"):
            pairs[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "durable", durable)
    rng = random.Random(3)
    template = [f"w{i}" for i in range(40)]

    def copy(edits):
        line = list(template)
        for i in rng.sample(range(40), edits):
            line[i] = f"x{rng.randrange(10**6)}"
        return " ".join(line)

    rows = [(i, copy(4)) for i in range(8)] + [(i, copy(rng.choice([1, 1, 2]))) for i in range(8, 100)]
    for rows in (rows, [(None, t) for _, t in rows]):
        pairs.clear()
        got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
        kept = sorted(r["text"] for r in got.collect())
        keyed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) t").orderBy("doc_id", "t").collect()
        near = brute.near_lines([(i, r["text"]) for i, r in enumerate(keyed)])
        assert kept == sorted("" if near.get(i) else r["text"] for i, r in enumerate(keyed))
        assert sum(map(bool, near.values())) > 85 and pairs["near-other-pairs"] < 20


def test_words_of_pairs_are_counted_once(monkeypatch):
    """pairs whose hashed bags of words fit are not counted word by word again, and are judged alike."""
    rng = random.Random(5)
    line = lambda: [f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 40))]
    pairs = [(x, line() if i % 4 == 0 else [*x[:2], *x[3:], "W1"][: len(x) + i % 3]) for i, x in enumerate(line() for _ in range(200))]
    expected = [brute.distance([w.lower() for w in x], [w.lower() for w in y]) <= max(1, min(len(x), len(y)) // 10) for x, y in pairs]
    monkeypatch.setattr(line_dedup, "Counter", None)
    assert any(expected) and list(line_dedup.near_pairs(*(pa.array([" ".join(p[k]) for p in pairs]) for k in (0, 1)), 10)) == expected


def test_words_and_frequent_grams_are_those_of_plain_python():
    """Words end where texts end, and frequent grams are counted once a line."""
    rng = random.Random(4)
    for _ in range(200):
        texts = ["".join(rng.choice(" \t\naZé") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))]
        for _, data, offsets in tokens.text_slices(pa.array(texts)):
            start, end, row = tokens.words(data, offsets)
            assert [(bytes(data[a:b]), r) for a, b, r in zip(start, end, row, strict=True)] == [(w, r) for r, t in enumerate(texts) for w in t.encode().split()]
    table = pa.table({"d": [0, 1, 2], "t": [0, 1, 2], "text": ["q r s t " * 6, "q r s t " * 6, "q r s t " + "u v w z " * 5]}).to_batches()
    told = pa.Table.from_batches(line_dedup._keys(iter(table), 1, 10, 2, 1 << 19)).to_pylist()
    assert [r["n"] for r in told if r["line"] is None] == [2]  # q r s t, in two different lines
