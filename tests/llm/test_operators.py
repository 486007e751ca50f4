"""Each text operator against plain Python, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import math
import random
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format as chat
from tidemark.llm import decontaminate as decon
from tidemark.llm import common, factorization, html_text, jaccard_join, line_dedup, mixing, quality_rules, repeated_bytes, textfeatures, toxicity
from tidemark.llm.common import components
from tidemark.llm.jaccard_join import class_ends, fragments_of, jaccard_classes, keep_one_each

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ran tel vis som dar pel".split()]


def prose(rng, n, per_line=12):
    w = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, n, per_line))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([8, 40, 120, 300])) for _ in range(12)]
    out = list(base)
    out += [edited(rng, t, rng.choice([1, 2, 4])) for t in base for _ in range(3)]
    out += base[:4] + [t.upper() for t in base[:2]] + [prose(rng, 4000), None, "", "   \n\t", "one two", "one two", "é ü ñ ß", "a b c d e\na b c d e\nA b  c d e f"]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts, with columns whose names the operators use inside."""
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], [f"s{i % 3}", None][i % 7 == 0], len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("d", "t", "n", "key", "words", "size", "label", "w", "comp", "line", "spans", "h"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(spark, docs, texts, nothing):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in texts:
        e, r = brute.base_counts(t), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(nothing).count() == 0
    rng = random.Random(1)
    clean = [(i, "The cat sat and the dog ran to the house. " * 0 + " ".join(rng.choice(["the", "of", "and", "house", "river", "walks", "green", "to", "a", "in", "is", "quiet", f"word{rng.randrange(900)}"]) for _ in range(300)), "en", "s", 1) for i in range(30)]
    junk = [(100, " ".join(f"#{rng.randrange(10**6)}$$ %%&|" for _ in range(200)), "en", "s", 1), (101, clean[0][1].upper().replace(" ", "!! "), "en", "s", 1)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert all(got[i] for i in range(30)) and not got[100] and not got[101]


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 3.0]), ([2.0, 2.0], [5.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()] == [1.0, 0.0, None]


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text &amp; more", "just text & more"),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T &lt;1&gt;</h1><p>a  b\n c<br>d<p><b>e</b>f</article><div class='ad'>buy</div><footer>f</footer>", "T <1>\n\na b c d\n\nef"),
        ("<main><p>x</p><section class='comments'><p>reader</p></section><form><p>no</p></form><script>if (a<b) {}</script><p>y<!-- <p>z</p> --></main>", "x\n\ny"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><aside>s</aside></article>", "one\n\ntwo\n\na\n\nb"),
        ("<article><p>caf&eacute; &#8364; &unknown; &nbsp;end</p></article>", "café € &unknown; end"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_main_text_by_density():
    para = "<p>" + "some words of the story " * 12 + "</p>"
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><div>{para * 3}</div><div>{para * 2}</div></div><div>short</div>"
    assert len(html_text.main_text(page).split("\n\n")) == 5 and "one" not in html_text.main_text(page) and "short" not in html_text.main_text(page)
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<a \"<b" * 200) is not None


def tree(rng, depth=0):
    """A random element: (tag, children), children being texts and elements."""
    name = rng.choice(["div", "section", "div", "ul"]) if depth < 3 and rng.random() < 0.7 else rng.choice(["p", "a", "span", "p"])
    if name in ("p", "a", "span"):
        return name, [" ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([1, 3, 30, 80])))]
    return name, [tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))]


def shown(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(shown, node[1]))}</{node[0]}>"


def density_tree(node, body=None, linked=False):
    """Elements in page order as (characters, density, sum of the children's densities), counted anew for each."""

    def count(x, linked):
        if isinstance(x, str):
            return len(x), 0, len(x) * linked, 0
        linked = linked or x[0] == "a"
        parts = [count(c, linked) for c in x[1]]
        return sum(p[0] for p in parts), 1 + sum(p[1] for p in parts), sum(p[2] for p in parts), (x[0] == "a") + sum(p[3] for p in parts)

    def density(x, linked):
        c, t, lc, lt = count(x, linked)
        base = math.log(c / max(1.0, c - lc) * lc + body * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / max(1.0, lc) * t / max(1.0, lt)))) / max(html_text.LEAST_LOG, math.log(base)) if c else 0.0

    if body is None:
        c, _, lc, _ = count(node, False)
        body = lc / c
    linked = linked or node[0] == "a"
    inner = [x for x in node[1] if not isinstance(x, str)]
    out = [(count(node, linked)[0], density(node, linked), sum(density(x, linked) for x in inner))]
    for x in inner:
        out += density_tree(x, body, linked)
    return out


def test_density_against_a_naive_tree():
    rng = random.Random(12)
    for _ in range(200):
        node = ("body", [tree(rng) for _ in range(rng.randrange(1, 6))])
        parent, tag, unseen, _, runs = html_text._parse(shown(node))
        chars, density, total = html_text.measures(parent, tag, unseen, runs)
        for i, (c, d, s) in enumerate(density_tree(node), 1):
            assert (chars[i], density[i], total[i]) == (c, pytest.approx(d), pytest.approx(s))


def test_density_decides_on_pages_without_names(monkeypatch):
    """Pages of plain div elements: lists of links and the text. Without the density most are wrong."""
    rng = random.Random(13)
    pages = []
    for _ in range(40):
        links = lambda: "<div>" + "".join(f"<div><a href=#>{prose(rng, 2, 9)}</a></div>" for _ in range(rng.randrange(8, 15))) + "</div>"
        text = [prose(rng, rng.randrange(40, 90), 99) for _ in range(rng.randrange(2, 6))]
        pages.append((f"<body>{links()}<div><div>{''.join(f'<p>{x}</p>' for x in text)}</div></div>{links()}</body>", "\n\n".join(text)))
    assert all(html_text.main_text(page) == text for page, text in pages)
    monkeypatch.setattr(html_text, "_density", lambda *_: 1.0)
    assert sum(html_text.main_text(page) != text for page, text in pages) > 30


def test_long_comments_are_not_the_text():
    story, talk = "<p>" + "some words of the story " * 12 + "</p>", "<p>" + "what a reader says of it " * 20 + "</p>"
    assert html_text.main_text(f"<body><div>{story * 2}</div><div class='comments'>{talk * 9}</div></body>").count("reader") == 0
    assert html_text.main_text(f"<body><article>{story * 2}</article><aside>{talk * 9}</aside></body>").count("reader") == 0


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>"), (2, None, None), (1, "u", "<article><p>é</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_line_dedup(spark, docs, texts, nothing):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.line_dedup(texts)
    assert line_dedup.dedup_lines(nothing).count() == 0 and line_dedup.dedup_documents(nothing).columns == nothing.columns
    rows = [(i, "x " * 5 + " ".join(rng), "en", "s", 1) for i, rng in enumerate([["a", "b"], ["a", "c"], ["a"], ["q", "a", "b"], ["z", "y"]])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.line_dedup([(r[0], r[1]) for r in rows])
    assert line_dedup.within_edits("a b c", "a c") and line_dedup.within_edits("a b c", "A x c") and not line_dedup.within_edits("a b c", "b a c")


def test_line_dedup_with_clashing_columns(spark):
    """Columns that the operator makes itself: the counts are replaced, helpers step aside, and documents keep theirs."""
    rows = spark.createDataFrame([(1, "a\nb", 5), (2, "a\nb", 6), (3, "b\nc\n", 7), (4, None, 8), (None, "c", 9), (5, "", 10)], "doc_id long, text string, n_removed int")
    for name in ("d", "T", "gone", "row", "n_lines"):
        rows = rows.withColumn(name, F.lit("x"))
    got = line_dedup.dedup_lines(rows)
    assert got.columns == ["doc_id", "text", "d", "T", "gone", "row", "n_lines", "n_removed"]
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()} == {(None, "c", 0), (1, "a\nb", 0), (2, "", 2), (3, "", 2), (4, None, 0), (5, "", 0)}
    kept = line_dedup.dedup_documents(rows)
    assert kept.columns == rows.columns and {(r["doc_id"], r["n_removed"]) for r in kept.collect()} == {(None, 9), (1, 5), (4, 8), (5, 10)}


def test_line_dedup_frequent_runs_and_several_blocks(spark, monkeypatch):
    """Lines around common passages; the result is the same with frequent runs put last and with many small blocks."""
    rng = random.Random(11)
    common = [prose(rng, 25, 100) for _ in range(3)]
    lines = [f"{prose(rng, rng.randrange(8, 40), 100)} {rng.choice(common)}" for _ in range(90)]
    lines += [edited(rng, rng.choice(lines), rng.choice([1, 3, 5])) for _ in range(60)]
    rows = [(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    expected = brute.line_dedup(rows)
    for seen, most, chunk, block in ((8, 100_000, 1 << 19, 1 << 20), (2, 30, 50, 40), (1 << 30, 0, 1 << 19, 100)):
        for name, value in (("SEEN_OFTEN", seen), ("MOST_FREQUENT", most), ("CHUNK", chunk), ("BLOCK", block)):
            monkeypatch.setattr(line_dedup, name, value)
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == expected


def test_mixing(spark, docs, nothing):
    rows = docs.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    expected = sorted(map(tuple, con.execute(mixing.ORACLE).fetchall()))
    names = [x[0] for x in con.description]
    got = mixing.mix_sources(docs)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == expected
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect())) == sorted(map(tuple, got.collect()))
    by = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    assert all(abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1 and r["over"] <= 0 for r in by.collect())
    assert mixing.mix_sources(nothing).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(nothing.union(spark.createDataFrame([(1, None, None, None, 0)], DOCS))).collect()] == [0]


@pytest.mark.parametrize("buckets,edge", [(2, 1), (3, 0), (1 << 16, 1)])
def test_mixing_cuts_the_last_bucket_again(spark, monkeypatch, buckets, edge):
    """However few the buckets, the rows taken are the same; repeated rows share a key that no cut parts."""
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    rng = random.Random(14)
    rows = [(i // 3 if i % 7 == 0 else i, "#$ " * rng.randrange(30) + prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "b", None]), 0) for i in range(300)]
    rows += [(1, "one two three", "en", "b", 0)] * 5
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, DOCS).toPandas())
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(3)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, con.execute(mixing.ORACLE).fetchall()))


def test_targets_share_the_excess(spark):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx((1.5 * 2010 - 20) / 3) and got[None] == pytest.approx((1.5 * 2010 - 20) * 2 / 3)


def test_chat_escapes_come_back():
    rng = random.Random(2)
    bits = ["\\", "<", "|", ">", "[", "/", "INST]", "</s>", "<|end|>", chat.TURN, chat.TEXT, "x", "\n", "é"]
    for _ in range(3000):
        said = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(said)) == said and not any(c in chat.escape(said) for c in chat.CONTROL)


def test_chat_layouts():
    hello = [("user", "hi"), ("assistant", "yo")]
    for record in (
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"id": 3, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"prompt": "hi", "completion": "yo"},
        {"question": "hi", "answer": "yo"},
        {"turns": [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]},
    ):
        assert chat.canonical(json.dumps(record)) == hello
    assert chat.canonical(json.dumps({"instruction": "do", "input": "this", "output": "ok"})) == [("user", "do\n\nthis"), ("assistant", "ok")]
    assert chat.canonical("{") is None and chat.canonical(None) is None and chat.canonical('{"what": 1}') is None


@pytest.mark.parametrize(
    "record",
    ['{"messages":["a"]}', '{"instruction":5,"output":"x"}', '{"messages":[{"role":"user","content":7}]}', '{"messages":[{"role":"user","content":["x"]}]}', "[1]", "7", "", None, "{", '{"what":1}', '{"prompt":{"a":"b"},"completion":"c"}', "[" * 100_000, '{"turns":"x"}'],
)
def test_records_that_nobody_knows(record):
    assert chat.parsed(record) == (None, None)


def test_records_with_nulls():
    assert chat.canonical('{"messages":[null,{"role":"user","content":"a"},{"role":"assistant"},{"content":"c"}]}') == [("user", "a"), ("assistant", ""), ("", "c")]
    assert chat.canonical('{"turns":[]}') == [] and chat.canonical('{"prompt":"","completion":"b","id":{"x":1}}') == [("user", ""), ("assistant", "b")]
    assert chat.parsed('{"prompt":"a","completion":"b"}')[0] != chat.parsed('{"instruction":"a","output":"b"}')[0]


def test_mixed_layouts_hold_the_same_turns(spark):
    rng, rows = random.Random(6), []
    for conv in [None, *range(-20, 40)]:
        for k in range(rng.choice([1, 2, 2, 2, 3, 5])):
            role = rng.choice(["user", "assistant", "system", "human", None]) if rng.random() < 0.3 else ["user", "assistant"][k % 2]
            rows.append((conv, k, role, rng.choice(["", None, "a", "</s>", "x\\n" * 3000])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x"))
    one, two = (chat.format_chats(chat.records_of(df, mixed)) for mixed in (False, True))
    assert one.select("layout").distinct().count() == 1 and two.select("layout").distinct().count() == 5
    plain = lambda x: {tuple(r) for r in chat.digests(x).collect()}
    assert plain(one) == plain(two)
    odd = spark.createDataFrame([(1, "{"), (2, None), (None, '{"messages":["a"]}'), (4, '{"prompt":"a","completion":"b"}')], "conv_id long, record string")
    assert sorted((str(r["conv_id"]), r["n_turns"]) for r in chat.digests(chat.format_chats(odd)).collect()) == [("1", None), ("2", None), ("4", 2), ("None", None)]


def test_chat_format(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 0, "user", "tie"), (None, 0, "user", "<|turn|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.records_of(df))).collect()}
    told = {1: [("user", "a"), ("assistant", "b</s>")], 2: [("", "")], 3: [("assistant", ""), ("user", "tie")], None: [("user", "<|turn|>")]}
    for conv, turns in told.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(chat.records_of(df.limit(0)))).count() == 0


def test_intervals_of_a_transform():
    rng = random.Random(17)
    for _ in range(300):
        length, letters = rng.choice([1, 3, 8, 20]), rng.choice(["ab", "abcd", "abcdefghijkl"])
        base = "".join(rng.choice(letters) for _ in range(60))
        parts = []
        for _ in range(rng.randrange(1, 8)):
            part = list(base[rng.randrange(20) : rng.randrange(25, 60)])
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(letters)
            parts.append("".join(part).encode())
        text = np.concatenate([*[np.r_[np.frombuffer(x, np.uint8).astype(np.int16) + 2, np.int16(1)] for x in parts], np.zeros(1, np.int16)])
        order = repeated_bytes.suffix_order(text, 80)
        assert [tuple(text[i : i + 80]) for i in order] == sorted(tuple(text[i : i + 80]) for i in range(len(text)))
        often = Counter(x[i : i + length] for x in parts for i in range(len(x) - length + 1))
        got, at = repeated_bytes.repeated_starts(text, length), 0
        for x in parts:
            assert [bool(got[at + i]) for i in range(len(x) - length + 1)] == [often[x[i : i + length]] > 1 for i in range(len(x) - length + 1)]
            at += len(x) + 1


@pytest.mark.parametrize("sizes", [(1, 1, 1), (300, 50, 40)])
def test_repeated_bytes_in_small_blocks(spark, docs, texts, monkeypatch, sizes):
    for name, value in zip(("BLOCK_BYTES", "CHUNK", "SPANS"), sizes, strict=True):
        monkeypatch.setattr(repeated_bytes, name, value)
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeated_bytes.remove_repeats(docs, 40, 8).collect()}
    assert got == brute.repeated_bytes([(i, (t or "").encode()) for i, t in texts], 40)
    with pytest.raises(ValueError):
        repeated_bytes.remove_repeats(docs, 1001)


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeated_bytes(spark, docs, texts, nothing, hot):
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeated_bytes.remove_repeats(docs, 40, 8, hot).collect()}
    assert got == brute.repeated_bytes([(i, (t or "").encode()) for i, t in texts], 40)
    if hot:
        assert repeated_bytes.remove_repeats(nothing).count() == 0
        odd = [(1, "ab" * 300, None, None, 0), (2, "é" * 150 + "xyz" * 60, None, None, 0), (3, "é" * 120, None, None, 0)]
        got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeated_bytes.remove_repeats(spark.createDataFrame(odd, DOCS)).collect()}
        assert got == brute.repeated_bytes([(r[0], r[1].encode()) for r in odd], 200)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(500):
        bad, rude = i % 4 == 0, i % 5 == 1
        w = prose(rng, 60).split(" ")
        if rude:
            w[7] = w[30] = rng.choice(["trashword", "scumword"])
        text = " ".join(x + "***$$" if bad else x for x in w)
        rows.append((i, text, "en", "s", 0))
        marks.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, DOCS).cache(), spark.createDataFrame(marks, "doc_id long, quality int, toxic int").cache()


def test_quality_classifier(spark, labelled, docs, nothing):
    rows, marks = labelled
    machine = factorization.train(rows, marks)
    got = factorization.score(rows, machine).join(marks, "doc_id").where("held_out")
    assert got.count() > 50 and got.where("predicted = quality").count() >= 0.97 * got.count()
    assert got.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").count() == 0
    odd = factorization.score(docs, machine)
    assert odd.count() == docs.count() and odd.where("score between 0 and 1").count() == docs.count()
    assert factorization.score(nothing, machine).count() == 0 and factorization.keep_good(docs, machine).columns == docs.columns
    assert factorization.keep_good(docs, machine).count() == odd.where("predicted = 1").count()
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert factorization.train(rows, flipped).bias == machine.bias  # held-out labels are never learned from
    none = factorization.train(rows, marks.limit(0))
    assert {r["score"] for r in factorization.score(rows.limit(3), none).collect()} == {0.5}


def some_features(n=40, prefixes=()):
    rng = random.Random(18)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(n)] + ["", None]
    parts = [x for _, x in textfeatures.sparse_rows(pa.array(texts), 64 if not prefixes else toxicity.BUCKETS, prefixes)]
    assert len(parts) == 1
    return parts[0]


def test_factorisation_against_the_sum_over_pairs():
    rng, x = np.random.default_rng(1), some_features()
    x.index = x.index % factorization.BUCKETS
    m = factorization.Machine(0.3, rng.normal(size=factorization.WIDTH), rng.normal(size=(factorization.WIDTH, factorization.FACTORS)), x.stats.mean(0), x.stats.std(0) + 0.1)
    begin, feature, value = m.design(x)
    got, _ = m.logits(begin, feature, value)
    for r in range(len(got)):
        f, v = feature[begin[r] : begin[r + 1]], value[begin[r] : begin[r + 1]]
        z = 0.3 + sum(m.linear[i] * a for i, a in zip(f, v, strict=True))
        z += sum(m.factors[f[i]] @ m.factors[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert got[r] == pytest.approx(z)


def test_chain_against_a_plain_loop():
    rng, x = np.random.default_rng(2), some_features(120, toxicity.PREFIXES)
    n = len(x.begin) - 1
    labels = (rng.random((n, 2)) < 0.4).astype(float)
    labels[3, 0] = labels[7, 1] = np.nan
    chain = toxicity.fit(labels, x, ["one", "two"])
    told = np.zeros(n)
    for fold in range(toxicity.FOLDS):  # what a model says of rows it has not learned from
        learn = np.array([i for i in range(n) if i % toxicity.FOLDS != fold and not np.isnan(labels[i, 0])])
        keep = np.isin(np.arange(n), learn)
        model = toxicity._fit(labels[keep, 0], toxicity._rows(x, keep), np.zeros((len(learn), 0)))
        for i in range(fold, n, toxicity.FOLDS):
            told[i] = np.clip(model.bias + sum(model.words[j] for j in x.index[x.begin[i] : x.begin[i + 1]]), -30, 30)
    known = ~np.isnan(labels[:, 1])
    second = toxicity._fit(labels[known, 1], toxicity._rows(x, known), told[known, None])
    assert np.allclose(chain.links[1].words, second.words) and chain.links[1].earlier == pytest.approx(second.earlier)
    got = chain.logits(x)
    for i in range(n):
        one = np.clip(chain.links[0].bias + sum(chain.links[0].words[j] for j in x.index[x.begin[i] : x.begin[i + 1]]), -30, 30)
        two = chain.links[1].bias + sum(chain.links[1].words[j] for j in x.index[x.begin[i] : x.begin[i + 1]]) + chain.links[1].earlier[0] * one
        assert got[i] == pytest.approx([one, np.clip(two, -30, 30)])


def test_training_sample_is_the_same_each_time(spark, labelled):
    """Null ids, ids with several texts and labels, and ties: whatever the partitions, the same rows are learned from."""
    rows, marks = labelled
    more = rows.where("doc_id < 60").withColumn("text", F.concat(F.lit("other words here "), "text"))
    twice = rows.union(more).union(rows.where("doc_id < 30").withColumn("doc_id", F.lit(None).cast("long")))
    said = marks.union(marks.where("doc_id < 40").selectExpr("doc_id", "1 - quality", "toxic")).union(spark.createDataFrame([(None, 1, 1)], marks.schema))
    one, two = (factorization.train(twice.repartition(k), said.repartition(k), most=120) for k in (2, 5))
    assert one.bias == two.bias and np.array_equal(one.factors, two.factors)
    assert factorization.score(twice, one).where("doc_id is null and held_out").count() == 0


def test_toxicity(spark, labelled, docs, nothing):
    rows, marks = labelled
    labels = marks.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(rows, labels, ["low_quality", "toxic"])
    assert len(chain.links[1].earlier) == 1
    got = toxicity.score(rows, chain).withColumnRenamed("toxic", "said").join(marks, "doc_id").where("held_out")
    assert got.where("said = toxic").count() >= 0.97 * got.count()
    assert toxicity.score(docs, chain).count() == docs.count() and toxicity.score(nothing, chain).count() == 0


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, docs, texts, nothing, n, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(docs, n, num, 100).collect()}
    assert got == brute.components(texts, n, num, 100)
    if n == 5:
        assert jaccard_classes(nothing, n, num).count() == 0
        kept = keep_one_each(docs, n, num)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in got.items() if c == d}


def test_jaccard_groups(spark):
    """Near copies around the threshold: what leaders leave open is found by the prefixes."""
    rng = random.Random(9)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, rng.choice([0, 3, 6, 9])), "en", "s", 0) for i in range(80)]
    for num in (70, 80, 90):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(spark.createDataFrame(rows, DOCS), 3, num, 100).collect()}
        assert got == brute.components([(r[0], r[1]) for r in rows], 3, num, 100)
    ends = class_ends(1000)
    assert all(f - s > (e - 1) * 10 // 90 for e, f, s in zip(ends[1:], *fragments_of(ends, 90, 100), strict=True))


@pytest.mark.parametrize("most,leaders,rounds,block", [(0, 2, 2, 60), (30, 1000, 1, 1 << 20), (100_000, 4, 0, 300)])
def test_jaccard_of_a_template(spark, monkeypatch, most, leaders, rounds, block):
    """Copies of a template with its slots filled differently: linked in chains, whichever way they are found."""
    for name, value in (("MOST_FREQUENT", most), ("LEADERS", leaders), ("ROUNDS", rounds), ("BLOCK", block)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(15)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for slot in range(20, 180, 25):
            w[slot] = f"s{slot}o{rng.randrange(5)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(1000 + i, prose(rng, 30), "en", "s", 0) for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect()}
    assert got == brute.components([(r[0], r[1]) for r in rows], 3, 90, 100)


def test_jaccard_of_rows_that_share_or_lack_ids(spark):
    """Two texts of one doc_id are two nodes; rows without one link, and go where a row with one is in their group."""
    rng = random.Random(16)
    a, b, c, d = (prose(rng, 80, 99) for _ in range(4))
    rows = [(5, a), (5, b), (9, edited(rng, b, 1)), (None, a), (None, c), (None, c), (None, edited(rng, c, 1)), (7, d), (7, d), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], DOCS).withColumn("node", F.lit("x"))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_classes(df).collect())
    assert got == sorted([("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), *[("None", "None")] * 5, ("7", "7"), ("7", "7")])
    kept = keep_one_each(df)
    assert kept.columns == df.columns
    left = sorted((str(r["doc_id"]), r["text"], r["source"]) for r in kept.collect() if r["text"] and r["text"] not in (c, rows[6][1]))
    assert left == sorted([("5", a, "s0"), ("5", b, "s1"), ("7", d, "s7")])
    assert kept.count() == 6 and kept.where("text is null or text = ''").count() == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    rng = random.Random(1)
    rng.shuffle(chain)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, texts, nothing):
    items = [(1, " ".join(texts[2][1].split()[3:20])), (10, "one two"), (11, None), (12, "..."), (2, "no such words here at all my friend of mine today"), (13, texts[2][1]), (14, "É Ü"), (1, "GURAN")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:] for r in decon.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == {i: brute.hits(t, items) for i, t in texts}
    clean = decon.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, h in got.items() if not h[-1]}
    assert decon.decontaminate(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in decon.decontaminate(docs, bench.limit(0)).collect())


def test_nothing_is_broadcast_beyond_the_bound(spark, docs, texts, monkeypatch):
    """With a bound of no rows, and without the planner's own broadcasts, all joins shuffle and results are the same."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = line_dedup.dedup_lines(docs)
        assert "Broadcast" not in lines._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"]: r["text"] for r in lines.collect()} == brute.line_dedup(texts)
        classes = jaccard_classes(docs, 3, 90, 100)
        assert "Broadcast" not in classes._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()} == brute.components(texts, 3, 90, 100)
        items = [(1, " ".join(texts[2][1].split()[3:20])), (10, "one two")]
        hits = decon.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert {r["doc_id"]: r["n_hit"] for r in hits.collect()} == {i: brute.hits(t, items)[1] for i, t in texts}
        assert mixing.mix_sources(docs).count() == docs.count() and keep_one_each(docs).columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 2 + [(None, "a b c d e f g", "en", None, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(1, "c d e")], "item_id long, text string")
    for got in (quality_rules.quality_rules(df), mixing.mix_sources(df), jaccard_classes(df), decon.decontaminate(df, bench), repeated_bytes.remove_repeats(df), line_dedup.dedup_lines(df)):
        assert got.count() == 4
    assert sorted(r["n_hit"] for r in decon.decontaminate(df, bench).collect()) == [0, 3, 3, 3]
    assert keep_one_each(df).where("doc_id = 1").count() == 1
