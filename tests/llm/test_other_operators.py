"""Pages, dialogues, vectors and classifiers."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import chat, html_extraction, language_id, quality, topk
from flowtide.llm.html_blocks import blocks
from flowtide.llm.queries import ORACLE_SQL, remainder


@pytest.fixture(scope="module")
def labeller():
    return html_extraction.train()


def test_blocks():
    html = '<p>a &amp; b<br>c</p><script>var t="</p>";</script><ul><li>x<li><a href=1>y</a></ul><!-- <p>no</p> --><div class="ad top" id=q>z&nbsp;  &#233;</div><p>open'
    assert [(b.text, b.path.all_names()) for b in blocks(html)] == [("a & b c", ("p",)), ("x", ("ul", "li")), ("y", ("ul", "li")), ("z é", ("div", ".ad", ".top", ".q")), ("open", ("p",))]
    assert blocks(None) == blocks("") == blocks("<br><p></p>") == []
    assert [b.text for b in blocks("a < b <c d='>'>e</c> <!-- never closed")] == ["a < b e"]


def test_labeller_on_unseen_pages(labeller):
    pages = [html_extraction.generate(9_000_000 + i) for i in range(200)]
    got = np.concatenate([np.array(x) for x in labeller.article([p for p, _ in pages])])
    gold = np.concatenate([g for _, g in pages]) > 0
    assert (got == gold).mean() > 0.98


def test_extraction(spark, labeller):
    html = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Title here</h1><p>First &lt;para&gt; with\n  some words. And more of it.</p><p>Second paragraph of the text, with words.</p></article><footer>&copy; site</footer></body></html>'
    rows = [(1, "u", html, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", html, "x")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labeller).collect()
    want = "Title here\n\nFirst <para> with some words. And more of it.\n\nSecond paragraph of the text, with words."
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id == 1) == [(1, "u", want, len(want))] * 2
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id > 1) == [(2, "", 0), (3, "", 0)]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), labeller).count() == 0


def test_chat_against_sql(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "ann", None, " "]), r.choice([None, "", "hé", "long text\n"])) for c in range(20) for t in range(r.randint(1, 9))]
    rows += [(5, 2, "user", "tie"), (5, 2, "user", "tie"), (None, 1, "user", "no dialogue"), (5, None, "user", "no turn"), (99, 1, "system", "alone")]
    rows += [(77, t, "user" if t % 2 else "bob", f"t{t}") for t in range(700)]
    df = spark.createDataFrame([(*x, "view", 1) for x in rows], "conv_id long, turn long, role string, text string, view string, start int")
    for stretch in (256, 2):
        got = sorted(map(str, map(tuple, chat.rotate(df, stretch).select("conv_id", "view", "turn", "place", "chat_role", "name", "rendered", "start", "loss_start", "loss_end").collect())))
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        want = con.execute(f"SELECT conv_id, \"view\", turn, place, chat_role, name, rendered, start, loss_start, loss_end FROM ({ORACLE_SQL['op2_chat_formatting']})").fetchall()
        assert got == sorted(map(str, want))
    assert chat.rotate(df.where("false")).count() == 0


def test_chat_masks(spark):
    df = spark.createDataFrame([(1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", "bye"), (1, 0, "system", "be kind")], "conv_id long, turn long, role string, text string")
    for view, theirs in (("ann", ["hi", "bye"]), ("bob", ["yo"])):
        rows = chat.rotate(df).where(F.col("view") == view).orderBy("place").collect()
        whole = "".join(r.rendered for r in rows)
        assert [whole[r.loss_start : r.loss_end] for r in rows if r.loss_start is not None] == [x + chat.CLOSE for x in theirs]
        assert [r.chat_role for r in rows][0] == "system" and all(whole[r.start :].startswith(r.rendered) for r in rows)


def best(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in ok]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(ok) if b != a and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 100])
def test_top_k(spark, block):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 0.3, 12).tolist()) for i in range(600)]
    rows += [(700, rows[100][1]), (700, rows[100][1]), (701, None), (702, []), (800, [None] * 12), (900, [float("nan")] * 12), (903, [1.0] * 3), (1000, [0.5] * 3), (1100, [1e9] * 12), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, block int, n int").repartition(3)
    assert sorted(map(tuple, topk.top_k(df, 10, block=block).collect())) == best(rows, 10)
    assert topk.top_k(df.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1, 10**9])
def test_lists_are_read_in_part(scale):
    """Far fewer entries than all are read where few dimensions count, and the k best are among the candidates anyway."""
    r = np.random.default_rng(11)
    n, d, k = 3000, 40, 10
    skewed = np.floor(r.standard_t(2, (n, d)) * 100 * 0.6 ** np.arange(d)).astype(np.int64) * scale
    even = r.integers(-5, 6, (n, d)) * scale  # many ties
    for vectors, share in ((skewed, 0.7), (even, 1.0)):
        lists, ids = topk.Lists(vectors), r.permutation(n)
        for mine in range(40):
            query = vectors[mine] // scale if scale > 1 else vectors[mine]
            score = vectors @ query
            every = np.delete(np.arange(n), mine)
            want = every[np.lexsort((ids[every], -score[every]))[:k]]
            for known in (-np.inf, float(score[want[-1]])):
                rows, got = lists.best(ids, query, mine, k, known)
                assert rows.tolist() == want.tolist() and got.tolist() == score[want].tolist()
        assert lists.read < share * 80 * n * d
    assert [x.tolist() for x in topk.Lists(even).best(ids, np.zeros(d, np.int64), 0, 2)] == [[int(i) for i in np.argsort(np.where(np.arange(n) == 0, n, ids))[:2]], [0, 0]]


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "straße über mädchen schön früh", "cc": "niño año señal mañana corazón"}


def documents(n=240):
    r = random.Random(3)
    rows = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        words = [r.choice(LANGS[lang].split()) + r.choice(["", "s", "e"]) for _ in range(r.randint(4, 40))]
        good = r.random() < 0.7
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), lang if r.random() < 0.9 else None, int(good)))
    return rows


def test_language_id(spark):
    rows = documents()
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "aa"), (1003, "über " * 30_000, "bb"), (1003, "über", "bb"), (None, "niño", "cc")]
    df = spark.createDataFrame([x[:3] for x in rows] + extra, "doc_id long, text string, lang string")
    got = language_id.language_id(df, remainder(5) != 0, remainder(5) == 0).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 3 + ["bb"]
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in rows if lang and by[i].held_out]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    nothing = language_id.language_id(df.where("false"), remainder(5) != 0, remainder(5) == 0)
    assert nothing.count() == 0
    assert {r.lang_pred for r in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string")), remainder(5) != 0, remainder(5) == 0).collect()} == {"und"}


def test_many_languages_and_repeated_ids(spark):
    """As many languages as there are texts of one, and ids that a third of all rows share."""
    names = [f"l{i:03}" for i in range(260)]
    rows = [(i * 10 + j, " ".join(f"{name}{chr(97 + k)}" for k in range(8)), name) for i, name in enumerate(names) for j in range(3)]
    rows += [(rows[0][0], f"other text {i % 7}", names[0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = language_id.chosen(df, F.lit(True), 2)
    assert {r["count"] for r in ids.groupBy("lang").count().collect()} <= {1, 2}
    got = language_id.language_id(df, F.col("doc_id") % 10 < 2, F.col("doc_id") % 10 == 2, per_lang=2).where("held_out").collect()
    assert len(got) == 260 and np.mean([r.lang_pred == names[r.doc_id // 10] for r in got]) > 0.95


def test_a_language_of_one_shared_id(spark):
    """Thousands of rows of one id count once: the id's own hash doesn't decide whether the language is learnt."""
    rows = [(i, f"el perro come {i % 5} casa la mesa", "es") for i in range(30)]
    for shared in range(1000, 1006):
        df = spark.createDataFrame(rows + [(shared, f"the dog eats {i % 7} house with things", "en") for i in range(2000)], "doc_id long, text string, lang string")
        assert {(r.lang, r["count"]) for r in language_id.chosen(df, F.lit(True), 10).groupBy("lang").count().collect()} == {("es", 10), ("en", 1)}
    got = language_id.language_id(df, F.lit(True), F.lit(False), per_lang=10).groupBy("lang_pred").count().collect()
    assert {(r.lang_pred, r["count"]) for r in got} == {("es", 30), ("en", 2000)}


def test_labels_that_disagree(spark):
    df = spark.createDataFrame([(i, f"text {i} {'good words' if i % 2 else 'BAD!! WORDS!!'}") for i in range(60)] + [(1, "good words again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (5, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, F.lit(True))
    assert isinstance(model, quality.Model) and np.isfinite(model.w1).all()
    assert quality.fit(df, labels.where("doc_id in (4, 5)"), F.lit(True)) == quality.Constant(0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="supplied tables are not here")
def test_held_out_rows_of_the_supplied_tables(spark):
    """Area under the curve of the quality score, and accuracy of the language, on rows that were not learnt from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marked = quality.quality(docs, labels, remainder(3) != 1, remainder(3) == 1).where("held_out").join(labels, "doc_id").where("quality is not null").select("score", "quality").collect()
    good, bad = ([r.score for r in marked if r.quality == y] for y in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.98
    found = language_id.language_id(docs, remainder(5) != 0, remainder(5) == 0).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.99


def test_language_of_long_texts(spark):
    """Megabyte texts of many words, which differ between languages only in how often letters follow each other."""
    r = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    odds = {lang: r.dirichlet(np.full(26, 0.6), 26) + 0.004 for lang in ("aa", "bb", "cc")}

    def text(lang, n):
        steps = (odds[lang] / odds[lang].sum(axis=1, keepdims=True)).cumsum(axis=1)
        at, out, draws, ends = 0, [], r.random(n), r.random(n) < 0.18
        for x, end in zip(draws.tolist(), ends.tolist(), strict=True):
            at = min(int(np.searchsorted(steps[at], x)), 25)
            out.append(letters[at] + " " * end)
        return "".join(out)

    rows = [(i, text(lang, int(r.integers(80, 600 if lang == "aa" else 6000))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    long = [(1000 + i, text(lang, 1_000_000), lang) for i, lang in enumerate(["aa", "bb", "cc"])]
    df = spark.createDataFrame(rows + long, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.language_id(df, F.col("doc_id") < 1000, F.col("doc_id") >= 1000).collect()}
    assert [(i, got[i].lang_pred) for i, _, _ in long] == [(i, lang) for i, _, lang in long]
    assert all(got[i].score > 0.9 for i, _, _ in long)


def test_stretches_lose_no_ngram():
    import pyarrow as pa

    column = pa.array(["", "ab", "héllo wörld " * 50, None, "xyz" * 7], pa.string())
    whole, parts = np.zeros((5, language_id.FEATURES), bool), np.zeros((5, language_id.FEATURES), bool)
    for into, stretch in ((whole, 1 << 20), (parts, 5)):
        for at, x in language_id.presence(column, stretch):
            np.logical_or.at(into, at, x > 0)
    assert (whole == parts).all() and whole[1].sum() == 3 and not whole[[0, 3]].any()


def test_quality(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows] + [(2000, None, 0.1), (2001, "", 0.1), (None, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(2000, None), (5, rows[5][3])], "doc_id long, quality int")
    got = quality.quality(df, labels, remainder(3) != 1, remainder(3) == 1).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, y) for i, _, _, y in rows if by[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert quality.quality(df.where("false"), labels, remainder(3) != 1, remainder(3) == 1).count() == 0
    assert {r.score for r in quality.quality(df, labels.where("false"), remainder(3) != 1, remainder(3) == 1).collect()} == {0.5}
