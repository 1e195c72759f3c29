"""Best-fit packing, ranked lexical search and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flowtide.llm import best_fit, lexical_search, periodic_runs
from flowtide.llm.queries import ORACLE_SQL, op13_periodic_runs, repeated_tail

DOCS = "doc_id long, text string, serial string, row int, runs int, bin int, term string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], DOCS).repartition(parts)


codes = lambda: lambda text: [ord(c) for c in text]  # noqa: E731  a lambda, which Spark sends by value


@pytest.mark.parametrize(("node", "near", "keep", "fan"), [(4096, 16, 64, 16), (20, 1, 3, 2), (5, 0, 1, 3)])
def test_best_fit_round_trip(spark, node, near, keep, fan):
    r = random.Random(node)
    rows = [(i, "".join(r.choice("abcé") for _ in range(r.choice([0, 1, 5, 20, 49, 50, 51, 99, 200, 777])))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, "abc"), (500, None), (501, "x" * 49), (502, "x" * 99)]
    got = best_fit.pack_best_fit(frame(spark, rows), 50, 0, codes, node, near, keep, fan).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append([*map(ord, t or ""), 0])
    assert set(by_doc) == set(texts)
    for doc, many in texts.items():
        want = Counter()
        for ids in many:
            over = len(ids) % 50
            edges = sorted({0, over, *range(over, len(ids) + 1, 50)})
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                want[i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4"))] += 1
        assert Counter((p.piece, p.start, p.length, p.ids_crc32) for p in by_doc[doc]) == want
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) <= 50
    if node == 4096:  # one node: no fewer than plain best-fit, which stays within 11/9 of the best
        total = sum(p.length for p in got)
        assert len(by_sequence) <= 11 / 9 * -(-total // 50) + 1


def test_best_fit_of_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "Hello <|endoftext|> world"), (2, "é" * 5000), (3, None), (4, "word " * 3000)]
    got = best_fit.pack_best_fit(frame(spark, rows)).collect()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in got if p.doc_id == i), key=lambda p: p.piece)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length]) for p in own) and all(p.length == 2048 for p in own[1:])


def test_no_bins_are_left_that_fit_together(spark):
    rows = [(i, "a" * (i % 37)) for i in range(2000)]
    got = best_fit.pack_best_fit(frame(spark, rows), 50, 0, codes, 100, 0, 64, 4).collect()
    fill = Counter()
    for p in got:
        fill[p.sequence_id] += p.length
    assert len(fill) <= 1.02 * sum(fill.values()) / 50 + 1
    assert best_fit.pack_best_fit(frame(spark, rows).where("false")).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    def terms(t):
        return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(t or "")]

    every = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(n for *_, n in every), Counter(w for _, c, _ in every for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in every:
            m = 100 - 25 + (25 * n * len(every)) // total
            s = sum(math.floor(1000 * math.log((2 * len(every) + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("max_terms", "per_block", "k"), [(500_000, 1 << 16, 20), (40, 30, 3), (500_000, 7, 1)])
def test_lexical_search(spark, max_terms, per_block, k):
    r = random.Random(k)
    vocabulary = ["the", "The", "é", "Éa", "x1", *(f"w{i}" for i in range(60))]

    def text(n):
        return r.choice([" ", "-", "\n"]).join(vocabulary[min(int(r.expovariate(0.08)), 64)] for _ in range(n))

    docs = [(i, text(r.choice([0, 1, 3, 30, 200]))) for i in range(150)] + [(3, "the w1 w2"), (3, "the w1 w2"), (None, "the w1 w2"), (900, None), (901, " -- "), (902, "w5 " * 4000)]
    docs += [(1000 + i, "same words w3 w9") for i in range(60)]
    items = [(i, text(r.choice([1, 4, 25]))) for i in range(12)] + [(4, None), (5, ""), (5, "w3 w9 w3"), (None, "w1 the"), (77, "nowhere")]
    benchmark = spark.createDataFrame([(i, t, 1, "z") for i, t in items], "item_id long, text string, row int, terms string")
    got = lexical_search.lexical_search(frame(spark, docs), benchmark, k, max_terms, per_block).collect()
    assert sorted(str(tuple(x)) for x in got) == ranked(docs, items, k)


def test_lexical_search_of_nothing(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([("q", "a"), ("r", "zz")], "item_id string, text string")
    assert [tuple(x)[:3] for x in lexical_search.lexical_search(docs, items).collect()] == [("q", 1, 1)]
    assert lexical_search.lexical_search(docs.where("false"), items).count() == 0
    assert lexical_search.lexical_search(docs, items.where("false")).count() == 0


def plain_runs(w, least=6, periods=4):
    out = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda x: (x[0], x[2]))


def periodic(r, size):
    w = []
    while len(w) < size:
        w += [r.choice("abcde"[: r.choice([1, 2, 5])]) for _ in range(r.randint(1, 7))] * r.randint(1, 7)
    return w[:size]


@pytest.mark.parametrize(("least", "periods"), [(6, 4), (2, 2), (9, 3)])
def test_runs_of_arrays(least, periods):
    r = random.Random(periods)
    for _ in range(400):
        docs = [periodic(r, r.choice([0, 1, 5, 12, 40, 90])) for _ in range(r.randint(1, 4))]
        x = np.array([v for k, w in enumerate(docs) for v in [*map(ord, w), -1 - k]], np.int32)
        at, want = 0, []
        for w in docs:
            want += [(s + at, n, p) for s, n, p in plain_runs(w, least, periods)]
            at += len(w) + 1
        assert [tuple(v) for v in periodic_runs.runs_of(x, max(map(len, docs)), least, periods).tolist()] == want


def test_long_runs():
    x = np.array([7] * 30_000 + [-1] + [*range(500)] * 60 + [-2], np.int32)
    assert periodic_runs.runs_of(x, 30_000).tolist() == [[0, 30_000, 1], [30_001, 30_000, 500]]


def test_periodic_runs_query(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(periodic(r, r.choice([0, 3, 30, 120])))) for i in range(400)]
    rows += [(5, rows[5][1]), (None, "a a a a a a"), (401, None), (402, "é é " * 50), (403, "  ")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect())))
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if (other := repeated_tail(i, len(w))) is not None:
            w = [w[k] for k in other]
        runs = plain_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = " ".join(v for k, v in enumerate(w) if k not in gone)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(map(str, want)) and sum(x[1] > 0 for x in want) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    assert sorted(map(str, con.execute(ORACLE_SQL["op13_periodic_runs"]).fetchall())) == [x for x in got if not x.startswith("(None")]
    assert periodic_runs.periodic_runs(frame(spark, rows).where("false")).count() == 0
