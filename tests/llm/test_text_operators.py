"""Operators on documents against brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from flowtide.llm import decontamination, packing, simhash, substring_dedup, token_counts
from flowtide.llm.components import components

DOCS = "doc_id long, text string, batch string, n long, key string"  # columns whose names clash with the operators' own
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(12, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            at = r.randint(0, len(words))
            words[at:at] = r.choice(shared)
        rows.append([i, r.choice([" ", "\n", "\t ", "  "]).join(words)])
    rows += [[n, None], [n + 1, ""], [n + 2, " \n\t"], [n + 3, rows[3][1]], [n + 4, rows[3][1]], [n + 5, "x " * 30], [n + 6, "x " * 20], [n + 7, "one"], [n + 8, " nb sp  em"]]
    rows += [[n + 9, " ".join(r.choice(vocabulary) for _ in range(20_000))], [n + 10, "y" * 50_000]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "k") for i, t in rows], DOCS)


def removed(rows, window):
    first = {}
    words = [(i if i is not None else float("inf"), WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batch_bytes", [1 << 24, 3000])
def test_substring_dedup(spark, batch_bytes):
    rows = corpus() + [[None, corpus()[3][1]], [None, "n " + corpus()[3][1]], [5, corpus()[7][1]]] + [[None, " ".join(f"null{i}" for i in range(j, j + 400))] for j in range(0, 9, 3)]
    got = substring_dedup.substring_dedup(frame(spark, rows), batch_bytes=batch_bytes).collect()
    want = removed(rows, 13)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=key)
    texts = dict(rows)
    assert all(r.kept_text == texts[r.doc_id] for r in got if not r.n_removed and r.doc_id not in (None, 5))


def test_substring_dedup_in_increments(spark, tmp_path):
    """A stored, compacted index gives the same as all documents at once."""
    rows = corpus(2)
    want = dict(zip((i for i, _ in rows), removed(rows, 13), strict=True))
    got, history = {}, None
    for k, part in enumerate((rows[:50], rows[50:90], rows[90:])):
        docs = frame(spark, part)
        for r in substring_dedup.substring_dedup(docs, history=history, bits=3, batch_bytes=4000).collect():
            got[r.doc_id] = (r.n_words, r.n_removed, r.kept_sha256)
        batched, _ = substring_dedup.in_batches(docs.select("doc_id", "text"), 4000)
        run = substring_dedup.asks(batched, 3)
        substring_dedup.compact(*([run] if history is None else [history, run])).write.parquet(str(tmp_path / str(k)))
        history = spark.read.parquet(str(tmp_path / str(k)))
    assert got == want


def test_words_that_collide():
    """Words whose sums of bytes times powers of an odd number agree modulo 2**64 (Thue-Morse words) are still told apart."""
    import pyarrow as pa

    from flowtide.llm.words import split

    first = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    second = first.translate(str.maketrans("ab", "ba"))
    one, two = split(pa.array([f"{first} {second}"])).digests()
    assert one[0] != one[1] and two[0] != two[1]
    rest = " ".join(f"w{i}" for i in range(12))
    table = pa.table({"doc_id": [1, 2], "text": [f"{first} {rest}", f"{second} {rest}"]})
    assert not substring_dedup.Batch(table, 13).later.any()


def test_keys_shared_by_different_windows():
    """Runs that hold one key with several checks."""
    runs = substring_dedup.Runs()
    runs.add(np.array([3, 7, 7, 7, 9], np.uint64), np.array([1, 1, 2, 5, 1], np.uint32))
    ask = np.array([7, 7, 7, 3, 9, 10], np.uint64), np.array([5, 4, 1, 1, 2, 1], np.uint32)
    assert runs.seen(*ask).tolist() == [True, False, True, True, False, False]


def test_bounds_of_batches(spark):
    r = random.Random(8)
    rows = [[r.randint(0, 300), "x" * r.randint(0, 400)] for _ in range(900)] + [[301, "y" * 20_000], [None, "z" * 900], [None, None]]
    batched, total = substring_dedup.in_batches(frame(spark, rows).select("doc_id", "text"), 2000)
    got = [tuple(x) for x in batched.select("doc_id", "batch", "text").collect()]
    assert len(got) == len(rows) and total == sum(len(t or "") for _, t in rows)
    own = sorted({(i, b) for i, b, _ in got if i is not None})
    assert len(own) == len({i for i, _ in own}) and [b for _, b in own] == sorted(b for _, b in own)
    size, ids = {}, {}
    for i, b, t in got:
        size[b] = size.get(b, 0) + len(t or "")
        ids.setdefault(b, set()).add(i)
    assert all(size[b] <= 2000 or ids[b] in ({None}, {301}) or len(ids[b]) == 1 for b in size) and len(size) < 250
    assert all(b >= substring_dedup.NULLS for i, b, _ in got if i is None)


def test_runs_compact():
    runs = substring_dedup.Runs()
    r = np.random.default_rng(0)
    every = set()
    for _ in range(40):
        keys = np.unique(r.integers(0, 5000, 100).astype(np.uint64))
        seen = runs.seen(keys, keys.astype(np.uint32))
        assert seen.tolist() == [int(k) in every for k in keys]
        runs.add(keys[~seen], keys[~seen].astype(np.uint32))
        every |= set(keys.tolist())
        assert len(runs.runs) < 12 and all((np.diff(k.astype(np.int64)) > 0).all() for k, _ in runs.runs)
    assert not runs.seen(np.array([4], np.uint64), np.array([5], np.uint32))[0]  # the same key with another check
    x = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()


def leaks(rows, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    entries = []
    for i, t in items:
        w = word(t)
        n = min(window, len(w))
        entries += [(i, tuple(w[s : s + n])) for s in range(len(w) - n + 1)] if n else []
    out = []
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for item, key in entries:
            n = len(key)
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == key:
                    hit.update(range(s, s + n))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("max_block,segment", [(1 << 20, 4096), (5000, 40)])
def test_decontamination(spark, max_block, segment):
    rows = corpus(3, 60)
    words = [WORD.findall(t or "") for _, t in rows]
    items = [[i, " ".join(w[2:18])] for i, w in enumerate(words[:8])] + [[100, None], [101, ""], [102, "w7É w14é"], [103, "W5"], [9, " ".join(words[0][2:18])], [200, " ".join(words[-2][50:250])], [None, " ".join(words[10][:15])], [100, "W9 w21é W3"]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(frame(spark, rows), bench, max_block=max_block, segment=segment).drop("item_ids").collect()
    assert sorted(map(tuple, got)) == sorted(leaks(rows, items))
    empty = bench.where("false")
    assert not any(r.contaminated for r in decontamination.decontaminate(frame(spark, rows), empty).collect())
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, fps, bits=4):
    group = list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                group[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("chunk", [1024, 4])
def test_simhash(spark, chunk):
    r = random.Random(4)
    rows = corpus(4, 60)
    for i in range(40):  # near copies in chains
        words = (rows[i % 5][1] or "").split()
        rows.append([1000 + i, " ".join(w for w in words if r.random() > 0.02)])
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_dedup(frame(spark, rows), chunk=chunk).collect()}
    fps = [fingerprint(t) for _, t in rows]
    want = reach([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)}
    assert simhash.simhash_dedup(frame(spark, [])).count() == 0
    assert [x.component_id for x in simhash.simhash_dedup(frame(spark, [[7, "a b"], [7, "a b"]])).collect()] == [7, 7]


def test_components_and_heavy_keys(spark, monkeypatch):
    """A star, a long chain and random trees, with every key of three rows or more joined as a heavy one."""
    import flowtide.llm.components as module

    r = random.Random(14)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)] + [(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(40)] + [(5, None)]
    group = {i: {i} for i in range(230)}
    for a, b in edges[:-1]:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    want = {i: min(g) for i, g in group.items() if min(g) != i}
    df = spark.createDataFrame(edges, "a long, b long")
    for heavy in (3, 1000):
        monkeypatch.setattr(module, "HEAVY", heavy)
        assert {x.node: x.root for x in components(df).collect()} == want


def test_simhash_of_many_copies(spark, monkeypatch):
    import flowtide.llm.components as module

    monkeypatch.setattr(module, "HEAVY", 2)
    rows = [[i, "the same text in every row of these"] for i in range(9, 2, -1)] + [[50, "another text of its own altogether"], [None, "another text of its own altogether"], [None, "nobody has an id here at all"]]
    got = sorted(((x.doc_id, x.component_id) for x in simhash.simhash_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(i, 3) for i in range(3, 10)] + [(50, 50), (None, 50), (None, None)], key=str)


def test_links_of_planted_clusters(spark):
    """Clusters of fingerprints a few bits apart, and chains that only hold through their middle."""
    r = np.random.default_rng(5)
    fps = set()
    for _ in range(30):
        x = int(r.integers(0, 1 << 63))
        for _ in range(int(r.integers(1, 40))):
            fps.add(x)
            for b in r.choice(64, int(r.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for chunk in (1024, 5):
        links = [(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))) for a, b in simhash.links(df, chunk=chunk).distinct().collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
        roots = {f: f for f in fps}
        nodes = spark.createDataFrame([(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))) for a, b in links], "a long, b long")
        for node, root in components(nodes).collect():
            roots[int(np.int64(node).astype(np.uint64))] = int(np.int64(root).astype(np.uint64))
        want = reach(list(range(len(fps))), fps)
        by = {}
        assert all(by.setdefault(w, roots[f]) == roots[f] for f, w in zip(fps, want, strict=True))
        assert len(set(by.values())) == len(by)


def test_golay():
    """All words within three bits of a codeword decode to it."""
    r = np.random.default_rng(6)
    words = r.integers(0, 1 << 12, 200)
    plain = np.array([next(c for c in range(w << 11, (w + 1) << 11) if simhash.decode(np.array([c]))[0] == w and not simhash._tables()[1][simhash._tables()[0][0][c & 255] ^ simhash._tables()[0][1][c >> 8 & 255] ^ simhash._tables()[0][2][c >> 16]]) for w in words.tolist()[:20]])
    for c, w in zip(plain.tolist(), words.tolist()[:20], strict=True):
        for _ in range(50):
            flips = r.choice(23, 3, replace=False)
            assert simhash.decode(np.array([c ^ sum(1 << int(b) for b in flips)]))[0] == w


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows = corpus(7, 80) + [[500, "a <|endoftext|> b"], [500, "again"], [501, " " * 3000 + "x" * 3000]]
    got = packing.pack(frame(spark, rows)).collect()
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*own.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {k[0] for k in pieces} == set(want)
    for (doc, n), parts in pieces.items():
        ids = next(x for x in want[doc] if len(x) == n)
        parts.sort(key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == n
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_of_long_white_space(spark):
    """Runs on which tiktoken's pattern overflows, alone, inside a text, and beside a special string."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [[1, " " * 2_000_000], [2, "\n" * 2_000_000], [3, "a b" + "\t\r" * 600_000 + "c  d"], [4, "é" + " " * 199_999 + "<|endoftext|>"], [5, " " * 200_000 + "x"]]
    want = {i: np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    got = packing.pack(frame(spark, rows)).collect()
    assert {p.doc_id: p.doc_tokens for p in got} == {i: len(x) for i, x in want.items()}
    assert sum(p.length for p in got) == sum(map(len, want.values()))
    assert all(p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes()) for p in got)


def test_projections_are_of_one_text():
    """A key is the same in any batch, whatever stands beside it and whichever white space ends its words."""
    import pyarrow as pa

    texts = ["a b cat", "dog x", "zzz y", "", None, "one\ntwo\tlongerthaneightbytes", "one two longerthaneightbytex", "x" * 100, " é "]
    alone = [packing.projections(pa.array([t], pa.string()))[0].tolist() for t in texts]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        assert packing.projections(pa.array(order, pa.string())).tolist() == [alone[texts.index(t)] for t in order]
    assert packing.projections(pa.array(["one two\tx"]))[0].tolist() == packing.projections(pa.array([" one\ntwo  x\n"]))[0].tolist()
    assert alone[5] != alone[6]


def test_encoder_gives_the_ids_of_tokenizers():
    """tiktoken over the same vocabulary against tokenizers, on random strings of all kinds of characters."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own, encode, r = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.default_encoder(), random.Random(13)
    pools = ["abc XYZ", "0123 .,;'", "\t\n\r \u00a0\u2003\u200b", "éßñüøæœ", "日本語한국어中文", "🙂👩‍👩‍👧🇫🇷", "'s't're've'm'll'd", "<|endoftext|>", "".join(map(chr, range(1, 256))), "".join(map(chr, range(0x300, 0x370))), "مرحبا עברית हिन्दी"]
    for n in range(3000):
        text = "".join(r.choice(r.choice(pools)) if r.random() < 0.97 else chr(r.choice([*range(1, 0xD800), *range(0xE000, 0x110000)])) for _ in range(r.randint(0, 60)))
        text = text if n % 50 else text + "<|endoftext|>" + text
        assert list(encode(text)) == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_hilbert():
    """The curve visits every cell once, a step of one at a time."""
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_token_counts(spark):
    import sentencepiece
    from public_tokenizers import path

    rows = corpus(8, 60) + [[600, "a  b   c ▁ d▁e <s> <unk> \n\n x"], [600, "a  b"], [601, ("lorem ipsum ▁ dolor  sit▁ amet\n") * 300]]
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = sorted((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows)
    for long in (32_768, 40):
        assert sorted(map(tuple, token_counts.token_counts(frame(spark, rows), long=long).collect())) == want
    assert token_counts.token_counts(frame(spark, [])).count() == 0
