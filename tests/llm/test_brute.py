"""Operators against plain versions on small made-up data."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fieldsheet.llm import chat, decontamination, graph, html_extract, html_pages, language, line_dedup, mixing, near_dedup, quality, simhash, vptree, warc
from fieldsheet.llm.html_dom import Page

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["al", "ber", "cin", "dor", "eth", "fal", "gor", "hin", "ist", "jor", "kel", "lom", "mir", "nos", "olp", "pra", "qua", "rin", "sel", "tum"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOC)


def fp_plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_plain(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        base = prose(r, r.choice([0, 1, 2, 5, 30, 120])) if i % 3 == 0 or not rows else (r.choice(rows)[1] or "") + (" X" if i % 2 else "")
        rows.append((i, base if i % 17 else None, "en", "s"))
    got = {x.doc_id: (x.fp & (2**64 - 1), x.component_id) for x in simhash.group(docs(spark, rows)).collect()}
    fps = {i: fp_plain(t) for i, t, _, _ in rows}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == groups_plain(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def test_covering_masks():
    r = random.Random(2)
    for radius in (3, 5):
        m = [x & (2**64 - 1) for x in simhash.masks(radius)]
        assert len(m) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any(d & x == 0 for x in m)


def test_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {x.node: x.root for x in graph.components(simhash.links(df)).collect()}
    got = defaultdict(set)
    for f in signed:
        got[root.get(f, f)].add(f & (2**64 - 1))
    want = defaultdict(set)
    for f, k in groups_plain(fps, lambda a, b: (a ^ b).bit_count() <= 3).items():
        want[k].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(500, 500 + i) for i in range(1, 30)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    assert got == groups_plain({n for p in pairs for n in p}, lambda a, b: frozenset((a, b)) in pairs)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limits", [{}, {"ALL_PAIRS": 1, "HOT": 2}, {"RADIUS": -1, "COMMON": 2, "PAIRS_AT_ONCE": 3, "BLOCK_BYTES": 64, "CROWD": 2, "BEFORE": 3}])
def test_near_stage(spark, monkeypatch, limits):
    """Also with every bucket a large one, and with a first search that finds nothing, so that the exact one finds all."""
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(5)
    rows = []
    for k in range(12):
        base = prose(r, 120).split()
        rows.append((k * 10, " ".join(base), "en", "s"))
        for j in range(1, 4):
            w = list(base)
            for _ in range((0, 1, 2, 20)[j]):
                w[r.randrange(len(w))] = "new" + str(r.random())[2:8]
            rows.append((k * 10 + j, " ".join(w).upper() if j == 1 else " ".join(w), "en", "s"))
        for j, n in enumerate((8, 14, 20, 25, 27, 40), 4):  # a passage of other words after it
            rows.append((k * 10 + j, " ".join(base) + " " + prose(r, n), "en", "s"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "two words", "en", "s"), (903, "two  WORDS", "en", "s"), (904, "two word", "en", "s"), (905, "a a a a a a", "en", "s"), (906, "a a a a a a a", "en", "s")]
    got = {x.doc_id: x.group_id for x in near_dedup.groups(docs(spark, rows)).collect()}
    sets = {i: frozenset(simhash.shingles((t or "").lower().encode(), 5)) for i, t, _, _ in rows}
    same = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert got == groups_plain(sets, same)
    stay = {x.doc_id for x in near_dedup.keep_first(docs(spark, rows)).collect()}
    assert stay == set(got.values())


def test_dense_bucket_gives_few_pairs():
    r = np.random.default_rng(6)
    n = 3000
    fp = np.zeros(n, np.uint64) ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    a, b = near_dedup._near(0, fp, np.arange(n))
    fp[7] = ~np.uint64(0)
    a, b = near_dedup._near(near_dedup.bucket(np.zeros(1, np.uint64), np.zeros(1, np.int64))[0], fp & ~near_dedup.MASK[0], np.arange(n))
    assert len(a) >= n - 1 and len(set(a.tolist())) == len(a) and (a != b).mean() > 0.99


def test_crowd_links():
    """A tile joins exactly the components that have similar members, with a link fewer than components."""
    r = np.random.default_rng(7)
    base = r.integers(0, 2**40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], r.integers(0, 2**40, k).astype(np.uint64)])) for k in r.integers(0, 16, 80)]
    rep, root, block = np.arange(80), np.concatenate([np.zeros(40, int), np.arange(40, 80)]), r.integers(0, 2, 80)
    before = [[1] if i % 5 == 0 else [] for i in range(80)]
    one = lambda pairs: groups_plain(range(80), lambda i, j: (i, j) in pairs or (j, i) in pairs or root[i] == root[j])
    for blocks in (block, block * 0):
        want = {(i, j) for i in range(80) for j in range(80) if root[i] != root[j] and near_dedup.similar(sets[i], sets[j]) and (blocks[i] != blocks[j] or not blocks.any()) and not (i % 5 == 0 == j % 5)}
        a, b = near_dedup.meet(rep, root, blocks, before, sets)
        assert all(x in want for x in zip(a, b, strict=True)) and len(a) <= 40
        assert one(want) == one(set(zip(a, b, strict=True)))


def test_shared_hashes(monkeypatch):
    """Over batches cut anywhere: all rows of hashes that two classes hold, with one number for a hash."""
    r = np.random.default_rng(7)
    rows = sorted({(int(h), int(k)) for h, k in zip(r.integers(-9, 9, 300) ** 3, r.integers(0, 40, 300), strict=True)} | {(7, k) for k in range(500)} | {(10**6, 1)})
    rows = sorted(rows + rows[::5])
    for common in (5, 1 << 20):
        monkeypatch.setattr(near_dedup, "COMMON", common)
        cuts = [0, *sorted(r.integers(0, len(rows), 12).tolist()), len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[a:b]], pa.int64()), pa.array([x[1] for x in rows[a:b]], pa.int64()), pa.array([50] * (b - a), pa.int64())], ["h", "k", "n"]) for a, b in zip(cuts, cuts[1:])]
        got = [x for b in near_dedup._shared(iter(batches)) for x in b.to_pylist()]
        held = defaultdict(set)
        for h, k in rows:
            held[h].add(k)
        assert {(x["h"], x["k"]) for x in got} >= {(h, k) for h, k in rows if len(held[h]) > 1}
        df = {}
        assert all(df.setdefault(x["h"], x["df"]) == x["df"] for x in got)
        if common > 9999:
            assert df == {h: len(v) for h, v in held.items() if len(v) > 1} and len(got) == sum(df.values())


def test_prefix_filter_loses_no_similar_pair():
    r = np.random.default_rng(8)
    for _ in range(400):
        n = int(r.integers(1, 60))
        x = np.unique(r.integers(0, 2**40, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.1], r.integers(0, 2**40, int(r.integers(0, 1 + n // 8))).astype(np.uint64)]))
        if len(y) and near_dedup.similar(x, y):
            cut = [s[: near_dedup.may_miss(np.int64(len(s))) + near_dedup.must_share(np.int64(len(s)))] for s in (x, y)]
            assert len(np.intersect1d(*cut)) >= max(near_dedup.need(np.int64(len(s))) for s in (x, y))
        union = len(np.union1d(x, y))
        assert near_dedup.similar(x, y) == (len(y) > 0 and len(np.intersect1d(x, y)) >= 0.8 * union)


def test_line_dedup(spark, monkeypatch):
    r = random.Random(7)
    pool = [prose(r, r.randint(1, 6)) for _ in range(15)] + ["short", " \t Spaced LINE here \r", "spaced line here", "ünïcödé abc", "", "LÄNGE ÄÖÜ x"]
    rows = [(i // 2 if i < 6 else i, None if i == 9 else "\n".join(r.choice(pool) for _ in range(r.randint(0, 6))), "en", "s") for i in range(50)]
    lines = {i: (t or "").split("\n") for i, (_, t, _, _) in enumerate(rows)}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 10:
                held[key(x)].add(rows[i][0])
    want = []
    for i, ls in lines.items():
        kept = [x for x in ls if not (len(held[key(x)]) > 1 and rows[i][0] != min(held[key(x)]))]
        want.append((rows[i][0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    for bits in (line_dedup.BITS, 1 << 10):  # with filters that are far too small too
        monkeypatch.setattr(line_dedup, "BITS", bits)
        got = line_dedup.dedup_lines(docs(spark, rows)).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def waterfill(sizes, weights, share):
    t, fixed = [0.0] * len(sizes), set()
    while True:
        left = share * sum(sizes) - sum(2 * sizes[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            return [2.0 * s for s in sizes]
        t = [2.0 * sizes[i] if i in fixed else left * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        over = [i for i in free if t[i] > 2 * sizes[i] + 1e-9]
        if not over:
            return t
        fixed |= set(over)


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, prose(r, r.randint(0, 40)) if i % 11 else None, "en", r.choice(["b", "a", "a", "a", "z", "é", None])) for i in range(400)] + [(5, "same row", "en", "a")] * 2
    got = mixing.allocate(docs(spark, rows), keep=("text",)).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [sum(size(t) for _, t, _, s in rows if s == n) for n in names]
    want = dict(zip(names, waterfill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5), strict=True))
    taken = defaultdict(int)
    for x in got:
        assert x.size == size(x.text) and x.target == pytest.approx(want[x.source]) and len(x.shards) <= 2 and x.source_size == sizes[names.index(x.source)]
        taken[x.source] += x.size * len(x.shards)
    for n in names:
        assert abs(taken[n] - want[n]) <= 40
    again = mixing.allocate(docs(spark, rows).repartition(7), keep=("text",)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_splitting_tree():
    quotas = [1000, 10, 0, 335]
    deal = mixing.split_quotas(quotas, 7, 3)
    assert [sum(c) for c in zip(*deal, strict=True)] == quotas
    assert max(map(sum, deal)) - min(map(sum, deal)) <= 3
    big = np.array([mixing.split_quotas(quotas, 8, s)[0][0] for s in range(300)])
    assert abs(big.mean() - 125) < 2  # each shard's share of a source is right on average


def test_chat(spark):
    e = [("c", 1, 1, "message", "user", "</s>[INST] hi \\l <|x|>\n"), ("c", 2, 2, "message", "assistant", "Hel"), ("c", 3, 2, "delta", None, "lo <"), ("c", 4, 3, "message", "user", "gone"),
         ("c", 5, 2, "regenerate", "assistant", "Bet"), ("c", 6, 2, "delta", "x", "ter"), ("c", 7, 3, "message", "user", None), ("c", 8, 1, "edit", "user", "edited[/INST]"), (None, 1, 1, None, None, "n")]
    m = chat.fold(spark.createDataFrame(e, "conv_id string, seq long, msg long, kind string, role string, text string"))
    out = {r.conv_id: r for r in chat.render(m).withColumn("turns", chat.read_back(chat.F.col("formatted"))).withColumn("loss", chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in out["c"].turns] == [("user", "edited[/INST]"), ("assistant", "Better"), ("user", "")]
    assert out["c"].loss == "Better" and [tuple(t) for t in out[None].turns] == [("", "n")]
    nasty = ["\\", "\\l", "\\b\\l<", "[<|", "|>\n</s>\n", "日本</s>", ""]
    t = spark.createDataFrame([(1, i, "assistant", x) for i, x in enumerate(nasty)], "conv_id long, turn long, role string, text string")
    row = chat.render(chat.fold(chat.turns_to_events(t))).withColumn("turns", chat.read_back(chat.F.col("formatted"))).withColumn("loss", chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans"))).first()
    assert [x.text for x in row.turns] == nasty and row.loss == "".join(nasty)


def template_plain(text):
    t = re.sub("[\x01-\x03]", " ", text or "")
    t = re.sub(r"(?<=[a-zß-ÿ,;:] )[A-ZÀ-Þ][a-zß-ÿ]+", lambda m: "\x03" + m[0], t).lower()
    t = re.sub(r"\d(?:[\d.,]*\d)?", lambda m: f" \x01{m[0]} ", t)
    t = re.sub(rf"(\x01[^ ]*)\s+({decontamination.UNITS})(?!\w)", r"\1 " + "\x02" + r"\2", t)
    t = re.sub(r"(?<=\d)[.,](?=\d)", "_", t).replace("ß", "ss")
    return re.sub(r"[^\w\x01-\x03]+", " ", t).split()


def contaminated_plain(text, item):
    a, b = template_plain(text), template_plain(item)
    mark = lambda w: w[0] if w[0] in "\x01\x02\x03" else w
    wins = lambda t: [tuple(map(mark, t[i : i + 5])) for i in range(max(1, len(t) - 4))] if t else []
    wa, wb = wins(a), wins(b)
    by = defaultdict(list)
    for i, x in enumerate(wa):
        for j, y in enumerate(wb):
            if x == y:
                by[i - j].append((i, j))
    found = set()
    for shift in by.values():
        stands, clash = {}, False
        for i, j in shift:
            for x, y in zip(a[i : i + 5], b[j : j + 5], strict=False):
                if y[0] in "\x01\x02\x03":
                    clash |= stands.setdefault(y, x) != x
        found |= {wb[j] for i, j in shift if not clash or not any(y[0] in "\x01\x02\x03" for y in b[j : j + 5])}
    return bool(wb) and len(found) >= 0.8 * len(set(wb))


def test_decontamination(spark):
    r = random.Random(9)
    items = [(1, "If Tom has 12 apples and buys 30 kg more for Tom at 2.5 dollars how much is left of 12 apples"), (2, prose(r, 30)), (3, prose(r, 15) + ". Die " + prose(r, 9)), (4, "one two"), (5, ""), (6, None), (7, items_copy := prose(r, 20)), (8, items_copy)]
    reworded = "so If Tom has 7 apples and buys 9 km more for Tom at 3 euros how much is left of 7 apples"
    clash = "so If Tom has 7 apples and buys 9 km more for Tom at 3 euros how much is left of 8 apples"
    texts = [reworded, clash, prose(r, 50) + " " + items[1][1].upper() + "!! " + prose(r, 20), prose(r, 200), items[2][1].replace(" ", "%%% "), "One  TWO!", "one two three", None, "", items_copy, " ".join(items[1][1].split()[:15]), prose(r, 5) + " " + items[2][1][:-20]]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s")])
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, x in items if contaminated_plain(t, x)}
    assert got == want and {(0, 1), (2, 2), (4, 3), (5, 4), (9, 7), (9, 8)} <= got and (1, 1) not in got and (6, 4) not in got


def test_warc(spark, tmp_path):
    r = random.Random(10)
    rows = []
    for i in range(120):
        kind = r.choice(["response", "revisit"])
        url = r.choice(["http://A.example/x/", "https://www.a.example/x?utm_q=1#f", "http://b.example:80/y?b=2&a=1", "https://b.example/y?a=1&b=2", None])
        rows.append((i, url, r.choice([None, *range(0, 400_000, 40_000)]), kind, r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "Mon"]), None, {"etag": '"1"', "age": str(i), "content-length": str(i)} if i % 3 else None))
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema)
    key = lambda u: None if u is None else "a.example/x" if "a.example" in u.lower() else "b.example/y?a=1&b=2"
    want = {}
    for i, u, ts, kind, etag, mod, _, _ in rows:
        if kind == "revisit":
            c = [x for x in rows if x[3] == "response" and u and ts is not None and x[2] is not None and key(x[1]) == key(u) and x[2] < ts]
            if not c:
                want[i] = (None, "unresolved")
                continue
            b = max(c, key=lambda x: (x[2], x[0]))
            pairs = [(etag and etag.removeprefix("W/"), b[4] and b[4].removeprefix("W/")), (mod, b[5])]
            known = [x == y for x, y in pairs if x and y]
            want[i] = (b[0], "mismatch" if False in known else "resolved" if known else "unverified")
    got = warc.resolve(df).collect()
    assert {x.record_id: (x.response_id, x.outcome) for x in got} == want
    for x in got:
        if x.outcome == "resolved" and rows[x.record_id][7] and rows[x.response_id][7]:
            assert x.headers["age"] == str(x.record_id) and x.headers["content-length"] == str(x.response_id)
    data = b"".join(bytes(x.warc) for x in warc.to_warc(df.where("ts IS NOT NULL AND url IS NOT NULL")).orderBy("record_id").collect())
    (tmp_path / "a.warc").write_bytes(data)
    back = {x.record_id: (x.url, x.ts, x.kind, x.headers) for x in warc.read_warc(spark, str(tmp_path)).collect()}
    assert back == {x[0]: (x[1], x[2], x[3], x[7] or {}) for x in rows if x[1] and x[2] is not None}


def test_nearest(spark):
    r = np.random.default_rng(11)
    v = r.normal(size=(600, 8)).astype(np.float32)
    v[::5] = v[0]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(700, None), (800, [0.0] * 8), (900, [float("nan")] * 8), (1000, [1.0, None] + [0.0] * 6), (1100, [1.0, 2.0]), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in vptree.nearest(df).collect()}
    want, d = {}, v.astype(np.float64)
    for q in range(0, 600, 100):
        dist = vptree.distances(d[q : q + 1], d)[0]
        for k, j in enumerate(sorted((j for j in range(600) if j != q), key=lambda j: (dist[j], j))[:10], 1):
            want[q, k] = (j, dist[j])
    assert got == want  # exact: recall 1
    loose = {(x.query_id, x.vec_id) for x in vptree.nearest(df, factor=1.5).collect()}
    assert len(loose & {(q, j) for (q, _), (j, _) in want.items()}) >= 0.5 * len(want)


def test_vptree_prunes():
    r = np.random.default_rng(12)
    t = vptree.Tree(r.normal(size=(4000, 3)))
    q = r.normal(size=(20, 3))
    best, dist = t.search(q, 5, 1.0)
    d = vptree.distances(q, t.points)
    assert (np.sort(d, axis=1)[:, :5] == dist).all()


def test_quality(spark):
    r = random.Random(13)
    rows = []
    for i in range(900):
        good = i % 3 > 0
        n = r.randint(20, 150)
        text = ". ".join(prose(r, 9).capitalize() for _ in range(n // 9)) + "." if good else " | ".join(prose(r, 1) for _ in range(n)) if i % 2 else prose(r, n).upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)] + [(5000, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), labels)
    got = {x.doc_id: x.score for x in quality.score(docs(spark, rows + [(9999, None, None, None), (9998, "", "en", "s")]), model, "doc_id").collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in held]) >= 0.97 and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(docs(spark, []), labels) is None
    # The score is the logistic of the difference of two Gaussian log densities.
    x = np.array([quality.statistics(t.encode()) for _, t, _, _ in rows])
    m = model
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k] @ m.factors[k].T)
        diff = x - m.means[k]
        assert np.allclose(((diff @ m.factors[k]) ** 2).sum(1), np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff), rtol=1e-6)


def longest_phrases(text, training):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in training and text[i : i + k] in training:
            k += 1
        i += k
        n += 1
    return n


def test_language(spark):
    r = random.Random(14)
    train = [r.randrange(1, 6) for _ in range(400)]
    a = language.Automaton(train)
    joined = "".join(map(str, train))
    other = language.Automaton(train[:50])
    texts = [[r.randrange(0, 7) for _ in range(n)] for n in (1000, 256, 100, 7, 1)]
    sizes = np.array([len(s) for s in texts])
    got = language.phrases([a.table, other.table], np.array(sum(texts, []), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
    for k, t in enumerate((joined, joined[:50])):
        assert got[k].tolist() == [longest_phrases("".join(map(str, s)), t) for s in texts]
    sets = {"xx": ["ka", "to", "mi", "re"], "yy": ["str", "ong", "ley", "ish"], "zz": ["éau", "que", "ont", "ère"]}
    say = lambda k, n: " ".join("".join(r.choice(sets[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(k := "xyz"[i % 3] * 2, r.randint(5, 200)), k, "s") for i in range(300)]
    extra = [(1000, None, "xx", "s"), (1001, "123 !?", "xx", "s"), (1002, "", None, "s"), (1003, "A" * 100_000, "xx", "s"), (None, "katomi", "xx", "s")]
    model = language.fit(docs(spark, rows))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(docs(spark, rows + extra), model, "doc_id").collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i][0] == rows[i][2] for i in held) and all(0 <= s <= 1 for _, s in got.values())
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0) and got[1003][0] in sets
    none = language.fit(docs(spark, []))
    assert {x.lang_pred for x in language.identify(docs(spark, rows[:3]), none, "doc_id").collect()} == {"und"}


def test_html_extraction():
    rng = random.Random(99)
    pages = [html_pages.page(rng) for _ in range(200)]
    want = []
    for h in pages:
        p = Page(h)
        b = html_extract.Batch([p], training=True)
        state, blocks = [0] * len(p.tags), {}
        for i, k in enumerate(b.keep.tolist()):
            state[i] = k if k >= 0 else state[p.parents[i]] if i else 0
        for o, k, t in zip(p.text_owner, p.text_block, p.texts, strict=True):
            if state[o]:
                blocks.setdefault(k, []).append(t)
        want.append("\n".join(x for x in (" ".join("".join(v).split()) for v in blocks.values()) if x))
    got = html_extract.extract(pages, html_extract.model())
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) >= 0.95  # pages not trained on
    odd = ["", None, "<", "plain", "<p>a<!-- open", "<div " * 2000, "<div>" * 20_000 + "x", "<p>1 &lt; 2 &amp; 3</p>", "<script>x</script>", "<textarea><p>q"]
    assert len(html_extract.extract(odd, html_extract.model())) == len(odd) and html_extract.extract(odd, html_extract.model())[:2] == ["", ""]


def test_dom_rules():
    p = Page("<p><b>one<br><p>two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><script>'</p>'</script>e &copy; &amp;lt;")
    blocks = {}
    for k, t in zip(p.text_block, p.texts, strict=True):
        blocks.setdefault(k, []).append(t)
    assert [" ".join("".join(v).split()) for v in blocks.values() if "".join(v).strip()] == ["one", "two", "a", "b", "c", "d", "e © &lt;"]
