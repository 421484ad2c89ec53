"""The operators against plain versions of what they compute, exact round trips and held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, chat, language_id, minhash, packing, simple8b, topk, toxicity, url_lists
from tessera.llm.common import Scratch
from tessera.operators.components import components
from tessera.llm.trees import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- 1 chat


def test_viterbi_is_the_best_of_all_paths(spark):
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    rng = random.Random(1)
    for _ in range(20):
        text = "\n".join(rng.choice(["User: what now?", "Well, this.", "- item one", "assistant: fine.", "    code()", "Do it!"]) for _ in range(rng.randint(1, 6)))
        lines = chat.split_lines([(None, text)])
        emit = model.scores(lines)
        value = lambda path: model.start[path[0]] + emit[0, path[0]] + sum(model.step[lines[i].step][path[i - 1], path[i]] + emit[i, path[i]] for i in range(1, len(path)))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=len(lines)), key=value)
        assert math.isclose(value(tuple(model.viterbi(lines))), value(best))


def test_written_markers_are_recovered(spark):
    table = spark.read.parquet(f"{BIG}/conversations.parquet")
    model = chat.train(table)
    right = total = 0
    names = {"system": "System", "user": "Human", "assistant": "AI"}
    talks = defaultdict(list)
    for r in table.orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role, r.text))
    for rows in talks.values():
        want = [role for role, text in rows if text and text.strip()]
        want = [a for a, b in zip(want, [None, *want]) if a != b]
        got = [role for role, _ in chat.parse_transcript("\n".join(f"{names[role]}: {text}" for role, text in rows if text and text.strip()), model)]
        right += got == want
        total += 1
    assert right / total >= 0.9


def test_roles_of_the_table_stand(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r.conv_id: list(r.roles) for r in chat.op1_chat_format(spark, SF).collect()}
    want = defaultdict(list)
    for r in table.orderBy("conv_id", "turn").collect():
        if r.text and r.text.strip() and want[r.conv_id][-1:] != [r.role]:
            want[r.conv_id].append(r.role)
    assert sum(got[c] == want[c] for c in got) >= 0.95 * len(got)


@pytest.mark.parametrize("rows", [
    [("user", "Is a > b?\na > b holds when a=2"), ("assistant", "ok\nAnswer: 42")],
    [("assistant", "Context: none\n    code(a)\nq] model: 5"), ("user", "User: quoted\nQ: x")],
    [(None, "q] what\na > b\nnothing: here"), ("user", "Assistant: not me")],
])
def test_no_text_is_lost(spark, rows):
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    letters = lambda t: re.sub(r"\s", "", t)
    got = model.turns(rows)
    assert letters("".join(t for _, t in got)) == letters("".join(t for _, t in rows))
    if all(r for r, _ in rows):
        assert [r for r, _ in got] == [r for r, _ in rows]


def test_only_decoded_markers_go(spark):
    rng = random.Random(4)
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    heads = ["User:", "<|assistant|>", "[system]", "**Human:**", "A:", "### Assistant", "a >", "[user>", "Answer", "x:", "- "]
    for _ in range(60):
        text = "\n".join(f"{rng.choice(heads)} {rng.choice(['Why so?', 'It is.', 'code(x)', ''])}" for _ in range(rng.randint(1, 8)))
        lines = [x for x in chat.split_lines([(None, text)]) if x.text.strip()]
        want = "".join(x.bare if x.marker == r else x.text for x, r in zip(lines, model.viterbi(lines)))
        assert re.sub(r"\s", "", "".join(t for _, t in model.turns([(None, text)]))) == re.sub(r"\s", "", want)


def test_withheld_roles_are_recovered(spark):
    got = chat.op1_chat_format(spark, BIG).agg({"n_lines": "sum", "n_recovered": "sum"}).first().asDict()
    assert got["sum(n_recovered)"] >= 0.85 * got["sum(n_lines)"] > 0


# ---------------------------------------------------------------- 2 top-k


def test_topk_prunes_by_coordinates_and_length():
    rng = np.random.default_rng(7)
    centres = np.eye(40) + 0.02 * rng.normal(size=(40, 40))
    x = np.repeat(centres, 20, 0) + 0.01 * rng.normal(size=(800, 40))
    x *= rng.lognormal(0, 0.7, (800, 1))
    order = np.argsort(-np.linalg.norm(x, axis=1))
    x, ids = x[order], np.arange(800)
    top = topk.TopK(ids[::7], x[::7], 5)
    for a in range(0, 800, 80):
        top.meet(ids[a : a + 80], x[a : a + 80])
    assert all(n > 0 for n in top.used.values()), top.used
    scores = np.round(x[::7] @ x.T, 9)
    for k, i in enumerate(ids[::7]):
        want = sorted(((-scores[k, j], j) for j in range(800) if j != i))[:5]
        assert top.near[top.row == k].tolist() == [j for _, j in want]


def test_queries_are_those_that_are_asked_for(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 5)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, k=3, bucket=10, queries=8, asking=F.col("id") % 20 == 0, group=2).collect()
    want = {(i, r + 1, j) for i in range(0, 90, 20) for r, (_, j) in enumerate(sorted((-round(float(x[i] @ x[j]), 9), j) for j in range(90) if j != i)[:3])}
    assert {(r.vec_id, r.rank, r.neighbour) for r in got} == want


@pytest.mark.parametrize("bucket,queries", [(7, 14), (64, 64)])
def test_topk_equals_all_products(spark, bucket, queries):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 6)) * rng.lognormal(0, 1.5, (150, 1)), 1)
    x[10] = x[11] = x[12]
    x[20] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, k=5, bucket=bucket, queries=queries).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append((r.neighbour, r.score))
    scores = np.round(x @ x.T, 9)
    for i in range(150):
        want = sorted(((-scores[i, j], j) for j in range(150) if j != i))[:5]
        assert [n for n, _ in got[i]] == [j for _, j in want]
        assert np.allclose([s for _, s in got[i]], [-s for s, _ in want])


# ---------------------------------------------------------------- 3 packing


def naive_pack(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    seen = Counter(c for _, _, c in items)
    for size, source, cluster in items:
        cluster = cluster if seen[cluster] > 1 else None
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        b = bins[k]
        out.append((k, capacity - b["room"]))
        b["room"] -= size
        b["sources"] |= {source} - {None}
        b["clusters"] |= {cluster} - {None}
    return out


def test_packing_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(30):
        items = sorted(((rng.randint(1, 60), rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.choice(["x", "y", None, rng.random()])) for _ in range(200)), key=lambda t: -t[0])
        got = packing.pack([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 64)
        assert got == naive_pack(items, 64)


def test_packing_covers_each_document_once(spark, docs):
    got = packing.pack_documents(docs).collect()
    spans, bins = defaultdict(list), defaultdict(list)
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        spans[r.doc_id].append((r.doc_offset, r.length))
        bins[r.shard, r.bin].append((r.bin_offset, r.length, source[r.doc_id]))
    want = {r.doc_id: r.n for r in docs.select("doc_id", packing.count_tokens(docs.text).alias("n")).collect() if r.n}
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == want
    for s in spans.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0
    for b in bins.values():
        b.sort()
        assert all(a + n == c for (a, n, _), (c, _, _) in zip(b, b[1:])) and sum(n for _, n, _ in b) <= packing.CAPACITY
        assert len({s for _, _, s in b}) == len(b)


# ---------------------------------------------------------------- 4 toxicity


def test_held_out_toxicity(spark):
    documents, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(documents, labels.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r.toxicity for r in toxicity.score_documents(documents, model).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.filter("doc_id % 2 = 1").collect()]
    bad, good = [p for p, t in held if t], [p for p, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    hits = sum(p >= model.threshold for p in bad) / len(bad)
    alarms = sum(p >= model.threshold for p in good) / len(good)
    assert auc >= 0.97 and hits >= 0.9 and alarms <= 0.03, (auc, hits, alarms)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    s = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * s))).astype(float)
    fit = Isotonic().fit(s, y)
    assert (np.diff(fit(np.sort(s))) >= -1e-12).all()
    order = np.argsort(s)
    ys = y[order]
    minmax = [max(min(ys[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]  # pool-adjacent-violators in closed form
    assert np.allclose(sorted({round(v, 9) for v in minmax}), sorted({round(v, 9) for v in fit.y}))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:400], y[:400])
    assert ((model.decision(x[400:]) > 0) == y[400:]).mean() > 0.9


def slow_features(text, lexicon):
    """The dense features of one text, a token at a time."""
    words = toxicity.Words(lexicon)
    rows = [words._row(t) for t in text.split()]
    n = max(len(rows), 1)
    hits = [(i, r) for i, r in enumerate(rows) if r[0] > 0]
    strong, weak = [h for h in hits if h[1][0] >= toxicity.STRONG], [h for h in hits if h[1][0] < toxicity.STRONG]
    bit = lambda k: sum(r[1] >> k & 1 for r in rows)
    near = sum(any(0 <= i + d < len(rows) and d and rows[i + d][1] & 1 for d in range(-3, 4)) for i, _ in hits)
    return [
        math.log1p(len(rows)), len(strong) / n, len(strong), len({r[4] for _, r in strong}), len(weak) / n, len(weak), sum(r[0] for _, r in hits) / n, max([r[0] for _, r in hits], default=0),
        near / n, bit(0) / n, bit(1) / n, sum(r[2] for r in rows) / n, sum(r[3] for r in rows) / n, bit(2) / n, bit(3), bit(4) / n,
    ]


def test_features_by_hand(docs):
    lexicon = dict.fromkeys(toxicity.SEED, 4.0) | {"bo*": 1.5, "the": 0.4}
    texts = ["", "  ", "You IDIOT!!! st00pid l0ser", "the boat, the boats; bold?", "you " * 40 + "moron" + "!" * 30] + [r.text or "" for r in docs.limit(60).collect()]
    got = toxicity.features(pa.array(texts), lexicon, 1)
    assert np.allclose(got, [slow_features(t, lexicon) for t in texts])


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, (80, 3)).astype(float), (rng.random(80) < 0.4).astype(float)
    model = BoostedTrees(trees=1, depth=1).fit(x, y)
    feature, cut, value = model.nodes[0]
    p = y.mean()
    g, h = p - y, np.full(80, p * (1 - p))
    gain = lambda m: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (m, ~m))
    tried = {(j, c): gain(x[:, j] <= c) for j in range(3) for c in range(8) if 3 <= (x[:, j] <= c).sum() <= 77}
    left = x[:, feature[0]] <= cut[0]
    assert math.isclose(gain(left), max(tried.values()))
    assert math.isclose(value[1], -0.2 * g[left].sum() / (h[left].sum() + 1))


# ---------------------------------------------------------------- 5 near duplicates


def test_groups_equal_all_pairs(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    sig, some = minhash.signatures(pa.array([r.text or "" for r in rows]))
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(rows)):
        if some[i]:
            for j in np.flatnonzero(some & ((sig == sig[i]).mean(1) >= minhash.THRESHOLD)):
                a, b = root(rows[i].doc_id), root(rows[j].doc_id)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.group_id for r in minhash.groups(docs).collect()}
    want = {d: root(d) for d in parent}
    pairs = lambda g: {(a, b) for m in _members(g) for a, b in itertools.combinations(sorted(m), 2)}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.9 * len(pairs(want)) > 0
    # Against the true share of common shingles: all pairs well above the threshold are found, none well below it is a link by itself.
    grams = {r.doc_id: set(zip(w, w[1:], w[2:])) for r in rows if len(w := [x for t in (r.text or "").split() if (x := re.sub(r"^[\W_]+|[\W_]+$", "", t.lower()))]) >= 3}
    ids = sorted(grams)
    share = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if grams[a] and grams[a] & grams[b]}
    near = [p for p, j in share.items() if j >= 0.7]
    assert near and all(got[a] == got[b] for a, b in near)
    groups_ = [m for m in _members(got) if len(m) == 2]
    assert all(share.get(tuple(sorted(m)), 0) >= 0.3 for m in groups_ if set(m) <= grams.keys())


def walked(spark, texts, chunk):
    sigs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    scratch = Scratch(spark, "walk")
    signed = minhash._signed(sigs.select("id", minhash.signature(sigs.text).alias("s")), scratch)
    edges = minhash._edges(signed, 0.5, scratch, chunk)
    roots = {bytes(r.node): bytes(r.root) for r in components(edges, scratch).collect()}
    part = defaultdict(set)
    for r in signed.collect():
        part[roots.get(bytes(r.dg), bytes(r.dg))].add(r.id)
    return sorted(map(sorted, part.values()))


def test_large_buckets_are_cut_without_losing_links(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):  # all share a passage, so that buckets hold texts of many groups
        own = [f"v{rng.randrange(10**6)}" for _ in range(45)]
        texts += [" ".join(base + own), " ".join(base + own[:-2]), " ".join(base + own[2:])]
    assert walked(spark, texts, 4096) == walked(spark, texts, 6) and len(walked(spark, texts, 6)) < len(texts)


def _members(g):
    out = defaultdict(list)
    for d, r in g.items():
        out[r].append(d)
    return out.values()


def test_minima_estimate_jaccard():
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:300] + [f"v{i}" for i in range(100)])
    sig, _ = minhash.signatures(pa.array([a, b]))
    grams = lambda t: set(zip(t.split(), t.split()[1:], t.split()[2:]))
    truth = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.12


def test_planted_copies(spark, docs):
    base = docs.filter("length(text) > 600").orderBy("doc_id").limit(5).collect()
    planted = [(10_000 + i, r.text.upper(), r.lang, r.source, r.n_chars) for i, r in enumerate(base)] + [(20_000 + i, " ".join(w for k, w in enumerate(r.text.split()) if k % 40), r.lang, r.source, r.n_chars) for i, r in enumerate(base)]
    got = {r.doc_id: r.group_id for r in minhash.groups(docs.unionByName(spark.createDataFrame(planted, docs.schema))).collect()}
    for i, r in enumerate(base):
        assert got[10_000 + i] == got[20_000 + i] == got[r.doc_id]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "test")).collect()}
    parent = {n: n for e in edges if None not in e for n in e}

    def root(a):
        return a if parent[a] == a else root(parent[a])

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: root(n) for n in parent if root(n) != n}


# ---------------------------------------------------------------- 6 Simple-8b


def test_simple8b_round_trip():
    rng = np.random.default_rng(9)
    for block in (1, 7, 512):
        rows = [np.zeros(0, np.uint64), np.zeros(1300, np.uint64), np.array([2**60, 0, 2**64 - 1, 2**60 - 1], np.uint64), rng.integers(0, 50_000, 3000).astype(np.uint64), (2 ** rng.integers(0, 63, 900)).astype(np.uint64)]
        words, offsets, per_row = simple8b.encode(np.concatenate(rows), np.array([len(r) for r in rows]), block)
        at = first = 0
        for r, n in zip(rows, per_row):
            blocks = -(-len(r) // block)
            assert (simple8b.decode(words[at : at + n], len(r), np.asarray(offsets[first : first + blocks]), block) == r).all()
            at, first = at + n, first + blocks
    words, _, _ = simple8b.encode(np.full(600, 3, np.uint64), np.array([600]), 600)
    assert len(words) == 20  # 30 ids of 2 bits a word


def slow_words(ids, block):
    """(ids taken, selector, ids) of each block's words by the plain rule: the most ids that any selector covers."""
    out = []
    for a in range(0, len(ids), block):
        rest = [int(x) for x in ids[a : a + block]]
        while rest:
            fits = [(min(int(simple8b.COUNT[s]), len(rest)), s) for s in range(1, 16) if all(x < 1 << int(simple8b.WIDTH[s]) for x in rest[: simple8b.COUNT[s]])]
            take = max(fits)[0] if fits else 1
            out.append(({s for n, s in fits if n == take} or {0}, rest[:take]))
            rest = rest[take:]
    return out


def test_simple8b_words_by_hand():
    rng = np.random.default_rng(10)
    for block in (1, 5, 512):
        for ids in ([0] * 130, [1, 0, 3, 7] * 40, rng.integers(0, 50_257, 900).tolist(), [2**60, 5, 2**60 - 1], (2 ** rng.integers(0, 60, 300)).tolist()):
            words, _, _ = simple8b.encode(np.array(ids, np.uint64), np.array([len(ids)]), block)
            left = [int(w) for w in words]
            for selectors, taken in slow_words(ids, block):
                word = left.pop(0)
                s = word >> 60
                assert s in selectors
                if s:  # among selectors that cover as many any will do
                    assert [word >> (i * int(simple8b.WIDTH[s])) & ((1 << int(simple8b.WIDTH[s])) - 1) for i in range(len(taken))] == taken
                else:
                    assert left.pop(0) == taken[0]
            assert not left


# ---------------------------------------------------------------- 7 language


def naive_ranks(text, top):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip())
    return counts


def test_held_out_language(spark):
    documents = spark.read.parquet(f"{BIG}/documents.parquet")
    model = language_id.train(documents.filter("doc_id % 2 = 0"))
    got = language_id.identify_documents(documents.filter("doc_id % 2 = 1 and length(text) >= 200"), model).join(documents, "doc_id").collect()
    assert sum(r.language == r.lang for r in got) / len(got) >= 0.95


def test_out_of_place_distance_by_hand():
    texts = ["abc abd abc", "ab abc", "zzz", ""]
    owner, gram, count, rank = language_id.ranked(texts, 400)
    for i, t in enumerate(texts):
        want = naive_ranks(t, 400)
        assert sorted(count[owner == i].tolist(), reverse=True) == sorted(want.values(), reverse=True)
    mine = {int(g): int(r) for g, r in zip(gram[owner == 0], rank[owner == 0])}
    profile = {int(g): int(r) for g, r in zip(gram[owner == 1], rank[owner == 1])}
    grams = np.array(sorted(profile), np.uint64)
    model = language_id.Profiles(["x"], grams, np.array([[profile[int(g)] for g in grams]]), 400, 1.0)
    _, dist, _ = model.identify(["abc abd abc"])
    assert dist[0] == pytest.approx(sum(abs(r - profile[g]) if g in profile else 400 for g, r in mine.items()) / (len(mine) * 400))


# ---------------------------------------------------------------- 8 BPE


def test_bpe_equals_plain_merging(docs):
    import tiktoken

    encoder = bpe.load(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    texts = [r.text or "" for r in docs.limit(80).collect()] + ["", " ", "  a  b\n\n c", "日本語🙂 é", "x" * 3000, "ab" * 2000, "don't we'll 123,456"]
    for t in texts:
        ids = encoder.encode(t).tolist()
        assert ids == other.encode_ordinary(t)
        assert encoder.decode(ids) == t


# ---------------------------------------------------------------- 9 URL lists


def test_url_lists_by_hand(spark):
    rng = random.Random(6)
    day = lambda: f"2024-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d}"
    patterns = ["a.example", "b.a.example", "b.a.example/x", "a.example/x/y", "c.example"]
    entries = [(rng.choice("lm"), rng.choice(patterns), rng.choice(["add", "remove"]), day()) for _ in range(60)]
    captures = [(i, f"https://{rng.choice(['', 'b.', 'w.b.'])}{rng.choice(['a', 'c'])}.example/{rng.choice(['', 'x', 'x/y', 'q'])}?z=1", day()) for i in range(300)]
    want = {}
    for i, url, when in captures:
        host, _, path = url.removeprefix("https://").partition("/")
        parts = [p for p in path.partition("?")[0].split("/") if p]
        labels = host.split(".")
        keys = {".".join(labels[k:]) for k in range(len(labels))} | {host + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)}
        active = []
        for name, pattern in {(e[0], e[1]) for e in entries}:
            past = [(d, a == "add") for n, p, a, d in entries if (n, p) == (name, pattern) and d <= when]
            if pattern in keys and past and max(past)[1]:
                active.append((-len(pattern), pattern, name))
        want[i] = min(active)[1:] if active else (None, None)
    got = url_lists.filter_captures(spark.createDataFrame(captures, "page_id bigint, url string, fetched string"), spark.createDataFrame(entries, "list string, pattern string, action string, day string"))
    assert {r.page_id: (r.pattern, r.list) for r in got.collect()} == want
    assert {v[0] is None for v in want.values()} == {True, False}


# ---------------------------------------------------------------- 10 audio


def slow_ima(data, block):
    out = []
    for a in range(0, len(data), block):
        b = data[a : a + block]
        if len(b) < 4:
            break
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 3) + 2)))
                out.append(value)
    return out


def slow_law(kind):
    out = []
    for b in range(256):
        if kind == "ulaw":
            u = ~b & 255
            v = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
            out.append(-v if u & 128 else v)
        else:
            a = b ^ 0x55
            e, m = a >> 4 & 7, a & 15
            v = (m << 4) + 8 if e == 0 else ((m << 4) + 264) << (e - 1)
            out.append(v if a & 128 else -v)
    return out


def test_codecs_by_hand():
    rng = np.random.default_rng(3)
    every = bytes(range(256))
    ulaw, alaw = audio.decode([every, every], ["ulaw", "alaw"])
    assert ulaw.tolist() == slow_law("ulaw") and alaw.tolist() == slow_law("alaw")
    payloads = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 3, 4, 255, 256, 257, 1021, 5000)]
    for p, got in zip(payloads, audio.decode(payloads, ["ima"] * len(payloads))):
        assert got.tolist() == slow_ima(p, audio.BLOCK)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 8000
    got = audio.resample((9000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16), 8000, 16000)
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(got) == 8000 and np.abs(got[200:-200] - want[200:-200]).max() < 90


@pytest.mark.parametrize("source,target", [(8000, 16000), (8000, 11025), (16000, 8000), (8000, 8000)])
def test_resampling_is_a_plain_convolution(source, target):
    x = np.random.default_rng(1).integers(-20000, 20000, 90).astype(np.int16)
    got = audio.resample(x, source, target)
    g = math.gcd(source, target)
    up, down = target // g, source // g
    h = audio.sinc_filter(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, h)[len(h) // 2 :]
    want = x if up == down else np.clip(np.rint(full[: len(x) * up : down]), -32768, 32767)
    assert len(got) == -(-len(x) * up // down) and np.abs(got - want.astype(int)).max() <= 1
