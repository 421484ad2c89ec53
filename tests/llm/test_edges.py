"""Every operator on messy tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, chat, language_id, minhash, packing, simple8b, topk, toxicity, url_lists

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("id", "tokens", "shard", "sig", "dg", "node", "count", "keep", "group_id", "toxic", "toxicity", "language", "order", "rest", "cluster", "fold", "x", "n", "words", "p")


def clash(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})

WORDS = "the river runs through green hills and every small boat follows its own slow path toward the open sea".split()
LONG = " ".join(WORDS[(i * i) % len(WORDS)] + str(i % 97) for i in range(60_000))


def rows():
    base = " ".join(WORDS)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "   \n\t ", "en", None, 5), (6, LONG, "en", "c", 1),
        (None, "a row without an id", None, "a", 1), (7, "!!! ... ???", "en", "a", 1), (8, "日本語 のテキスト 🙂 é  x", "xx", "d", 1), (9, base.upper(), "en", "b", 1),
    ]


@pytest.fixture(scope="module")
def messy(spark):
    return clash(spark.createDataFrame(rows(), DOCS))


@pytest.fixture(scope="module")
def empty(spark):
    return clash(spark.createDataFrame([], DOCS))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (9, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_toxicity(messy, empty, labels):
    got = toxicity.score_documents(messy, toxicity.train(messy, labels)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(by[k].toxicity == 0.0 and by[k].toxic == 0 for k in (3, 4, 5))
    assert by[1].toxicity == by[2].toxicity
    assert toxicity.score_documents(empty, toxicity.train(empty, labels)).count() == 0


def test_language(messy, empty):
    model = language_id.train(messy)
    got = language_id.identify_documents(messy, model).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(by[k].language == "und" and by[k].distance == 1.0 for k in (3, 4, 5, 7))
    assert language_id.identify_documents(messy, language_id.train(empty)).filter("language <> 'und'").isEmpty()
    assert language_id.identify_documents(empty, model).count() == 0


def test_minhash(messy, empty):
    got = {r.doc_id: r for r in minhash.groups(messy).collect()}
    assert sorted(got) == list(range(1, 10))
    assert got[1].group_id == got[2].group_id == got[9].group_id == 1 and got[1].keep == 1 and got[2].keep == 0
    assert all(got[k].group_id == k and got[k].keep == 1 for k in (3, 4, 5, 6, 7, 8))
    kept = minhash.deduplicate(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None])
    assert minhash.groups(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_packing(messy, empty):
    got = packing.pack_documents(messy, capacity=128).collect()
    assert not {r.doc_id for r in got} & {3, 4, 5}
    assert None in {r.doc_id for r in got}
    assert all(0 < r.length and r.bin_offset + r.length <= 128 for r in got)
    assert sum(r.length for r in got if r.doc_id == 6) == 60_000
    same = [(r.shard, r.bin) for r in got if r.doc_id in (1, 2)]
    assert len(same) == len(set(same)) == 3  # equal texts never share a bin
    assert packing.pack_documents(empty).count() == 0


def test_tokens(messy, empty):
    packed = simple8b.pack_documents(messy)
    ids = {(r.doc_id, tuple(r.token_ids)) for r in bpe.encode_documents(messy).collect()}
    assert {(r.doc_id, tuple(r.token_ids)) for r in simple8b.unpack_documents(packed).collect()} == ids
    back = Counter((r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(messy)).collect())
    assert back == Counter((d, t or "") for d, t, *_ in rows())
    assert simple8b.pack_documents(empty).count() == 0 and bpe.encode_documents(empty).count() == 0
    assert packed.filter("doc_id in (3, 4)").filter("n_tokens <> 0 or length(words) > 0 or size(block_offsets) > 0").isEmpty()


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    data = [(1, 0, "user", "Hi there?"), (1, 0, "user", "Hi there?"), (1, 1, None, "Hello."), (2, 0, None, None), (None, 0, "bogus", ""), (3, None, "user", "late"), (3, 0, "system", LONG), (4, 0, "user", "<|end|> trick")]
    df = spark.createDataFrame(data, schema).withColumns({c: F.lit(1) for c in ("conv", "rows", "last", "f", "c")})
    model = chat.train(df)
    got = {r.conv_id: r for r in chat.format_conversations(df, model).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert got[2].n_turns == 0 and got[2].rendered == "" and got[None].n_turns == 0
    assert got[1].rendered.count("Hi there?") == 1
    assert list(got[3].roles) == ["system", "user"]
    assert got[4].rendered.count("<|end|>") == 1
    assert chat.format_conversations(df.limit(0), model).count() == 0
    assert chat.format_conversations(df, chat.train(df.limit(0))).count() == 5


def test_topk(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (None, [9.0, 9.0]), (8, [0.5, 0.5]), (9, [None, 1.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(3) for c in ("id", "vec", "norm", "block", "order", "key")})
    got = sorted((r.vec_id, r.rank, r.neighbour, r.score) for r in topk.top_k(df, k=2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 8, 0.5), (2, 1, 1, 1.0), (2, 2, 8, 0.5), (6, 1, 1, 0.0), (6, 2, 2, 0.0), (8, 1, 1, 0.5), (8, 2, 2, 0.5)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_urls(spark):
    entries = spark.createDataFrame([("l", "bad.example", "add", "2024-01-10"), ("l", "bad.example", "add", "2024-01-10"), ("l", "bad.example", "remove", "2024-01-10"), ("l", "bad.example", "remove", "2024-02-01"), ("m", None, "add", "2024-01-01")], "list string, pattern string, action string, day string")
    data = [(1, "http://x.bad.example/a", "2024-01-09"), (1, "http://x.bad.example/a", "2024-01-09"), (2, "http://x.bad.example/a", "2024-01-10"), (3, "http://BAD.example.:80", "2024-01-31"), (4, "http://bad.example", "2024-02-01"), (5, None, "2024-01-15"), (6, "", "2024-01-15"), (7, "http://bad.example", None), (None, "//bad.example/", "2024-01-15"), (8, "http://" + "a." * 2000 + "bad.example/" + "p/" * 2000, "2024-01-15")]
    df = spark.createDataFrame(data, "page_id bigint, url string, fetched string").withColumns({c: F.lit(1) for c in ("id", "pattern", "list", "blocked", "m", "h_id")})
    got = Counter((r.page_id, r.blocked) for r in url_lists.filter_captures(df, entries).collect())
    assert got == Counter({(1, 0): 2, (2, 1): 1, (3, 1): 1, (4, 0): 1, (5, 0): 1, (6, 0): 1, (7, 0): 1, (None, 1): 1, (8, 1): 1})
    assert url_lists.filter_captures(df.limit(0), entries).count() == 0
    assert url_lists.filter_captures(df, entries.limit(0)).filter("blocked = 1").isEmpty()


def test_audio(spark):
    data = [(1, "ulaw", bytes(range(256))), (1, "ulaw", bytes(range(256))), (2, "mp3", b"xx"), (3, None, b"xx"), (4, "alaw", None), (5, "ima", b""), (6, "ima", b"\x00\x00\xff\x00" + b"\x17" * 700), (7, "alaw", b"\x55" * 300_000), (None, "ulaw", b"a")]
    df = spark.createDataFrame(data, "id bigint, codec string, payload binary").withColumns({c: F.lit(1) for c in ("pcm", "n_samples", "sample_rate")})
    got = audio.decode_audio(df).collect()
    assert len(got) == len(data)
    by = {r.id: r for r in got}
    assert by[2].pcm is None and by[3].n_samples is None and by[4].pcm is None
    assert by[5].n_samples == 0 and bytes(by[5].pcm) == b""
    assert by[7].n_samples == 600_000 and by[1].n_samples == 512
    assert audio.decode_audio(df.limit(0)).count() == 0
