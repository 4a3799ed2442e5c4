import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemmata.llm import encode, pack

HAVE = __import__("os").path.exists(encode.VOCABULARY)
pytestmark = pytest.mark.skipif(not HAVE, reason="no vocabulary file")


@pytest.fixture(scope="module")
def codec():
    with open(encode.VOCABULARY, "rb") as f:
        return encode.Codec(encode.load_ranks(f.read()))


ODD = ["", " ", "\n\n α", "x's'll '' ''s", "!'s ?'re", "a" * 3000, "λόγος" * 900, "ἀρχή τοῦ λόγου　β", "<|endoftext|> [UNK]", "١٢٣ 4５6", "éà", "\x1c\x1dα \t\r\n", "😀😀'd😀", "α" * 700 + "  " * 400 + "β" * 700]


@pytest.mark.parametrize("text", ODD)
def test_fragments_give_the_ids_of_the_whole_text(codec, text):
    whole = codec.encoding.encode_ordinary(text)
    for least in (1, 2, 7, 512):
        assert codec.encode(text, least) == whole
        assert "".join(codec.fragments(text, least)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sdtrevml 　αβἀ!?.1２é́")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_any_cut(text):
    with open(encode.VOCABULARY, "rb") as f:
        codec = encode._codec(f.read())
    assert codec.encode(text, 1) == codec.encoding.encode_ordinary(text)


def test_encode_rows(spark, codec):
    texts = [None, "", "   ", "τὸν λόγον 12", "a'b " * 500, "dup", "dup"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df, long=300, span=64).collect()}
    assert got == {i: codec.encoding.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    sizes = {r["doc_id"]: r["n"] for r in encode.encode(df, out="n", count=True, long=300, span=64).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert encode.encode(df.limit(0)).count() == 0


def test_repeated_keys_give_the_same_rows_at_any_length(spark, codec):
    texts = ["λόγος " * 200, "νόμος " * 250, "λόγος " * 200, None, "", "short"]
    df = spark.createDataFrame([(k, t) for k, t in zip((7, 7, 7, 7, None, None), texts)] + [(None, "λόγος " * 300)], "doc_id long, text string")
    want = sorted((r["doc_id"] or 0, codec.encoding.encode_ordinary(r["text"] or "")) for r in df.collect())
    for long in (300, 1 << 20):
        assert sorted((r["doc_id"] or 0, r["ids"]) for r in encode.encode(df, long=long, span=100).collect()) == want
        assert sorted((r["doc_id"] or 0, r["n"]) for r in encode.encode(df, out="n", count=True, long=long, span=100).collect()) == sorted((k, len(v)) for k, v in want)


def containers_are_right(rows, items, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["container"], []).append(r)
    for held in by.values():
        held.sort(key=lambda r: r["position"])
        assert [r["position"] for r in held] == list(range(len(held)))
        at = 0
        for r in held:
            assert r["start"] == at
            at += r["size"]
        assert at <= capacity
    total = {}
    for r in rows:
        total.setdefault(r["doc_id"], []).append((r["piece"], r["size"]))
    for key, size in items.items():
        parts = sorted(total[key])
        assert [p for p, _ in parts] == list(range(len(parts)))
        assert sum(s for _, s in parts) == size
        assert len(parts) == max(1, -(-size // capacity))
    assert len(total) == len(items)
    return len([k for k, held in by.items() if any(r["size"] for r in held)])


def test_pack(spark):
    rng = np.random.default_rng(3)
    sizes = [0, 0, 0, 100, 101, 250, 300, *rng.integers(1, 101, 400).tolist(), *[33] * 200]
    items = {i: int(s) for i, s in enumerate(sizes)}
    df = spark.createDataFrame([(i, s) for i, s in items.items()], "doc_id long, size long")
    rows = pack.pack(df, capacity=100, salts=5).collect()
    used = containers_are_right(rows, items, 100)
    assert used <= -(-sum(sizes) // 100) + 2


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, size long")
    rows = pack.pack(df, capacity=10).collect()
    assert sorted((r["doc_id"], r["container"], r["position"], r["size"]) for r in rows) == [(1, 0, 0, 0), (2, 0, 1, 0)] or len(rows) == 2
    assert pack.pack(df.limit(0), capacity=10).count() == 0
    same = spark.createDataFrame([(7, 4), (7, 4), (7, 4)], "doc_id long, size long")
    assert len(pack.pack(same, capacity=10).collect()) == 3


def test_exact_complements():
    counts = np.zeros(11, dtype=np.int64)
    counts[[7, 3, 6, 2, 1]] = [2, 2, 1, 1, 2]
    patterns = pack.solve(counts)
    assert sum(p.times for p in patterns) == 3
    assert all(sum(p.sizes) == 10 for p in patterns)
