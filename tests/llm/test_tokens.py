"""Encoding, the token store and shards, against the tokenizers library and plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import bpe, common, hilbert, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "", " ", "   ", "a", "Hello world", "it's we'll 'S", "a  b   c", "tab\there\n\n new", "  lead", "trail  ", "aaaaaaaaaaaaaaaaaaaaaa",
    "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|endoftext", "日本語のテキスト", "éèê über ñandú", "😀😀 emoji", "1234567 89.5%", " 　 x", "\x1c\x1d a\x00 b",
    "a\x00 \x00 b", "²½ Ⅷ", "foo_bar(baz)[0] == {};", "\r\n\r\nabc", "word " * 300, "z" * 3000, None,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_library_s(spark, library):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH).collect()
    for r in rows:
        assert list(r.ids) == ids_of(library, r.text), r.text
        assert r.decoded == (r.text or "") == library.decode(list(r.ids), skip_special_tokens=False)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_any_text, "library") else test_any_text.library
    test_any_text.library = library
    raw = bpe.encoder(PATH).encode([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, text)


def test_small_memory(monkeypatch, library):
    from threadloom.llm import pretokens

    monkeypatch.setattr(pretokens, "KEPT", 5)
    monkeypatch.setattr(pretokens, "KEPT_FOR_A_WHILE", 3)
    model = bpe.PrefixBpe(PATH)
    own = pretokens.PieceEncoder(lambda p: [np.array(x, dtype="<u4").tobytes() for x in model.encode(p)], bpe.added_tokens(PATH))
    for _ in range(2):
        for i in range(0, len(TEXTS), 3):
            part = TEXTS[i : i + 3]
            assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(part)] == [ids_of(library, t) for t in part]


def test_workers_keep_a_bounded_part_of_the_words():
    """300 000 distinct words leave no more in a worker than the bounds of the encoder and the last batch; before, all stayed."""
    common._HELD.pop("bpe", None)
    own, rng = bpe.encoder(PATH), random.Random(8)
    words = [f"{i:x}" for i in rng.sample(range(16**5, 16**6), 300_000)]
    ids = [own.encode([" ".join(words[i : i + 10_000])])[0] for i in range(0, len(words), 10_000)]
    assert own.encode([" ".join(words[:10_000])])[0] == ids[0] and bpe.decode(np.frombuffer(ids[3], "<u4"), PATH) == " ".join(words[30_000:40_000])
    assert len(own.chunks) <= bpe.KEPT + bpe.KEPT_FOR_A_WHILE + 10_001 < 270_000
    common._HELD.pop("bpe", None)


def test_decoding_any_ids():
    assert bpe.decode([-1, 10**6], PATH) == ""
    assert bpe.decode([50256], PATH) == "<|endoftext|>"


@given(st.lists(st.integers(0, 5000), min_size=0, max_size=300))
@settings(max_examples=100, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(steps) if steps else np.zeros(0, dtype=np.int64)
    packed = token_store.EliasFano.from_bytes(token_store.EliasFano.of(values).to_bytes())
    assert packed.all().tolist() == values.tolist()
    assert [packed.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        packed.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    packed = token_store.EliasFano.of(values)
    assert len(packed.low) + len(packed.high) < 10_000 * (2 + np.log2(values[-1] / 10_000)) / 8 * 1.05


def test_token_store(spark, library, tmp_path):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    token_store.write_store(df, str(tmp_path / "store"), PATH, 2, block_ids=40)
    read = token_store.documents_of(token_store.read_store(spark, str(tmp_path / "store")), with_ids=True).collect()
    read.sort(key=lambda r: r.start)
    assert [r.doc_id for r in read] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in read:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids[:-1])) for r in read) == Counter((i, tuple(ids_of(library, t))) for i, t in rows)
    token_store.write_store(df.limit(0), str(tmp_path / "empty"), PATH, 2)
    assert token_store.documents_of(token_store.read_store(spark, str(tmp_path / "empty"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n\x85\u3000aA9é.'s😀"), max_size=20) | st.text(max_size=30), max_size=6))
def test_chunks_joined_for_the_library(texts):
    if not hasattr(test_chunks_joined_for_the_library, "own"):
        test_chunks_joined_for_the_library.own = token_store.LibraryEncoder(PATH)
    own = test_chunks_joined_for_the_library.own
    own.chunks.clear()
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [ids_of(own.library, t) for t in texts]


def test_library_gets_many_chunks_at_a_time(library):
    own, sent = token_store.LibraryEncoder(PATH), []
    encode_all = own._encode_all
    own._encode_all = lambda texts: sent.extend(texts) or encode_all(texts)
    texts = [" ".join(f"w{i}x" for i in range(4000)), "w1x w2x new", *TEXTS]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [ids_of(library, t) for t in texts]
    assert len(sent) < 50
    own.joined = False
    own.chunks.clear()
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [ids_of(library, t) for t in texts]


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (3, 1), (4, 2)])
def test_curve_visits_neighbours(spark, axes, bits):
    cells = spark.range(1 << (axes * bits)).select(
        *[F.shiftright("id", bits * a).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{a}") for a in range(axes)]
    )
    rows = cells.withColumn("h", hilbert.curve_place([F.col(f"x{a}") for a in range(axes)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (axes * bits)))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(axes)) == 1


def test_shards(spark, tmp_path):
    random.seed(2)
    rows = [(random.randint(0, 60), random.choice(["", "same text", None, "é" * random.randint(1, 50)]), random.choice(["en", None]), f"src{random.randint(0, 9)}") for _ in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("slot", F.lit("clash"))
    meta = hilbert.document_metadata(df)
    placed = hilbert.assign_shards(meta, hilbert.document_place(meta), ["doc_id", "text_crc32", "size"])
    out = placed.collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 203 and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    nodes = [n for n in ("PythonUDF", "ArrowEvalPython", "MapInArrow", "MapInPandas") if n in placed._jdf.queryExecution().executedPlan().toString()]
    assert not nodes
    plain = df.drop("slot")
    hilbert.write_shards(plain, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").count().count() == 8
    assert Counter(back.select("doc_id", "text", "lang", "source").collect()) == Counter(plain.collect())
    empty = hilbert.document_metadata(plain.limit(0))
    assert hilbert.assign_shards(empty, hilbert.document_place(empty), ["doc_id", "text_crc32", "size"]).count() == 0


def test_decoding_after_encoding_keeps_no_encoder():
    from threadloom.llm import common

    bpe.encoder(PATH).encode(["some words", "<|endoftext|>"])
    assert bpe.decoder(PATH).decode(np.array([50256])) == "<|endoftext|>" and "bpe" in common._HELD
    assert bpe.decoder(PATH, "bpe_decoding").decode(np.array([50256])) == "<|endoftext|>"
    assert set(common._HELD) == {"bpe_decoding"}
    common.drop_held()
    assert not common._HELD
