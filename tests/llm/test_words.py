"""Collocations, byte-level BPE by distinct words, and runs of repeated words, against plain Python and the tiktoken library."""

import base64
import random
import re
import tracemalloc
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import byte_bpe, collocations, periodic, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

TEXTS = [
    "", " ", None, "a", "Hello world, it's we'll 'S", "tab\there\n\n new   x", "日本語のテキスト", "😀😀 emoji ñandú", "1234567 89.5%", "\x1c\x1d a\x00 b",
    "<|endoftext|>", "word " * 300, "z" * 3000, "ab" * 700 + "　", "Hello world", "Hello world",
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- byte-level BPE

@pytest.mark.parametrize("block", [1, 200, 1 << 20])
def test_ids_are_the_library_s(spark, library, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(i, t, "kept", "clash") for i, t in enumerate(TEXTS)], "block long, text string, at string, ids string")
    encoded = byte_bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["block", "at", "ids"]
    rows = byte_bpe.decode_ids(encoded.withColumn("copy", F.col("ids")), RANKS, "copy").collect()
    assert Counter(r.block for r in rows) == Counter(range(len(TEXTS)))
    for r in rows:
        text = TEXTS[r.block] or ""
        assert list(r.ids) == library.encode_ordinary(text), text
        assert bytes(r.decoded) == text.encode() and r["at"] == "kept"


def test_no_texts(spark):
    empty = byte_bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.decode_ids(empty, RANKS).count() == 0
    assert byte_bpe.encode_texts(spark.createDataFrame([(None,)], "text string"), RANKS, public_tokenizers.PATTERN).collect()[0].ids == []


def test_decoding_unknown_ids(spark, library):
    rows = [(1, [0, 70_000, -3, 5]), (2, None), (3, []), (3, [5, None, 5])]
    got = byte_bpe.decode_ids(spark.createDataFrame(rows, "i int, ids array<int>"), RANKS).collect()
    first, fifth = library.decode_single_token_bytes(0), library.decode_single_token_bytes(5)
    assert sorted((r.i, bytes(r.decoded)) for r in got) == sorted([(1, first + fifth), (2, b""), (3, b""), (3, fifth * 2)])


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=120) | st.text(alphabet="aeinrst", min_size=40, max_size=200).map(str.encode))
def test_any_word(word):
    ranks = byte_bpe.ranks_of(RANKS)
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert byte_bpe.encode_word(word, ranks) == [ranks[p] for p in parts]


def test_only_words_are_shuffled(spark):
    """Words go out and ids come back; the texts' positions stay where they are."""
    df = spark.createDataFrame([(i, "one two three one two " * 50) for i in range(20)], "i int, text string").coalesce(1)
    encoded = byte_bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert {len(r.ids) for r in encoded.collect()} == {len(tiktoken_ids("one two three one two " * 50))}


def tiktoken_ids(text):
    ranks = byte_bpe.ranks_of(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=30), max_size=6), st.integers(0, 300))
def test_packed_positions(texts, scale):
    number, known = {}, 0
    for text in texts:
        positions = np.array([number.setdefault(x * scale, len(number)) for x in text], dtype=np.int64)
        assert byte_bpe._unpack(byte_bpe._pack(positions, known)).tolist() == positions.tolist()
        known = len(number)
    many = np.arange(70_000)
    assert byte_bpe._unpack(byte_bpe._pack(many, 0)).tolist() == byte_bpe._unpack(byte_bpe._pack(many, 70_000)).tolist() == many.tolist()


# ---------------------------------------------------------------- runs

def runs_of(words):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(12, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text_with_repeats(rng):
    words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]) for _ in range(rng.choice([0, 3, 12, 13, 40, 200]))]
    if len(words) > 10 and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = rng.randint(1, max(1, (len(words) - a) // 2))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    return words


def test_runs_are_all_runs(spark, monkeypatch):
    rng = random.Random(4)
    texts = [text_with_repeats(rng) for _ in range(150)]
    phrase = [f"w{i}" for i in range(40)]
    texts += [phrase * 30, ["x", *phrase, *phrase, "x", *phrase[:39], *phrase], ["é"] * 12, ["É", "é"] * 6, ["a"] * 11]
    rows = [(i, rng.choice(["  ", "\n", " \t"]).join(w) + " ", "clash") for i, w in enumerate(texts)] + [(-1, None, ""), (-2, "", ""), (-3, "a a " * 12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(2)
    for slice_bytes, pairs in ((1, 7), (4000, 500), (1 << 22, 1 << 20)):
        monkeypatch.setattr(periodic, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(periodic, "GRID_PAIRS", pairs)
        got = {r.doc_id: r for r in periodic.find_runs(df).select("*", periodic.longest_run("runs").alias("best")).collect()}
        assert len(got) == len(rows)
        for i, text, _ in rows:
            words = re.findall("[^\x20\x09-\x0d]+", text or "")
            want = runs_of(words)
            assert [tuple(r) for r in got[i].runs] == want, words
            assert got[i].collapsed == collapsed(words, want)
            best = max(want, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            assert (tuple(got[i].best) if got[i].best else None) == best
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_long_and_hostile_texts():
    rng = random.Random(2)
    cases = {"same": ["a"] * 60_000, "two": ["a", "b"] * 30_000, "fibonacci": list("ab"), "plain": [str(rng.randrange(20_000)) for _ in range(60_000)]}
    a, b = ["a"], ["a", "b"]
    while len(b) < 3000:
        a, b = b, b + a
    cases["fibonacci"] = b
    for name, words in cases.items():
        runs, rest = periodic._runs_and_rest([" ".join(words).encode()])
        got = sorted((int(s), int(e - s), int(q)) for _, s, e, q in runs)
        if name == "fibonacci":
            assert got == runs_of(words)
        else:
            assert got == {"same": [(0, 60_000, 1)], "two": [(0, 60_000, 2)], "plain": []}[name]
        assert rest[0] == collapsed(words, got)


def test_common_extensions():
    rng = random.Random(8)
    for _ in range(40):
        words = text_with_repeats(rng) or ["a"]
        number = {w: i + 2 for i, w in enumerate(dict.fromkeys(words))}
        sequence = np.array([number[w] for w in words] + [1])
        pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words))][:3000]
        if not pairs:
            continue
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        got = periodic.CoverLce(sequence).extend(i, j)
        for x, y, common in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
            want = 0
            while y + want < len(words) and words[x + want] == words[y + want]:
                want += 1
            assert common == want


def test_planted_period(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 2, 30, 90])))) for i in range(120)] + [(None, "no id"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("planted", queries.with_planted_period(F.col("text"), F.col("doc_id")))
    changed = 0
    for r in df.collect():
        words = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += words != r.text.split()
        assert (r.planted or "").split() == words
    assert changed > 3


# ---------------------------------------------------------------- collocations

def mined(rows, support=10, cover=50, top=2000):
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + s])) for s in (1, 2, 3) for i in range(len(words) - s + 1))
    out = []
    for lang in total:
        found = []
        for (own, words), a in counts.items():
            if own != lang or len(words) < 2 or a < support:
                continue
            cuts = [(10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            longer = [f for (o, w), f in counts.items() if o == lang and len(w) == 3 > len(words) and f >= support and words in (w[:2], w[1:])]
            if any(100 * f >= cover * a for f in longer):
                continue
            score, k = min(cuts)
            found.append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "É", "é", "\x00x", "city", "a b", *[f"w{i}" for i in range(25)]]
    weights = [8, 8, 4, 4, 1, 1, 1, 2, 1, *[1] * 25]
    rows = []
    for _ in range(n):
        text = rng.choices(words, weights, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice([["New", "York", "City"], ["new", "york", "city"], ["of", "the"]])
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", " , "] if rng.random() < 0.2 else [" "]) for w in text)))
    return rows + rows[:20] * 3 + [("en", None), ("en", ""), ("xx", "...")]


@pytest.mark.parametrize(("support", "top", "shards"), [(10, 2000, 3), (5, 7, 3), (10, 2000, 1), (3, 50, 7)])
def test_phrases_are_those_of_a_full_count(spark, monkeypatch, support, top, shards):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    rows = corpus(support, 220)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(5)
    got = collocations.mine(df, support=support, top=top, shards=shards).drop("cut").collect()
    assert sorted(map(tuple, got)) == mined(rows, support, top=top)
    assert len(got) > (20 if support == 10 else 10)


def test_phrases_with_a_full_bit_table(spark, monkeypatch):
    """Where the table lets everything through, counts are exact all the same."""
    rows = corpus(77, 150)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "bit_table", lambda candidates: b"\xff" * (1 << 17))
    assert sorted(map(tuple, collocations.mine(df).drop("cut").collect())) == mined(rows)


def test_memory_of_phrase_counting():
    """Counting holds what a slice of the text needs, not what its batch needs; hashing holds under 5.2 bytes for each byte of a slice (5.8 before)."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(1500)) for _ in range(120)]
    columns = {"text": texts, "lang": ["en"] * len(texts), "shard": pa.array([i % 3 for i in range(len(texts))], pa.int32())}
    batch, size = pa.RecordBatch.from_pydict(columns), sum(map(len, texts))
    known = np.zeros(1 << 20, dtype=np.uint8)
    known[::8] = 255
    words, peaks = Counter(), []
    for most in (size, size // 6):
        tracemalloc.start()
        for out in collocations.known_phrases(iter([batch]), known.tobytes(), most):
            words.update([n for p, n in zip(out.column("phrase").to_pylist(), out.column("times").to_pylist(), strict=True) if p is None])
            del out
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    tracemalloc.start()
    times = sum(sum(out.column("times").to_pylist()) for out in collocations.local_hashes(iter([batch])))
    hashing = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k * n for k, n in words.items()) == 2 * 120 * 1500 and times == 120 * (1500 + 1499 + 1498)
    assert peaks[1] < 0.4 * peaks[0] and hashing < 5.2 * size, (size, peaks, hashing)


def test_no_phrases(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).count() == 0


def test_large_scores_are_exact(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        a = rng.randint(10, 10**12)
        rows.append((a, a + rng.randint(0, 10**12), a + rng.randint(0, 5)))
    df = spark.createDataFrame([tuple(map(Decimal, r)) for r in rows], "a decimal(19,0), l decimal(19,0), r decimal(19,0)")
    df = df.select(*[F.col(c).cast("long") for c in "alr"])
    got = df.select("a", "l", "r", collocations.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in got)


def test_top_of_one_language_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANK_GROUPS", (3, 2))
    rows = [("en", f"p{i % 90} q{i % 90} r{i % 7}.") for i in range(1800)]
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), top=25).drop("cut").collect()
    assert sorted(map(tuple, got)) == mined(rows, top=25)
