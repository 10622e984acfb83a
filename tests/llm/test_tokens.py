"""Token ids, the binary file and packing: exact round trips and invariants."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import packing, pfor, tokens
from foliant.llm.queries import QUERIES, tokenizer_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbcé0 1.,'s\n\t\r\x0b\x0c\x1c\x85\xa0 ßİΣ!#&日́ĠĊ")), max_size=30), max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    for name in FILES:
        work = tokens.encoder(tokenizer_path(name))
        work.pieces.clear()
        assert [np.frombuffer(x, "<u2").tolist() for x in work.ids([t.encode() for t in texts])] == plain(name, texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700), st.integers(1, 3), st.integers(50, 100))
def test_segments_round_trip(ids, docs, percentile):
    values = np.array(ids, np.uint32)
    data = pfor.encode_segment(values, [len(ids)] + [0] * (docs - 1), 64, percentile)
    segment = pfor.Segment(data)
    assert segment.read().tolist() == ids and segment.doc_lengths.sum() == len(ids)
    assert segment.read(1, 2).tolist() == ids[64:128]


def test_outliers_are_exceptions():
    values = np.array([5] * 250 + [60_000] * 6, np.uint32)
    assert len(pfor.encode_segment(values, [256])) < len(pfor.encode_segment(values, [256], percentile=100.0))


def expected_file(rows, name="byte_bpe_50k.json"):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, out = 0, []
    for (doc_id, _), ids in zip(rows, plain(name, [t for _, t in rows]), strict=True):
        data = np.array([*ids, 2], "<u4")
        out.append((doc_id, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    return sorted(out, key=repr)


def test_token_file_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op9_token_binary"](spark, sf_dir).collect()), key=repr) == expected_file(rows)


def test_token_file_odd_rows(odd_rows, no_rows):
    rows = [tuple(r) for r in odd_rows.select("doc_id", "text").collect()]
    found = pfor.token_file(odd_rows, tokenizer_path("byte_bpe_50k.json"), segment_ids=500)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected_file(rows)
    assert pfor.token_file(no_rows, tokenizer_path("byte_bpe_50k.json")).count() == 0


def check_pieces(rows, pieces, window=4096, name="word_bpe_49k.json"):
    import collections

    texts = collections.defaultdict(list)
    for (doc_id, _), ids in zip(rows, plain(name, [t for _, t in rows]), strict=True):
        texts[doc_id].append(np.array([*ids, 2], "<u4"))
    total = collections.Counter()
    for p in pieces:
        assert any(len(t) == p["doc_tokens"] and zlib.crc32(t[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for t in texts[p["doc_id"]])
        total[p["doc_id"]] += p["length"]
    assert total == {k: sum(map(len, v)) for k, v in texts.items()}
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window and at & (at - 1) == 0


def test_packing_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(rows, QUERIES["op8_retrieval_packing"](spark, sf_dir).collect())


def test_packing_odd_rows(odd_rows, no_rows):
    rows = [tuple(r) for r in odd_rows.select("doc_id", "text").collect()]
    path = tokenizer_path("word_bpe_49k.json")
    check_pieces(rows, packing.pack(odd_rows, path, window=64, shard_tokens=1000).collect(), 64)
    assert packing.pack(no_rows, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_rows, path, window=100)


def test_ranking_equals_plain_bm25():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=1 << 16)
    idf = np.where(df > 0, np.log1p((50 - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
    mean = float(np.mean([len(t) for t in texts]))
    shard = packing.Bm25Shard(texts, idf, mean, query_terms=5)
    shard.unused[[3, 7]] = False
    weight = lambda d, t: idf[t] * (tf := (texts[d] == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
    for seed in (3, 20):
        own = sorted(np.unique(texts[seed]), key=lambda t: -weight(seed, t))[:5]
        score = {d: sum(weight(d, t) for t in own) for d in range(50) if shard.unused[d]}
        found = shard.ranked(seed).tolist()
        assert set(found) == {d for d, s in score.items() if s > 0}
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(found, found[1:]))


def test_sequences_hold_every_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    path = tokenizer_path("word_bpe_49k.json")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    fixed = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.sequences(packing.pack(fixed, path), fixed, path).collect()
    ids = sorted(i for r in found for i in r["ids"])
    assert ids == sorted(i for t in plain("word_bpe_49k.json", [t for _, t in rows]) for i in [*t, 2])


def test_neighbours_by_any_term_of_the_seed():
    texts = [np.arange(100, 140, dtype=np.uint16), *(np.array([t, 5000 + t], np.uint16) for t in range(100, 140))]
    shard = packing.Bm25Shard(texts, np.linspace(9, 1, 1 << 16).astype(np.float32), 4.0)
    assert set(shard.ranked(0).tolist()) >= set(range(1, 41))


@functools.cache
def library_of(name):
    return Tokenizer.from_file(tokenizer_path(name))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "don't", "x's", "'ll", "a1b2", "...", "«», ", "Über", "NAÏVE", "ß", "é", "Σ", " ", "\n", "  ", "0", " 0 ", " ", "_", "--", "(b)", "日本", "endoftext"]), max_size=12).map("".join), max_size=5))
def test_ids_are_those_of_the_unmodified_library(texts):
    for name in FILES:
        library = library_of(name)
        work = tokens.encoder(tokenizer_path(name))
        wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):  # new pieces, then known ones
            assert [np.frombuffer(x, work.type).tolist() for x in work.ids([t.encode() for t in texts])] == wanted


def test_added_tokens_in_texts(spark):
    docs = spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, "hello world")], "doc_id long, text string")
    found = pfor.token_file(docs, tokenizer_path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in ([31373, 220, 50256, 995], [31373, 995])]


def test_unknown_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"a": 0, "b.c": 1, "?": 2}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(str(tmp_path / "words.json"))
    work = tokens.PieceEncoder(str(tmp_path / "words.json"))
    assert not work.fine and [np.frombuffer(x, work.type).tolist() for x in work.ids([b"a b.c  a", b"", b"x"])] == [[0, 1, 0], [], [2]]


def test_large_vocabularies_have_wide_ids(tmp_path):
    from tokenizers import models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)} | {"?": 70_000}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "wide.json")
    plain.save(path)
    assert tokens.id_type(path) == "<u4"
    assert np.frombuffer(tokens.PieceEncoder(path).ids([b"w69999 w1 no"])[0], "<u4").tolist() == [69_999, 1, 70_000]


def test_best_neighbours_come_in_the_order_of_all():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 30, rng.integers(1, 9)).astype(np.uint16) for _ in range(300)]
    shard = packing.Bm25Shard(texts, np.linspace(3, 1, 30).astype(np.float32), 4.0)
    shard.unused[::7] = False
    for seed in range(0, 300, 11):
        assert list(shard.neighbours(seed)) == shard.ranked(seed).tolist()
