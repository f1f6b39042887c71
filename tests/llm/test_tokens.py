import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing, tokens, topics
from brindle.llm.token_planes import BLOCK_IDS, ShardReader, ShardWriter, from_planes, round_trip, to_planes
from brindle.llm.tokens import CachedEncoder, default_path

ALPHABET = "aA bÉß'!<|>endoftextstartoftext\n\t0١é́ İǅﬁ漢字\x1c\x85  'sS’ll÷×ªº.,-12"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_path())


def plain_ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_cache_gives_the_library_s_ids(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab Éß1234.!|,%-÷×\n\t\r") for _ in range(60)) for _ in range(1000)] + ["a<|endoftext|>b don't", None, ""]
    made = CachedEncoder(default_path())
    for _ in range(2):
        for text, ids in zip(texts, made.encode_documents(texts, step=100)):
            assert ids.tolist() == plain_ids(plain, text), repr(text)


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("top", [0, 1, 300, 70_000, 2**32 - 1])
def test_planes_round_trip(mode, top):
    ids = np.random.default_rng(top % 97).integers(0, top + 1, 1003).astype("<u4")
    assert (from_planes(to_planes(ids, mode), len(ids), mode) == ids).all()


def test_shard_round_trip():
    rng = np.random.default_rng(3)
    docs = [(None if i == 0 else i, rng.integers(0, 49408, n).astype("<u4")) for i, n in enumerate([1, 5, BLOCK_IDS + 7, 2 * BLOCK_IDS, 3])]
    stream = io.BytesIO()
    writer = ShardWriter(stream)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    got = list(ShardReader(stream, len(stream.getvalue())).documents())
    start = 0
    for (doc_id, ids), (i, s, back) in zip(docs, got, strict=True):
        assert (doc_id, start) == (i, s) and (ids == back).all()
        start += len(ids)


def test_shard_cut_short():
    with pytest.raises(ValueError, match="cut short"):
        ShardReader(io.BytesIO(b"x" * 50), 50)


def test_files_of_odd_documents(spark, odd, empty, plain):
    got = sorted(round_trip(odd).collect(), key=lambda r: r.start)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    start = 0
    for r, want in zip(got, rows, strict=True):
        ids = plain_ids(plain, want.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert round_trip(empty).count() == 0


def check_pieces(rows, texts, plain):
    """Each id in exactly one piece; sequences gapless, at most a window, padded nowhere."""
    ids = {}
    for doc_id, text in texts:
        ids.setdefault(doc_id, []).append(plain_ids(plain, text))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        whole, copies = ids[doc_id][0], len(ids[doc_id])
        assert sum(p.length for p in pieces) == copies * len(whole)
        for p in pieces:
            assert p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], "<u4").tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW and at & (at - 1) == 0


def test_packing_odd_documents(odd, empty, plain):
    check_pieces(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], plain)
    assert packing.pack(empty).count() == 0


def test_packing_many(spark, plain, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{i % 7}"]) for _ in range(rng.randint(1, 900)))) for i in range(120)]
    check_pieces(packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, plain)


def test_neighbours_are_the_lexical_ones():
    a, b = np.arange(100, 160, dtype="<u4"), np.arange(200, 260, dtype="<u4")
    docs = [a, b, a[:50], b[10:], np.arange(300, 340, dtype="<u4")]
    idf = np.ones(400, np.float32)
    index = packing.Bm25Shard(docs, idf, 50.0)
    index.unused[0] = False
    assert list(index.neighbours(0)) == [2]
    assert packing.order_by_retrieval(docs, idf, 50.0) == [0, 2, 1, 3, 4]


@pytest.mark.parametrize("query_terms", [None, 4])
def test_neighbours_against_brute_force_bm25(query_terms):
    rng = np.random.default_rng(17)
    docs = [rng.zipf(1.4, rng.integers(5, 200)).clip(0, 299).astype("<u4") for _ in range(150)]
    df = np.array([sum(t in d for d in map(set, docs)) for t in range(300)])
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    average = float(np.mean([len(d) for d in docs]))

    def weight(t, d):
        tf = int((d == t).sum())
        return float(idf[t]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))

    for seed in (0, 7, 99):
        index = packing.Bm25Shard(docs, idf, average, query_terms)
        index.unused[[seed, 3, 5]] = False
        terms = index.asks[seed].tolist()
        own = sorted((weight(t, docs[seed]) for t in set(docs[seed].tolist())), reverse=True)[:query_terms]
        assert np.allclose(sorted((weight(t, docs[seed]) for t in terms), reverse=True), own)
        want = {i: sum(weight(t, d) for t in terms) for i, d in enumerate(docs) if i not in (seed, 3, 5)}
        got = list(index.neighbours(seed))
        assert set(got) == {i for i, x in want.items() if x > 0}
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got[:-1], got[1:]))


def test_documents_of_a_vocabulary_share_topics():
    rng = np.random.default_rng(8)
    docs = [(kind, (rng.zipf(1.3, rng.integers(30, 300)).clip(0, 999) + 1000 * kind).astype("<u4")) for kind in rng.integers(0, 4, 600)]
    made = topics.Topics([topics.counted(ids) for _, ids in docs[:200]])
    kinds = {}
    for kind, ids in docs:
        kinds.setdefault(made.of(ids), []).append(kind)
    alike = sum(max(np.bincount(k)) for k in kinds.values())
    assert alike >= 0.95 * len(docs) and len(kinds) > 4
    changes = [max(set(kinds[t]), key=kinds[t].count) for t in sorted(kinds)]
    assert sum(a != b for a, b in zip(changes[:-1], changes[1:])) < len(changes) / 2  # neighbouring topics are close


def test_topics_of_odd_samples():
    none = np.empty(0, "<u4")
    for sample in ([], [none], [none, none], [np.array([5], "<u4")] * 3, [none, np.array([7, 7, 8], "<u4")]):
        made = topics.Topics([topics.counted(ids) for ids in sample])
        assert made.of(none) == 0 and 0 <= made.of(np.arange(40_000, dtype="<u4")) < max(1, len(sample))


def test_long_texts_do_not_crowd_one_range():
    rng = np.random.default_rng(4)
    sigs = [packing.signature(rng.integers(0, 49408, n)) for n in [30] * 400 + [20_000] * 400]
    short, long = np.median(sigs[:400]), np.median(sigs[400:])
    assert 0.5 < long / short < 2


def test_one_doc_id_is_dealt_to_several_files(spark, plain, monkeypatch):
    monkeypatch.setattr("brindle.llm.token_planes.SHARD_BYTES", 200)
    docs = spark.createDataFrame([(1, "the same text again and again")] * 200 + [(0, "first"), (2, "last")], "doc_id long, text string").repartition(5)
    got = sorted(round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0] + [1] * 200 + [2] and len({r.path for r in got if r.doc_id == 1}) > 3
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got[:-1], got[1:]))
