"""Token operators against the libraries' own encoding, and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinledger.llm import packing, token_counts, wavelet
from twinledger.llm.packing import Plan, best_fill
from twinledger.llm.scratch import new_path, reachable
from twinledger.llm.tokens import Encoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " ", "\n", "one", " two words ", "tabs\tand\r\nlines\n\n  indented  twice", "it's we'll they'd 'sudden",
    "Ünïcode, «quoted» ’apostrophe’ — dash…", "wide blank　and line", "漢字かな交じり文 mixed", "emoji 👩‍👧 é combining ́start",
    "a <|endoftext|> b<|endoftext|>c", "1234 5,678.90 | x=1;y=2", "x" * 5000, "word. " * 700, "\x1c\x1d control \x85 next", "Word.Word!? (word) [Word];word:",
]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = "the of and ouenthering Éaux réa on, in. to\nbe is; 7".split(" ")
    longer = [" ".join(rng.choices(words, k=rng.randrange(1, 3000))) for _ in range(40)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS + longer + ["one", "one"])]
    reachable(spark)
    return spark.createDataFrame(rows + [(5, TEXTS[5], "en", "s", 0)], SCHEMA).repartition(3)


@pytest.mark.parametrize("path, blanks", [(BYTE, True), (WORD, False)])
def test_units_give_the_ids_of_the_whole_text(path, blanks):
    texts = [t or "" for t in TEXTS]
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        own = Encoder(path, blanks)
        assert [list(np.frombuffer(i, "<u4")) for i in own.encode(texts)] == [e.ids for e in whole]
        assert [list(np.frombuffer(i, "<u4")) for i in own.encode(texts)] == [e.ids for e in whole]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé .,\n\t'sd1| ́​\x1f漢")), min_size=1, max_size=4))
def test_units_on_odd_texts(texts):
    for path, blanks in ((BYTE, True), (WORD, False)):
        own = _made.setdefault(path, Encoder(path, blanks))
        own.units, own.older = {}, own.units if len(texts) > 2 else {}
        assert [list(np.frombuffer(i, "<u4")) for i in own.encode(texts)] == [
            e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


_made = {}


def test_best_fill_is_closest():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(5))}
        room = rng.randrange(0, 40)
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
        used = best_fill(counts, room)
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * k for n, k in used.items()) == max(reach)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 9), max_size=8))
def test_plan_places_every_id_once_without_padding(counts):
    plan = Plan(counts, 32)
    where, filled = {}, {}
    for rest, first, last, at, size, copies, slot, offset in plan.rows:
        for n in range(first, last + 1):
            k = slot + n - first
            for i in range(size):
                assert where.setdefault((rest, n, at + i), True) is True
                filled.setdefault(k // copies, []).append(offset + k % copies * size + i)
    assert len(where) == sum(n * c for n, c in counts.items()) == sum(map(len, filled.values()))
    for places in filled.values():
        assert sorted(places) == list(range(len(places)))
        assert len(places) & (len(places) - 1) == 0
    assert sorted(filled) == list(range(len(filled)))


def test_packing_round_trip(docs):
    rows = docs.collect()
    tokenizer = Tokenizer.from_file(BYTE)
    pieces = packing.pack(docs).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    for doc_id, ids in whole.items():
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        got = sorted((p.start, i) for p in own for i in [tuple(np.frombuffer(p.ids, "<u2"))])
        expected = len(ids) * len(ids[0])
        assert sum(p.length for p in own) == expected
        for p in own:
            piece = ids[0][p.start:p.start + p.length]
            assert p.ids_crc32 == crc(piece) and list(np.frombuffer(p.ids, "<u2")) == piece and p.doc_tokens == len(ids[0])
        if len(ids) == 1:
            assert [i for _, part in got for i in part] == ids[0]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0, int), np.array([7]), rng.zipf(1.3, 200_000) % 49408, np.full(70_000, 65_535)):
        shard = wavelet.Shard(wavelet.build(ids, np.array([4]), np.array([len(ids)])))
        assert np.array_equal(shard.ids(), ids)
        for i in rng.integers(0, len(ids), 5) if len(ids) else ():
            value = int(ids[i])
            places = np.flatnonzero(ids == value)
            assert shard.access(int(i)) == value and shard.count(value) == len(places)
            assert shard.rank(value, int(i)) == np.count_nonzero(ids[:i] == value)
            k = int(rng.integers(len(places)))
            assert shard.select(value, k) == places[k]
        assert shard.count(60_000) == np.count_nonzero(ids == 60_000)


def test_wavelet_file_round_trip(spark, docs):
    file = new_path(spark, "wavelet-test")
    wavelet.write(docs, file, shard_tokens=5_000)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.read(spark, file).collect())
    tokenizer, start = Tokenizer.from_file(WORD), 0
    for (got_start, doc_id, n, got_crc), row in zip(found, sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [1]
        assert (got_start, doc_id, n, got_crc) == (start, row.doc_id, len(ids), crc(ids))
        start += n
    assert spark.read.parquet(file).count() > 3


def test_wavelet_of_nothing_and_null_id(spark):
    assert wavelet.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = wavelet.round_trip(spark.createDataFrame([(None, None, None, None, None), (1 << 60, "a", None, None, None)], SCHEMA)).collect()
    assert sorted((r.start, r.doc_id) for r in rows) == [(0, None), (1, 1 << 60)]


def plain_count(word, counter):
    """The same scores without sharing: the best cut of one word by recursion over its ends."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + width * counter.byte, 0, best[end - 1][1] + width)]
        ways += [(counter.scores[word[s:end]] + best[s][0], end - s, best[s][1] + 1) for s in range(end) if word[s:end] in counter.scores]
        top = max(ways, key=lambda w: (w[0], w[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


def test_token_counts_against_single_words(docs):
    counter = token_counts.Counter(token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model")))
    found = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    memo = {}
    for row in docs.collect():
        words = [w.decode() for w in (row.text or "").encode().split()]
        if any(len(w) > 200 for w in words):
            continue
        total = sum(memo.setdefault(w, plain_count(token_counts.MARK + w, counter)) for w in words)
        assert (row.doc_id, len(words), total) in found
    assert len(token_counts.token_counts(docs).collect()) == docs.count()


def test_token_counts_of_nothing(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
