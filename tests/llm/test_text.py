"""Coders, counts and fingerprints against brute force, and odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsieve.llm import bpe, simhash, wordpiece
from flowsieve.llm.components import components

RANKS = bpe.read_ranks(open(public_tokenizers.path(bpe.RANKS_FILE), "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = bpe.Encoder(RANKS), bpe.Decoder(RANKS)
MODEL = open(public_tokenizers.path(wordpiece.VOCABULARY_FILE), "rb").read()

ODD = ["", " ", "\n\n  x\t\ty ", "a" * 3000, " " * 700 + "x", "-" * 400, "= " * 150, "I'll we'VE don't 'S", "naïve Größe ñandú",
       "日本語 中文 한국어", "😀👍🏽 é ​　\x85", "\x1c\x1d a\x00b", "0123456789 ½ ² Ⅷ", "<|endoftext|>", "__init__" * 60]
SCHEMA = "doc_id bigint, text string, fingerprint string, score double, ids array<int>, row string, host string"


def rows_of(texts):
    """Rows with clashing extra columns; a null id and a null text among them."""
    rows = [(i, t, "x", 1.0, [1], "y", None) for i, t in enumerate(texts)]
    return rows + [(None, "lost and found", None, None, None, None, None), (len(texts), None, "x", 0.0, None, "z", "h"), rows[-1]]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys_and_decode_back(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(ids) == text and "".join(DECODER.stream(ids)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab e\n tTHE.=- é中'0"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_is_encoded_as_the_library_does(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and DECODER.decode(ids) == text


def test_decoder_refuses_broken_characters():
    half = LIBRARY.encode_ordinary("\U00013000")[:1]
    with pytest.raises(UnicodeDecodeError):
        DECODER.decode(half)


def test_round_trip_handles_odd_rows(spark):
    rows = rows_of(ODD)
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((r[0], len(i := LIBRARY.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                    hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_little_memory_changes_nothing():
    small = bpe.Encoder(RANKS, memory=5)
    assert all(small.encode(t) == LIBRARY.encode_ordinary(t) for t in ODD)


def test_encode_then_decode_as_tables(spark):
    df = spark.createDataFrame([(1, "Größe 😀"), (2, None), (3, "")], "doc_id bigint, text string")
    back = bpe.decode(bpe.encode(df))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "Größe 😀", 2: "", 3: ""}


def greedy(vocabulary, word):
    pieces, at, longest = 0, 0, max(map(len, vocabulary))
    while at < len(word):
        for length in range(min(longest, len(word) - at), 0, -1):
            if word[at:at + length] in vocabulary:
                break
        else:
            return -1
        at += length
        pieces += 1
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.sets(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=8),
       st.lists(st.text("abcd", min_size=1, max_size=20), max_size=20))
def test_automaton_counts_as_greedy_matching(initial, continuing, words):
    automaton = wordpiece.Automaton(initial, continuing)
    for word in words:
        first = next((n for n in range(len(word), 0, -1) if word[:n] in initial), 0)
        rest = greedy(continuing, word[first:]) if first else -1
        assert automaton.count(word) == (-1 if rest < 0 else 1 + rest)


def test_token_counts_of_whole_texts(spark):
    processor = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    vocabulary = {processor.id_to_piece(i) for i in range(processor.get_piece_size())
                  if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))}
    texts = [*ODD[:3], "a" * 200, *ODD[7:12], "x͸y plain words"]
    rows = rows_of(texts)
    want = []
    for r in rows:
        counts = [greedy(vocabulary, wordpiece.WORD_START + w) for w in (r[1] or "").split()]
        want.append((r[0], len(counts), sum(max(c, 1) for c in counts), sum(c < 0 for c in counts)))
    assert sorted(map(tuple, wordpiece.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == sorted(want, key=repr)
    assert wordpiece.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_groups(values, distance=3):
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def long_texts():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(6)]
    near = [t.replace(f" {t.split()[k]} ", " changed ", 1) for t in base for k in (20, 150)]
    return [*base, *near, base[0].upper(), "one two", "one", "", "ONE", "x " * 20_000]


def test_fingerprints_and_components(spark):
    rows = rows_of(long_texts())
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    values = [plain_fingerprint(r[1]) for r in rows]
    tops = plain_groups(values)
    least = {t: min((r[0] for r, u in zip(rows, tops) if u == t and r[0] is not None), default=None) for t in set(tops)}
    want = sorted(((r[0], f"{v:016x}", least[t]) for r, v, t in zip(rows, values, tops)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = rows_of(long_texts())
    got = simhash.representatives(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    tops = plain_groups([plain_fingerprint(r[1]) for r in rows])
    want = sorted((min((r for r, u in zip(rows, tops) if u == t), key=lambda r: (r[0] is None, r[0] or 0))[0] for t in set(tops)), key=repr)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == want
    assert simhash.representatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_blocks_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6))) for _ in range(400)} | {rng.getrandbits(63) for _ in range(100)})
    tops = plain_groups(prints)
    want = {v: prints[t] for v, t in zip(prints, tops)}
    got = simhash.fingerprint_groups(spark.createDataFrame([(v,) for v in prints], "fp bigint"), small=8, piece=64)
    assert {r.fp: r.root for r in got.collect()} == want


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = components(spark.createDataFrame([*chain, *hub, (5, 5), (7, 6)], "u bigint, v bigint"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1301)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_bits_need_over_half():
    texts = ["a b c d", "a b c d e", "  A\tb\nC  d "]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert np.int64(np.uint64(simhash.fingerprint("a b c"))) is not None
