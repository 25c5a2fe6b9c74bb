import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from harbinger.llm.histogram_packing import END_ID, WordIds, fill_gaps, pack_histogram, pack_tokens  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]


def check(docs, out, capacity, slack):
    """Every id once, checksums right, sequences gapless and padded by no more than slack."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted = Counter()
    for doc_id, text in docs:
        wanted[(doc_id, tuple(whole_ids(tokenizer, text)))] += 1
    by_doc, sequences = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, rows in by_doc.items():
        own = [(ids, n) for (d, ids), n in wanted.items() if d == doc_id]
        covered = Counter()
        for r in rows:
            piece = [i for i, _ in own if zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert piece and r.doc_tokens in {len(i) for i in piece}
            covered.update((r.doc_tokens, k) for k in range(r.start, r.start + r.length))
        for size in {len(i) for i, _ in own}:
            copies = sum(n for i, n in own if len(i) == size)
            assert all(covered[(size, k)] == copies for k in range(size))
        assert sum(covered.values()) == sum(len(i) * n for i, n in own)
    assert set(by_doc) == {d for d, _ in docs}
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and (capacity - at <= slack or at & (at - 1) == 0)


def random_docs(seed, n):
    draw = random.Random(seed)
    words = ["it's", "Zürich", "plain", "wordy", "x1234", "$$$end", "<|endoftext|>", "\x00odd", "ﬁne"]
    return [(i, " ".join(draw.choices(words, k=draw.choice([1, 3, 9, 30, 200, 900])))) for i in range(n)]


@pytest.mark.parametrize("capacity, slack", [(64, 0), (64, 5), (100, 0), (512, 16)])
def test_every_id_in_one_place(spark, capacity, slack):
    docs = random_docs(capacity + slack, 120) + [(200, None), (201, ""), (5, "again the same id"), (None, "no id"), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = pack_tokens(frame, PATH, capacity, slack).collect()
    check(docs, out, capacity, slack)


def test_one_length_for_all(spark):
    docs = [(i, "seven words that are always the same") for i in range(500)]
    out = pack_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), PATH, 32, 0).collect()
    check(docs, out, 32, 0)


def test_odd_rows(spark, documents, empty):
    out = pack_tokens(documents, PATH).collect()
    check([(r.doc_id, r.text) for r in documents.collect()], out, 4096, 16)
    assert [r.length for r in out if r.doc_id in (4, 5, 6)] == [1, 1, 1]
    assert pack_tokens(empty, PATH).collect() == []


def test_words_give_the_ids_of_the_whole_text():
    tokenizer = Tokenizer.from_file(PATH)
    words = WordIds(PATH)
    texts = ["I'M we'll 'tis %%%a1b2 'S ''ll", "a\x1cb \x85 c d", "ΣΑΣ İi é é", "<|endoftext|>a<|startoftext|> <|", "\t\n", "x" * 5000]
    for text in texts + [t for _, t in random_docs(4, 40)]:
        assert words.of(text).tolist() == whole_ids(tokenizer, text)


def plain_shortest_pack_first(lengths, capacity):
    """Piece by piece: the pack with most room, a new one when none has room for it."""
    packs = []
    for length in sorted(lengths, reverse=True):
        best = max(range(len(packs)), key=lambda i: capacity - packs[i], default=None)
        if best is None or capacity - packs[best] < length:
            packs.append(0)
            best = len(packs) - 1
        packs[best] += length
    return packs


@pytest.mark.parametrize("seed", range(30))
def test_histogram_plan(seed):
    draw = random.Random(seed)
    capacity = draw.choice([16, 40, 128])
    counts = {length: draw.randint(1, 40) for length in draw.sample(range(1, capacity + 1), draw.randint(1, 12))}
    placements, runs, packs = pack_histogram(counts, capacity)
    filled, seen = Counter(), Counter()
    for length, _rank, count, pack, offset in sorted(placements, key=lambda p: -p[0]):
        for k in range(count):
            assert filled[pack + k] == offset
            filled[pack + k] += length
        seen[length] += count
    assert seen == Counter(counts) and max(filled.values()) <= capacity
    assert {p: capacity - room for room, pack, n in runs for p in range(pack, pack + n)} == dict(filled)
    total = sum(length * n for length, n in counts.items())
    plain = plain_shortest_pack_first([length for length, n in counts.items() for _ in range(n)], capacity)
    assert -(-total // capacity) <= packs <= len(plain) + len(counts)
    dissolved, gaps = fill_gaps(runs, packs, capacity, 0)
    assert sum(n * f for _, n, f, _ in dissolved) == sum(n * room for _, _, n, room, _ in gaps)
