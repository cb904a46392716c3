"""Token files and packing against whole-text encoding and brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logrung.llm import token_store
from logrung.llm.encode import WordEncoder, giving_back
from logrung.llm.packing import OpenBins, best_fit_decreasing, pack, token_pieces
from logrung.llm.queries import op1_token_output, op10_best_fit_packing
from logrung.llm.token_store import TokenFile, read_documents, write_tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
NASTY = [
    "",
    " ",
    "  two  spaces ",
    "tab\there \n new\n\nlines \r\n end ",
    "a\u00a0b \u3000 c\u2003d",
    "it's can't  I'll 'tis ' s",
    "x<|endoftext|>y <|endoftext|> z<|startoftext|>",
    "e\u0301 \u0301 İstanbul ΣΑΣ ß ﬁ 1234 ½ \U0001f600 \U00010400",
    "\x1c\x1d a\x85b \x0b\x0c",
    "###%%% && || 12,345.67 -- __a__",
    "\n", "\n \n", "word " * 50,
]


def _whole(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "kept"), [(BYTE, True), (WORD, False)])
@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_word_by_word_equals_whole_text(path, kept, limit):
    rng = random.Random(5)
    alphabet = list("abé ß.,'\n\t  ") + ["\u00a0", "\u0301", "日", " the", "'s", "12", "\r\n"]
    texts = NASTY + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    encoder = WordEncoder(path, kept, cache_words=limit)
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        ids, counts = encoder.encode(part)
        ends = np.cumsum(counts)
        got = [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
        assert got == _whole(path, part)


def _expected(rows, path, end):
    """Brute force: ids of each document with the end id, in id order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, _whole(path, [r[1] for r in rows]), strict=True):
        ids = [*ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op1_token_output(spark, sf).collect())
    assert got == _expected(rows, BYTE, 2)


def test_token_files_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(None, "null id"), (7, None), (3, "same"), (3, "same"), (900, "x " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    got = read_documents(spark, write_tokens(docs.repartition(5), BYTE, True, 2)).collect()
    assert len(got) == len(rows)
    # Equal ids stand in the order of a hash of their texts, so they are compared as a set.
    want = {}
    for doc_id, text in rows:
        ids = [*_whole(BYTE, [text])[0], 2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert read_documents(spark, write_tokens(none, BYTE, True, 2)).collect() == []
    assert pack(token_pieces(none, WORD, False, 0)).collect() == []


def test_random_access_to_sequences_and_masks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    manifest = write_tokens(docs, BYTE, True, 2, length=128, per_batch=4)
    for shard in manifest.collect():
        file = TokenFile(shard.tokens_path)
        assert len(file) == -(-shard.n_tokens // 128)
        flat = np.concatenate(list(file.batches()))
        for i in random.Random(1).sample(range(len(file)), min(9, len(file))):
            ids = file.ids(i)
            assert not ids.flags.owndata and ids.dtype == np.uint16
            assert ids.tolist() == flat[i * 128 : (i + 1) * 128].tolist()
            real = min(128, shard.n_tokens - i * 128)
            assert file.mask(i).to_pylist() == [True] * real + [False] * (128 - real)


def _slow_best_fit(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        fits = [r for r in bins if r >= n]
        if fits:
            at = bins.index(min(fits))
        else:
            bins.append(capacity)
            at = len(bins) - 1
        out.append(bins[at])
        bins[at] -= n
    return out, len(bins)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_best_fit_equals_a_scan_of_all_bins(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 120))), reverse=True)
        bins, offsets = best_fit_decreasing(np.array(lengths, np.int64), capacity)
        left, count = _slow_best_fit(lengths, capacity)
        assert len(set(bins.tolist())) == count
        # The tightest capacity is the same whichever of equal bins is taken.
        assert [capacity - o for o in offsets.tolist()] == left


def test_open_bins_closes_full_ones():
    bins = OpenBins(8)
    assert bins.take(1) is None
    bins.add(0, 0)
    assert bins.take(1) is None
    bins.add(1, 5)
    bins.add(2, 3)
    assert bins.take(3) == (2, 3) and bins.take(3) == (1, 5) and bins.take(1) is None


def _check_packed(rows, texts, end=0, capacity=2048):
    """Every piece of every document once, gapless sequences; returns (sequences, tokens)."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = {}
    for (doc_id, _), ids in zip(texts, _whole(WORD, [t[1] for t in texts]), strict=True):
        ids = np.array([*ids, end], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.setdefault(doc_id, []).append((piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq), sum(r.length for r in rows)


def test_packing_query_equals_brute_force(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op10_best_fit_packing(spark, sf).collect()
    sequences, tokens = _check_packed(rows, texts)
    lengths = sorted((r.length for r in rows), reverse=True)
    assert sequences == _slow_best_fit(lengths, 2048)[1]
    assert sequences <= 1.02 * -(-tokens // 2048) + 1


def test_packing_edge_rows_and_groups(spark):
    texts = [(i, t) for i, t in enumerate(NASTY)] + [(None, None), (None, "a b"), (5, None), (77, "long " * 9000)]
    texts += [(88, "same row")] * 40
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("clash"))
    pieces = token_pieces(docs.repartition(3), WORD, False, 0)
    rows = pack(pieces, per_group=16).collect()
    _check_packed(rows, texts)


def test_two_byte_ids_only_where_they_fit():
    assert token_store.SEQUENCE == 2048
    assert WordEncoder(BYTE, True).n_ids <= 1 << 16


def test_a_task_gives_back_what_it_freed():
    def held():
        text = open("/proc/self/smaps_rollup").read()
        return sum(int(x.split()[1]) for x in text.splitlines() if x.startswith("Pss_Anon")) / 1024

    def work(batches):
        for batch in batches:
            # Blocks too small to be mapped on their own, the last one above all others.
            blocks = [np.ones(8_000) for _ in range(4_000)]
            kept.append(blocks[-1])
            del blocks
            yield batch

    kept, before = [], held()
    assert list(giving_back(work)(iter("ab"))) == ["a", "b"]
    assert held() - before < 100


@pytest.mark.parametrize(("path", "kept"), [(BYTE, True), (WORD, False)])
def test_words_and_the_marks_behind_them_are_kept_apart(path, kept):
    words = ["".join(x) for x in itertools.product("abéß", "oun", "rst", "xyz")]
    marks = ["", ".", ",", "!?", "...", ")"]
    texts = [" ".join(w + m for w in words) for m in marks]
    encoder = WordEncoder(path, kept)
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == _whole(path, texts)
    assert len(encoder._codes) <= len(words) + 2 * len(marks)
