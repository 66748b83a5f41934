import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pingtrail.llm import packing, token_files
from pingtrail.llm.encoding import encoder
from pingtrail.llm.queries import tokenizer
from pingtrail.session import scratch_path

ODD = ["", " ", "  a", "a  b ", " a\n b \n", "é  x  y\x1c z", "a　 b <|endoftext|> c", " ́x á  b's",
       "x \n\n y\t\tz  ", "<|endoftext|>", " <|startoftext|>", "a\x1c b\x1c  c", "don't stop 's 's12 3\n",
       "no-spaces" * 900, "long text of words " * 3000, "a  b   c"]


def plain(name):
    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_whole_text(name):
    encode, rng = plain(name), random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t ab'sé1!\x1c") for _ in range(60)) for _ in range(300)]
    assert [x.tolist() for x in encoder(tokenizer(name)).encode(texts)] == [encode(t) for t in texts]


def test_small_cache_gives_the_same_ids():
    from pingtrail.llm.encoding import Encoder

    small = Encoder(tokenizer("byte_bpe_50k.json"), cache_entries=3)
    encode = plain("byte_bpe_50k.json")
    for _ in range(3):
        assert [x.tolist() for x in small.encode(ODD)] == [encode(t) for t in ODD]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marks_line_breaks_and_letters_with_a_combining_lower_case(name):
    from pingtrail.llm.encoding import Encoder

    encode, rng = plain(name), random.Random(3)
    texts = ["\u0130. \u0130, x\u0130.\n\u0130", "a.\nb", "x a.\nb,\n'sc d", "a,\n\nb", "\n", "a\n", "\na", "a.. b.,", "\u017f.\nK \u212a."]
    texts += ["".join(rng.choice(" \n\tab'.,\u0130\u017f\u03a3\u0301") for _ in range(40)) for _ in range(300)]
    for entries in (3, 1000):
        own = Encoder(tokenizer(name), entries)
        for _ in range(2):
            assert [x.tolist() for x in own.encode(texts)] == [encode(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_go_to_the_library_together_and_once(name):
    from pingtrail.llm.encoding import Encoder

    class Counting:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    own = Encoder(tokenizer(name))
    own.tokenizer = Counting(own.tokenizer)
    words = ["".join(chr(97 + n // 26 ** k % 26) for k in range(3)) for n in range(5000)]
    text = " ".join(w + "" if n % 3 else w + ".\n" + w[::-1] for n, w in enumerate(words))
    for _ in range(2):
        assert [x.tolist() for x in own.encode([text])] == [plain(name)(text)]
    assert own.tokenizer.texts <= 500


def test_token_files_round_trip(spark, docs_of):
    texts = [None, *ODD, "a b"]
    ids = list(range(50, 50 + 3 * len(texts), 3))
    random.Random(2).shuffle(ids)
    folder = scratch_path(spark, "t")
    token_files.write_token_files(docs_of(texts, ids).repartition(3), folder, tokenizer("byte_bpe_50k.json"), 2, shards=4)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, folder).collect()}
    encode, start = plain("byte_bpe_50k.json"), 0
    for i, text in sorted(zip(ids, texts)):
        want = np.array([*encode(text or ""), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(got) == len(ids)
    shard = token_files.manifest(spark, folder).orderBy("shard").first()
    raw = token_files.open_array(folder, "ids", shard.shard, "<u2")
    assert len(raw) == shard.n_ids and shard.id_bytes == 2


def test_token_files_null_and_repeated_ids_and_empty_table(spark, docs_of):
    folder = scratch_path(spark, "t")
    token_files.write_token_files(docs_of(["b", "a", "c"], [5, 5, None]), folder, tokenizer("byte_bpe_50k.json"), 2)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (5, 2), (5, 4)]
    empty = scratch_path(spark, "t")
    token_files.write_token_files(docs_of([]), empty, tokenizer("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def lay_out(classes):
    return [[n for n, each in items for _ in range(each)] for count, items in classes for _ in range(count)]


def one_by_one(lengths, capacity):
    """Large-item matching, then best fit, piece by piece."""
    bins, large = [], sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        n = large.pop(0)
        fit = next((m for m in large if n + m <= capacity), None)
        if fit is not None:
            large.remove(fit)
        bins.append([n] if fit is None else [n, fit])
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        b = min((b for b in bins if sum(b) + n <= capacity), key=lambda b: capacity - sum(b), default=None)
        bins.append([n]) if b is None else b.append(n)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_as_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice([1, 2, capacity]) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in lengths}
    bins = lay_out(packing.plan_classes(counts, capacity))
    assert all(sum(b) <= capacity for b in bins) and sorted(n for b in bins for n in b) == sorted(lengths)
    assert len(bins) == len(one_by_one(lengths, capacity))
    assert all(sum(3 * n > capacity for n in b) <= 2 for b in bins)
    assert len(packing.plan_classes({n: c * 10**9 for n, c in counts.items()}, capacity)) <= 4 * capacity


def test_pieces_fill_sequences_without_gaps(spark, docs_of):
    texts = [None, "", "a b c", "a b c", "x " * 50, "y z " * 40, "w " * 9, "v " * 9] * 3
    got = packing.pack_documents(docs_of(texts), tokenizer("word_bpe_49k.json"), 1, 16, with_ids=True).collect()
    encode = plain("word_bpe_49k.json")
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, text in enumerate(texts):
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in rows for x in r.ids] == [*encode(text or ""), 1]
        assert [r.start for r in rows] == [16 * k for k in range(len(rows))] and all(r.length == 16 for r in rows[:-1])
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 16
    assert len(by_sequence) == len(one_by_one([r.length for r in got], 16))


def test_packing_of_an_empty_table(docs_of):
    assert packing.pack_documents(docs_of([]), tokenizer("word_bpe_49k.json"), 1).count() == 0


def test_pieces_of_shards_and_a_hot_id(spark, docs_of):
    texts = [f"text number {n}" for n in range(400)]
    ids = [None] * 150 + [9] * 150 + list(range(10, 110))
    folder = scratch_path(spark, "t")
    token_files.write_token_files(docs_of(texts, ids).repartition(5), folder, tokenizer("byte_bpe_50k.json"), 2, shards=8)
    # no id keeps its rows in one shard
    assert max(r.n_docs for r in token_files.manifest(spark, folder).collect()) < 150
    read = token_files.read_token_files(spark, folder, step=16, piece=20)
    assert read.rdd.getNumPartitions() >= 20
    got = sorted(read.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    encode = plain("byte_bpe_50k.json")
    want = sorted(zlib.crc32(np.array([*encode(t), 2], "<u4").tobytes()) for t in texts)
    assert sorted(r.ids_crc32 for r in got) == want


def test_registered_token_queries(spark):
    from pingtrail.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encode, start = plain("byte_bpe_50k.json"), 0
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, "/root/testdata/sf0.001").collect()}
    for i in sorted(docs):
        want = np.array([*encode(docs[i]), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    encode = plain("word_bpe_49k.json")
    held = {}
    for r in QUERIES["op3_best_fit_packing"](spark, "/root/testdata/sf0.001").collect():
        held.setdefault(r.doc_id, []).append(r)
    assert held.keys() == docs.keys()
    for i, rows in held.items():
        want = np.array([*encode(docs[i]), 1], "<u4")
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(want[r.start:r.start + r.length].tobytes())
        assert sum(r.length for r in rows) == len(want)
