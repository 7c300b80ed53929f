"""Encoders against their libraries, token-id files, packing and attribution against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import FOLDER, empty, odd

from matchspark.llm import attribution, common, id_files, packing, pieces, queries, range_coder
from matchspark.llm.merging import ByteCoder, PieceCoder
from matchspark.session import scratch_dir

LETTERS = "abcdeeehttt  \n\t '▁éÉß漢字😀Σσ.,!?0123456789²½Ⅷ\x00\x1c 　 \r<s></s><0x0A>́İK"


def strange(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["", " ", "  a", "a  ", "aaaa" * 50, "ababab" * 30, "hehehehe" * 9, " ▁ ▁▁x", "\n\n\n a", "abcabc" * 20 + " the" * 3]
    return out + [" " * k + "the" * j + " " * k for k in range(5) for j in range(4)]


@pytest.fixture(scope="module")
def piece_path():
    return common.vocabulary("piece_bpe_32k.model")


def parts(flat, counts):
    edges = np.r_[0, np.cumsum(counts)]
    return [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_piece_coder_equals_the_library(piece_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    mine = PieceCoder(common.read_file(piece_path))
    texts = strange(1500, 1)
    found = parts(*mine.encode(texts))
    assert found == lib.encode(texts)
    assert [mine.decode(np.array(i, np.int64)) for i in found] == [lib.decode(i) for i in found]
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randint(0, 31999) if rng.random() < 0.6 else rng.randint(0, 300) for _ in range(rng.randint(1, 12))]
        assert mine.decode(np.array(ids)) == lib.decode(ids)


LONG_WORDS = {"letters": "abcdefghijklmnopqrstuvwxyz", "frequent": "etaoinshr", "few": "the", "one": "a", "strange": "aé漢字😀\u0301b0"}


@pytest.mark.parametrize("kind", LONG_WORDS)
def test_words_without_end_equal_the_library(piece_path, kind):
    """Words far beyond the length at which they are cut, beside short ones and cut anew in later rounds."""
    import sentencepiece
    import tokenizers

    rng = random.Random(kind)
    texts = ["".join(rng.choice(LONG_WORDS[kind]) for _ in range(n)) for n in (1, 63, 64, 65, 66, 500, 30_000)]
    texts += [" ".join(texts[:6]), "the " + texts[5] + " end"]
    assert parts(*PieceCoder(common.read_file(piece_path)).encode(texts)) == sentencepiece.SentencePieceProcessor(model_file=piece_path).encode(texts)
    path = common.vocabulary("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert parts(*ByteCoder(common.read_file(path).decode()).encode(texts)) == want


def test_a_word_of_a_million_letters_takes_few_rounds(piece_path):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    mine = PieceCoder(common.read_file(piece_path))
    looked = []
    find = mine.table.find
    mine.table.find = lambda left, right: looked.append(len(left)) or find(left, right)
    ids, counts = mine.encode([word])
    assert mine.decode(ids) == word and counts.tolist() == [len(ids)]
    assert sum(looked) < 40 * len(word)


def test_memory_of_words_does_not_change_ids(piece_path):
    mine = PieceCoder(common.read_file(piece_path))
    texts = strange(300, 3)
    first = mine.encode(texts)[0]
    mine.remember = 5
    for _ in range(3):
        assert np.array_equal(mine.encode(texts)[0], first)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_byte_coder_equals_the_library(name):
    from tokenizers import Tokenizer

    path = common.vocabulary(name)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = strange(1500, 4)
    found = parts(*ByteCoder(common.read_file(path, text=True)).encode(texts))
    assert found == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


MARKED = [
    "a<|endoftext|>b", "<|endoftext|>", "<|startoftext|>", "x <|endoftext|>  y", "<|endoftext|><|endoftext|> \n<|startoftext|>a",
    "<|endoftext<|endoftext|>|>", "it's<|endoftext|>'s", "A <|ENDOFTEXT|> <|StartOfText|>b", "é\u0301<|endoftext|>\u0301x", None, "", "plain",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts_are_single_ids(name):
    from tokenizers import Tokenizer

    path = common.vocabulary(name)
    lib = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = MARKED + [rng.choice(["<|endoftext|>", "<|startoftext|>", " "]).join(rng.sample(strange(300, 7), 4)) for _ in range(500)]
    mine = ByteCoder(common.read_file(path, text=True))
    assert parts(*mine.encode(texts)) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    if not mine.folds:
        widths = [int(mine.width[ids].sum()) for ids in parts(*mine.encode(texts))]
        assert widths == [len((t or "").encode()) for t in texts]


def test_op1_digests(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=common.vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.QUERIES["op1_sentencepiece"](spark, FOLDER).collect()}
    docs = common.table(spark, FOLDER, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = lib.encode(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark, piece_path):
    rows = pieces.decode(pieces.encode(odd(spark), piece_path), piece_path).collect()
    assert len(rows) == odd(spark).count()
    assert {r.doc_id: r.ids for r in rows}[1] == []
    assert pieces.encode(empty(spark), piece_path).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, rng.integers(0, 300)) for _ in range(40)]
    blocks += [np.full(500, 7), np.zeros(0, np.int64), np.arange(300) % 3 + 49000, np.full(2000, 65535), np.zeros(1, np.int64)]
    coded = range_coder.encode(blocks)
    back = range_coder.decode(coded, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    assert len(coded[43]) < 200, "repeats are learnt"
    with pytest.raises(ValueError):
        range_coder.encode([np.array([1 << 16])])


def expected_files(docs, name="word_bpe_49k.json", end=1):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.vocabulary(name))
    at, out = 0, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [end]
        out[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_op10_files(spark):
    got = queries.QUERIES["op10_token_files"](spark, FOLDER).collect()
    want = expected_files(common.table(spark, FOLDER, "documents").collect())
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_files_of_odd_rows_and_damage(spark):
    path = scratch_dir(spark, "test", "odd-files")
    id_files.write(odd(spark).coalesce(1), path, common.vocabulary("word_bpe_49k.json"))
    rows = id_files.report(spark, path).collect()
    assert len(rows) == odd(spark).count()
    assert sum(r.doc_id is None for r in rows) == 1
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert [a for a, _ in spans] == np.r_[0, np.cumsum([n for _, n in spans])][:-1].tolist()
    blob = spark.read.parquet(path).first().blob
    with pytest.raises(ValueError):
        id_files.unpack(b"broken" + blob[6:])
    none = scratch_dir(spark, "test", "no-files")
    id_files.write(empty(spark), none, common.vocabulary("word_bpe_49k.json"))
    assert id_files.report(spark, none).count() == 0


def test_crcs_of_pieces_add_up():
    rng = np.random.default_rng(1)
    for _ in range(50):
        parts = [rng.integers(0, 1 << 32, rng.integers(0, 5000), dtype=np.uint32) for _ in range(rng.integers(1, 6))]
        whole = zlib.crc32(b"".join(p.tobytes() for p in parts))
        assert id_files.crc_of([(len(p), zlib.crc32(p.tobytes())) for p in parts]) == whole


def test_files_of_repeated_ids_in_several_parts(spark):
    """Rows of one id with equal and other texts, long ones over many blocks; ids come back whole."""
    path = scratch_dir(spark, "test", "repeated-files")
    rows = [(k % 7, f"text {k % 11} " * (1 + 900 * (k % 5))) for k in range(60)] + [(None, "a " * 5000)] * 2
    id_files.write(odd(spark, rows), path, common.vocabulary("word_bpe_49k.json"))
    got = id_files.report(spark, path).collect()
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    ids = [(i, np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(b) // 4, zlib.crc32(b)) for i, b in ids)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in spans] == np.r_[0, np.cumsum([n for _, n in spans])][:-1].tolist()
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert in_order == sorted(in_order)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in id_files.read(spark, path).collect()) == sorted((str(i), b) for i, b in ids)


def laid_out(histogram, capacity):
    """Bins of a plan, after checking that ranks are covered once and bins have no gaps."""
    bins, seen = {}, {}
    for length, rank, count, first, offset in packing.plan(histogram, capacity):
        seen.setdefault(length, []).append((rank, count))
        for b in range(first, first + count):
            bins.setdefault(b, []).append((offset, length))
    for length, n in histogram.items():
        at = 0
        for rank, count in sorted(seen.get(length, [])):
            assert rank == at
            at += count
        assert at == n
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def test_plans_are_valid_and_tight():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([7, 20, 100, 2048])
        histogram = {}
        for _ in range(rng.randint(0, 60)):
            histogram[rng.randint(1, capacity)] = rng.randint(1, rng.choice([1, 3, 50]))
        bound = -(-sum(k * n for k, n in histogram.items()) // capacity)
        assert bound <= laid_out(histogram, capacity) <= 2 * bound + 1
    many = {k: int(3000 / (1 + k / 50)) + 1 for k in range(1, 2049)}
    assert laid_out(many, 2048) == -(-sum(k * n for k, n in many.items()) // 2048)
    assert laid_out({683: 5, 1365: 4, 1024: 3, 700: 9}, 2048) <= 13


def test_large_pieces_pair_best():
    """Against the best matching of every small set of large pieces."""
    rng = random.Random(5)

    def best(items, capacity):
        if not items:
            return 0
        a, rest = items[0], items[1:]
        out = 1 + best(rest, capacity)
        for k, b in enumerate(rest):
            if a + b <= capacity:
                out = min(out, 1 + best(rest[:k] + rest[k + 1 :], capacity))
        return out

    for _ in range(60):
        items = [rng.randint(34, 100) for _ in range(rng.randint(1, 8))]
        histogram = {x: items.count(x) for x in items}
        assert laid_out(histogram, 100) == best(items, 100)


def checked_packing(rows, docs, capacity=2048):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs}
    sequences, covered = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, found in covered.items():
        assert [p for p, _, _ in sorted(found)] == list(range(len(found)))
        assert sum(n for _, _, n in found) == len(ids[doc])
        assert all(n == capacity for _, _, n in sorted(found)[1:])
    assert covered.keys() == ids.keys()
    return len(sequences), -(-sum(map(len, ids.values())) // capacity)


def test_op9_packing(spark):
    rows = queries.QUERIES["op9_packing"](spark, FOLDER).collect()
    used, bound = checked_packing(rows, common.table(spark, FOLDER, "documents").collect())
    assert used <= bound + 1


def test_packing_of_odd_rows(spark):
    path = common.vocabulary("byte_bpe_50k.json")
    rows = packing.pack(packing.pieces(odd(spark), path)).collect()
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places)
    assert sum(r.piece == 0 for r in rows) == odd(spark).count()
    with_ids = packing.pieces(odd(spark), path, with_ids=True)
    assert all(len(r.ids) == r.length for r in with_ids.collect())
    assert packing.pack(packing.pieces(empty(spark), path)).count() == 0


def test_attribution_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 30)
        tokens = np.array(sorted(set(rng.sample(range(1, n + 1), rng.randint(1, n))) | {n}))
        sections = np.array(sorted(set(rng.sample(range(1, n + 1), rng.randint(1, n))) | {n}))
        got, crossing = attribution.attribute(tokens, sections)
        start = 0
        for k, end in enumerate(tokens):
            shares, begin = [], 0
            for stop in sections:
                shares.append(max(0, min(end, stop) - max(start, begin)))
                begin = stop
            assert got[k] == int(np.argmax(shares))
            assert crossing[k] == (sum(s > 0 for s in shares) > 1)
            start = end


def test_op3_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    rows = queries.QUERIES["op3_token_counts"](spark, FOLDER).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in common.table(spark, FOLDER, "documents").collect():
        text, found = d.text or "", sorted(by[d.doc_id], key=lambda r: r.section)
        assert sum(r.n_tokens for r in found) == len(lib.encode(text, add_special_tokens=False).ids)
        lines = text.splitlines(keepends=True) if "\r" not in text else None
        assert found[0].start == 0 and found[-1].end == len(text)
        if lines and all(x not in text for x in "\x0b\x0c\x1c\x1d\x1e\x85  "):
            assert [text[r.start : r.end] for r in found] == lines


def test_attribution_of_odd_rows(spark):
    rows = attribution.section_tokens(odd(spark), common.vocabulary("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd(spark).collect()}
    assert [(r.start, r.end, r.n_tokens) for r in rows if r.doc_id == 1] == [(0, 0, 0)]
    assert attribution.section_tokens(empty(spark), common.vocabulary("byte_bpe_50k.json")).count() == 0
