import random
import tracemalloc
import zlib

import numpy as np
import pytest

from lattica.llm import _text, rangecoder, token_counts, token_output

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a  b", "a \nb", "a\n b", " lead", "trail ", "x<|endoftext|>y", "it's  'll", "a b", "a b c", "1 2 3", "tab\t tab", "日本語 \U0001f600 x", "\x00 \x1c y", "the cat sat. " * 50]


def tokenizer():
    t = tokenizers.Tokenizer.from_file(token_output.default_vocab())
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5 * 256 + 7, 20_000])
@pytest.mark.parametrize("kind", ["random", "same", "periodic", "skewed"])
@pytest.mark.parametrize("block", [256, rangecoder.BLOCK])
def test_coder_round_trip(n, kind, block):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, 50257, n), "same": np.full(n, 50256), "periodic": np.arange(n) % 23, "skewed": rng.zipf(1.2, n) % 50257}[kind].astype(np.int32)
    prior = rangecoder.Prior.of(ids)
    stored = rangecoder.Prior.unpack(prior.pack())
    assert prior.freq.sum() == 1 << 16 and (stored.freq == prior.freq).all()
    blocks = rangecoder.encode(ids, prior, block)
    assert len(blocks) == -(-n // block)
    assert (rangecoder.decode(blocks, n, stored, block) == ids).all()
    if n > block:  # any block alone
        assert (rangecoder.decode(blocks[1:2], min(n - block, block), stored, block) == ids[block : 2 * block]).all()
    if kind in ("same", "periodic") and n == 20_000 and block == rangecoder.BLOCK:
        assert sum(map(len, blocks)) < n / 8


def test_carries_go_far_back():
    ids = np.concatenate([np.tile([5, 9], 3000), np.random.default_rng(1).integers(0, 50257, 3000), np.full(4000, 50256)]).astype(np.int32)
    for seed in range(5):
        x = np.random.default_rng(seed).permutation(ids)
        p = rangecoder.Prior.of(ids)
        assert (rangecoder.decode(rangecoder.encode(x, p, 256), len(x), p, 256) == x).all()


def test_block_sizes():
    assert [rangecoder.block_size(n) for n in (0, 1, 256 * 2048, 256 * 2048 + 1, 10**8)] == [256, 256, 256, 512, 4096]


def test_shard_round_trip_and_damage():
    rng = np.random.default_rng(0)
    lengths = [1, 5000, 0, 3]
    ids = rng.integers(0, 50257, sum(lengths)).astype(np.int32)
    data = token_output.pack([5, None, -7, 9], lengths, ids)
    docs, got, back = token_output.unpack(data)
    assert docs == [5, None, -7, 9] and got.tolist() == lengths and (back == ids).all()
    for at in (3, 30, 60, len(data) - 1):
        with pytest.raises(ValueError):
            token_output.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_encoder_equals_the_library():
    rng = random.Random(1)
    texts = ODD + ["one, two!? don't. U.S.A. 3rd x1, ,. . !", "ʼn ªº ǅ ⅷ ², ½."] + ["".join(rng.choice("ab 1.,'\n\té ") for _ in range(rng.randrange(60))) for _ in range(400)]
    e, t = token_output.Encoder(token_output.default_vocab()), tokenizer()
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute(rows):
    t, start, out = tokenizer(), 0, []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [token_output.END]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [token_output.SHARD, 100])
def test_shards_of_a_table(odd, spark, shard):
    rows = sorted({(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()}, key=lambda r: r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, token_output.token_output(df, shard=shard).collect())) == brute(rows)


def test_odd_tables(odd, none):
    got = token_output.token_output(odd).collect()
    assert len(got) == odd.count() and min(r.start for r in got) == 0
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert token_output.token_output(none).collect() == []


def unigram(vocab):
    t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0)] + vocab, 0, False))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_the_library_with_ties(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab▁") for _ in range(n))
    pieces = sorted({word(rng.randrange(1, 5)) for _ in range(25)} - {""})
    vocab = [(p, -float(rng.randrange(1, 4))) for p in pieces]  # many equal sums
    t, c = unigram(vocab), token_counts.Counter(vocab)
    texts = ["".join(rng.choice("aabb c") for _ in range(rng.randrange(30))) for _ in range(300)]
    assert c.texts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_counts_of_odd_rows(odd, none):
    vocab = token_counts.default_vocab()
    t = unigram(vocab)
    want = sorted((str(r.doc_id), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd).collect()) == want
    assert token_counts.token_counts(none).collect() == []
    c = token_counts.Counter(vocab)
    assert c.texts(ODD) == [len(t.encode(x, add_special_tokens=False).ids) for x in ODD]
    assert token_counts.Counter([]).texts(["ab c", ""])[1] == 0


def most_bytes(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_shard_takes_few_bytes_an_id():
    n = 150 * rangecoder.BLOCK
    ids = (np.random.default_rng(0).zipf(1.3, n) % 50257).astype("<u2")
    prior, by_prior = most_bytes(lambda: rangecoder.Prior.of(ids))
    blocks, by_encode = most_bytes(lambda: rangecoder.encode(ids, prior, rangecoder.BLOCK))
    back, by_decode = most_bytes(lambda: rangecoder.decode(blocks, n, prior, rangecoder.BLOCK))
    assert (back == ids).all()
    assert by_prior < 30 * n and by_encode < 10 * n and by_decode < 11 * n


def test_a_task_leaves_nothing_in_its_worker():
    _text.words(np.frombuffer(b"some words", np.uint8), np.array([0, 10]))
    assert _text._powers and list(_text.tidy(iter([1, 2]))) == [1, 2] and not _text._powers


def test_new_words_go_to_the_library_in_runs():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgé") for _ in range(9)) + end for end in ("", ".", "!?", "\nx", "3's") for _ in range(400)]
    e, sent = token_output.Encoder(token_output.default_vocab()), []
    ids, t = e._ids, tokenizer()
    e._ids = lambda texts: [sent.extend(texts), ids(texts)][1]
    e.model = None  # nothing goes round the library's own split
    texts = [" ".join(words[:1500]), " ".join(words[1500:]) + " \0 a\0b", "Ġab Ċ ab"]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(sent) < 2 * len(words) / token_output.RUN


def test_bytes_of_the_format():
    rng, crc = np.random.default_rng(3), 0
    for n, block in ((1, 256), (257, 256), (9000, 256), (9000, 4096)):
        ids = np.where(rng.random(n) < 0.5, np.arange(n) % 7, rng.integers(0, 1 << 16, n) >> rng.integers(0, 15, n))
        prior = rangecoder.Prior.of(ids.astype(np.int32))
        blocks = rangecoder.encode(ids.astype(np.int32), prior, block)
        crc = zlib.crc32(prior.pack()[-4:] + b"".join(blocks), crc)  # the Adler sum: packing may differ
        assert (rangecoder.decode(blocks, n, prior, block) == ids).all()
    assert crc == 2484480047
