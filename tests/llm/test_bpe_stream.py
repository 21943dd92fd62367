"""The streaming encoder and decoder against the library, on awkward texts cut anywhere."""

import hashlib
import random

import pytest

from jobmetrics.llm import bpe_stream
from jobmetrics.llm.queries import QUERIES, vocabulary

FILE = vocabulary("word_bpe_49k.json")
ODD = [
    "",
    " \t\n",
    "Hello WORLD's <|endoftext|> éÉ 12 ..''s 's  İΣ",
    "<|startoftext|><|endoftext|><|ENDOFTEXT|> <|endoftext",
    "'re''ve'r e'rex '' 'l 'll",
    "ΑΣ ΣΑΣ ẹ́ ̈́ 각 ㎯½",
    "ééé ñandú 🙂🙂 ▁mark <s>   日本語 \x00\x01\x1c ünïcödé \U00016ea0 \U00010d50 ೝ",
    "a" * 5000,
    "th" * 4000 + "e",
    "!?." * 3000,
    "日本" * 2000,
    "0123456789" * 300,
]


@pytest.fixture(scope="module")
def model():
    return bpe_stream.model(FILE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def texts():
    rng = random.Random(8)
    pool = "aaaabbcdeéÉ ΣσİỊ̴́'srtvemld.!?<|>\n\t 0123½日本🙂ᅠᅡ각՘Ᲊᛪཱི᷺"
    yield from ODD
    for _ in range(1500):
        text = "".join(rng.choices(pool, k=rng.choice([3, 8, 20, 60])))
        yield text + rng.choice(["", "<|endoftext|>", "<|startoftext|>"]) + text[:3]
    for letters in ("ab", "aeiou", "etaoin", "th"):
        yield "".join(rng.choices(letters, k=20_000))


def test_ids_equal_the_librarys_however_the_text_is_cut(model, library):
    rng = random.Random(9)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text).tolist() == want, text[:80]
        size = rng.choice([1, 2, 3, 50]) if len(text) < 500 else 777
        cut = [text[i : i + size] for i in range(0, len(text), size)]
        assert [i for ids in model.pieces(cut) for i in ids] == want, (size, text[:80])
        assert model.tokens(want) == library.decode(want, skip_special_tokens=False)


def test_lookahead_settles_tokens_for_every_continuation(model):
    """Tokens that end the lookahead before the end of a beginning are those of every whole."""
    rng = random.Random(10)
    seen = 0
    for letters in ("etaoin", "ab", "abcdefghijklmnopqrstuvwxyz", "th"):
        for _ in range(30):
            word = "".join(rng.choices(letters, k=400)).encode()
            symbols = [model.inside[b] for b in word]
            ends = [set(), set()]
            for part, found in ((symbols[:300], ends[0]), (symbols, ends[1])):
                at = 0
                for token in model.merged(part):
                    at += model.width[token]
                    found.add(at)
            differ = [p for p in ends[0] ^ ends[1] if p < 300]
            seen = max(seen, 300 - min(differ, default=300))
    assert 0 < seen <= model.lookahead < 1000


def test_lookahead_of_small_lists():
    """By trying all continuations: with merges (b c) and (a b), what follows one symbol after b can still split ab."""
    assert bpe_stream.sufficient_lookahead([("b", "c"), ("a", "b")], len) == 2
    assert bpe_stream.sufficient_lookahead([("a", "b"), ("c", "d")], len) == 1
    assert bpe_stream.sufficient_lookahead([], len) == 0


def test_memory_of_a_long_word_is_bounded(model):
    encoder, most = bpe_stream.Encoder(model), 0
    for _ in range(300):
        encoder.feed("etaoinsh" * 100)
        held = len(encoder.raw) + len(encoder.text) + (len(encoder.run[1].waiting) if encoder.run else 0)
        most = max(most, held)
    assert most < 2 * (model.lookahead + bpe_stream.SLACK) + bpe_stream.HELD


def test_decoder_gives_the_text_in_any_cut(model):
    rng = random.Random(11)
    for text in [*ODD, "日本 naïve <|endoftext|>", "\x80é"]:
        ids = model.encode(text).tolist()
        whole = bpe_stream.Decoder(model)
        want = whole.feed(ids) + whole.finish()
        cut = bpe_stream.Decoder(model)
        size = rng.choice([1, 2, 5])
        assert "".join(cut.feed(ids[i : i + size]) for i in range(0, len(ids), size)) + cut.finish() == want
        assert model.encode(want).tolist() == ids or "<|" in text or "'" in text
    # Bytes that make no character: one replacement for each longest beginning.
    for data in (b"\xe2\x82", b"\xff\xfe", b"\xe2\x28\xa1", b"\xf0\x9f\x98a", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80"):
        decoder = bpe_stream.Decoder(model)
        assert decoder.feed(model.inside[b] for b in data) + decoder.finish() == data.decode(errors="replace")


def test_rows(spark, library):
    schema = "doc_id long, text string, ids int, n_tokens string"
    rows = [(1, None), (1, ""), (None, "Two words"), (2, "Two words"), (2, "Two words"), (3, "x" * 100_000), (4, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], schema)
    got = [tuple(r) for r in bpe_stream.token_digests(docs, FILE).collect()]
    assert len(got) == len(rows)
    for (doc_id, text), row in zip(rows, got):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row == (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    real = bpe_stream.encode_texts(docs, FILE).collect()
    assert real[6]["decoded"] == "a <|endoftext|> b" and real[2]["ids"] == library.encode("Two words", add_special_tokens=False).ids
    assert bpe_stream.token_digests(docs.limit(0), FILE).collect() == []


def test_query_equals_the_library(spark, library):
    small = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_bpe"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
