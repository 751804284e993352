import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barwright.llm import id_coder, queries
from barwright.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(tokenizer, text, end=0):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("alphabet", [1, 2, 300, 50_257, 200_000])
@pytest.mark.parametrize("n", [1, 2, 64, 65, 4097, 30_000])
def test_blocks_come_back(n, alphabet):
    dice = np.random.default_rng(n + alphabet)
    for ids in (dice.integers(0, alphabet, n), np.minimum(dice.geometric(0.02, n), alphabet) - 1, np.resize(dice.integers(0, alphabet, 50), n)):
        block = id_coder.encode(ids)
        assert (id_coder.decode(block) == ids).all()


def test_model_learns_and_blocks_stand_alone():
    dice = np.random.default_rng(1)
    words = [dice.integers(0, 50_000, 4) for _ in range(300)]
    ids = np.concatenate([words[i] for i in dice.zipf(1.3, 40_000) % 300])[:100_000]
    block = id_coder.encode(ids)
    # Far below the 16 bits of an id, and below what the frequencies of single ids alone would give.
    counts = np.bincount(ids)
    order0 = -(counts[counts > 0] / len(ids) * np.log2(counts[counts > 0] / len(ids))).sum()
    assert 8 * len(block) / len(ids) < 0.75 * order0
    assert id_coder.encode(ids) == block


@pytest.mark.parametrize("at", [0, 5, 9, 20, 27, 40, -1])
def test_damaged_blocks_are_errors(at):
    block = bytearray(id_coder.encode(np.arange(5000) % 700))
    block[at] ^= 1
    with pytest.raises(ValueError):
        id_coder.decode(bytes(block))


def test_short_cut_equals_the_tokenizer():
    tokenizer, ids_of = Tokenizer.from_file(PATH), tf._encoder(PATH, 0)
    dice = random.Random(2)
    letters = list("abTHE '’sretvlmd019.,!?-_()<|>\n\r\t\x0b\x0c\x1c\x1d\x85\xa0éÜß÷×ªº²µ€😀漢Ωж ́") + ["'ll", "'re", "  ", "<|endoftext|>", " the", "n't"]
    for _ in range(3000):
        text = "".join(dice.choice(letters) for _ in range(dice.randrange(30)))
        assert ids_of(text).tolist() == plain_ids(tokenizer, text), repr(text)


def test_many_texts_at_once_equal_the_tokenizer():
    """Stretches of texts, some empty or for the tokenizer whole; of the pieces only new ones meet the model, also after a new beginning."""
    tokenizer, encoder = Tokenizer.from_file(PATH), tf._Encoder(PATH, 0)
    assert encoder.by_piece
    model, asked = encoder.known.ids_of, []
    encoder.known.ids_of = lambda pieces: (asked.append(len(pieces)), model(pieces))[1]
    dice = random.Random(7)
    letters = list("abTHE 'sretvlmd019.,!?-_()<|>\n\r\t\x0bé ÜßÀ'  ") + ["'ll", "'re", "'ve", "'s'd", "  ", " the", "n't", "x" * 90]
    for most in (300, 1_000_000):
        encoder.known.most = most
        for _ in range(60):
            rows = ["".join(dice.choice(letters) for _ in range(dice.randrange(30))) + dice.choice(["", "’", "<|endoftext|>", "÷"]) * (dice.random() < 0.2) for _ in range(dice.randrange(50))]
            assert [ids.tolist() for ids in encoder.many([row.encode() for row in rows])] == [plain_ids(tokenizer, row) for row in rows]
    asked.clear()
    same = "some words, some other words"
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.many([same.encode()] * 3000)] == [plain_ids(tokenizer, same)] * 3000
    assert sum(asked) <= 5


def test_files_come_back(spark, documents, monkeypatch):
    """Odd rows, several files a task, and documents through many blocks."""
    dice = random.Random(4)
    rows = [(i, " ".join(dice.choice(("some", "words", "Zürich", "x-1", "\n")) for _ in range(dice.randrange(200)))) for i in range(80)]
    rows += [(None, "no id"), (None, None), (-5, ""), (3, "again"), (3, "again"), (3, None), (1000, "a b" * 20_000), (2000, "<|endoftext|> 漢字")]
    tokenizer = Tokenizer.from_file(PATH)
    index, folder = tf.write_tokens(documents(rows).repartition(5), PATH, file_ids=700)
    assert index.count() > 8
    found = tf.read_tokens(index, folder).orderBy("start").collect()
    assert len(found) == len(rows)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    place, expected = 0, {}
    for i, text in rows:
        expected.setdefault(i, []).append(plain_ids(tokenizer, text))
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == place and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        expected[r.doc_id].remove(ids.tolist())
        place += r.n_tokens
    assert not any(expected.values())


def test_nothing_to_write(spark, documents):
    index, folder = tf.write_tokens(documents([]), PATH)
    assert tf.read_tokens(index, folder).count() == 0


def test_long_documents_span_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(id_coder, "BLOCK", 500)
    system, base = tf._filesystem(f"file://{tmp_path}")
    writer = tf._Writer(system, base, 0)
    docs = [("a", 3), ("b", 497), ("c", 1700), (None, 1), ("", 300), ("d", 500), ("e", 10)]
    for name, n in docs:
        writer.add(name, np.arange(n) % 97)
    writer.close()
    found, n = [], 0
    with system.open_input_stream(f"{base}/{writer.name}", compression=None) as source:
        for name, ids, ends in tf._documents(source, writer.name):
            assert (ids == (n + np.arange(len(ids))) % 97).all()
            n += len(ids)
            if ends:
                found.append((name, n))
                n = 0
    assert found == docs
    data = (tmp_path / writer.name).read_bytes()
    for cut in (data[:-1], data[:200], data + b"x", data[: tf.HEAD.size] + data[tf.HEAD.size + 700 :]):
        (tmp_path / "cut").write_bytes(cut)
        with pytest.raises(ValueError), system.open_input_stream(f"{base}/cut", compression=None) as source:
            list(tf._documents(source, "cut"))


def test_query_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in queries.op11_token_files(spark, sf).collect()}
    place = 0
    for doc_id, text in rows:
        ids = np.array(plain_ids(tokenizer, text), "<u4")
        r = found.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (place, len(ids), zlib.crc32(ids))
        place += len(ids)
    assert not found
