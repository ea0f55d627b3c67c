"""Token counts, packing and token files against the library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tablewarden.llm import packing, pretokens, token_counts, token_files  # noqa: E402
from tablewarden.llm.queries import vocabulary  # noqa: E402

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [
    "", " ", "a", "it's we'll they've 'sup x!'s  ''s\n's \n's don't's", "  lead", "trail  ", " \n\n x", "a b c", "x<|endoftext|>y <|startoftext|>", "İstanbul ΑΣ Σ", "étude café é",
    "日本語テキスト 123 ４５", "\u0085a\x1c b\x1dc\x00d", "👍🏽 ok", "ﬁ ŉ ǅ", "=====  ===", "\t\t\ta\t b", "a" * 300, "aaa aaaa", "ababab" * 40, "\r\n\r\n", "don't", "'", "''", "1 22 333",
]


def texts() -> list[str]:
    r = random.Random(2)
    letters = "abcdefgh eéßñ日\n'!1 .,- "
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 400))) for _ in range(60)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path):
    library, some = Tokenizer.from_file(path), texts()
    counts, ids = pretokens.Encoder(path)(some)
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_texts_are_cut_safely(path, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK", 50)
    library, some = Tokenizer.from_file(path), ["".join(texts()).replace("<|endoftext|>", "").replace("<|startoftext|>", "").replace("́", "")]
    counts, ids = pretokens.Encoder(path)(some)
    assert ids.tolist() == library.encode(some[0], add_special_tokens=False).ids


def test_cut_keeps_everything():
    t = "ab cd  ef\n gh" * 50
    assert "".join(pretokens.cut(t, 7)) == t


def test_rank_synchronous_merging():
    library, some = Tokenizer.from_file(BYTES), texts()
    counts, _ = token_counts.counter(BYTES)(some)
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def thue_morse(n: int, a: str = "e", b: str = "t") -> tuple[str, str]:
    """A word and its letter-for-letter complement: equal under every polynomial fingerprint modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("size", [16, 1024])
def test_words_with_one_polynomial_fingerprint(path, size):
    one, other = thue_morse(size)
    library, texts = Tokenizer.from_file(path), [one, other, f"{one} {other}", other]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    together = pretokens.Encoder(path)
    assert together(texts)[1].tolist() == [i for w in want for i in w]
    apart = pretokens.Encoder(path)
    assert [apart([t])[1].tolist() for t in texts] == want
    if path == BYTES:
        assert token_counts.counter(path)(texts)[0].tolist() == [len(w) for w in want]


def test_a_memo_hit_is_compared_letter_by_letter(monkeypatch):
    """With fingerprints that say nothing, ids are still right."""
    monkeypatch.setattr(pretokens, "span_hashes", lambda codes, starts, ends: np.ones(len(starts), np.uint64))
    library, some = Tokenizer.from_file(BYTES), texts()
    encode = pretokens.Encoder(BYTES)
    for t in some * 2:
        assert encode([t])[1].tolist() == library.encode(t, add_special_tokens=False).ids


def test_added_tokens_inside_texts_go_through_the_merging(monkeypatch):
    library, counter = Tokenizer.from_file(BYTES), token_counts.counter(BYTES)
    monkeypatch.setattr(pretokens.Encoder, "_whole", lambda *a: pytest.fail("the library encoded a text"))
    some = ["x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|><|endoftext|> b ", "<|endoftext", "it's <|endoftext|>'s"]
    assert counter(some)[0].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, part int")


def test_token_counts(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, "x", None), (None, "", None, 2), (3, "é " * 2000, None, 0)]
    got = sorted(map(tuple, token_counts.token_counts(frame(spark, rows), BYTES).collect()), key=str)
    long = len(Tokenizer.from_file(BYTES).encode("é " * 2000).ids)
    assert got == sorted([(1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (None, 0, 0, False), (3, 6000, long, True)], key=str)
    assert token_counts.token_counts(frame(spark, []), BYTES).collect() == []


def test_packing(spark):
    some = texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(some)] + [(900, None, None, None), (901, "tie", None, 1), (901, "tie", None, 1)]
    library = Tokenizer.from_file(WORDS)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t, _, _ in rows}
    got = sorted(packing.pack(frame(spark, rows).repartition(3), WORDS, window=64, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    at, pieces = 0, {}
    for r in got:
        assert (r.sequence_id, r.offset) == divmod(at, 64) and r.offset + r.length <= 64
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert piece == ids[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids[r.doc_id])
        at += r.length
        pieces.setdefault(r.doc_id, []).append(r.length)
    assert at == sum(len(ids[d]) for d, *_ in rows) and sum(pieces[901]) == 2 * len(ids[901])
    assert packing.pack(frame(spark, []), WORDS).collect() == []


def test_token_files(spark, tmp_path):
    some = texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(some)] + [(900, None, None, None), (901, "tie", None, 1), (901, "tie", None, 1)]
    random.Random(4).shuffle(rows)
    library = Tokenizer.from_file(BYTES)
    folder = f"file://{tmp_path}/files"
    got = sorted(map(tuple, token_files.token_files(frame(spark, rows).repartition(5), BYTES, length=16, folder=folder).collect()))
    at, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.token_files(frame(spark, []), BYTES).collect() == []


def test_shards_give_random_access(tmp_path):
    folder = f"file://{tmp_path}"
    writer = token_files.ShardWriter(folder, 7, 8, False, 9)
    ids = np.arange(8 * token_files._ROWS * 2 + 11, dtype=np.uint16)
    for part in np.array_split(ids, 13):
        writer.write(part)
    writer.close()
    reader = token_files.ShardReader(folder, 7)
    row, mask = reader.sequence(300)
    assert row.tolist() == ids[2400:2408].tolist() and mask.all()
    row, mask = reader.sequence(len(ids) // 8)
    assert mask.tolist() == [True] * 3 + [False] * 5 and row[3:].tolist() == [9] * 5
    assert reader.ids(2040, 30).tolist() == ids[2040:2070].tolist()
    reader.close()
