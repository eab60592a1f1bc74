import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from harrow.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", "a", " ", "  ", "   " * 40, "a" * 3000, " " * 1000 + "x", "<s>", "</s> <unk> <0x41>", "▁▁a▁", "a▁ b", "é é ﬁ", "日本語 テスト", "😀👍🏽!!", "\n\n\n\t", "a\x00b", "ΑΣ ΟΔΟΣ"]


def many():
    rng = random.Random(5)
    letters = "abcdeéèñßüÀÇ '’.,!?-0123456789\n\t<|>Σσ漢字😀́▁\x00 etaoinshr  "
    some = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    out = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    out += ["".join(rng.choice(some) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return out + ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(100)] + ["".join(rng.choice(some).strip() for _ in range(2000))]


def test_equals_the_library():
    codec, texts = pieces.Codec(pieces.read_model(PATH)), many()
    want = LIBRARY.encode(texts, add_bos=True, add_eos=True)
    for x, ids, w in zip(texts, codec.encode(texts), want, strict=True):
        assert list(memoryview(ids).cast("I")) == w, x
        assert codec.decode(ids) == LIBRARY.decode(w), x
    assert [i[4:-4] for i in codec.encode(texts)] == codec.encode(texts, ends=False)


def test_decodes_any_ids():
    codec, rng = pieces.Codec(pieces.read_model(PATH)), random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randint(1, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids), ids


def test_one_by_one_is_the_same():
    merges, rng = pieces.Codec(pieces.read_model(PATH)).merges, random.Random(7)
    for _ in range(200):
        word = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 80)))
        codes = merges.of_letter[np.frombuffer(word.encode("utf-32-le"), np.uint32)].astype(np.int64)
        assert merges.one_by_one(codes).tolist() == merges.encode([word])[0].tolist()


def test_small_cache(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    codec, texts = pieces.Codec(pieces.read_model(PATH)), many()[:200]
    for _ in range(2):
        for x in texts:
            assert list(memoryview(codec.encode([x])[0]).cast("I")) == LIBRARY.encode(x, add_bos=True, add_eos=True)


def test_query_rows(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(99, None), (None, "Hello"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, pieces.digests(df, PATH).collect()), key=str)
    want = []
    for k, x in rows:
        ids = LIBRARY.encode(x or "", add_bos=True, add_eos=True)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids int, decoded int")
    out = pieces.transcode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.count() == 0


def test_refuses_other_models(tmp_path):
    raw = open(PATH, "rb").read()
    (tmp_path / "m").write_bytes(raw.replace(b"\x0a\x08identity\x12\x00\x18\x01\x20\x00", b"\x0a\x08identity\x12\x00\x18\x01\x20\x01"))
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "m"))
