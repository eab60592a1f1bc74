import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from harrow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "don't I'LL we'Ve", "x<|endoftext|>Y <|startoftext|>", "<|endoftext", "a b c\x1cd", "é é ﬁ", "12 345 ½ ²", "日本語 テスト", "😀👍🏽!!", "a" * 3000, "\n\t \r\x0b", "---***", "ß ẞ ǅ", "a\x85b\x00c"]


def test_equals_the_library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    codec = bpe.Codec(bpe.read_vocabulary(PATH))
    rng = random.Random(3)
    letters = "abcdeéèñßüÀÇ '’.,!?-0123456789\n\t<|>Σσ漢字😀́"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        mine = codec.encode(x)
        assert list(memoryview(mine).cast("I")) == ids if mine else ids == [], x
        assert codec.decode(mine) == t.decode(ids, skip_special_tokens=False), x


def test_query_rows(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(i, x) for i, x in enumerate(ODD)] + [(99, None), (None, "Hello"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    want = []
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids int, decoded int")
    out = bpe.transcode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.count() == 0
