import math
import random

import public_tokenizers

from harrow.llm import lattice_lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_held_out_scores_keep_up_with_word_counts(spark):
    """Words of no language, most of them frequent: pieces alone spell each of them letter by letter."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("qzxkvjw") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(400)], k=80))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for head in (5, 1 << 18):
        got = [r for r in lattice_lm.score(df, PATH, head=head).collect() if r.held_out]
        assert got and all(math.isfinite(r.score) for r in got)
        assert all(r.score > r.base_score - 0.05 * r.n_tokens for r in got)


def test_words_and_end_are_shares_of_one(spark):
    """What training holds has its count's share at least, and the rest is left to spellings."""
    docs = [(i, "ab ab cd") for i in range(40)]
    out = {(d, t): lattice_lm.score(spark.createDataFrame([*docs, (None, t)], "doc_id long, text string"), PATH).where("doc_id is null").first() for d, t in ((None, ""), (None, "ab"), (None, "cd"), (None, "\U0001f600" * 300))}
    end, ab, cd, odd = (r.score for r in out.values())
    n = out[None, ""].train_tokens // 4
    assert math.isclose(10**end, n / (4 * n + 2), rel_tol=1e-9)
    share = lambda x: 10 ** (x - end)
    assert 2 * n / (4 * n + 2) <= share(ab) and n / (4 * n + 2) <= share(cd)
    assert 10**end + share(ab) + share(cd) < 1 and math.isfinite(odd) and odd < -300
