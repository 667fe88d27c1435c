"""Wide ids beside null ones come out of every operator and stage as they went in."""

import time

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import bpe, exact_dedup, flac, language, line_dedup, minhash, mixing, pii, quality, sharding, toxicity
from tapeloom.llm.common import materialise
from tapeloom.llm.queries import bpe_codec

IDS = [2**62 + 1, None, 2**62 + 3, 2**62 + 5, -(2**62) - 1]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, f"text number {n} has some words of its own, {'abcdefg'[n] * 40} and a mail a{n}@b.cd", "en", "s") for n, i in enumerate(IDS)]
    return materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1), "wide")


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(IDS[0], 1, 0), (IDS[2], 0, 1), (IDS[3], 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d, k: pii.detect_pii(d),
    "redact": lambda d, k: pii.redact(d),
    "sharding": lambda d, k: sharding.stratified_shards(d, shards=2),
    "minhash": lambda d, k: minhash.near_duplicates(d),
    "flac": lambda d, k: flac.media_digests(d),
    "quality": lambda d, k: quality.classify_quality(d, k),
    "toxicity": lambda d, k: toxicity.classify_toxicity(d, k),
    "exact": lambda d, k: exact_dedup.exact_dedup(d),
    "bpe": lambda d, k: bpe.round_trip(d, bpe_codec(d.sparkSession)),
    "mixing": lambda d, k: mixing.mix(d, k, {"good": 0.8, "poor": 0.1, "toxic": 0.1}),
    "language": lambda d, k: language.identify_language(d),
    "lines": lambda d, k: line_dedup.drop_shared_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_are_kept(name, wide, known):
    found = OPERATORS[name](wide, known).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((i is None, i or 0) for i in IDS)
    for of in ("class_id", "keep_id"):
        assert all(r[of] == r["doc_id"] for r in found if of in r.asDict())


def test_stages_keep_ids(spark, wide, known, tmp_path):
    import corpus_pipeline

    known.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    frame, left = wide, set(IDS)
    for name, function in corpus_pipeline.STAGES:
        frame = materialise(function(spark, frame, str(tmp_path)), f"ids-{name}")
        now = {r["doc_id"] for r in frame.select("doc_id").collect()}
        assert now <= left, name
        left = now
    assert left


def test_long_words_take_few_rounds(spark):
    """A word of 30 000 random letters: seconds, where one contraction in a step takes minutes; and equal ids."""
    import random

    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    engine, rng = bpe.Engine(ranks, public_tokenizers.PATTERN), random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "ab" * 9000, "x" * 20_001, "".join(rng.choice("日本語の文章を") for _ in range(4000)), "".join(rng.choice(["the", "ing", "tion", "a"]) for _ in range(3000))]
    began = time.process_time()
    found = [engine.encode([words[0]]).to_pylist()[0]]
    took = time.process_time() - began  # of this process, which other work on the machine doesn't lengthen
    found += [engine.encode([w]).to_pylist()[0] for w in words[1:]]
    assert found == [own.encode_ordinary(w) for w in words]
    assert took < 15
    for alphabet in ("ab", "abc", "aeiou", "est", "日本a"):
        for _ in range(12):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(401, 900)))
            assert engine.encode([word]).to_pylist() == [own.encode_ordinary(word)]


def test_long_words_of_any_vocabulary_equal_a_plain_loop():
    """Ranks in any order, so that contractions open pairs of lower rank; and words in which equal pairs stand close."""
    import random

    def plain(ranks, raw):
        toks = [bytes([b]) for b in raw]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(toks, toks[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[t] for t in toks]
            i = best[1]
            toks[i : i + 2] = [toks[i] + toks[i + 1]]

    for seed in range(20):
        rng = random.Random(seed)
        letters = rng.choice(["ab", "abc", "a", "abcd"])
        tokens = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, rng.choice([4, 7])))).encode() for _ in range(rng.randrange(3, 40))})
        ids = list(range(256, 256 + len(tokens)))
        rng.shuffle(ids)
        ranks = {bytes([b]): b for b in range(256)} | dict(zip(tokens, ids, strict=True))
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(401, 480))) for _ in range(2)] + [(letters * 500)[:450]]
        assert bpe.Engine(ranks, r"\p{L}+").encode(words).to_pylist() == [plain(ranks, w.encode()) for w in words], seed
