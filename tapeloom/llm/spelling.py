"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form that each stands for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, maybe_broadcast, small_batches, trimmed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT, FACTOR = 6, 5, 5
#: A task's counts are handed over when it holds so many words.
HELD_WORDS = 200_000

_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def altered(doc_id: str, word: str, every: int) -> str:
    """word, less one code point where `every` divides the crc32 of ``<doc_id>:<word>``, which also names the place."""
    h = zlib.crc32(f"{doc_id}:{word}".encode("utf-8", "surrogatepass"))
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, alter_every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters of all whole texts, A-Z in lower case, of enough code points and occurrences.

    Words are counted within tasks, in parts of bounded size, before counts are shuffled. `alter_every` plants
    misspellings (see altered). Null texts have no words and a null id is an empty text; an empty table gives no rows.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for run_, n in Counter(RUN.findall(text or "")).items():
                    word = run_.lower() if run_.isascii() else run_.translate(_LOWER)
                    if alter_every:
                        word = altered(doc_id or "", word, alter_every)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
        if held:
            yield rows()

    source = small_batches(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: all ordered pairs of distinct words that differ by one inserted, deleted or replaced code point.

    One word of a pair gives two disjoint chunks, its first and its last half (without the middle of an odd length); the
    other gives its grams as long as such a half, with their places. An edit lies outside one of the chunks, which then is
    a gram of the other word at most one place further; so every pair meets, with either word as the one of two chunks.
    Grams that lie over one place off wherever a chunk of a word of like length begins can't meet one and are left out, so
    that a word gives a few grams however long it is. Candidates of unlike lengths, or more than an edit apart, leave the join unseen.

    Words have 2 code points at least. Hot grams are for adaptive skew joins to split, as both sides are shuffled plainly.
    """
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    ends = F.array(F.lit(0), size - half)
    chunk = words.select("word", size.alias("size"), half.alias("q"), F.explode(ends).alias("p"))
    chunk = chunk.select("word", "size", F.expr("substring(word, p + 1, q)").alias("gram"), F.explode(F.expr("array(p - 1, p, p + 1)")).alias("p")).filter("p >= 0")
    lengths = F.array_distinct(F.array(*[F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]))
    grams = words.select(F.col("word").alias("near"), size.alias("near_size"), F.explode(lengths).alias("q")).filter("q > 0 AND q <= near_size")
    places = F.expr("filter(array_distinct(array(0, 1, near_size - q - 2, near_size - q - 1, near_size - q)), p -> p BETWEEN 0 AND near_size - q)")
    grams = grams.select("near", "near_size", "q", F.explode(places).alias("p"))
    grams = grams.select("near", "near_size", F.expr("substring(near, p + 1, q)").alias("gram"), "p")
    like = (F.abs(F.col("size") - F.col("near_size")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return chunk.join(grams, ["gram", "p"]).filter(like).select("word", "near").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for (word, form): the last form along the chain, whose known length doubles each round."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    n = links.count()
    while True:
        ahead = maybe_broadcast(links.select(F.col("word").alias("root"), F.col("root").alias("far")), n)
        links = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "forms")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of (word, n), words distinct.

    A word's form is its near word of largest n (of equals the least in code-point order) if that is at least `factor`
    times its own n; the root is the last form along the chain, or the word. n grows along a chain, so it ends.
    An empty table gives no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    n = words.count()
    others = maybe_broadcast(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), n)
    best = near_words(words).join(others, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("most", -F.col("best.rank"))
    form = F.when(F.col("most") >= factor * F.col("n"), F.col("best.near"))
    found = found.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("most")).alias("form_n"))
    found = materialise(found, "variants")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
