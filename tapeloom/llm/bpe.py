"""Byte-level BPE encoding and decoding by DuckDB queries within Spark's partitions."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Texts are handled in blocks of about so many characters (a longer text is a block of its own).
BLOCK_CHARS = 600_000
#: A task's memo of encoded words has two generations of so many words; words in use move to the younger one.
MEMO_WORDS = 80_000
#: Words of more bytes take many contractions in a step, the others one.
LONG_BYTES = 400
#: Memory of a worker's DuckDB, which writes no files; a word of over half a million bytes gets as much more as it needs.
MEMORY, MEMORY_A_BYTE = 200_000_000, 400
#: Words of one query: so many bytes of states at most (LEFTMOST keeps each word's states until its fixpoint).
QUERY_BYTES = 40_000_000

#: One step: the token pairs of each word meet the merge table; its leftmost pair of least rank becomes one token.
LEFTMOST = """
WITH RECURSIVE state(word, toks) AS (
    SELECT word, toks FROM fresh
    UNION ALL
    SELECT s.word, s.toks[:b.pos - 1] || [b.tok] || s.toks[b.pos + 2:]
    FROM state s JOIN (
        SELECT p.word, min(m.tok::BIGINT * 1048576 + p.pos) AS least, least // 1048576 AS tok, least % 1048576 AS pos
        FROM (SELECT word, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[:-2], 1) AS pos FROM state) p
        JOIN merges m ON p.l = m.l AND p.r = m.r GROUP BY p.word
    ) b ON s.word = b.word
)
SELECT word, arg_min(toks, len(toks)) AS toks FROM state GROUP BY word ORDER BY word
"""
#: The same contractions for long words, many in a step. {reach} is the length of the longest token within the words. A pair may go
#: ahead of its turn where no pair up to {reach} places off ranks lower: what is contracted before its turn ranks lower too, and would have
#: to grow over all those places, into a longer token than there is, to touch it. Pairs of equal rank go from the left: a cluster of them, with
#: gaps of {reach} places at most, up to the first that lower pairs are near or whose new neighbours would rank lower; of adjacent ones every other.
LOCAL = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
    SELECT word, toks FROM fresh
    UNION
    SELECT word, list(tok ORDER BY pos) FROM (
        SELECT word, pos, CASE WHEN taken THEN rank ELSE tok END AS tok, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM (
            SELECT *, chosen AND coalesce(bool_and(plain) OVER (PARTITION BY word, rank, cluster ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS taken FROM (
                SELECT c.*, hit AND clean AND NOT (chosen AND least(coalesce(a.tok, c.rank), coalesce(b.tok, c.rank)) < c.rank) AS plain FROM (
                    SELECT *, lead(tok, 2) OVER w AS after, CASE WHEN lag(chosen, 2, false) OVER w THEN rank ELSE lag(tok) OVER w END AS ahead FROM (
                        SELECT *, hit AND clean AND odd AS chosen FROM (
                            SELECT *, bool_and(hit) OVER g AS clean, row_number() OVER g % 2 = 1 AS odd, sum(CASE WHEN gap <= {reach} THEN 0 ELSE 1 END) OVER (PARTITION BY word, rank ORDER BY pos) AS cluster FROM (
                                SELECT *, pos - row_number() OVER e AS chain, pos - lag(pos) OVER e AS gap, coalesce(rank = best, false) AS hit FROM (
                                    SELECT *, min(rank) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS best, max(rank) OVER (PARTITION BY word) AS worst FROM (
                                        SELECT p.*, m.tok AS rank FROM (SELECT word, unnest(toks) AS tok, unnest(toks[2:] || [-1]) AS nxt, generate_subscripts(toks, 1) AS pos FROM state) p
                                        LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r
                                    )
                                ) WHERE worst IS NOT NULL WINDOW e AS (PARTITION BY word, rank ORDER BY pos)
                            ) WINDOW g AS (PARTITION BY word, rank, chain ORDER BY pos)
                        )
                    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
                ) c
                LEFT JOIN merges a ON c.chosen AND a.l = c.ahead AND a.r = c.rank
                LEFT JOIN merges b ON c.chosen AND b.l = c.rank AND b.r = c.after
            )
        )
    ) WHERE NOT gone GROUP BY word
)
SELECT word, toks FROM state ORDER BY word
"""
#: Decoding: token positions meet the vocabulary; ordered aggregates put the bytes of stretches of tokens together.
STRETCH = 4096
DECODE = f"""
SELECT string_agg(v.piece, '' ORDER BY t.pos) AS piece FROM tokens t JOIN vocab v ON t.tok = v.tok GROUP BY t.pos // {STRETCH} ORDER BY t.pos // {STRETCH}
"""

_engines: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank (and id) of each token from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def latin_pattern(pattern: str) -> re.Pattern:
    """The split pattern for texts of Latin-1 characters alone, its Unicode classes written out; ``re`` runs it faster."""
    every = [chr(c) for c in range(256)]
    ranges = lambda keep: "".join(re.escape(c) for c in every if keep(c))
    kinds = {r"\p{L}": ranges(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": ranges(lambda c: unicodedata.category(c)[0] == "N"), r"\s": ranges(lambda c: bool(regex.match(r"\s", c)))}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern):
        if part in kinds:
            out.append(kinds[part] if inside else f"[{kinds[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{kinds[chr(92) + 's']}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + size[i] - 1 of all i in a row."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class Engine:
    """A DuckDB with the merge table and the vocabulary, and a memo of words already encoded (ids as int32 bytes)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.any_words, self.latin_words = ranks, regex.compile(pattern), latin_pattern(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.by_length = sorted(ranks, key=len, reverse=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(rank)
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "tok": pa.array(whole, pa.int32())})
        # bytes travel as Latin-1 characters: one character a byte, so that string_agg can order and join them
        vocab = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]})
        for name, table in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def forget(self) -> None:
        """Empty the memo: a worker process keeps the tables alone between tasks."""
        self.memo, self.older = {}, {}

    def _contract(self, raw: list[bytes], query: str) -> list[bytes]:
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int32)
        toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(raw), np.uint8)]))
        self.db.register("fresh", pa.table({"word": pa.array(np.arange(len(raw), dtype=np.int32)), "toks": toks}))
        found = self.db.sql(query).to_arrow_table().column("toks").combine_chunks()
        self.db.unregister("fresh")
        flat, cuts = found.values.to_numpy().astype(np.int32).tobytes(), (found.offsets.to_numpy() * 4).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, new: list[str]) -> None:
        """Put the ids of new words in the memo."""
        short, long_ = [], []
        for w in new:
            raw = w.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.memo[w] = np.int32(whole).tobytes()
            else:
                (short if len(raw) <= LONG_BYTES else long_).append((w, raw))
        for lo, hi in _blocks([2 * len(raw) ** 2 for _, raw in short], QUERY_BYTES):
            self.memo.update(zip((w for w, _ in short[lo:hi]), self._contract([raw for _, raw in short[lo:hi]], LEFTMOST), strict=True))
        for reach, part in self._by_reach(long_):
            for lo, hi in _blocks([100 * len(raw) for _, raw in part], QUERY_BYTES):
                most = max(MEMORY, MEMORY_A_BYTE * max(len(raw) for _, raw in part[lo:hi]))
                self.db.execute(f"SET memory_limit = '{most}B'")
                self.memo.update(zip((w for w, _ in part[lo:hi]), self._contract([raw for _, raw in part[lo:hi]], LOCAL.format(reach=reach)), strict=True))
                self.db.execute(f"SET memory_limit = '{MEMORY}B'")

    def _by_reach(self, words: list[tuple[str, bytes]]) -> list[tuple[int, list[tuple[str, bytes]]]]:
        """Words by the length of the longest token within them, rounded up to a power of two."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w, raw in words:
            longest = next((len(t) for t in self.by_length if len(t) <= 8 or t in raw), 8)
            groups.setdefault(1 << max(longest - 1, 1).bit_length(), []).append((w, raw))
        return sorted(groups.items())

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_words.findall(text)
        return self.latin_words.findall(text)

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts as words: (distinct words' ids in a row, their counts, the distinct word of each place, words of each text).

        The ids of a block's distinct words are looked up or learnt once; texts only refer to them.
        """
        split = [self.words(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        new = []
        for w in distinct:
            if w not in self.memo:
                if (known := self.older.get(w)) is None:
                    new.append(w)
                else:
                    self.memo[w] = known
        self.learn(new)
        ids = [self.memo[w] for w in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), np.int32), size, coded.indices.to_numpy(), np.array([len(s) for s in split], np.int64)

    def decode_runs(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """large_binary of the bytes of each run of ids; ids beyond the vocabulary give nothing."""
        self.db.register("tokens", pa.table({"pos": np.arange(len(ids), dtype=np.int32), "tok": ids.astype(np.int32)}))
        found = self.db.sql(DECODE).to_arrow_table().column("piece").to_pylist()
        self.db.unregister("tokens")
        known = (ids >= 0) & (ids < len(self.length))
        ends = _offsets(np.where(known, self.length[np.where(known, ids, 0)], 0))[_offsets(size)]
        return _cut("".join(found).encode("latin-1"), ends)

    def encode(self, texts: list[str]) -> pa.Array:
        """list<int32> of the ids of each text."""
        return _listed(*self.encode_words(texts))

    def decode(self, ids: pa.Array) -> pa.Array:
        """large_binary of the bytes of each list of ids."""
        size = np.diff(ids.offsets.to_numpy())
        return self.decode_runs(ids.flatten().to_numpy(zero_copy_only=False), size)

    def both(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids of each text, and the bytes that they decode to: distinct words' ids are decoded once and put together."""
        ids, size, place, words = self.encode_words(texts)
        pieces = self.decode_runs(ids, size).take(pa.array(place))
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[: len(place) + 1][_offsets(words)]
        return _listed(ids, size, place, words), _cut(pieces.buffers()[2] or b"", ends)


def _cut(data, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])


def _listed(ids: np.ndarray, size: np.ndarray, place: np.ndarray, words: np.ndarray) -> pa.Array:
    each = size[place]
    flat = ids[_spread((np.cumsum(size) - size)[place], each)]
    return pa.ListArray.from_arrays(pa.array(_offsets(each)[_offsets(words)].astype(np.int32)), pa.array(flat))


@contextmanager
def _engine(ranks: dict[bytes, int], pattern: str, key: int) -> Iterator[Engine]:
    """The worker process's engine for one task; between tasks it keeps its tables and no words."""
    if key not in _engines:
        _engines.clear()
        _engines[key] = Engine(ranks, pattern)
    try:
        yield _engines[key]
    finally:
        _engines[key].forget()
        give_back()


def _blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


class Codec:
    """Encoding and decoding columns for one rank file and split pattern; the vocabulary is broadcast (fixed size)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = load_ranks(path)
        self.key = hash((path, pattern, len(ranks)))
        self.ranks, self.pattern = spark.sparkContext.broadcast(ranks), pattern

    def encode(self, text: str | F.Column):
        """array<int> of ids for whole texts: each match of the pattern alone, no special tokens; null counts as empty."""
        ranks, pattern, key = self.ranks, self.pattern, self.key

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with _engine(ranks.value, pattern, key) as engine:
                for batch in batches:
                    texts = [t or "" for t in batch.to_pylist()]
                    yield _joined([engine.encode(texts[lo:hi]) for lo, hi in _blocks([len(t) for t in texts], BLOCK_CHARS)], pa.list_(pa.int32()))

        return run(text)

    def both(self, text: str | F.Column):
        """struct<ids, decoded>: whole texts encoded, and their ids decoded again, in one pass of a worker; null counts as empty."""
        ranks, pattern, key = self.ranks, self.pattern, self.key

        @F.arrow_udf("ids array<int>, decoded binary")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with _engine(ranks.value, pattern, key) as engine:
                for batch in batches:
                    texts = [t or "" for t in batch.to_pylist()]
                    done = [engine.both(texts[lo:hi]) for lo, hi in _blocks([len(t) for t in texts], BLOCK_CHARS)]
                    ids, decoded = _joined([d[0] for d in done], pa.list_(pa.int32())), _joined([d[1] for d in done], pa.large_binary())
                    yield pa.StructArray.from_arrays([ids, decoded.cast(pa.binary())], ["ids", "decoded"])

        return run(text)

    def decode(self, ids: str | F.Column):
        """binary of the bytes of array<int> ids; null gives null, an id beyond the vocabulary gives nothing."""
        ranks, pattern, key = self.ranks, self.pattern, self.key

        @F.arrow_udf("binary")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with _engine(ranks.value, pattern, key) as engine:
                for batch in batches:
                    some = batch.fill_null(pa.scalar([], batch.type)) if batch.null_count else batch
                    size = pc.list_value_length(some).to_pylist()
                    raw = [engine.decode(some.slice(lo, hi - lo)) for lo, hi in _blocks(size, BLOCK_CHARS // 4)]
                    out = _joined(raw, pa.large_binary()).cast(pa.binary())
                    yield pc.if_else(batch.is_null(), pa.scalar(None, pa.binary()), out)

        return run(ids)


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode_documents(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: token ids of every whole text; a null text counts as empty and has none.

    Rows that repeat and null ids give a row each; an empty table gives none; other columns are not read.
    """
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), codec.encode(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ids"))


def round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: texts encoded, and the ids decoded again.

    A null text counts as empty and has no tokens. Rows that repeat and null ids give a row each; an
    empty table gives none; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    coded = small_batches(docs).select(F.col(id_col).alias("doc_id"), codec.both(text).alias("c")).select("doc_id", "c.*")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
