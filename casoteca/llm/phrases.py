"""Phrase collocation mining after SON: shards are mined on their own, then all candidates are counted.

The documents of a language are dealt to shards. A phrase that occurs ``support`` times in the language occurs
in at least one shard as often as that shard's share of the language asks for, so every shard is mined completely at
that lower support and the union of what they find holds all frequent phrases. A second pass
counts the candidates exactly everywhere. Words count as phrases of length one.

The number of shards is fixed, so that this lower support does not fall when the input grows. Large shards are
mined in pieces, words and pairs before longer phrases: each piece counts its phrases by hash, the
counts of the pieces are added, and phrases that reach the shard's support are noted in a table of bits. Longer
phrases are counted where all pairs inside them are noted. A collision only adds a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casoteca.llm.text import LOWER, byte_table, hashes, mix, parts, segments, text_bytes, word_bounds
from casoteca.sources.session import freed_shuffles
from casoteca.sources.workspace import cut_lineage, passing_tables

#: Bytes of text that a task mines at a time (a shard or a piece of one), and the shards of a language.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 8
#: Shards up to this part of a piece are mined whole, which takes a pass less.
WHOLE = 4
#: Candidates whose hashes go along with the tasks of the second pass; more go as a table of bits.
FEW_CANDIDATES = 4_000_000
#: The table has ``1 << PLACE_BITS`` bits (32 MB) and is made in ``SLICES`` parts.
PLACE_BITS, SLICES = 28, 64
#: Leading bits of a hash that pieces hand on.
HASH_BITS = 40
#: Languages up to which their sizes go along with the tasks.
FEW_LANGUAGES = 100_000
#: Parts that the phrases of a language are dealt to before the last ranking.
SALTS = 64

_BREAK = byte_table([(b, b) for b in b".,;:!?"] + [(0x0A, 0x0D)], True)
_WORD = ~_BREAK & byte_table([(0x20, 0x20), (0x09, 0x09)], False)


def _tokens(column: pa.ChunkedArray) -> Iterator[tuple]:
    """Text in parts: lower-cased bytes, begins, ends and hashes of the words, and for each word how many (up to 127)
    are left to the end of its piece. Phrases never cross the end of a piece."""
    for batch in parts(pa.table({"text": column}).to_batches()):
        data, offsets = text_bytes(batch["text"])
        data = LOWER[data]
        start, end, first = word_bounds(data, offsets, _WORD)
        # a word begins a piece if it is the first of its text or follows a break
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)[start]
        begins = np.ones(len(start), bool)
        begins[1:] = breaks[1:] != breaks[:-1]
        begins[first[:-1][first[:-1] < len(start)]] = True
        edges = np.append(np.flatnonzero(begins), len(start))
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(start))
        yield data, start, end, hashes(data, start, end), np.minimum(left, 127).astype(np.int8)


class Tally:
    """Hashes of the words of some texts, for counting phrases by hash alone."""

    def __init__(self, column: pa.ChunkedArray):
        self.size, words, left = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
        for data, _, _, own, inside in _tokens(column):
            self.size += len(data)
            words.append(own)
            left.append(inside)
        self.words, self.left = np.concatenate(words), np.concatenate(left)

    def counts(self, shortest: int, longest: int,
               seen: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Hashes in order, and counts, of the phrases of each of ``shortest`` to ``longest`` words.

        With a table ``seen``, those where all phrases inside that are shorter than ``shortest`` are in it.
        """
        value, live = mix(self.words), np.ones(len(self.words), bool)
        for length in range(1, longest + 1):
            if length > 1:
                live[:-1] &= live[1:] & (self.left[:-1] >= length)
                live[-1:] = False
                _append(value, np.flatnonzero(live), self.words, length)
            if length >= shortest:
                every = value[live]
                every.sort()
                begin = _begins(every)
                yield length, every[begin], np.diff(np.append(begin, len(every)))
            elif seen is not None:
                live[live] = _among(seen, value[live])


class Shard:
    """The words of some texts and the phrases they form.

    Words are numbered; ``left`` counts the words up to the end of the piece, up to 127 of them.
    """

    def __init__(self, column: pa.ChunkedArray):
        held, known, spelled, inner = [], [], [], []
        self.size = 0
        for data, start, end, own, left in _tokens(column):
            self.size += len(data)
            if not len(start):
                continue
            keys, example, which = np.unique(own, return_index=True, return_inverse=True)
            held.append((len(known), which.astype(np.int32)))
            known.append(keys)
            spelled.append(_pieces(data, start[example], end[example]))
            inner.append(left)
        none = [np.zeros(0, np.int32)]
        self.keys, example = np.unique(np.concatenate(known or [np.zeros(0, np.uint64)]), return_index=True)
        self.spelled = pa.concat_arrays(spelled or [pa.array([], pa.string())]).take(pa.array(example))
        self.words = np.concatenate([np.searchsorted(self.keys, known[k]).astype(np.int32)[which]
                                     for k, which in held] or none)
        self.left = np.concatenate(inner or none)

    def phrases(self, longest: int, support: int, some: np.ndarray | None,
                ) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """For every length: where an example of each phrase begins, its count, the length and its hash.

        Phrases qualify with ``support`` occurrences or, if ``some`` is given, with a hash in it (see ``_among``).
        They are told apart by pairs of numbers, not by hashes: one stands for the phrase without its
        last word, the other for that word. Longer phrases are looked for where both shorter ones inside
        them qualify; so parts of a phrase in ``some`` must be in it too.
        """
        value = mix(self.keys)
        at, key, live = np.arange(len(self.words), dtype=np.int32), self.words, np.ones(len(self.words), bool)
        rolled = None if some is None else value[self.words]
        for length in range(1, longest + 1):
            if length > 1:
                at = np.flatnonzero(live[:-1] & live[1:] & (self.left[:-1] >= length)).astype(np.int32)
                if some is not None:
                    _append(rolled, at, self.keys, length, self.words)
            if some is not None:
                at = at[_among(some, rolled[at])]
            pair = self.words[at] if length == 1 else \
                key[at].astype(np.int64) << np.int64(32) | self.words[at + (length - 1)]
            if not len(pair):
                return
            order = np.argsort(pair)
            pair = pair[order]
            begin = _begins(pair)
            count = np.diff(np.append(begin, len(pair)))
            example = at[order[begin]]
            if some is not None:
                value, good = rolled[example], np.ones(len(begin), bool)
            else:
                if length > 1:
                    value = mix(value[key[example]] * np.uint64(3) + self.keys[self.words[example + (length - 1)]])
                good = count >= support
            key, live = np.zeros(len(self.words), np.int32), np.zeros(len(self.words), bool)
            key[at[order]] = np.repeat(np.arange(len(begin), dtype=np.int32), count)
            live[at[order]] = np.repeat(good, count)
            yield example[good], count[good], length, value[good]

    def texts(self, begin: np.ndarray, length: int) -> pa.Array:
        """Phrases with one space between words."""
        return pc.binary_join_element_wise(
            *(self.spelled.take(pa.array(self.words[begin + k])) for k in range(length)), " ")


def _append(value: np.ndarray, at: np.ndarray, words: np.ndarray, length: int, number: np.ndarray | None = None) -> None:
    """The hashes of phrases that begin ``at`` become those of phrases longer by a word, some at a time."""
    for a in range(0, len(at), 1 << 18):
        some = at[a:a + (1 << 18)]
        last = some + (length - 1)
        value[some] = mix(value[some] * np.uint64(3) + words[last if number is None else number[last]])


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal entries begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _among(some: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which hashes are in ``some``: hashes in order, or bytes of a table of bits, where some others seem to be too."""
    if some.dtype == np.uint8:
        place = value >> np.uint64(64 - PLACE_BITS)
        return (some[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    place = np.searchsorted(some, value)
    place[place == len(some)] = 0
    return some[place] == value if len(some) else np.zeros(len(value), bool)


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    ends = np.concatenate(([0], np.cumsum(size)))
    raw = data[np.repeat(start, size) + segments(size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))


_SCHEMA = "lang string, phrase string, words int, hash long, count long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _found(lang: str, shard: Shard, longest: int, support: int, some: np.ndarray | None) -> pa.Table:
    out = [pa.Table.from_arrays([pa.array(v, t) for v, t in zip(([lang], [None], [0], [0], [len(shard.words)]), _TYPES)], _NAMES)]
    for begin, count, length, value in shard.phrases(longest, support, some):
        if len(begin):
            out.append(pa.Table.from_arrays(
                [pa.repeat(lang, len(begin)), shard.texts(begin, length), pa.repeat(pa.scalar(length, pa.int32()), len(begin)),
                 pa.array(value.view(np.int64)), pa.array(count)], _NAMES))
    return pa.concat_tables(out)


def _rows(documents: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
                            F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def _sizes(rows: DataFrame) -> DataFrame:
    """lang, the bytes of its texts, and in how many pieces each of its shards is mined."""
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    return cut_lineage(sizes.withColumn("pieces", F.greatest(
        F.lit(1), F.ceil(F.col("bytes") / F.lit(LEAST_SHARDS * SHARD_BYTES))).cast("long")))


def _shards(documents: DataFrame, lang_column: str, text_column: str, sizes: DataFrame | None = None) -> DataFrame:
    """lang, text, the shard of a row and its piece, and what ``_sizes`` has of the language."""
    rows = _rows(documents, lang_column, text_column)
    sizes = _sizes(rows) if sizes is None else sizes
    # texts move once, by language, shard and piece together: never by language alone
    return rows.withColumn("row", F.monotonically_increasing_id()).join(_few(sizes), "lang") \
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(LEAST_SHARDS)).cast("int")) \
        .withColumn("piece", F.pmod(F.xxhash64("row", F.lit(1)), "pieces")) \
        .drop("row").repartition("lang", "shard", "piece")


def _few(languages: DataFrame) -> DataFrame:
    """A table with a row per language, marked for broadcast if a count shows that it is small."""
    return F.broadcast(languages) if languages.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES else languages


def _mined(shards: DataFrame, longest: int, support: int, some=None) -> DataFrame:
    """Phrases of every shard, or piece of one, with their counts there; a row without a phrase has its words.

    In the first pass a shard's support is its share of the language's bytes, rounded up.
    """
    def run(table: pa.Table) -> pa.Table:
        lang, whole = table["lang"][0].as_py(), table["bytes"][0].as_py()
        shard = Shard(table["text"])
        if some is not None:
            return _found(lang, shard, longest, 1, some.value)
        return _found(lang, shard, longest, _share(support, shard.size, whole), None)

    return shards.groupBy("lang", "shard", "piece").applyInArrow(run, _SCHEMA)


def _share(support: int, size: int, whole: int) -> int:
    return max(1, -(-support * size // max(whole, 1)))


def _packed(value: np.ndarray) -> bytes:
    """The leading ``HASH_BITS`` of hashes in order, highest bytes first, which compresses well."""
    short = (value >> np.uint64(64 - HASH_BITS)).view(np.uint8).reshape(-1, 8)
    return short[:, HASH_BITS // 8 - 1::-1].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """Hashes with zeros in place of what ``_packed`` has left out."""
    short = np.frombuffer(data, np.uint8).reshape(HASH_BITS // 8, -1)
    out = np.zeros((short.shape[1], 8), np.uint8)
    out[:, :8 - HASH_BITS // 8 - 1:-1] = short.T
    return out.view(np.uint64)[:, 0]


def _places(value: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Places of hashes (in order) in the table of bits, by slice."""
    place = np.unique(value >> np.uint64(64 - PLACE_BITS)).astype(np.uint32)
    limits = np.searchsorted(place, np.arange(SLICES + 1, dtype=np.uint32) * np.uint32((1 << PLACE_BITS) // SLICES))
    for k in np.flatnonzero(np.diff(limits)):
        yield int(k), place[limits[k]:limits[k + 1]].tobytes()


def _place_rows(value: np.ndarray) -> pa.RecordBatch:
    rows = list(_places(value))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()),
                                       pa.array([x for _, x in rows], pa.binary())], ["slice", "places"])


def _table_of_bits(places: DataFrame, seen: np.ndarray | None = None) -> np.ndarray:
    """Bytes of a table with the bits of ``seen`` and those that rows of (slice, places) name; slices are made in tasks."""
    size = (1 << PLACE_BITS) // SLICES

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        for data in table["places"]:
            bits[np.frombuffer(data.as_buffer(), np.uint32) & np.uint32(size - 1)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([packed], pa.binary())})

    made = cut_lineage(places.groupBy("slice").applyInArrow(run, "slice int, bits binary"))
    out = np.zeros((SLICES, size // 8), np.uint8) if seen is None else seen.reshape(SLICES, -1).copy()
    for row in made.toLocalIterator():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _mined_in_pieces(shards: DataFrame, longest: int, support: int) -> np.ndarray:
    """A table of bits of all phrases that reach some shard's share of the support."""
    spark, seen = shards.sparkSession, None
    clipped = np.min_scalar_type(support)
    schema = "lang string, shard int, length int, part int, bytes long, size long, hashes binary, counts binary"
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]
             for x in schema.split(", ")]

    def counted(first: int, last: int, sent) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            lang, shard, whole, pieces = (table[c][0].as_py() for c in ("lang", "shard", "bytes", "pieces"))
            tally, parts, rows = Tally(table["text"]), 2 * pieces, []
            # a part holds the hashes of a range; every piece names its size to each
            begins = np.array([-(-(k << 24) // parts) for k in range(parts)], np.uint64) << np.uint64(40)
            for length, value, count in tally.counts(first, last, sent and sent.value):
                count = np.minimum(count, support).astype(clipped)
                limits = np.append(np.searchsorted(value, begins), len(value))
                rows += [(lang, shard, length, k, whole, tally.size, _packed(value[a:b]), count[a:b].tobytes())
                         for k, (a, b) in enumerate(zip(limits[:-1], limits[1:]))]
            return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                            [x.split()[0] for x in schema.split(", ")])

        return shards.groupBy("lang", "shard", "piece").applyInArrow(run, schema)

    def summed(table: pa.Table) -> pa.Table:
        value = np.concatenate([_unpacked(x.as_buffer()) for x in table["hashes"]])
        count = np.concatenate([np.frombuffer(x.as_buffer(), clipped) for x in table["counts"]])
        order = np.argsort(value)
        value = value[order]
        begin = _begins(value)
        total = np.add.reduceat(count[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        need = _share(support, sum(table["size"].to_pylist()), table["bytes"][0].as_py())
        return pa.Table.from_batches([_place_rows(value[begin][total >= need])])

    # words and pairs are counted in one pass, and all longer ones in another, where the pairs inside them are noted
    for first, last in [(1, min(2, longest)), (3, longest)][:1 + (longest > 2)]:
        sent = None if seen is None else spark.sparkContext.broadcast(seen)
        blocks = counted(first, last, sent)
        seen = _table_of_bits(blocks.groupBy("lang", "shard", "length", "part").applyInArrow(
            summed, "slice int, places binary"), seen)
        if sent is not None:
            sent.destroy()
    return seen


def _mined_whole(shards: DataFrame, longest: int, support: int) -> np.ndarray:
    """All phrases that reach some shard's share of the support: their hashes in order or, if many, a table of bits."""
    local = cut_lineage(_mined(shards, longest, support).where("words > 0").select("hash").distinct())
    if local.count() <= FEW_CANDIDATES:
        return np.unique(local.toArrow()["hash"].to_numpy().view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _place_rows(batch["hash"].to_numpy().view(np.uint64))

    return _table_of_bits(local.mapInArrow(run, "slice int, places binary"))


def _counts(spark: SparkSession, documents: DataFrame, longest: int, support: int, lang_column: str,
            text_column: str) -> DataFrame:
    """lang, phrase, words, count of all phrases with the support; words 0: all words of a language."""
    with freed_shuffles(spark), passing_tables(spark):     # every pass deals the texts anew
        sizes = _sizes(_rows(documents, lang_column, text_column))
        shards = _shards(documents, lang_column, text_column, sizes)
        large = sizes.where(F.col("bytes") > LEAST_SHARDS * SHARD_BYTES // WHOLE).limit(1).count()
        mined = _mined_in_pieces if large else _mined_whole
        some = spark.sparkContext.broadcast(mined(shards, longest, support))
        counted = _mined(shards, longest, support, some).groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
        return cut_lineage(counted.where((F.col("count") >= support) | (F.col("words") == 0)), keep=True)


def collocations(documents: DataFrame, longest: int = 5, support: int = 100, top: int = 2000, percent: int = 100,
                 lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """The ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at
    spaces and tabs. a is a phrase's number of occurrences, n that of all words of the language. Candidates have 2 to
    ``longest`` words and a >= ``support``. The cut of a phrase with the lowest floor(1000 a n / (l r)) counts, l and r
    being the occurrences of both halves; of equal ones that after the fewest words. Candidates inside a longer one
    that has ``percent`` of their occurrences are left out. Order: score and a descending, phrase ascending by bytes.

    Rows without a language are of language ``und``; NULL and empty texts have no words; repeated rows count as often as
    they occur; an empty table gives no rows; other columns are not looked at. A document is one shard's, however
    long it is. Up to 10^14 words a language are counted exactly.
    """
    counts = _counts(documents.sparkSession, documents, longest, support, lang_column, text_column)
    single = counts.where("words > 0").select("lang", "phrase", "count")
    whole = counts.where("words = 0").select("lang", F.col("count").alias("n"))
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"))
    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .withColumn("first", F.concat_ws(" ", F.slice(words, F.lit(1), F.col("k")))) \
        .withColumn("rest", F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.col("words") - F.col("k"))))
    halves = cut.join(single.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"]) \
        .join(single.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"]) \
        .join(_few(whole), "lang")
    scored = halves.withColumn("score", F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(14,0)) * cast(n as decimal(14,0))) div "
        "(cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"))
    lowest = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase inside one longer by several words is inside one longer by a single word that occurs as often or more
    longer = candidates.where("words > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(F.array(
            F.concat_ws(" ", F.slice(words, F.lit(1), F.col("words") - 1)),
            F.concat_ws(" ", F.slice(words, F.lit(2), F.col("words") - 1)))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))) \
        .where(F.col("place") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
