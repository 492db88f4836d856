"""Piece vocabularies: where text may be cut, counting transducers, unigram Viterbi.

A piece model marks white space with U+2581 and puts one mark before every text
that is not empty. Texts are therefore handled with a space put in front.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StringType, StructField,
                               StructType)

from casoteca.llm.text import parts, segments, sums, text_bytes
from casoteca.llm.units import Known, cut, distinct, spread, unit_texts

MARK = "▁"
_MARK_BYTES = MARK.encode()


def marked(text: Column) -> Column:
    """The text with one space in front; empty and NULL texts are empty."""
    text = text.cast("string")
    return F.when(F.octet_length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))


@dataclass
class Vocabulary:
    """Pieces as bytes, with white space as plain spaces."""

    pieces: list[bytes]
    normal: np.ndarray      # piece may be matched in text
    byte_ids: np.ndarray    # piece of each single byte, -1 without byte fallback
    unknown: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                                or model.is_unused(i)) for i in range(n)])
        byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(names[i][3:5], 16)] = i
        return cls([x.replace(MARK, " ").encode() for x in names], normal, byte_ids, model.unk_id())

    def joined(self) -> np.ndarray:
        """Pairs of neighbouring bytes that some piece holds, or that lie inside a character.

        Between all others no piece reaches, so tokens end there.
        """
        pairs = np.zeros((256, 256), bool)
        pairs[:, 0x80:0xC0] = True
        for piece in {p for p, ok in zip(self.pieces, self.normal) if ok}:
            for form in (piece, piece.replace(b" ", _MARK_BYTES)):
                raw = np.frombuffer(form, np.uint8)
                pairs[raw[:-1], raw[1:]] = True
        pairs[0x20, 0xE2] = pairs[0x81, 0x20] = True   # a space beside a mark in the text itself
        return pairs


# ---------------------------------------------------------------- counting


class Transducer:
    """A deterministic transducer over bytes whose transitions carry token counts.

    States are prefixes of units. A transition emits what its byte adds to the
    number of tokens of the prefix when it ends a known unit, and 0 inside; the
    emissions of a run from the start state add up to the tokens of the unit.
    States are compiled when first met, at most ``limit`` of them, after which
    compilation starts again. Units over ``longest`` bytes are counted directly.
    """

    def __init__(self, count: Callable[[list[str]], list[int]], limit: int = 2_000_000,
                 longest: int = 48):
        self.count, self.limit, self.longest = count, limit, longest
        self._clear()

    def _clear(self) -> None:
        self.keys, self.targets = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.emitted = np.full(1, -1, np.int64)          # tokens of the unit that ends here

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states; missing ones are made."""
        key = state.astype(np.uint64) << np.uint64(8) | byte
        at = np.searchsorted(self.keys, key)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == key[there]
        if not there.all():
            new = np.unique(key[~there])
            ids = len(self.emitted) + np.arange(len(new))
            place = np.searchsorted(self.keys, new)
            self.keys = np.insert(self.keys, place, new)
            self.targets = np.insert(self.targets, place, ids)
            self.emitted = np.concatenate((self.emitted, np.full(len(new), -1, np.int64)))
            at = np.searchsorted(self.keys, key)
        return self.targets[at]

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each of the given (distinct) units."""
        size = end - start
        out = np.empty(len(start), np.int64)
        long = np.flatnonzero(size > self.longest)
        if len(long):
            out[long] = self.count(unit_texts(data, start[long], end[long]))
        short = np.flatnonzero(size <= self.longest)
        if len(self.emitted) + size[short].sum() > self.limit and len(self.emitted) > 1:
            self._clear()
        state = np.zeros(len(short), np.int64)
        live, depth = np.arange(len(short)), 0
        while len(live):
            live = live[size[short[live]] > depth]
            state[live] = self._step(state[live], data[start[short[live]] + depth])
            depth += 1
        unknown = np.flatnonzero(self.emitted[state] < 0)
        if len(unknown):
            self.emitted[state[unknown]] = self.count(
                unit_texts(data, start[short[unknown]], end[short[unknown]]))
        out[short] = self.emitted[state]
        return out


@dataclass
class ChunkMap:
    """What a chunk does to any state of the transducer.

    The state at a chunk's begin is the unit begun before it. A cut inside the
    chunk forgets it, so the map is: the bytes before the first cut finish the
    unit that came in, ``inner`` tokens follow, ``tail`` goes on. Without a cut the
    chunk only lengthens the unit.
    """

    head: bytes
    inner: int
    tail: bytes
    has_cut: bool


def compose(a: ChunkMap, b: ChunkMap, tokens: Callable[[bytes], int]) -> ChunkMap:
    if not a.has_cut and not b.has_cut:
        return ChunkMap(a.head + b.head, 0, b"", False)
    if not a.has_cut:
        return ChunkMap(a.head + b.head, b.inner, b.tail, True)
    if not b.has_cut:
        return ChunkMap(a.head, a.inner, a.tail + b.head, True)
    return ChunkMap(a.head, a.inner + tokens(a.tail + b.head) + b.inner, b.tail, True)


def scan(maps: list[ChunkMap], tokens: Callable[[bytes], int]) -> ChunkMap:
    """Composition of all maps, neighbours first, in rounds that could run side by side."""
    while len(maps) > 1:
        pairs = [compose(a, b, tokens) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[len(maps) & ~1:]
    return maps[0]


def token_counts(documents: DataFrame, model: str, limit: int = 4096, chunk_bytes: int = 1 << 16,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text, exactly as the library gives them.

    Texts above ``chunk_bytes`` are counted chunk by chunk; the chunks' state maps
    are composed in a scan. NULL and empty texts have 0 bytes and tokens. Rows
    are kept one for one whatever their ids; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known, joined = _counter(model)

        def tokens(unit: bytes) -> int:
            raw = np.frombuffer(unit, np.uint8)
            begin = cut(raw, np.array([0, len(raw)]), joined)
            return int(machine.run(raw, begin, np.append(begin[1:], len(raw))).sum()) if unit else 0

        for part in parts(batches):
            data, offsets = text_bytes(part["text"])
            begin = cut(data, offsets, joined)
            stop = np.append(begin[1:], len(data))
            size = np.diff(offsets)
            n = np.zeros(part.num_rows, np.int64)
            if len(begin):
                keys, where, which = distinct(data, begin, stop)

                def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    at = where[new]
                    return machine.run(data, begin[at], stop[at]), np.ones(len(at), np.int64)

                at, _ = known.look_up(keys, make)
                per_unit = known.values[at][which]
                first = np.searchsorted(begin, offsets)
                n = sums(per_unit, first)
                for d in np.flatnonzero(size > chunk_bytes):
                    mine = begin[first[d]:first[d + 1]]
                    counted = np.concatenate(([0], np.cumsum(per_unit[first[d]:first[d + 1]])))
                    n[d] = _by_chunks(data, int(offsets[d]), int(offsets[d + 1]), mine, counted,
                                      chunk_bytes, tokens)
            yield pa.RecordBatch.from_arrays(
                [part["row"], pa.array(np.maximum(size - 1, 0)), pa.array(n), pa.array(n > limit)],
                ["row", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col(id_column).alias("row"), marked(F.col(text_column)).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_bytes long, n_tokens long, over_limit boolean") \
        .withColumnRenamed("row", id_column)


@lru_cache(maxsize=1)
def _counter(model: str) -> tuple[Transducer, Known, np.ndarray]:
    """The transducer of this worker process."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)

    def count(texts: list[str]) -> list[int]:
        # the library adds the mark that the unit's own leading space stands for
        units = [x[1:] if x.startswith(" ") and len(x) > 1 else None for x in texts]
        plain = library.encode([u for u in units if u is not None], num_threads=1)
        given = iter(map(len, plain))
        return [next(given) if u is not None else _without_mark(library, x)
                for u, x in zip(units, texts)]

    return Transducer(count), Known(500_000), Vocabulary.load(model).joined()


def _without_mark(library, unit: str) -> int:
    """Tokens of a unit inside a word: a line break before it keeps the mark away from it."""
    return len(library.encode("\n" + unit)) - len(library.encode("\n"))


def _by_chunks(data: np.ndarray, begin: int, end: int, cuts: np.ndarray, counted: np.ndarray,
               chunk: int, tokens: Callable[[bytes], int]) -> int:
    maps = []
    for a in range(begin, end, chunk):
        b = min(a + chunk, end)
        low, high = np.searchsorted(cuts, [a, b])
        if low == high:
            maps.append(ChunkMap(data[a:b].tobytes(), 0, b"", False))
        else:
            maps.append(ChunkMap(data[a:cuts[low]].tobytes(), int(counted[high - 1] - counted[low]),
                                 data[cuts[high - 1]:b].tobytes(), True))
    whole = scan(maps, tokens)
    return tokens(whole.head) + whole.inner + tokens(whole.tail)


# ------------------------------------------------------- unigram encoding


class DoubleArray:
    """A trie in two arrays: the child of ``s`` by byte ``b`` is ``base[s] + b`` if ``check`` there is ``s``."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        self.longest = max(map(len, keys), default=0)
        base, check, value = [0], [0], [-1]
        single, several = 1, 1            # where to look for room, by number of children

        def grow(to: int) -> None:
            more = to + 1 - len(check)
            if more > 0:
                base.extend([0] * more)
                check.extend([-1] * more)
                value.extend([-1] * more)

        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            groups = []
            i = low
            while i < high:
                if len(keys[i]) == depth:
                    if value[state] < 0:
                        value[state] = values[i]
                    i += 1
                    continue
                j, byte = i, keys[i][depth]
                while j < high and keys[j][depth] == byte:
                    j += 1
                groups.append((byte, i, j))
                i = j
            if not groups:
                continue
            if len(groups) == 1:
                grow(single + 1)
                while check[single] >= 0:
                    single += 1
                    grow(single + 1)
                at = max(1, single - groups[0][0])
                if at + groups[0][0] != single:
                    at = max(1, several)
            else:
                at = several
            tries = 0
            while True:
                grow(at + 256)
                if all(check[at + g[0]] < 0 for g in groups):
                    break
                at += 1
                tries += 1
            if tries > 64:
                several = max(several, at - 32)
            base[state] = at
            for byte, i, j in groups:
                check[at + byte] = state
                todo.append((at + byte, i, j, depth + 1))
        grow(len(check) + 256)
        self.base, self.check, self.value = map(np.array, (base, check, value))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children, or -1."""
        to = self.base[state] + byte
        to = np.where(to < len(self.check), to, 0)
        return np.where((self.check[to] == state) & (to > 0), to, -1)


def rank_scores(vocabulary: Vocabulary) -> np.ndarray:
    """Log probabilities by Zipf's law over the order of the normal pieces."""
    rank = np.cumsum(vocabulary.normal)
    total = (1 / np.arange(1, vocabulary.normal.sum() + 1)).sum()
    return np.where(vocabulary.normal, -np.log(np.maximum(rank, 1) * total), -np.inf)


class Unigram:
    """The segmentation of a unit with the highest sum of piece scores.

    Between equal sums the one whose last piece is longer wins. A character that
    no piece covers alone may become its bytes, at the lowest score less 10.
    """

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray):
        normal = [i for i in range(len(vocabulary.pieces)) if vocabulary.normal[i]]
        self.trie = DoubleArray([vocabulary.pieces[i] for i in normal], normal)
        self.scores, self.byte_ids, self.unknown = scores, vocabulary.byte_ids, vocabulary.unknown
        self.penalty = float(scores[normal].min()) - 10

    def encode(self, data: np.ndarray, start: np.ndarray,
               end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all units, how many each has, and each one's score."""
        size = end - start
        score = np.zeros(len(start))
        count = np.zeros(len(start), np.int64)
        flat, owner, place = [], [], []
        by_size, done = np.argsort(size, kind="stable"), 0
        while done < len(start):      # classes of similar length keep the tables small
            length = int(size[by_size[done]])
            top = 16 if length <= 16 else max(length, min(2 * length, 1 << 20))
            to = int(np.searchsorted(size[by_size], top, side="right"))
            room = max(1, (4 << 20) // (top + 1))
            mine = by_size[done:min(to, done + room)]
            a, b, c, s = self._viterbi(data, start[mine], size[mine])
            score[mine] = s
            flat.append(a), owner.append(mine[b]), place.append(c)
            done += len(mine)
        if not flat:
            return np.zeros(0, np.int64), count, score
        flat, owner, place = map(np.concatenate, (flat, owner, place))
        by = np.lexsort((place, owner))
        np.add.at(count, owner, 1)
        return flat[by], count, score

    def _viterbi(self, data, start, size):
        n, longest = len(start), int(size.max())
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, longest + 1), np.int64)      # where the last piece begins
        piece = np.full((n, longest + 1), -1, np.int64)  # which it is; -1: bytes
        for s in range(longest):
            live = np.flatnonzero((size > s) & (best[:, s] > -np.inf))
            if not len(live):
                continue
            state = np.zeros(len(live), np.int64)
            lead = data[start[live] + s]
            wide = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            wide = np.minimum(wide, size[live] - s)
            alone = np.zeros(n, bool)
            chars = np.zeros(n, np.int64)
            chars[live] = wide
            rows = live
            for k in range(1, self.trie.longest + 1):
                inside = size[rows] >= s + k
                rows, state = rows[inside], state[inside]
                state = self.trie.step(state, data[start[rows] + s + k - 1])
                rows, state = rows[state >= 0], state[state >= 0]
                if not len(rows):
                    break
                value = self.trie.value[state]
                ends = value >= 0
                r, v = rows[ends], value[ends]
                alone[r[chars[r] == k]] = True
                total = best[r, s] + self.scores[v]
                better = total > best[r, s + k]
                r, v = r[better], v[better]
                best[r, s + k], back[r, s + k], piece[r, s + k] = total[better], s, v
            r = live[~alone[live]]
            to = s + chars[r]
            total = best[r, s] + self.penalty
            better = total > best[r, to]
            r, to = r[better], to[better]
            best[r, to], back[r, to], piece[r, to] = total[better], s, -1
        flat, owner, place = [], [], []
        at = size.copy()
        rows = np.arange(n)
        while len(rows):
            rows = rows[at[rows] > 0]
            before, got = back[rows, at[rows]], piece[rows, at[rows]]
            whole = got >= 0
            flat.append(got[whole]), owner.append(rows[whole]), place.append(before[whole])
            odd = rows[~whole]
            for row, a, b in zip(odd, before[~whole], at[odd]):
                ids = self.byte_ids[data[start[row] + a:start[row] + b]]
                ids = ids if (ids >= 0).all() else np.array([self.unknown])
                flat.append(ids), owner.append(np.full(len(ids), row))
                place.append(a + np.arange(len(ids)))
            at[rows] = before
        return (np.concatenate(flat), np.concatenate(owner), np.concatenate(place),
                best[np.arange(n), size])


class Decoder:
    """Texts of piece ids: bytes of all pieces, less the space put in front."""

    def __init__(self, vocabulary: Vocabulary):
        raw = list(vocabulary.pieces)
        for byte, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                raw[i] = bytes([byte])
        raw = [b"" if not vocabulary.normal[i] and i not in set(vocabulary.byte_ids.tolist()) else x
               for i, x in enumerate(raw)]
        raw[vocabulary.unknown] = b" \xe2\x81\x87 "
        self.size = np.array([len(x) for x in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes (with the leading spaces), and how many each text has."""
        size = self.size[ids]
        data = self.raw[np.repeat(self.begin[ids], size) + segments(size)]
        return data, sums(size, np.concatenate(([0], np.cumsum(counts))))


@lru_cache(maxsize=1)
def _coder(model: str, scores: Callable[[Vocabulary], np.ndarray],
           ) -> tuple[Unigram, Decoder, np.ndarray, Known]:
    """The coder of this worker process."""
    vocabulary = Vocabulary.load(model)
    return Unigram(vocabulary, scores(vocabulary)), Decoder(vocabulary), vocabulary.joined(), Known(300_000)


def encode_pieces(documents: DataFrame, model: str, id_column: str = "doc_id",
                  text_column: str = "text",
                  scores: Callable[[Vocabulary], np.ndarray] = rank_scores) -> DataFrame:
    """Unigram encoding of every whole text, and the text decoded from it.

    Returns every column of ``documents``, then ids (array), score (sum of log
    scores; a character that becomes bytes or unknown counts the coder's penalty) and decoded. NULL texts stay NULL with no ids; empty ones are empty.
    A mark (U+2581) in a text is no white space: it becomes its bytes and comes back.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder, joined, known = _coder(model, scores)
        for part in parts(batches, "_marked"):
            ids, counts, score = encode_part(part["_marked"], coder, joined, known)
            data, size = decoder.decode(ids, counts)
            ends = np.cumsum(size)
            nothing = part[text_column].is_null().to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            decoded = [None if no else raw[b - n + 1:b].decode("utf-8", "replace") if n else ""
                       for no, b, n in zip(nothing, ends.tolist(), size.tolist())]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32),
                                             pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in names), lists, pa.array(score), pa.array(decoded, pa.string())],
                [*names, "ids", "score", "decoded"])

    schema = StructType([*documents.schema, StructField("ids", ArrayType(IntegerType())),
                         StructField("score", DoubleType()), StructField("decoded", StringType())])
    if len(set(map(str.lower, schema.names))) < len(schema.names):
        raise ValueError("the documents already have a column named ids, score or decoded")
    return documents.withColumn("_marked", marked(F.col(text_column))).mapInArrow(run, schema)


def encode_part(column: pa.Array, coder: Unigram, joined: np.ndarray,
                known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all (marked) texts, how many each has, and each one's score."""
    data, offsets = text_bytes(column)
    begin = cut(data, offsets, joined)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(len(column), np.int64), np.zeros(len(column))
    stop = np.append(begin[1:], len(data))
    keys, where, which = distinct(data, begin, stop)

    def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = where[new]
        ids, count, score = coder.encode(data, begin[at], stop[at])
        return np.insert(ids, np.cumsum(count), score.view(np.int64)), count + 1

    at, size = known.look_up(keys, make)
    size = size - 1                       # the last value of a unit holds the bits of its score
    score = known.values[at + size].view(np.float64)
    ids = spread(known.values, at, size, which)
    first = np.searchsorted(begin, offsets)
    return ids, sums(size[which], first), sums(score[which], first)


def piece_digests(documents: DataFrame, model: str, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """Per document: n_pieces, ids_crc32 (of the little-endian 32-bit ids), score, round_trip.

    ``round_trip`` says whether decoding gives the text back; it is NULL for NULL texts.
    """
    coded = encode_pieces(documents.select(F.col(id_column), F.col(text_column)), model,
                          id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch[id_column], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()),
                 batch["score"], batch["same"]], [id_column, "n_pieces", "ids_crc32", "score", "round_trip"])

    kind = documents.schema[id_column].dataType.simpleString()
    return coded.select(id_column, "ids", "score", (F.col("decoded") == F.col(text_column)).alias("same")) \
        .mapInArrow(run, f"`{id_column}` {kind}, n_pieces long, ids_crc32 long, score double, round_trip boolean")
