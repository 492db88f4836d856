"""Scores by a bigram model with deleted interpolation.

P(w | h) = a2 * c(h, w) / c(h) + a1 * c(w) / N + a0 / (V + 1), where the weights a depend on
how often the context h was seen (``BUCKETS`` of powers of two). They are learned by
expectation-maximisation on held-out counts: the tokens of a fold of the training
documents, against counts of the other folds. The counts that score come from all
training documents.

Counting moves no token by itself. Documents are dealt to chunks of a few MB. A chunk sends
each of its distinct unigrams and bigrams once to the part that counts it, as sorted
hashes with counts, and gets the corpus counts back in the same order. A word in every
document costs one number a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casoteca.llm.text import LOWER, SPACED, hashes, mix, sums, text_bytes, word_bounds

#: Bytes of text of a chunk, and how many parts count for each chunk.
CHUNK_BYTES, PARTS_PER_CHUNK = 6 << 20, 0.5
#: Documents whose remainder by FOLDS is HELD_OUT are only scored; TUNE makes the held-out counts.
FOLDS, HELD_OUT, TUNE = 7, 2, 3
#: Context buckets: unseen, then one for each power of two of the context's count.
BUCKETS = 32
#: Hash bytes of a unigram and of a bigram. With the number of its part, two of n bigrams collide
#: about n^2 / 2^(8 bytes + 1) / parts times; raise beyond 1e9.
KEY_BYTES = (7, 6)
#: Steps of a scale on which held-out events are pooled for the weights: the two logarithms
#: of probability ratios, a quarter of a power of two each.
GRID, FINE = 128, 4

_END, _BEGIN = (mix(np.array([n], np.uint64))[0] for n in (0xE0D, 0xB061))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, where each text's begin, and the contexts."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    start, end, first = word_bounds(data, offsets, SPACED)
    n = len(texts)
    word = hashes(data, start, end)
    tokens = np.insert(word, first[1:], _END) if n else word
    begins = first + np.arange(n + 1)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins[:-1]] = _BEGIN
    return tokens, begins, before


def _distinct(keys: np.ndarray, kind: int, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys as counted, which one each is, and where each part's begin.

    The upper bits choose the part, so parts are stretches of the sorted keys.
    """
    lost = np.uint64(8 * (8 - KEY_BYTES[kind]))
    part = (keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
    short = keys << lost >> lost if lost else keys
    order = np.lexsort((short, part)) if lost else np.argsort(keys, kind="stable")
    p, s = part[order], short[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], which, np.searchsorted(p[new], np.arange(n_parts + 1, dtype=np.uint64))


def _bigrams(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ tokens)


def _pack(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _shorten(counts: np.ndarray) -> bytes:
    """A byte for each count, then in full those that do not fit."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _lengthen(raw, size: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", offset=size)
    return counts


_ASK = "kind int, part int, chunk int, keys binary, trained binary, tuned binary"
_ANSWER = "kind int, part int, chunk int, trained binary, tuned binary, tokens long, types long, tune_tokens long, fit_types long"


def _ask(n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunk = table["chunk"][0].as_py()
        tokens, begins, before = _tokens(table["text"].chunk(0))
        fold = np.repeat(np.asarray(table["fold"]), np.diff(begins))
        rows = []
        for kind, keys in enumerate((tokens, _bigrams(before, tokens))):
            short, which, bounds = _distinct(keys, kind, n_parts)
            trained = np.bincount(which[fold != HELD_OUT], minlength=len(short))
            tuned = np.bincount(which[fold == TUNE], minlength=len(short))
            rows += [(kind, p, chunk, _pack(short[a:b], KEY_BYTES[kind]), _shorten(trained[a:b]), _shorten(tuned[a:b]))
                     for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                        names=[x.split()[0] for x in _ASK.split(", ")])
    return run


def _count(table: pa.Table) -> pa.Table:
    """All chunks' requests to one part: their keys summed, and the sums back to each chunk."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    raw = table["keys"].to_pylist()
    sizes = np.array([len(x) for x in raw]) // KEY_BYTES[kind]
    keys = _unpack(b"".join(raw), KEY_BYTES[kind])
    del raw
    _, which = np.unique(keys, return_inverse=True)
    out, totals = [], []
    ends = np.cumsum(sizes)
    for name in ("trained", "tuned"):
        given = np.concatenate([_lengthen(x, n) for x, n in zip(table[name].to_pylist(), sizes.tolist())])
        total = np.bincount(which, given).astype(np.int64)
        totals.append(total)
        back = total[which]
        out.append([_shorten(back[a:b]) for a, b in zip(ends - sizes, ends)])
    n = len(sizes)
    first = np.arange(n) == 0      # totals are told once a part
    told = lambda v: pa.array(np.where(first, int(v), 0).astype(np.int64))
    return pa.table([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)),
                     table["chunk"].combine_chunks(), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()),
                     told(totals[0].sum()), told((totals[0] > 0).sum()), told(totals[1].sum()),
                     told((totals[0] > totals[1]).sum())],
                    names=[x.split()[0] for x in _ANSWER.split(", ")])


def _counts(answers: pa.Table, kind: int, which: np.ndarray, bounds: np.ndarray, fit: bool) -> np.ndarray:
    """Corpus counts of every token of a chunk; with ``fit`` those without the held-out fold."""
    total = np.zeros(bounds[-1], np.float64)
    kinds, parts = np.asarray(answers["kind"]), np.asarray(answers["part"])
    trained, tuned = (answers[c].combine_chunks() for c in ("trained", "tuned"))
    for i in np.flatnonzero(kinds == kind):
        a, b = int(bounds[parts[i]]), int(bounds[parts[i] + 1])
        total[a:b] = _lengthen(trained[i].as_buffer(), b - a)
        if fit:
            total[a:b] -= _lengthen(tuned[i].as_buffer(), b - a)
    return total[which]


def _resolved(table: pa.Table, answers: pa.Table, n_parts: int, fit: bool):
    """Tokens' counts: of the token, of its context as a context, of the two together."""
    table = table.combine_chunks()
    tokens, begins, before = _tokens(table["text"].chunk(0))
    single, pair = (_counts(answers, kind, *_distinct(keys, kind, n_parts)[1:], fit)
                    for kind, keys in enumerate((tokens, _bigrams(before, tokens))))
    context = np.empty_like(single)
    context[1:] = single[:-1]
    context[begins[:-1]] = single[begins[1:] - 1]    # as many begins as ends
    return table, begins, single, context, pair


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def _parts_of(single, context, pair, total, types):
    """The three estimates of every token."""
    return (np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), single / max(total, 1),
            np.full(len(single), 1 / (types + 1)))


def _gather(n_parts: int):
    """Held-out tokens of a chunk, pooled by context bucket and rounded probability ratios."""
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "r2", "r1", "n"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], names=names)
        whole, _, tune_tokens, types = answers["totals"].combine_chunks()[0].as_py()
        total = whole - tune_tokens
        table, begins, single, context, pair = _resolved(table, answers, n_parts, True)
        tune = np.repeat(np.asarray(table["fold"]), np.diff(begins)) == TUNE
        p2, p1, p0 = (p[tune] for p in _parts_of(single, context, pair, total, types))
        r2, r1 = (np.where(p > 0, np.clip(np.rint(FINE * np.log2(np.maximum(p, 1e-300) / p0)), 1 - GRID, GRID - 1), -GRID)
                  for p in (p2, p1))
        key = (_bucket(context[tune]).astype(np.int64) * 2 * GRID + (r2 + GRID).astype(np.int64)) * 2 * GRID \
            + (r1 + GRID).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        return pa.table([pa.array((key // (4 * GRID * GRID)).astype(np.int32)),
                         pa.array((key // (2 * GRID) % (2 * GRID) - GRID).astype(np.int32)),
                         pa.array((key % (2 * GRID) - GRID).astype(np.int32)), pa.array(n)], names=names)
    return run


def learn_weights(bucket: np.ndarray, r2: np.ndarray, r1: np.ndarray, n: np.ndarray,
                  rounds: int = 60) -> np.ndarray:
    """Weights (bucket x bigram, unigram, uniform) by expectation-maximisation; EM starts from thirds.

    Buckets without held-out tokens get the weights of all tokens together.
    """
    p = np.stack([np.where(r > -GRID, 2.0 ** (r / FINE), 0.0) for r in (r2, r1)] + [np.ones(len(n))], axis=1)

    def em(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p[rows] * w
            share *= (n[rows] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / n[rows].sum()
        return np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()

    everything = em(np.arange(len(n))) if len(n) else np.full(3, 1 / 3)
    return np.stack([em(np.flatnonzero(bucket == b)) if (bucket == b).any() else everything
                     for b in range(BUCKETS)])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [np.stack([np.asarray(b[c]) for c in ("bucket", "r2", "r1", "n")]) for b in batches if b.num_rows]
    bucket, r2, r1, n = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0))
    yield pa.RecordBatch.from_arrays(
        [pa.array([learn_weights(bucket, r2, r1, n).ravel().tolist()], pa.list_(pa.float64()))], ["weights"])


def _score(n_parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["row", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (table.schema.field("row").type, pa.bool_(), *3 * [pa.int64()],
                                                       *2 * [pa.float64()])], names=names)
        total, types = answers["totals"].combine_chunks()[0].as_py()[:2]
        learned = answers["weights"].combine_chunks()[0].as_py()     # NULL without held-out tokens
        weights = np.full((BUCKETS, 3), 1 / 3) if learned is None else np.array(learned).reshape(BUCKETS, 3)
        table, begins, single, context, pair = _resolved(table, answers, n_parts, False)
        w = weights[_bucket(context)]
        p = sum(w[:, i] * x for i, x in enumerate(_parts_of(single, context, pair, total, types)))
        base = np.log10((single + 1) / (total + (types + 1)))
        held = np.asarray(table["fold"]) == HELD_OUT
        n = len(held)
        return pa.table([table["row"], pa.array(held), pa.array(np.diff(begins)), pa.array(sums(single > 0, begins)),
                         pa.array(np.full(n, total)), pa.array(np.add.reduceat(base, begins[:-1])),
                         pa.array(np.add.reduceat(np.log10(p), begins[:-1]))], names=names)
    return run


def scores(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           chunk_bytes: int = CHUNK_BYTES, row: Column | None = None) -> DataFrame:
    """Log10 probabilities of all texts.

    Words are lower-cased (A-Z) and split at white space; an end follows every text and counts
    as a token. Documents whose crc32 of the id (as text) has remainder 2 by 7 are held
    out: scored, not learned from. Returns per document row: the id, held_out,
    n_tokens, n_known (tokens seen in training), train_tokens, base_score (unigrams
    with one added), score. NULL and empty texts are an end alone; a row without an id
    counts as training. Every row of a repeated id is counted and scored. Other columns
    are not looked at.
    """
    spark = documents.sparkSession
    fold = F.pmod(F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)), F.lit(FOLDS))
    size = documents.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    n_chunks = int(size // chunk_bytes) + 1
    n_parts = max(8, int(n_chunks * PARTS_PER_CHUNK))
    width = max(n_chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = F.col(id_column) if row is None else row
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    dealt = documents.select(F.pmod(F.xxhash64(F.col(id_column), text), F.lit(n_chunks)).cast("int").alias("chunk"),
                             given.alias("row"), fold.cast("int").alias("fold"), text.alias("text")) \
        .repartition(width, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(n_parts), _ASK)
    answers = asked.groupBy("kind", "part").applyInArrow(_count, _ANSWER).repartition(width, "chunk")
    told = answers.where("kind = 0").agg(F.array(*(F.coalesce(F.sum(c), F.lit(0)).cast("long")
                                                   for c in ("tokens", "types", "tune_tokens", "fit_types"))))
    answers = answers.withColumn("totals", told.scalar())
    pooled = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")) \
        .applyInArrow(_gather(n_parts), "bucket int, r2 int, r1 int, n long") \
        .groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))
    # at most one row for each bucket and pair of grid steps, whatever the corpus
    weights = pooled.coalesce(1).mapInArrow(_learn, "weights array<double>")
    weighted = answers.withColumn("weights", weights.scalar())
    schema = StructType([StructField("row", dealt.schema["row"].dataType), *StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")])
    return dealt.groupBy("chunk").cogroup(weighted.groupBy("chunk")).applyInArrow(_score(n_parts), schema) \
        .withColumnRenamed("row", id_column if row is None else "row")
