"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A window of ``WINDOW`` words is an edge of the graph. Edges are dealt by their
minimizer, the smallest of the hashed k-mers inside: equal edges meet in one
partition, and neighbouring edges of a document mostly travel together as one row.

1. ``_edges`` makes those rows. Inside a task an edge that occurs again is settled
   on the spot, so what is sent of an edge is bounded by the number of tasks, not by
   its occurrences.
2. ``_first_occurrences`` meets all rows of a minimizer and gives every repeated
   edge the coordinates of its first occurrence (its source).
3. ``_paths`` joins the repeated edges of a document: edges that follow one another
   here and at their source form a nonbranching path, which is compacted to one span.
4. ``_measure`` joins spans and texts. It removes the spans and also digests the words
   of every span, both where it is removed and at its source.
5. A last join compares the digests, so that each span is verified at its source
   coordinates. Should hashes have collided, all is done again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casoteca.llm.text import (PART_BYTES, SPACED, hashes, mix, parts, segments, text_bytes, windows,
                               word_bounds)
from casoteca.sources.session import freed_shuffles
from casoteca.sources.workspace import cut_lineage

WINDOW = 20
#: Words of a minimizer; a run of edges that share one has WINDOW - KMER + 1 edges at most.
KMER = 6
#: Bytes kept of an edge's hash; with its partition key that is 72 bits. Raise for > 1e10 edges.
EDGE_BYTES = 6
_KEY_BITS = 24
#: Words of a task whose edges are settled together; some 150 bytes of memory each.
DEAL_WORDS = 500_000


def _runs(words: np.ndarray, first: np.ndarray, seed: int):
    """Edges of all documents: begins and hashes, and where runs with one minimizer begin."""
    begin, edge = windows(words, first, WINDOW, seed)
    at, kmer = windows(words, first, KMER, seed + 1)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, edge, none, np.zeros(0, np.uint64)
    # position of each edge's first k-mer in ``kmer``; k-mers of a document are consecutive
    where = np.searchsorted(at, begin).astype(np.int32)
    span = WINDOW - KMER + 1
    smallest, size = np.arange(len(kmer), dtype=np.int32), 1
    while size < span:                 # doubling: index of the leftmost smallest of ``size`` k-mers
        step = min(size, span - size)
        a, b = smallest[:len(smallest) - step], smallest[step:]
        smallest = np.where(kmer[b] < kmer[a], b, a)
        size += step
    low = smallest[where]
    new = np.ones(len(begin), bool)
    new[1:] = low[1:] != low[:-1]
    run = np.flatnonzero(new)
    return begin, edge, run, kmer[low[run]]


def _edges(documents: DataFrame, seed: int) -> DataFrame:
    """Runs of edges: key, doc, start, edges (hash bytes), or settled repeats.

    A settled row has no ``edges`` but ``spans``: (start, count, source document,
    source start) of edges that occur earlier in the same task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids_held = [], []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _deal(held, ids_held, seed)

        for part in parts(batches):
            data, offsets = text_bytes(part["text"])
            start, end, first = word_bounds(data, offsets, SPACED)
            held.append((hashes(data, start, end, seed), first))
            ids_held.append(part["id"].to_numpy())
            total += len(start)
            if total > DEAL_WORDS:
                yield from flush()
                held.clear(), ids_held.clear()
                total = 0
        yield from flush()

    return documents.mapInArrow(run, "key int, doc long, start int, edges binary, spans binary")


_SPAN = np.dtype([("start", "<i4"), ("count", "<i4"), ("source", "<i8"), ("at", "<i4")])


def _deal(held: list, ids_held: list, seed: int) -> Iterator[pa.RecordBatch]:
    words = np.concatenate([w for w, _ in held])
    base = np.cumsum([0] + [len(w) for w, _ in held])
    first = np.concatenate([f[:-1] + b for (_, f), b in zip(held, base)] + [[len(words)]])
    ids = np.concatenate(ids_held)
    held.clear()
    begin, edge, run, minimizer = _runs(words, first, seed)
    del words
    if not len(begin):
        return
    doc = (np.searchsorted(first, begin, side="right") - 1).astype(np.int32)
    start = (begin - first[doc]).astype(np.int32)
    begin = None
    # first occurrence inside this task, by (document id, start)
    rank = np.empty(len(ids), np.int32)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    by = np.lexsort((start, rank[doc], edge)).astype(np.int32)
    new = np.ones(len(by), bool)
    new[1:] = edge[by[1:]] != edge[by[:-1]]
    source = np.empty(len(by), np.int32)
    source[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by), dtype=np.int32), 0))]
    del by, new
    again = source != np.arange(len(source))
    # settled: maximal stretches whose sources follow one another too
    stretch = np.flatnonzero(again & ~_follows(again, doc, start, doc[source], start[source]))
    if len(stretch):
        ends = np.searchsorted(stretch, np.flatnonzero(again), side="right")
        count = np.bincount(ends - 1, minlength=len(stretch))
        spans = np.zeros(len(stretch), _SPAN)
        spans["start"], spans["count"] = start[stretch], count
        spans["source"], spans["at"] = ids[doc[source[stretch]]], start[source[stretch]]
        owner, at = np.unique(doc[stretch], return_index=True)
        raw, size = spans.tobytes(), _SPAN.itemsize
        bounds = np.append(at, len(stretch)) * size
        yield pa.RecordBatch.from_arrays(
            [pa.array((mix(owner.astype(np.uint64)) >> np.uint64(64 - _KEY_BITS)).astype(np.int32)),
             pa.array(ids[owner]), pa.nulls(len(owner), pa.int32()), pa.nulls(len(owner), pa.binary()),
             pa.array([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
            ["key", "doc", "start", "edges", "spans"])
    # the rest: stretches of new edges inside each run
    fresh = ~again
    head = np.zeros(len(doc), bool)
    head[run] = True
    cut = fresh & (head | np.append([True], again[:-1]))
    at = np.flatnonzero(cut)
    if not len(at):
        return
    count = np.diff(np.append(np.searchsorted(np.flatnonzero(fresh), at), fresh.sum()))
    key = (mix(minimizer) >> np.uint64(64 - _KEY_BITS)).astype(np.int32)[np.searchsorted(run, at, side="right") - 1]
    raw = np.ascontiguousarray(edge[fresh].view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES]).tobytes()
    bounds = np.concatenate(([0], np.cumsum(count))) * EDGE_BYTES
    for a in range(0, len(at), 100_000):
        b = min(a + 100_000, len(at))
        piece = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(
            (bounds[a:b + 1] - bounds[a]).astype(np.int32)), pa.py_buffer(raw[bounds[a]:bounds[b]])])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[a:b]), pa.array(ids[doc[at[a:b]]]), pa.array(start[at[a:b]].astype(np.int32)), piece,
             pa.nulls(b - a, pa.binary())], ["key", "doc", "start", "edges", "spans"])


def _follows(again: np.ndarray, doc: np.ndarray, start: np.ndarray, source: np.ndarray,
             at: np.ndarray) -> np.ndarray:
    """Whether each repeated edge goes on where the one before it went, here and at its source."""
    out = np.zeros(len(doc), bool)
    out[1:] = (again[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1)
               & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + 1))
    return out


_REPEATS = "doc long, start int, count int, source long, at int"
_NAMES = ["doc", "start", "count", "source", "at"]


def _first_occurrences(edges: DataFrame) -> DataFrame:
    """Spans of edges that occur earlier, with the coordinates of the first occurrence.

    Rows of one key are in one partition, one after another; some ``DEAL_WORDS`` edges are
    compared at a time, or all those of one key if it has more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            settled = batch["spans"].is_valid()
            done = batch.filter(settled)
            if done.num_rows:
                sizes = np.array([len(x) for x in done["spans"].to_pylist()]) // _SPAN.itemsize
                spans = np.frombuffer(b"".join(done["spans"].to_pylist()), _SPAN)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(done["doc"]), sizes)),
                     *(pa.array(np.ascontiguousarray(spans[c])) for c in _NAMES[1:])], _NAMES)
            rest = batch.filter(pc.invert(settled))
            for part in parts(iter([rest]), "edges", DEAL_WORDS * EDGE_BYTES // 4):
                data, offsets = text_bytes(part["edges"])
                count = np.diff(offsets) // EDGE_BYTES
                held.append((np.asarray(part["key"]), np.asarray(part["doc"]), np.asarray(part["start"]), count, data))
                total += int(count.sum())
                if total > DEAL_WORDS and held[0][0][0] != held[-1][0][-1]:
                    rows = _joined(held)
                    last = int(np.searchsorted(rows[0], rows[0][-1]))     # the last key may go on
                    at = int(rows[3][:last].sum()) * EDGE_BYTES
                    yield _compare(*(x[:last] for x in rows[:4]), rows[4][:at])
                    held = [(*(x[last:].copy() for x in rows[:4]), rows[4][at:].copy())]
                    total = int(held[0][3].sum())
        if held:
            yield _compare(*_joined(held))

    return edges.repartition("key").sortWithinPartitions("key").mapInArrow(run, _REPEATS)


def _joined(held: list) -> tuple[np.ndarray, ...]:
    return tuple(map(np.concatenate, zip(*held)))


def _compare(key: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray,
             data: np.ndarray) -> pa.RecordBatch:
    """Spans of edges that occur earlier among those given."""
    data = data.reshape(-1, EDGE_BYTES)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :EDGE_BYTES] = data
    edge = wide.view("<u8").ravel()
    row = np.repeat(np.arange(len(key)), count)
    place = start[row] + segments(count)
    # the key joins the hash where two of them can be told apart: in a mixed number of 64 bits
    mixed = mix(edge * np.uint64(0x9E3779B97F4A7C15) + mix(key[row].astype(np.uint64)))
    _, group, sizes = np.unique(mixed, return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(sizes[group] > 1)
    group, d, p = group[repeated], doc[row[repeated]], place[repeated]
    by = np.lexsort((p, d, group))
    new = np.ones(len(by), bool)
    new[1:] = group[by[1:]] != group[by[:-1]]
    source = np.empty(len(by), np.int64)
    source[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
    later = np.flatnonzero(source != np.arange(len(by)))
    a, b, s, t = d[later], p[later], d[source[later]], p[source[later]]
    head = np.flatnonzero(~_follows(np.ones(len(a), bool), a, b, s, t))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[head]), pa.array(b[head].astype(np.int32)),
         pa.array(np.diff(np.append(head, len(a))).astype(np.int32)), pa.array(s[head]),
         pa.array(t[head].astype(np.int32))], _NAMES)


def _paths(repeats: DataFrame) -> DataFrame:
    """doc, and its compacted paths: (start, count, source, at) by start.

    An edge settled inside a task may have a source that is itself a repeat; the
    words are the same, so the span is the same.
    """
    rows = repeats.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*_NAMES[1:]))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["spans"]
            flat = lists.flatten()
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            start, count, source, at = (np.asarray(flat.field(i)) for i in range(4))
            doc = np.repeat(np.arange(len(lists)), np.diff(first))
            goes_on = np.zeros(len(start), bool)
            goes_on[1:] = ((doc[1:] == doc[:-1]) & (source[1:] == source[:-1])
                           & (start[1:] <= start[:-1] + count[:-1])
                           & (start[1:] - start[:-1] == at[1:] - at[:-1]))
            head = np.flatnonzero(~goes_on)
            reach = np.maximum.reduceat(start + count, head) if len(head) else start
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].take(pa.array(doc[head])), pa.array(start[head]),
                 pa.array((reach - start[head]).astype(np.int32)), pa.array(source[head]), pa.array(at[head])], _NAMES)

    return rows.mapInArrow(run, _REPEATS)


_RESULT = ("n_words long, n_removed long, kept_sha256 string, kept string, doc long, starts array<int>, "
           "counts array<int>, sources array<long>, ats array<int>, digests array<binary>, asked array<binary>")


def _measure(documents: DataFrame, paths: DataFrame, keep_text: bool, inside: str | None) -> DataFrame:
    """Removes every document's paths and digests the words it was asked about.

    ``inside`` names the field of ``row`` that is the text, which then goes along once only.
    """
    own = paths.select("doc", F.struct(F.lit(0).alias("role"), *_NAMES[1:]).alias("x"))
    asked = paths.select(F.col("source").alias("doc"), F.struct(
        F.lit(1).alias("role"), F.col("at").alias("start"), "count", F.lit(0).cast("long").alias("source"),
        F.lit(0).alias("at")).alias("x")).distinct()
    wanted = own.unionByName(asked).groupBy("doc").agg(F.sort_array(F.collect_list("x")).alias("wanted"))
    joined = documents.join(wanted, documents["id"] == wanted["doc"], "left").select(
        "row", "id", *([] if inside else ["text"]), "wanted")

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, batch["row"].field(inside)], [*batch.schema.names, "text"]) \
                if inside else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(with_text(batches), size=PART_BYTES // 2):
            data, offsets = text_bytes(part["text"])
            start, end, first = word_bounds(data, offsets, SPACED)
            out = {c: [] for c in ("n", "removed", "sha", "kept", "starts", "counts", "sources", "ats", "digests", "asked")}
            wanted = part["wanted"]
            flat = wanted.flatten()
            fields = [np.asarray(flat.field(i)) for i in range(5)]
            bounds = np.asarray(wanted.offsets) - wanted.offsets[0].as_py()
            raw = data.tobytes()
            for d in range(part.num_rows):
                a, b = first[d], first[d + 1]
                role, s, c, source, at = (f[bounds[d]:bounds[d + 1]] for f in fields)
                mine = role == 0
                line = _joined_words(data, raw, start[a:b], end[a:b], np.ones(b - a, bool))
                sizes = end[a:b] - start[a:b] + 1
                ends = np.cumsum(sizes)
                begins = ends - sizes
                digests = [hashlib.blake2b(line[begins[x]:ends[x + k + WINDOW - 2] - 1], digest_size=16).digest()
                           for x, k in zip(s.tolist(), c.tolist())]
                cover = np.zeros(b - a + 1, np.int32)
                np.add.at(cover, s[mine], 1)
                np.add.at(cover, s[mine] + c[mine] + WINDOW - 1, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = line if keep.all() else _joined_words(data, raw, start[a:b], end[a:b], keep)
                out["n"].append(int(b - a)), out["removed"].append(int((~keep).sum()))
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "replace") if keep_text and not (inside and keep.all()) else None)
                for name, v in (("starts", s), ("counts", c), ("sources", source), ("ats", at)):
                    out[name].append(v[mine].tolist())
                k = int(mine.sum())
                out["digests"].append(digests[:k])
                out["asked"].append([_stamp(x, y, z) for x, y, z in zip(s[k:].tolist(), c[k:].tolist(), digests[k:])])
            i32, i64 = pa.list_(pa.int32()), pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), i32, i32, i64, i32,
                     pa.list_(pa.binary()), pa.list_(pa.binary())]
            cols = [pa.array(v, t) for v, t in zip(out.values(), types)]
            yield pa.RecordBatch.from_arrays([part["row"], *cols[:4], part["id"], *cols[4:]],
                                             ["doc_id", *(x.split()[0] for x in _RESULT.split(", "))])

    schema = StructType([StructField("doc_id", documents.schema["row"].dataType), *StructType.fromDDL(_RESULT)])
    return joined.mapInArrow(run, schema)


def _stamp(start: int, count: int, digest: bytes) -> bytes:
    return start.to_bytes(4, "little") + count.to_bytes(4, "little") + digest


def _joined_words(data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    """The chosen words with one space between them."""
    start, end = start[keep], end[keep]
    if not len(start):
        return b""
    size = end - start + 1
    index = np.repeat(start, size) + segments(size)
    out = data[np.minimum(index, len(data) - 1)].copy()
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   keep_text: bool = False, attempts: int = 3, whole_rows: bool = False) -> DataFrame:
    """Removes every word covered by a window of 20 words that also starts earlier.

    Words are split at white space and unchanged. Earlier means a smaller
    document id, or an earlier start in the same document; windows are judged
    on the input. Returns per document row: the id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), kept (that text, if
    ``keep_text``). NULL and empty texts have no words. Rows without an id keep all
    their words and are no source; so do all rows of a repeated id but the one with
    the smallest text. Other columns are not looked at. With ``whole_rows`` all columns come back in
    place of the id, as one named ``row``, and kept is NULL where no word was removed.
    """
    given = F.struct(*(F.col(f"`{c}`") for c in documents.columns)) if whole_rows else F.col(id_column)
    rows = documents.select(given.alias("row"), F.col(id_column).cast("long").alias("id"),
                            F.col(text_column).cast("string").alias("text"))
    with freed_shuffles(documents.sparkSession):     # edges and texts are each shuffled about once
        if not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
            first = F.row_number().over(Window.partitionBy("id").orderBy("text")) == 1
            rows = rows.withColumn("id", F.when(first, F.col("id")))
        for seed in range(attempts):
            edges = _edges(rows.where("id is not null").select("id", "text"), 100 * seed)
            paths = cut_lineage(_paths(_first_occurrences(edges)))
            found = cut_lineage(_measure(rows, paths, keep_text, text_column if whole_rows else None))
            if not _mismatches(found):
                return found.select(F.col("doc_id").alias("row" if whole_rows else id_column), "n_words", "n_removed", "kept_sha256", "kept")
    raise RuntimeError("edge hashes collided in every attempt; raise EDGE_BYTES")


def _mismatches(found: DataFrame) -> int:
    """Spans whose words differ from those at their source coordinates."""
    spans = found.select(F.explode(F.arrays_zip("counts", "sources", "ats", "digests")).alias("x")) \
        .select("x.sources", "x.ats", "x.counts", "x.digests").distinct()
    asked = found.select("doc", F.explode("asked").alias("stamp")).distinct()
    stamps = spans.select(F.col("sources").alias("doc"), "ats", "counts", "digests")
    stamp = F.udf(lambda at, count, digest: _stamp(at, count, bytes(digest)), "binary")
    return stamps.select("doc", stamp("ats", "counts", "digests").alias("stamp")) \
        .join(asked, ["doc", "stamp"], "left_anti").count()
