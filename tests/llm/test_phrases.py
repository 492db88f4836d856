"""Collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from text_fixtures import shipped  # noqa: F401

from casoteca.llm import phrases


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0A-\x0D]", lowered)]


def plain(rows, longest, support, top, percent):
    out = []
    for lang in {x or "und" for x, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") == lang:
                for words in pieces(text):
                    n += len(words)
                    for k in range(1, longest + 1):
                        f.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        candidates = [p for p in f if len(p) > 1 and f[p] >= support]
        longer = Counter()
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], f[p])
        kept = []
        for p in candidates:
            if longer[p] and 100 * longer[p] >= percent * f[p]:
                continue
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, t.decode(), -a, left, right, n, -s)
                for i, (s, a, t, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(n):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", " x", "naïve", "W1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    common = ["w3 w9 w11", "w20 w21 w22 w23 w24", "É É"]
    out = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.1 else rng.choices(vocabulary, weights)[0]
                 for _ in range(rng.choice([0, 1, 3, 30, 90]))]
        out.append("".join(w + rng.choice([" ", " ", " ", "\t", " \t ", ". ", "\n", ",", "\r\n"]) for w in words))
    return out


def build(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.selectExpr("*", "1 as n", "'x' as phrase", "2 as shard", "3 as bytes", "cast(null as int) as row") \
        .repartition(3)


@pytest.mark.parametrize("support, percent, top, few", [(12, 100, 2000, 1 << 20), (5, 80, 15, 1 << 20), (7, 100, 2000, 0)])
def test_against_counting(spark, monkeypatch, support, percent, top, few):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t) for t in texts(300)]
    rows += [rows[0]] * 40 + [("a", None), ("a", ""), ("c", None), (None, "w1 w2"), ("d", " . ,")]
    rows += [("e", "x y " * 60_000), ("e", "x y\n" * 9)]
    monkeypatch.setattr(phrases, "SHARD_BYTES", 4000)
    monkeypatch.setattr(phrases, "FEW_CANDIDATES", few)
    found = phrases.collocations(build(spark, rows), support=support, percent=percent, top=top)
    assert sorted(map(tuple, found.collect())) == plain(rows, 5, support, top, percent)


def test_empty_table(spark):
    assert phrases.collocations(build(spark, [])).collect() == []


def test_every_frequent_phrase_is_local_somewhere(spark, monkeypatch):
    """The union of what shards report holds all frequent phrases, and less than all phrases."""
    monkeypatch.setattr(phrases, "LEAST_SHARDS", 3)
    rows = [("a", t) for t in texts(500)]
    local = phrases._mined(phrases._shards(build(spark, rows), "lang", "text"), 5, 40).where("words > 0")
    reported = {r.phrase for r in local.select("phrase").distinct().collect()}
    f = Counter(" ".join(w[i:i + k]) for _, t in rows for w in pieces(t) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert {p for p in f if f[p] >= 40} <= reported
    assert len(reported) < len(f) / 4


def test_shard_counts_all_phrases():
    some = texts(60)
    shard = phrases.Shard(pa.chunked_array([pa.array(some[:20]), pa.array(some[20:])]))
    f = Counter(" ".join(w[i:i + k]) for t in some for w in pieces(t) for k in range(1, 5) for i in range(len(w) - k + 1))
    got = {}
    for begin, count, length, value in shard.phrases(4, 1, None):
        assert len(np.unique(value)) == len(value)
        got |= dict(zip(shard.texts(begin, length).to_pylist(), count.tolist()))
    assert got == dict(f)


def test_more_text_of_a_language_makes_no_more_candidates(spark, monkeypatch):
    """Shards in many pieces keep their share of the support, so what is written stays far below all phrases."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    monkeypatch.setattr(phrases, "LEAST_SHARDS", 2)
    written, real = [], phrases.cut_lineage

    def counted(df, *args, **named):
        table = real(df, *args, **named)
        written.append(table.count())
        return table
    monkeypatch.setattr(phrases, "cut_lineage", counted)
    rows = [("a", t) for t in texts(300)]
    found = phrases.collocations(build(spark, rows), longest=4, support=40)
    assert sorted(map(tuple, found.collect())) == plain(rows, 4, 40, 2000, 100)
    f = Counter(" ".join(w[i:i + k]) for _, t in rows for w in pieces(t) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert max(written) < len(f) / 4


def test_pieces_count_like_one_text():
    some = texts(60)
    whole = phrases.Tally(pa.chunked_array([pa.array(some)]))
    f = Counter(" ".join(w[i:i + k]) for t in some for w in pieces(t) for k in range(1, 4) for i in range(len(w) - k + 1))
    lengths, values, counts = zip(*whole.counts(1, 3, None))
    value, count = np.sort(np.concatenate(values)), np.concatenate(counts)
    assert lengths == (1, 2, 3) and sorted(count.tolist()) == sorted(f.values())
    shard = phrases.Shard(pa.chunked_array([pa.array(some)]))
    assert sorted(np.concatenate([v for _, _, _, v in shard.phrases(3, 1, None)]).tolist()) == value.tolist()
    kept = phrases._unpacked(phrases._packed(value))
    assert (kept == value >> np.uint64(24) << np.uint64(24)).all()
    table = np.zeros(1 << phrases.PLACE_BITS - 3, np.uint8)
    for k, data in phrases._places(kept[::2]):
        place = np.frombuffer(data, np.uint32)
        assert (place // ((1 << phrases.PLACE_BITS) // phrases.SLICES) == k).all()
        np.bitwise_or.at(table, place >> 3, (1 << (place & 7)).astype(np.uint8))
    assert phrases._among(table, value[::2]).all() and not phrases._among(table, value[1::2]).any()
