"""Toxicity, transcripts, the language model and the pipeline."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from text_fixtures import SF, frame, shipped  # noqa: F401
from pyspark.sql import functions as F

from casoteca.llm import language_model, queries, toxicity, transcripts


def test_toxicity_on_held_out_labels(spark, frame):
    sf = SF.replace("sf0.001", "sf0.01")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    chain = toxicity.train(documents, labels.where(~held), toxicity.CATEGORIES)
    scored = toxicity.score(documents, chain).join(labels.where(held), "doc_id").collect()
    right = sum((r.p_toxic >= toxicity.THRESHOLD) == (r.toxic == 1) for r in scored)
    assert right / len(scored) > 0.95
    odd = toxicity.score(frame([(1, None), (1, ""), (None, "x " * 9000)]), chain).collect()
    assert len(odd) == 3 and all(0 < r.p_toxic < 1 for r in odd)
    one_class = toxicity.train(documents, labels.where("toxic = 0"), {"toxic": "toxic = 1"})
    assert toxicity.score(documents, one_class).where("p_toxic > 0.1").count() == 0
    none = toxicity.train(documents, labels.limit(0), toxicity.CATEGORIES)
    assert toxicity.score(documents.limit(0), none).count() == 0


def test_viterbi_and_blocks():
    rng = np.random.default_rng(0)
    s, k = transcripts.STATES, transcripts.SYMBOLS
    model = transcripts.Model(*(rng.integers(0, 50, shape) * 1.0 for shape in (s, (s, s), (s, k))))

    def score(seen, path):
        return model.start[path[0]] + model.emit[path[0], seen[0]] + sum(
            model.step[a, b] + model.emit[b, x] for a, b, x in zip(path, path[1:], seen[1:]))

    seen = rng.integers(0, k, 5).tolist()
    best = max(score(seen, p) for p in itertools.product(range(s), repeat=5))
    assert math.isclose(best, score(seen, transcripts.decode(model, seen, -1, -1)))
    seen = rng.integers(0, k, 200).tolist()
    blocks = [seen[i:i + 30] for i in range(0, 200, 30)]
    ends = transcripts._borders([transcripts.block_matrix(model, b) for b in blocks])
    joined = [x for b, (e, l) in zip(blocks, ends) for x in transcripts.decode(model, b, e, l)]
    assert math.isclose(score(seen, joined), score(seen, transcripts.decode(model, seen, -1, -1)))


def test_transcripts(spark):
    found = queries.QUERIES["op3_transcript_roles"](spark, SF)
    total = found.agg(F.sum("n_right"), F.sum("n_lines"), F.count("*")).first()
    assert total[0] / total[1] > 0.9
    assert total[2] == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    odd = spark.createDataFrame(
        [(1, 0, "user", "User: a\nb"), (1, 0, "user", "User: a\nb"), (1, None, None, None), (None, 2, "zz", ""),
         (3, 500, "assistant", "x"), (3, 1, "user", "hi?")], "conv_id long, turn long, role string, text string")
    raw = transcripts.raw_turns(odd.selectExpr("*", "1 as block"))
    turns = transcripts.parse(raw, transcripts.train(raw)).collect()
    assert sum(r.n_lines for r in turns) == 8
    assert transcripts.parse(raw.limit(0), transcripts.train(raw.limit(0))).count() == 0


def plain_scores(rows):
    texts = [(i, zlib.crc32(str(i).encode()) % 7, re.findall(r"[^\x20\x09-\x0D]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0"]) for i, t in rows]

    def count(skip):
        single, pair, context = Counter(), Counter(), Counter()
        for _, fold, words in texts:
            if fold not in skip:
                single.update(words)
                before = ["\1", *words[:-1]]
                pair.update(zip(before, words))
                context.update(before)
        return single, pair, context, sum(single.values()), len(single)

    def three(h, w, table):
        single, pair, context, total, types = table
        return [pair[h, w] / context[h] if context[h] else 0, single[w] / total, 1 / (types + 1)]

    fit, whole = count({2, 3}), count({2})
    events = Counter(x for _, fold, words in texts if fold == 3 for x in zip(["\1", *words[:-1]], words))
    p = np.array([three(h, w, fit) for h, w in events])
    bucket = np.array([min(math.frexp(fit[2][h])[1], language_model.BUCKETS - 1) for h, _ in events])
    n = np.array(list(events.values()))

    def em(mine):
        w = np.full(3, 1 / 3)
        for _ in range(60):
            share = p[mine] * w
            share *= (n[mine] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / n[mine].sum()
        return w

    weights = {b: em(bucket == b if (bucket == b).any() else bucket >= 0) for b in range(language_model.BUCKETS)}
    out = {}
    for i, fold, words in texts:
        total = base = 0.0
        for h, w in zip(["\1", *words[:-1]], words):
            b = min(math.frexp(whole[2][h])[1], language_model.BUCKETS - 1)
            total += math.log10(weights[b] @ np.array(three(h, w, whole)))
            base += math.log10((whole[0][w] + 1) / (whole[3] + whole[4] + 1))
        out[i] = (fold == 2, len(words), sum(whole[0][w] > 0 for w in words), whole[3], base, total)
    return out


def test_language_model(spark, frame):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "The the THE")]
    expected = plain_scores(rows)
    found = language_model.scores(frame(rows), chunk_bytes=20_000).collect()
    assert len(found) == len(rows)
    for r in found:
        held, n, known, total, base, score = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=0.03)       # the weights come from pooled events
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.scores(frame([(1, "a"), (None, "b"), (1, "a")])).count() == 3
    assert language_model.scores(frame([])).count() == 0


def test_pipeline_keeps_clean_documents(spark, frame, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(60))
    apart = " ".join(f"d{i}" for i in range(40))
    clean = {i: " ".join(f"c{i}x{k}" for k in range(40)) for i in range(30)}
    toxic = {100 + i: f"{clean[i]} idiot moron q{i}" for i in range(12)}
    benchmark = " ".join(f"b{i}" for i in range(12))
    docs = clean | toxic | {200: clean[0], 201: clean[1] + " z", 210: f"u {passage} v", 211: f"{apart} {passage} r",
                            220: f"k l {benchmark} m"}
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*clean, *toxic]], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    docs_left = spark.read.parquet(f"{out}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_left = stage(spark, docs_left, out)
        assert docs_left.schema.names == schema.replace(" long", "").replace(" string", "").split(", ")
    left = {r.doc_id: r for r in corpus_pipeline.run(spark, out).collect()}
    assert set(left) == {*clean, 210, 211}
    assert left[210].decoded == docs[210] and left[211].decoded == f"{apart} r"
    assert all(left[i].decoded == clean[i] for i in clean)
