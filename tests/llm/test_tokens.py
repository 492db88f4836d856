"""Token files, token counts and pieces against the libraries and a plain Viterbi."""

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from text_fixtures import SF, frame, shipped  # noqa: F401

from casoteca.llm import pieces, token_files, units

BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "a  b   c", "it's\n\n x\t\ty ", "<|endoftext|> a<|endoftext|>b", "x" * 400, "é é  ü \n",
       "日本 語 é 　 y", "<s>a</s>", "a▁b ▁", "🎉🎉", "w1 " * 30000, "ab" * 60]


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 64, 5000):
        values = np.sort(rng.integers(0, 37 * n + 1, n))
        coded = token_files.EliasFano.encode(values)
        some = rng.integers(0, n, 50) if n else np.zeros(0, int)
        assert (coded.select(some) == values[some]).all()
    assert len(coded.low) + len(coded.high) + len(coded.counts) < 5000 * 8 / 4
    with pytest.raises(ValueError):
        token_files.EliasFano.encode(np.array([2, 1]))


def test_token_files(spark, frame, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = [(100 - i, x) for i, x in enumerate(ODD)]
    blocks = token_files.write_token_files(frame(rows), str(tmp_path / "t"), BPE)
    found = {r.doc_id: r for r in token_files.read_token_files(blocks).collect()}
    at = 0
    for i, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = found.pop(i)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not found
    empty = token_files.write_token_files(frame([]), str(tmp_path / "e"), BPE)
    assert token_files.read_token_files(empty).count() == 0


def test_token_files_of_shared_and_missing_ids(frame, tmp_path):
    """Rows that share an id, or have none, are written in the order of their texts, whatever order they come in."""
    rows = [(None, "b"), (4, "x y"), (None, None), (4, None), (4, "x"), (4, "x y"), (None, "a"), (1, "é"), (4, "")]
    ways = []
    for k, some in enumerate((rows, rows[::-1])):
        blocks = token_files.write_token_files(frame(some), str(tmp_path / f"s{k}"), BPE)
        found = [tuple(r) for r in token_files.read_token_files(blocks).collect()]
        ways.append(sorted(found, key=lambda r: r[1]))
    assert ways[0] == ways[1] and [r[0] for r in ways[0]] == [None] * 3 + [1] + [4] * 5
    ends = [r[1] + r[2] for r in ways[0]]
    assert [r[1] for r in ways[0]] == [0, *ends[:-1]]


def test_token_counts(spark, frame):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for chunk in (7, 1 << 16):        # tiny chunks compose their state maps again and again
        found = pieces.token_counts(frame(list(enumerate(texts))), PIECES, chunk_bytes=chunk).collect()
        assert len(found) == len(texts)
        for r in found:
            text = texts[r.doc_id] or ""
            n = len(library.encode(text))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert pieces.token_counts(frame([]), PIECES).count() == 0


def plain_viterbi(text, vocabulary, coder):
    raw = text.encode()
    known = {}
    for i, piece in enumerate(vocabulary.pieces):
        if vocabulary.normal[i]:
            known.setdefault(piece, i)
    best, back = [0.0] + [-math.inf] * len(raw), [None] * (len(raw) + 1)
    for s in range(len(raw)):
        if best[s] == -math.inf:
            continue
        width, alone = 1 if raw[s] < 0x80 else 2 if raw[s] < 0xE0 else 3 if raw[s] < 0xF0 else 4, False
        for e in range(s + 1, min(len(raw), s + 48) + 1):
            i = known.get(raw[s:e])
            if i is not None:
                alone |= e - s == width
                if best[s] + coder.scores[i] > best[e]:
                    best[e], back[e] = best[s] + coder.scores[i], (s, [i])
        if not alone and best[s] + coder.penalty > best[s + width]:
            best[s + width] = best[s] + coder.penalty
            back[s + width] = s, [int(vocabulary.byte_ids[x]) for x in raw[s:s + width]]
    out, e = [], len(raw)
    while e:
        e, ids = back[e]
        out = ids + out
    return out


def test_pieces(spark, frame):
    vocabulary = pieces.Vocabulary.load(PIECES)
    coder = pieces.Unigram(vocabulary, pieces.rank_scores(vocabulary))
    for i in range(300, 32000, 997):
        state = np.array([0])
        for byte in vocabulary.pieces[i]:
            state = coder.trie.step(state, np.array([byte]))
        assert vocabulary.pieces[coder.trie.value[state[0]]] == vocabulary.pieces[i]
    texts = [x for x in ODD if x is None or len(x) < 2000]
    found = {r.doc_id: r for r in pieces.encode_pieces(frame(list(enumerate(texts))), PIECES).collect()}
    for i, text in enumerate(texts):
        expected = plain_viterbi(" " + text, vocabulary, coder) if text else []
        assert found[i].ids == expected
        assert found[i].decoded == text
    assert found[0].node is None and found[0].chunk == 2
    digests = pieces.piece_digests(frame(list(enumerate(texts))), PIECES).collect()
    assert {r.doc_id: r.n_pieces for r in digests} == {i: len(r.ids) for i, r in found.items()}
    with pytest.raises(ValueError):
        pieces.encode_pieces(frame([]).selectExpr("*", "1 as ids"), PIECES)


def test_cuts_are_safe():
    joined = pieces.Vocabulary.load(PIECES).joined()
    raw = np.frombuffer(" the end".encode(), np.uint8)
    assert units.cut(raw, np.array([0, len(raw)]), joined).tolist() == [0, 4]
    ids, counts, _ = pieces.encode_part(pa.array(["", " a"]), *pieces._coder(PIECES, pieces.rank_scores)[::2][:2],
                                        units.Known())
    assert counts.tolist() == [0, 1] and len(ids) == 1
