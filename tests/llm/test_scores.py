"""Scores of encoded texts against a plain Viterbi."""

import pytest
from test_tokens import ODD, PIECES, plain_viterbi
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import pieces


def test_scores_charge_characters_without_a_piece(frame):
    vocabulary = pieces.Vocabulary.load(PIECES)
    coder = pieces.Unigram(vocabulary, pieces.rank_scores(vocabulary))
    texts = [x for x in ODD if x is None or len(x) < 2000] + ["the house", "the 🎉 house", "🎉", "🎉" * 5]
    single = set(vocabulary.byte_ids.tolist())
    found = {r.doc_id: r for r in pieces.encode_pieces(frame(list(enumerate(texts))), PIECES).collect()}
    for i, text in enumerate(texts):
        want, spelled = 0.0, b""
        for k in plain_viterbi(" " + text, vocabulary, coder) if text else []:
            if k not in single:
                want += coder.scores[k]
                continue
            spelled += bytes([vocabulary.byte_ids.tolist().index(k)])
            try:
                spelled.decode()
            except UnicodeDecodeError:
                continue
            want, spelled = want + coder.penalty, b""
        assert found[i].score == pytest.approx(want)
    assert found[len(texts) - 1].score < found[len(texts) - 2].score < found[len(texts) - 4].score
