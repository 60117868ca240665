"""Vocabulary files of public tokenizers, read once on the driver and sent to the executors."""

from __future__ import annotations

from dataclasses import dataclass

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """Pieces by id with their ranks; ``bytes_`` maps a byte to its fallback piece. Size is that of the vocabulary file."""

    text: tuple
    rank: tuple
    bytes_: tuple
    special: frozenset


def load_pieces(path: str = PIECE_MODEL) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    text = tuple(m.id_to_piece(i) for i in range(n))
    special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
    found = {int(text[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
    return Pieces(text, tuple(max(0.0, -m.get_score(i)) for i in range(n)), tuple(found[b] for b in range(256)), special)
