"""Texts to token ids inside tasks: cut where no token can cross, distinct pieces encoded once while they are held.

A long text is cut at single spaces between two plain characters.  None of the three public vocabularies used here has a token
that reaches across such a space from the left (a space opens the next token or is dropped), so the ids of the parts, one
after another, are those of the whole text.  Within a part of plain characters, spaces and line feeds, the pieces that a
vocabulary's own pattern cuts it into are encoded one by one, whatever stands beside them, so each distinct piece goes to the library
once while it is held; other parts go to it whole.  Tests compare both with the library on whole tables and on random texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

from millwarden.llm.common import in_bytes

#: Plain: ASCII signs, letters and digits, Latin letters with marks.
_PLAIN = "[!-~À-ÖØ-öø-ɏ]"
CUT = re.compile(f" (?<={_PLAIN} )(?={_PLAIN})")
_SAFE = re.compile("[ \n!-~À-ÖØ-öø-ɏ]*")

#: Characters of a text handled at once, and distinct pieces of a generation (about 50 MB).
SEGMENT, HELD = 1 << 16, 400_000


def segments(text: str, size: int = SEGMENT) -> Iterator[tuple[str, bool]]:
    """Parts of about ``size`` characters and whether a part opens the text.  A stretch without a safe cut stays whole."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()], start == 0
        start = cut.end()
    yield text[start:], start == 0


#: The patterns of the two vocabularies, over plain characters, spaces and line feeds: contractions, letters, digits, marks, white space.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
_MARK = "!-/:-@\\[-`{-~"
_SPACED = re.compile(f" ?[{_LETTER}]+|{_CONTRACTION}| ?[0-9]+| ?[{_MARK}]+|[ \n]+(?![^ \n])|[ \n]+")
_BARE = re.compile(f"[a-zß-öø-ɏ]+|{_CONTRACTION}|[0-9]|[{_MARK}]+")

#: Ids of pieces, end to end, and where each piece's ids begin (one more than pieces).
Ids = tuple[np.ndarray, np.ndarray]


class Vocabulary:
    """A vocabulary file and its library.  Lists of pieces are encoded in few calls: a call costs more than a piece.

    Pieces with a space before them, or of a vocabulary that drops spaces, go as one text with single spaces, and are told apart by
    the tokens that open or, where spaces are dropped, close a piece.  Others go with a special token between them.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.call = lambda batch: model.encode(batch, num_threads=1)
            self.space, self.special = "", None  # the model adds the space
            return
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.call = lambda batch: [e.ids for e in model.encode_batch_fast(batch, add_special_tokens=False)]
        self.mark, self.space = "<|endoftext|>", " "
        self.mark_id = model.token_to_id(self.mark)
        self.special = re.compile("|".join(re.escape(t.content) for t in model.get_added_tokens_decoder().values()))
        tokens = [model.id_to_token(k) or "" for k in range(model.get_vocab_size())]
        closes = np.array([t.endswith("</w>") for t in tokens])
        self.closes = closes if closes.any() else None
        self.opens = np.array([t.startswith("\u0120") for t in tokens])

    def one(self, text: str) -> np.ndarray:
        return np.asarray(self.call([text])[0], dtype="<u4")

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text; none where its pattern may cut otherwise."""
        if self.special is None or self.special.search(text):
            return None
        if self.closes is not None:
            text = text.lower()
            return _BARE.findall(text) if _SAFE.fullmatch(text) else None
        return _SPACED.findall(text) if _SAFE.fullmatch(text) else None

    def spaced(self, piece: str) -> bool:
        return self.closes is not None or (piece[0] == " " and len(piece) > 1 and piece[1] not in " \n")

    def joined(self, pieces: list[str]) -> Ids:
        """Pieces that have a space before them, or of a vocabulary that drops it."""
        between = "" if self.closes is None else " "
        texts = [between.join(pieces[k : k + 64]) for k in range(0, len(pieces), 64)]
        ids = np.concatenate([np.asarray(x, dtype="<u4") for x in self.call(texts)])
        starts = np.flatnonzero(self.opens[ids]) if self.closes is None else np.flatnonzero(np.concatenate([[True], self.closes[ids]]))[:-1]
        return ids, np.append(starts, len(ids))

    def marked(self, pieces: list[str]) -> Ids:
        """Any pieces, with the mark between them."""
        ids = self.one(self.mark.join(pieces))
        at = ids == self.mark_id
        places = np.flatnonzero(at)
        return ids[~at], np.concatenate([[0], places - np.arange(len(places)), [len(ids) - len(places)]])


def as_bytes(ids: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return ids.tobytes()


class PieceTable:
    """The ids (as bytes) of each distinct piece.  Pieces of this generation and the last are held; older ones go."""

    def __init__(self, path: str, held: int = HELD):
        self.vocabulary, self.held = Vocabulary(path), held
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.young) > self.held:
            self.young, self.old = {}, self.young
        spaced, bare, v = [], [], self.vocabulary
        for p in pieces:
            value = self.old.get(p)
            if value is not None:
                self.young[p] = value
            else:
                (spaced if v.spaced(p) else bare).append(p)
        for new, encode in ((spaced, v.joined), (bare, v.marked)):
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                ids, bounds = encode(some)
                if len(bounds) != len(some) + 1:
                    raise ValueError("pieces and their ids do not match")
                bounds = bounds.tolist()
                self.young.update(zip(some, (as_bytes(ids[a:b]) for a, b in zip(bounds, bounds[1:]))))

    def values(self, parts: Sequence[tuple[str, bool]]) -> list[bytes]:
        """Per part (text, opens its document) its ids."""
        space = self.vocabulary.space
        texts = [text if first else space + text for text, first in parts]
        cut = [self.vocabulary.pieces(text) for text in texts]
        whole = [k for k, pieces in enumerate(cut) if pieces is None]
        known = self.young.get
        found = [[] if pieces is None else list(map(known, pieces)) for pieces in cut]
        short = [(k, [n for n, piece in enumerate(ids) if piece is None]) for k, ids in enumerate(found) if None in ids]
        if short:
            self._learn({cut[k][n] for k, places in short for n in places})
            learnt = self.young
            for k, places in short:
                pieces, ids = cut[k], found[k]
                for n in places:
                    ids[n] = learnt[pieces[n]]
        out = [b"".join(ids) for ids in found]
        for k, ids in zip(whole, self.vocabulary.call([texts[k] for k in whole]) if whole else []):
            out[k] = as_bytes(np.asarray(ids, dtype="<u4"))
        return out


#: Tables of this Python worker: tasks that it runs later start with the pieces that earlier ones met.
_TABLES: dict[str, PieceTable] = {}


def encoded(path: str, documents: Iterable[tuple], batch_bytes: int = 1 << 20) -> Iterator[tuple]:
    """(..., text) to (..., ids) of whole texts in the same order, a batch of about equal bytes at a time."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    table = _TABLES[path]
    waiting: list[tuple] = []
    parts = ((k, part, first) for k, d in enumerate(documents) for part, first in _noted(waiting, d))
    done, held = 0, []
    for run in in_bytes(parts, lambda x: len(x[1]), batch_bytes):
        for (k, *_), found in zip(run, table.values([x[1:] for x in run])):
            if k > done:
                yield (*waiting.pop(0), np.frombuffer(b"".join(held), dtype="<u4"))
                done, held = k, []
            held.append(found)
    if waiting:
        yield (*waiting.pop(0), np.frombuffer(b"".join(held), dtype="<u4"))


def _noted(waiting: list[tuple], document: tuple) -> Iterator[tuple[str, bool]]:
    waiting.append(document[:-1])
    return segments(document[-1] or "")
