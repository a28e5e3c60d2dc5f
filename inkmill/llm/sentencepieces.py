"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds all pieces; one pass over a text reports, at each end
position, every piece that ends there (its output links, longest first), and
each one relaxes the best way to that position.

* For *unigram* models a way's value is the sum of its pieces' scores, so the
  pass is the Viterbi search itself.
* For *BPE* models the sum of scores isn't what the library maximises: it merges
  the best pair again and again. The pass then keeps, per position, the last
  piece of the merged prefix: a piece relaxes a position if, right after the last
  piece kept at its start, merging would leave the two as they are. There is one
  such piece per position, because merging a prefix has one result, and a
  sequence whose neighbours are all stable is the merged sequence.

No piece of the usual models has a word mark behind another character, so texts
fall into runs (marks, then a word) that are encoded apart and remembered. If a
model has such pieces, whole texts are passed at once.

Decoding joins pieces, turns byte pieces back into characters (invalid bytes
become U+FFFD) and marks into spaces, and drops the first one.

Defined results: null and empty texts have no pieces and decode to the empty
text. Characters outside the model become byte pieces where it has them, else
the unknown id. Texts are passed whole, at any length. Repeated rows are kept;
other columns are dropped.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkmill.llm.common import give_back, load

MARK = "▁"
#: Runs that one task remembers (about 100 MB); they are dropped at its end.
CACHE_RUNS = 400_000
CACHE_PAIRS = 500_000
#: Runs up to this many characters are remembered.
RUN_CHARS = 48
#: Fixed value of the format: an unknown character scores this below the lowest piece.
UNKNOWN_PENALTY = 10.0
_UNKNOWN = -1


class PieceModel:
    """Pieces, scores and kinds of a model file, and its automaton."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._read(proto)

    @classmethod
    def of(cls, proto) -> PieceModel:
        self = cls.__new__(cls)
        self._read(proto)
        return self

    def _read(self, proto) -> None:
        import ahocorasick

        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        kind = proto.trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.unigram, self.dummy = kind == 1, norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.unknown_id = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.unknown_score = min((self.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.by_run = not any(MARK in p.lstrip(MARK) for p in self.ids)
        if not self.unigram and any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that isn't a piece")
        self.runs: dict[str, tuple[int, ...]] = {}
        self.stable: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shown = [self._shown(i) for i in range(len(self.pieces))]

    # --- encoding -----------------------------------------------------------

    def _merged(self, text: str, until: int = 1) -> list[str]:
        """Pairwise merging by score, leftmost first among equals: for short texts."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces of a piece's last merge; None for single characters."""
        known = self.parts.get(piece)
        if known is None and len(self.pieces[piece]) > 1:
            left = self._merged(self.pieces[piece], until=2)
            whole = len(left) == 2 and left[0] + left[1] in self.ids
            known = self.parts[piece] = (self.ids[left[0]], self.ids[left[1]]) if whole else (_UNKNOWN, _UNKNOWN)
        return known

    def _is_stable(self, last: int, piece: int) -> bool:
        """Whether merging leaves ``last`` and ``piece`` side by side as they are.

        Looks back through the merges on both sides of the border, from the last
        to the first: while two parts faced each other there, they would have
        merged if their pair came before the merge that ended this.
        """
        scores, pieces = self.scores, self.pieces
        if self._parts(piece) == (_UNKNOWN, _UNKNOWN):
            return False
        if last == _UNKNOWN:
            return True
        a, b, ended, from_right = last, piece, -np.inf, False
        while True:
            pair = self.ids.get(pieces[a] + pieces[b])
            if pair is not None and (scores[pair] > ended or scores[pair] == ended and from_right):
                return False
            of_a, of_b = self._parts(a), self._parts(b)
            if of_a is None and of_b is None:
                return True
            # of equal scores the left one was merged first
            if of_b is None or of_a is not None and scores[a] < scores[b]:
                a, ended, from_right = of_a[1], scores[a], False
            else:
                b, ended, from_right = of_b[0], scores[b], True

    def _pass(self, text: str) -> list[tuple[int, int]]:
        """(start, id) of the pieces of one run; unknown characters have id -1."""
        n = len(text)
        came = [(-1, _UNKNOWN)] * (n + 1)
        if self.unigram:
            best = [-np.inf] * (n + 1)
            best[0] = 0.0
            scores, upto, single = self.scores, 0, False

            def leave(end: int) -> None:  # all pieces that end here are known
                if not single and best[end - 1] + self.unknown_score > best[end]:
                    best[end], came[end] = best[end - 1] + self.unknown_score, (end - 1, _UNKNOWN)

            for last, (length, i) in self.automaton.iter(text):
                end = last + 1
                while upto < end:
                    if upto:
                        leave(upto)
                    upto, single = upto + 1, False
                start = end - length
                if length == 1:
                    single = True
                if best[start] + scores[i] > best[end]:
                    best[end], came[end] = best[start] + scores[i], (start, i)
            while upto <= n:
                if upto:
                    leave(upto)
                upto, single = upto + 1, False
        else:
            stable, n_pieces, found = self.stable, len(self.pieces), 0
            for last, (length, i) in self.automaton.iter(text):
                end = last + 1
                if end == found:
                    continue  # the one piece that ends here is known
                start = end - length
                if start == 0:
                    prior = _UNKNOWN
                elif (prior := came[start][1]) == _UNKNOWN and text[start - 1] in self.ids:
                    continue
                key = prior * n_pieces + i
                known = stable.get(key)
                if known is None:
                    if len(stable) > CACHE_PAIRS:
                        stable.clear()
                    known = stable[key] = self._is_stable(prior, i)
                if known:
                    came[end], found = (start, i), end
        out, at = [], n
        while at > 0:
            start, i = came[at]
            if start < 0:
                start, i = at - 1, _UNKNOWN
            out.append((start, i))
            at = start
        return out[::-1]

    def _run(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for start, i in self._pass(text):
            if i != _UNKNOWN:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in text[start].encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)  # neighbouring unknown characters are one piece
        return tuple(out)

    _split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def encode(self, text: str | None) -> list[int]:
        if not isinstance(text, str) or not text:
            return []
        text = text.replace(" ", MARK)
        if self.dummy:
            text = MARK + text
        if not self.by_run:
            return list(self._run(text))
        runs, out = self.runs, []
        for r in self._split.findall(text):
            ids = runs.get(r)
            if ids is None:
                ids = self._run(r)
                if len(r) <= RUN_CHARS:
                    if len(runs) > CACHE_RUNS:
                        runs.clear()
                    runs[r] = ids
            out += ids
        return out

    # --- decoding -----------------------------------------------------------

    def _shown(self, i: int) -> str:
        if i in self.control:
            return ""
        return " ⁇ " if i == self.unknown_id else self.pieces[i].replace(MARK, " ")

    def decode(self, ids: Sequence[int]) -> str:
        shown, byte_of = self.shown, self.byte_of
        if not byte_of or byte_of.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            parts: list[str] = []
            raw = bytearray()
            for i in ids:
                if i in byte_of:
                    raw.append(byte_of[i])
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                parts.append(shown[i])
            parts.append(raw.decode("utf-8", "replace"))
            text = "".join(parts)
        return text[1:] if self.dummy and text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (decoding gives the text back, marks as spaces)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_at(model_path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                texts = [x if isinstance(x, str) else "" for x in part["text"]]
                collects = gc.isenabled()
                gc.disable()  # many short-lived tuples and lists, and no cycles
                try:
                    ids = [model.encode(t) for t in texts]
                finally:
                    if collects:
                        gc.enable()
                same = [model.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_pieces": [len(i) for i in ids], "ids": [np.array(i, np.int32) for i in ids], "round_trip": same})
        model.runs.clear()
        give_back()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInPandas(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for rows of (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_at(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": [model.decode([int(k) for k in i]) if i is not None else "" for i in batch["ids"]]})

    return encoded.selectExpr("cast(doc_id as long) as doc_id", "cast(ids as array<int>) as ids").mapInPandas(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir):
    return encode(load(spark, sf_dir, "documents"), default_model())
