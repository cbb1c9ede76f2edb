"""Operator 9: count a piece vocabulary's tokens with a finite-state transducer.

The transducer reads a text letter by letter. A state holds, for each place where a piece could
have begun, the last token of the text up to that place and how many tokens lie between there and
here; a transition carries the change of the token count. States are made as texts reach them.

A word mark after another letter leads to one and the same state, since no piece has a word mark
inside, and so does a line end, which is in no piece. So a text falls into chunks, each mapping that state to itself and adding its count;
those maps compose by adding, which a running sum over all chunks of a batch does at once.

Null and empty texts count 0. A text of any length is counted whole, chunk by chunk; repeated rows are
counted one by one; an empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dialogmeter.llm.bpe_codec import blocks
from dialogmeter.llm.lasttoken import PairRules
from dialogmeter.llm.store import ship

MARK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CountTransducer:
    """Letters in, token counts out."""

    #: States and chunks remembered per worker; both are emptied when they are full.
    STATES, CHUNKS = 100_000, 600_000
    CHUNK_LENGTH = 64

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError(f"{path} has pieces that reach over a word mark")
        if any("\n" in p for p in score):
            raise ValueError(f"{path} has pieces with line ends")
        self.pieces = set(score)
        self.beginnings = {p[:k] for p in score for k in range(1, len(p))}
        self.rules = PairRules(lambda a, b: score.get(a + b), list)
        self.chunks: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        # A state: ((letters since a place, last token there, tokens there minus tokens here), ...), farthest first.
        self.states: list[tuple] = [(("", "", 0),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _move(self, state: int, letter: str) -> tuple[int, int]:
        """(next state, change of the count), remembered."""
        if letter in self.pieces:
            for since, last, behind in self.states[state]:
                token = since + letter
                if token in self.pieces and (self.rules.fits(last, token) if last else self.rules.reachable(token)):
                    change = behind + 1
                    break
            else:
                raise ValueError(f"no token ends with {letter!r}")
        else:  # spelled as bytes, and merged with nothing
            token, change = letter, len(letter.encode())
        places = []
        for since, last, behind in self.states[state]:
            if since + letter in self.beginnings:
                # No piece spans letter + mark, so what stands before a new mark does not matter.
                before = "" if since == "" and letter == MARK and not last.endswith(MARK) else last
                places.append((since + letter, before, behind - change))
        places.append(("", token, 0))
        made = tuple(places)
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
            self.moves.append({})
        self.moves[state][letter] = number, change
        return number, change

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a text that starts a new word."""
        if len(self.states) > self.STATES:
            self._clear()
        state, total = 0, 0
        for letter in chunk:
            move = self.moves[state].get(letter)
            if move is None:
                move = self._move(state, letter)
                if len(self.states) > 4 * self.STATES:  # a very long chunk: keep only where it stands
                    kept = self.states[move[0]]
                    self._clear()
                    if kept != self.states[0]:
                        self.number[kept] = 1
                        self.states.append(kept)
                        self.moves.append({})
                        move = 1, move[1]
                    else:
                        move = 0, move[1]
            state, change = move
            total += change
        return total

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of whole texts: chunk maps first, then one running sum over all of them."""
        if len(self.chunks) > self.CHUNKS:
            self.chunks.clear()
        known = self.chunks
        split = [chunks_of(text) if text else [] for text in texts]
        fresh = set().union(*split).difference(known)
        for chunk in fresh:
            marked = chunk if chunk[0] in " \n" else " " + chunk
            known[chunk] = self.count_chunk(marked.replace(" ", MARK))
        ends = np.cumsum([0, *map(len, split)])
        found = np.fromiter((n for chunks in split for n in map(known.__getitem__, chunks)), np.int64, int(ends[-1]))
        for chunk in fresh:
            if len(chunk) > self.CHUNK_LENGTH:
                del known[chunk]
        scan = np.concatenate([[0], np.cumsum(found)])
        return np.diff(scan[ends])


_CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text behind its leading word mark: "word" for one mark and a word, else as written.

    A chunk that begins with a line end has no mark before its word.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
        return [c[1:] if c[0] == " " and len(c) > 1 and c[1] != " " else c for c in _CHUNK.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


_transducers: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """The worker's transducer of a model file, made once."""
    if path not in _transducers:
        _transducers[path] = CountTransducer(path)
    return _transducers[path]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = 4096) -> DataFrame:
    """One row per row of ``df``: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    path = path or default_pieces()
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                n = machine.counts(texts)
                size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), size, pa.array(n), pa.array(n > limit)], schema.names
                )

    ship(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(run, schema)
