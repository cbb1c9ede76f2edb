"""Operator 7: encode and decode texts with a word-level byte-pair vocabulary.

Distinct words of a batch are walked in sorted order, which is the depth-first order of their
trie: the last-token states of the letters a word shares with the one before stay on the path
and are computed once.

Null and empty texts have no token and decode to the empty text. The special tokens' strings in
a text become their ids, as the tokenizer file says. A text of any length is encoded whole; repeated
rows are encoded one by one; an empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dialogmeter.llm.lasttoken import PairRules
from dialogmeter.llm.store import ship, worker_cache

WORD_END = "</w>"
#: Words remembered per worker between batches, in two halves: when the newer one is full, the older one goes.
MEMO_WORDS = 500_000
#: Longer words are encoded without being remembered.
MEMO_LENGTH = 64
#: Characters whose normal form and class the plain rules below give (tests compare each one).
_PLAIN = regex.compile(r"[\x00-\x7f\xa0-ɏ]*")
_FOLD_FREE = regex.compile(r"[^İ]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


class WordCodec:
    """The vocabulary of one tokenizer file and its words' encodings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model.get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path} is not a word-level byte-pair tokenizer")
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        ranks = {}
        for i, merge in enumerate(model["merges"]):
            ranks[tuple(merge if isinstance(merge, list) else merge.split(" "))] = i
        self.rules = PairRules(lambda a, b: ranks.get((a, b)), self.symbols)
        self.inner = {t for t in self.ids if not t.endswith(WORD_END)}
        self.final = {t[: -len(WORD_END)] for t in self.ids if t.endswith(WORD_END)}
        self.endings = {t[i:] for t in self.inner for i in range(len(t))}
        self.final_endings = {t[i:] for t in self.final for i in range(len(t))}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_in = regex.compile(split["pattern"]["Regex"])
        self.specials_in = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END):
            core = token[: -len(WORD_END)]
            return [*core[:-1], core[-1] + WORD_END]
        return list(token)

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised."""
        if _PLAIN.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            if _FOLD_FREE.fullmatch(text):
                return self.words_in.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def tokens_of(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, tokens) of distinct words, walking their trie depth first."""
        spelled = sorted(("".join(self.letters[b] for b in w.encode()), w) for w in words)
        inner, endings, fits = self.inner, self.endings, self.rules.fits
        path, before = [""], ""  # last token of each prefix of the word before
        for letters, word in spelled:
            shared, most = 0, min(len(before), len(letters), len(path) - 1)
            while shared < most and before[shared] == letters[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(len(path), len(letters)):
                path.append(self.last_token(letters, end, path, inner, endings, "", fits))
            tokens = [self.last_token(letters, len(letters), path, self.final, self.final_endings, WORD_END, fits)]
            at = len(letters) - len(tokens[0]) + len(WORD_END)
            while at:
                tokens.append(path[at])
                at -= len(path[at])
            before = letters
            yield word, tokens[::-1]

    def last_token(self, letters: str, end: int, path: list[str], tokens: set[str], endings: set[str], suffix: str, fits) -> str:
        """The one token that can end the first ``end`` letters, given the last tokens of shorter prefixes."""
        starts = []
        for start in range(end - 1, -1, -1):
            piece = letters[start:end]
            if piece in tokens:
                starts.append(start)
            elif piece not in endings:
                break
        for start in reversed(starts):
            token = letters[start:end] + suffix
            if fits(path[start], token) if start else self.rules.reachable(token):
                return token
        raise ValueError(f"no token ends {letters[:end]!r}")

    def packed(self, tokens: list[str]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(tokens)}I", *(self.ids[t] for t in tokens)), " ".join(tokens)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit words, decoded text) of each text."""
        split = []
        for text in texts:
            text = text or ""
            if self.specials_in and "<|" in text:
                parts: list[str] = []
                for i, part in enumerate(self.specials_in.split(text)):
                    parts += ["\0" + part] if i % 2 else self.pieces(part)
                split.append(parts)
            else:
                split.append(self.pieces(text))
        if len(self.memo) > MEMO_WORDS // 2:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        fresh = set().union(*split).difference(memo)
        for w in fresh.intersection(older):
            memo[w] = older[w]
        fresh.difference_update(older)
        local = {}
        for w in [w for w in fresh if w[0] == "\0" and w[1:] in self.special]:
            memo[w] = struct.pack("<I", self.special[w[1:]]), w[1:]
            fresh.discard(w)
        for word, tokens in self.tokens_of(fresh):
            (memo if len(word) <= MEMO_LENGTH else local)[word] = self.packed(tokens)
        for words in split:
            found = [memo.get(w) or local[w] for w in words] if local else [memo[w] for w in words]
            yield b"".join([ids for ids, _ in found]), " ".join([text for _, text in found])


def codec(path: str) -> WordCodec:
    """The worker's codec of a tokenizer file, loaded once."""
    codecs = worker_cache("bpe_codec")
    if path not in codecs:
        codecs[path] = WordCodec(path)
    return codecs[path]


#: Rows and characters encoded at a time.
BLOCK_ROWS, BLOCK_CHARS = 1000, 1_000_000


def blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows with a bounded number of characters, one row at least."""
    first, texts, size = 0, [], 0
    several = (t for at in range(0, len(column), BLOCK_ROWS) for t in column.slice(at, BLOCK_ROWS).to_pylist())
    for i, text in enumerate(several):
        if texts and (len(texts) >= BLOCK_ROWS or size + len(text or "") > BLOCK_CHARS):
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text or "")
    if texts:
        yield first, texts


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 with_ids: bool = True) -> DataFrame:
    """One row per row of ``df``: id, ``n_tokens``, ``ids`` (when ``with_ids``), ``decoded`` and their digests.

    ``with_ids=False`` leaves out the ids and the decoded text and keeps their digests.
    """
    path = path or default_tokenizer()
    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words = codec(path)
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                ids, decoded = zip(*words.encode(texts), strict=True)
                out = [batch.column(0).slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    out += [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())]
                out += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    ship(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
