"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model file (a parameter, read once by the driver and broadcast, as large as the
vocabulary) is a BPE model with byte fallback. The best path to a position ends in the one
piece that stands in a valid pair with the path before it: two pieces are valid neighbours
when merging their joint text gives just them. Each position thus keeps one
backpointer, at most the longest piece back, and only the last `longest` positions
can carry a path on. Whenever all their paths lead through one boundary, the ids up
to it are committed and forgotten; so memory stays within the window, however long
a text without a blank is. No piece crosses from a letter into a blank mark, so
each word starts at such a boundary, and short words are remembered.

Ids equal those of the library. Decoding joins pieces, puts byte pieces together as
UTF-8, and drops the mark that encoding puts first. Null text counts as
empty and has no ids. A literal U+2581 decodes to a blank, as in the library; the column
`round_trip` tells where the text did not come back. A model of another kind (unigram, or one whose normaliser changes texts) is refused. Ids of rows, extra columns and
repeated rows don't matter; an empty table stays empty.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from .common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Words up to this length are remembered, in two generations of at most WORD_BYTES each (of the older, words met again stay), and the backpointers of a word's first HEAD letters, within so many bytes in each worker (as estimated by entry); so are valid pairs, this many at most.
SHORT, WORD_BYTES, HEAD_BYTES, PAIRS, HEAD = 40, 128 << 20, 48 << 20, 400_000, 7


class Codec(dict):
    """Encoder and decoder of one model; as a dict, the ids of remembered words."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.piece = [p.id_to_piece(i) for i in range(n)]
        self.byte = [0] * 256
        self.id, self.score = {}, {}
        self.high = np.zeros(n, dtype=bool)
        for i, text in enumerate(self.piece):
            if p.is_byte(i):
                b = int(text[3:5], 16)
                self.byte[b] = i
                self.piece[i], self.high[i] = (chr(b), False) if b < 128 else (b, True)
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.id[text], self.score[text] = i, p.get_score(i)
        self.longest = max(map(len, self.id))
        #: Every end of a piece; the piece's id if it is one itself.
        self.tail = {s[i:]: None for s in self.id for i in range(len(s))} | self.id
        self.valid: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, list[str]] = {}
        #: The generation of words before the present one.
        self.old: dict[str, tuple[int, ...]] = {}
        self.word_bytes = self.head_bytes = 0

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by repeated best merges."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.valid.get(key)
        if found is None:
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            found = self.valid[key] = self.merged(a + b) == [a, b] if a else self.merged(b) == [b]
        return found

    def choose(self, text: str, i: int, last: list[str]) -> str:
        """The last piece of text[:i], from those of shorter beginnings."""
        tail, found = self.tail, [text[i - 1]]
        for start in range(i - 2, max(0, i - self.longest) - 1, -1):
            part = text[start:i]
            piece = tail.get(part, False)
            if piece is False:
                break
            if piece is not None:
                found.append(part)
        valid = self.valid
        while len(found) > 1:
            part = found.pop()
            before = last[i - len(part)]
            ok = valid.get((before, part))
            if ok or ok is None and self.pair(before, part):
                return part
        return found[0]

    def stream(self, letters):
        """Pieces of one word, given letter by letter; holds no more than the window allows."""
        window, last, text, longest = 1024 + self.longest, [""], "", self.longest
        for letter in letters:
            text += letter
            i = len(text)
            last.append(self.choose(text, i, last))
            if i >= window:
                paths = set(range(i - longest + 1, i + 1))
                while len(paths) > 1:  # follow the furthest path back until all meet
                    far = max(paths)
                    paths.remove(far)
                    paths.add(far - len(last[far]))
                (meet,) = paths
                if meet:
                    yield from self._path(last, meet)
                    text, last = text[meet:], last[meet:]
        yield from self._path(last, len(text))

    @staticmethod
    def _path(last, end):
        found = []
        while end:
            found.append(last[end])
            end -= len(last[end])
        return reversed(found)

    def ids(self, word: str) -> tuple[int, ...]:
        if len(word) <= SHORT:  # one window holds it
            last = [""]
            if len(word) > HEAD:  # what stands for a beginning stands for every word that has it
                head = word[:HEAD]
                if head not in self.heads:
                    self.head_bytes += 500
                    if self.head_bytes > HEAD_BYTES:
                        self.heads.clear()
                        self.head_bytes = 500
                    for i in range(1, HEAD + 1):
                        last.append(self.choose(head, i, last))
                    self.heads[head] = last
                last = self.heads[head][:]
            choose = self.choose
            for i in range(len(last), len(word) + 1):
                last.append(choose(word, i, last))
            pieces = self._path(last, len(word))
        else:
            pieces = self.stream(word)
        found = []
        for piece in pieces:
            i = self.id.get(piece)
            if i is None:
                found.extend(self.byte[b] for b in piece.encode())
            else:
                found.append(i)
        return tuple(found)

    def __missing__(self, word: str) -> tuple[int, ...]:
        """word: without its first mark."""
        found, end = self.old.pop(word, None), word[-1:]
        if found is None and end in (".", ",") and 1 < len(word) <= SHORT:  # where the end is a piece of its own, the word without it is remembered once
            before = self[word[:-1]]
            if isinstance(piece := self.piece[before[-1]], str) and self.pair(piece, end):
                found = (*before, self.id[end])
        if found is None:
            found = self.ids(MARK + word)
        if len(word) <= SHORT:
            self.word_bytes += 200 + 2 * len(word) + 8 * len(found)
            if self.word_bytes > WORD_BYTES:
                self.old = dict(self)
                self.clear()
                self.word_bytes = 0
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        text = text.replace(" ", MARK)
        if MARK + MARK in text or text[0] == MARK:
            words = [w[1:] for w in _CHUNK.findall(MARK + text)]
        else:
            words = text.split(MARK)
        return np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not self.high[ids].any():
            text = "".join(map(self.piece.__getitem__, ids.tolist()))
        else:
            piece = self.piece
            text = b"".join(bytes((p,)) if isinstance(p := piece[i], int) else p.encode() for i in ids.tolist()).decode(errors="replace")
        text = text.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The worker's codec of a model, kept from task to task with what it remembers."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def probes(codec: Codec) -> list[str]:
    """Texts that tell models apart: words of the vocabulary's own pieces, letters that normalisers change, marks inside words."""
    pieces = sorted(codec.id)
    draw = np.random.Generator(np.random.PCG64(3)).integers(0, len(pieces), (200, 3)).tolist()
    return ["ﬁne Ａ１ ½ x²", "a  b ", " lead", "tab\there\nline", "Caf\u0065\u0301", "a\u00a0b\u200b"] + ["".join(pieces[i] for i in three).replace(MARK, " ") for three in draw]


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model's bytes, read on the driver alone (executors get them); a model that this codec doesn't encode as the library does is refused."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), Codec(model)
    wrong = next((t for t in probes(codec) if codec.encode(t).tolist() != library.encode(t)), None)
    if wrong is not None:
        raise ValueError(f"{path} is not a BPE model with an identity normaliser: {wrong!r} has other ids in the library")
    return model


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: id, n_chars, n_ids, ids array<int>, round_trip."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model))

    def run(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1)[a:b].to_pylist()]
                ids = [codec.encode(t) for t in texts]
                back = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [batch.column(0)[a:b], pa.array(list(map(len, texts)), pa.int64()), pa.array(np.diff(ends), pa.int64()), lists, pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "n_ids", "ids", "round_trip"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "id long, n_chars long, n_ids long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model))

    def run(parts):
        codec = codec_of(shared.value)
        for part in parts:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x, dtype=np.int32)) for x in part])

    return rows.withColumn(out, F.pandas_udf(run, "string", PandasUDFType.SCALAR_ITER)(F.col(ids_col)))


def op1_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
