"""Byte-level BPE encoding and decoding with a sentencepiece model serialised directly from a rank file.

Every token's bytes become a string of byte symbols (printable characters one to one with the 256 bytes); the pieces,
scored by negative rank, are written as a sentencepiece BPE model with identity normalisation: no dummy prefix, no
removal or escaping of white space. Texts are cut into pre-tokens by the tokenizer's pattern: those of Latin letters
alone by classes of bytes, a block of texts at a time, the others by the pattern itself. Each pre-token that is a
token itself takes its id, all others are encoded by sentencepiece, which merges the pair with the best score, that is
the lowest rank, leftmost first. Pre-tokens repeat, so a block's are looked up once each, and each worker remembers the
ids of those it has seen, up to a bound. Decoding maps ids to their byte symbols and these back to bytes.
"""

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffer_of, texts, tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a task remembers; beyond, it forgets all and begins anew.
REMEMBERED = 400_000
#: Bytes of text that are cut and looked up at a time, and characters after which a longer text is cut first, where its
#: pattern allows.
PIECE_CHARS = 1 << 20
#: Longer pre-tokens are encoded each time and not remembered.
REMEMBERED_BYTES = 64


def byte_symbols() -> list[str]:
    """A character for each byte: the printable ones of Latin-1 stand for themselves, the rest are moved above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id (lines of base64 and rank); ids must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model: piece i is token i; the unknown piece that the format demands comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    symbols = byte_symbols()
    m = pb.ModelProto()
    for rank, token in enumerate(tokens):
        m.pieces.add(piece="".join(symbols[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = m.trainer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(m.pieces), len(tokens), -1, -1, -1
    t.max_sentencepiece_length = max(map(len, tokens), default=1)
    n = m.normalizer_spec
    n.name, n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", b"", False, False, False
    return m.SerializeToString()


#: The pattern whose pre-tokens :func:`starts` finds.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between letters: with that pattern a pre-token always begins there, whatever stands before.
_SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_LETTER, _DIGIT, _OTHER, _WHITE, _BEYOND = range(5)


def _kinds() -> np.ndarray:
    """The pattern's class of each byte. The bytes of U+00C0 to U+024F count as letters, which all but two of these are;
    what may be of another class, or is white space to some engines only, is beyond what bytes tell."""
    out = np.full(256, _BEYOND, np.uint8)
    out[:0x1C] = out[0x20:0x80] = _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _WHITE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = out[0x80:0xC0] = out[0xC3:0xC9] = _LETTER
    return out


_KINDS = _kinds()


def plain(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a text's pre-tokens follow from the classes of its bytes, by text."""
    beyond = _KINDS[data] == _BEYOND
    lead = np.flatnonzero(data[:-1] == 0xC3)
    beyond[lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]] = True  # the signs of multiplication and division
    out = np.ones(len(at) - 1, bool)
    out[np.searchsorted(at, np.flatnonzero(beyond), "right") - 1] = False
    return out


def starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin; each goes as far as the next one, or its text."""
    if not (n := len(data)):
        return np.zeros(0, np.int64)
    kind, first, out = _KINDS[data], np.zeros(n + 1, bool), np.ones(n + 4, bool)
    first[at] = True
    np.not_equal(kind[1:], kind[:-1], out=out[1:n])
    out[:n] |= first[:n]
    white = kind == _WHITE
    last = white[:-1] & ~white[1:] & ~first[1:n]  # before something else, the last white space is apart,
    out[: n - 1] |= last
    out[1:n] &= ~(last & (data[:-1] == 32))  # and a space belongs to what follows
    quote = np.flatnonzero((data == 39) & out[:n])
    end = at[np.searchsorted(at, quote, "right")]
    a, b = (np.where(quote + k < end, data[np.minimum(quote + k, n - 1)], 0) for k in (1, 2))
    one = np.isin(a, list(b"stmd"))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    out[quote[one | two] + 1] = False
    out[quote[one] + 2] = True
    out[quote[two] + 3] = True
    return np.flatnonzero(out[:n])


def _slices(whole, at: Iterable[int]) -> list:
    """The parts of a string or bytes between these places."""
    return [whole[a:b] for a, b in pairwise(at)]


def _gather(table: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of a table, given by start and size, one after another."""
    n = size[which]
    at = np.repeat(start[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return table[at]


class Codec:
    """Encoder and decoder of one vocabulary, made once a worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbols = byte_symbols()
        back = {ord(c): b for b, c in enumerate(symbols)}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size() - 1)]
        self.id_of = {p: i for i, p in enumerate(pieces)}
        self.symbols = np.array([ord(c) for c in symbols], "<u2")
        self.general = regex.compile(pattern).findall
        self.by_bytes = pattern == _PATTERN
        self.known: dict[bytes, bytes] = {}
        token_bytes = [bytes(back[ord(c)] for c in p) for p in pieces]
        self.table = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.size = np.array([len(x) for x in token_bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def learn(self, new: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens."""
        symbols = self.symbols[np.frombuffer(b"".join(new), np.uint8)].tobytes().decode("utf-16-le")
        raws = _slices(symbols, accumulate(map(len, new), initial=0))
        whole = list(map(self.id_of.get, raws))
        parts = iter(self.sp.encode([r for r, w in zip(raws, whole) if w is None], num_threads=1))
        ids = [next(parts) if w is None else (w,) for w in whole]
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return _slices(packed, accumulate((4 * len(x) for x in ids), initial=0))

    def pieces(self, text: str) -> list[str]:
        """A long text cut where a pre-token begins in any case; one that has no such place is one piece."""
        out, at = [], 0
        while self.by_bytes and len(text) - at > PIECE_CHARS and (seam := _SEAM.search(text, at + PIECE_CHARS)):
            out.append(text[at : seam.start()])
            at = seam.start()
        return [*out, text[at:]]

    def encode(self, values: list[str] | pa.Array) -> list[bytes]:
        """Ids of whole texts, packed as little-endian unsigned 32-bit integers. Texts are taken a few at a time."""
        array = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
        array.validate(full=True)  # else bytes that aren't UTF-8 would pass for letters
        data, at = buffer_of(array)
        out: list[bytes] = []
        for a, b in blocks(at, PIECE_CHARS):
            if at[b] - at[a] > PIECE_CHARS:
                out.append(b"".join(self._encode(*buffer_of(pa.array([p])))[0] for p in self.pieces(array[a].as_py())))
            else:
                out += self._encode(data[at[a] : at[b]], at[a : b + 1] - at[a])
        return out

    def _encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        tokens, counts = self.split(data, at)
        coded = tokens.dictionary_encode()
        content, ends = buffer_of(coded.dictionary)
        distinct, code, known = _slices(content.tobytes(), ends.tolist()), coded.indices.to_numpy(), self.known
        packed = list(map(known.get, distinct))
        if new := [k for k, p in enumerate(packed) if p is None]:
            for k, ids in zip(new, self.learn([distinct[k] for k in new])):
                packed[k] = ids
                if len(distinct[k]) <= REMEMBERED_BYTES:
                    known[distinct[k]] = ids
        n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = _gather(np.frombuffer(b"".join(packed), "<u4"), np.cumsum(n) - n, n, code)
        ends = np.append(0, np.cumsum(n[code]))[np.append(0, np.cumsum(counts))]
        return [ids[a:b].tobytes() for a, b in pairwise(ends.tolist())]

    def split(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all texts, in order, and their number by text."""
        easy = plain(data, at) if self.by_bytes else np.zeros(len(at) - 1, bool)
        if easy.all():
            begin = starts(data, at)
            offsets = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
            counts = np.diff(np.searchsorted(begin, at))
            return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, offsets, pa.py_buffer(data)]), counts
        parts, counts = [], np.zeros(len(easy), np.int64)
        bounds = [0, *(np.flatnonzero(np.diff(easy)) + 1).tolist(), len(easy)]
        for a, b in pairwise(bounds):  # runs of texts that are all plain, or all not
            if easy[a]:
                tokens, counts[a:b] = self.split(data[at[a] : at[b]], at[a : b + 1] - at[a])
            else:
                found = [self.general(data[x:y].tobytes().decode()) for x, y in pairwise(at[a : b + 1].tolist())]
                counts[a:b] = list(map(len, found))
                tokens = pa.array([t.encode() for own in found for t in own], pa.large_binary())
            parts.append(tokens)
        return pa.concat_arrays(parts), counts

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids, by one gather from the table of all tokens' bytes."""
        return _gather(self.table, self.start, self.size, np.frombuffer(packed, "<u4")).tobytes()


_CODECS: dict[str, Codec] = {}


def _codec(key: str, model: bytes, pattern: str) -> Codec:
    if key not in _CODECS:
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def _model(docs: DataFrame, path: str | None, pattern: str | None, most: int | None = None):
    import public_tokenizers as P

    tokens = read_ranks(path or P.path(VOCABULARY))
    if most is not None and len(tokens) > most:
        raise ValueError(f"the vocabulary has more than {most} tokens")
    model, pattern = serialise(tokens), pattern or P.PATTERN
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    return key, tune(docs.sparkSession).sparkContext.broadcast(model), pattern


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the token ids (array<int>) of every whole text, without special tokens; null texts count as empty, which
    have none. A column of that name is replaced. ``path`` is the rank file, ``pattern`` cuts the pre-tokens."""
    key, model, pattern = _model(docs, path, pattern)

    @F.pandas_udf("array<int>")
    def run(text):
        codec = _codec(key, model.value, pattern)
        values = texts(pa.Array.from_pandas(text, type=pa.string()))
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(values)])

    return docs.withColumn(ids_col, run(F.col(text_col)))


def decode(rows: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null."""
    key, model, pattern = _model(rows, path, pattern)

    @F.pandas_udf("binary")
    def run(ids):
        codec = _codec(key, model.value, pattern)
        return pd.Series([None if x is None else codec.decode(np.asarray(x, "<u4").tobytes()) for x in ids])

    return rows.withColumn(bytes_col, run(F.col(ids_col)))


def pack(docs: DataFrame, text_col: str = "text", data_col: str = "data", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the token ids of every whole text as packed little-endian unsigned 16-bit integers, which
    :func:`packing.pack` takes; null texts count as empty. The vocabulary must have at most 65536 tokens."""
    key, model, pattern = _model(docs, path, pattern, 1 << 16)

    @F.arrow_udf("binary")
    def run(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(key, model.value, pattern)
        for part in text:
            yield pa.array([np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in codec.encode(texts(part))], pa.binary())
        codec.known.clear()

    # nondeterministic to Spark, which else encodes once more for a filter on the ids
    return docs.withColumn(data_col, run.asNondeterministic()(F.col(text_col)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256
    (of the bytes decoded from those ids): encoding, decoding and hashing in one pass. With ``ids`` the packed ids come
    too (binary). Null texts count as empty; null ids stay; repeated rows give repeated results."""
    key, model, pattern = _model(docs, path, pattern)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if ids else 4]

    def run(batches):
        codec = _codec(key, model.value, pattern)
        for batch in batches:
            n, a, b, all_ = [], [], [], []
            for packed in codec.encode(texts(batch.column(1))):
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if ids:
                    all_.append(packed)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(all_, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)
        codec.known.clear()  # workers live on; what they remember shouldn't

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
