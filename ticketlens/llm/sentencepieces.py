"""SentencePiece encoding and decoding (operator 1): batched numpy Viterbi.

The vocabulary is read once on the driver (its size is checked) and broadcast.
In a task the words of a batch that were not seen before are grouped by length
and all words of a length advance together: at every end position the hashes of
the substrings of each piece length are probed in the sorted hashes of the
pieces of that length, and a vectorised maximum over the candidates stores the
back pointer.

Two kinds of models:

* ``unigram``: the maximum is over path score plus piece score.
* ``bpe``: a piece sequence is what merging yields exactly if every two
  neighbours are what merging yields from their joint text, so a candidate may
  only follow the best last piece of its start position if the two stay apart
  when merged (asked once per pair and remembered). At every position exactly
  one candidate passes; the maximum picks it.

Words start at a run of spaces (written as U+2581) and no piece goes on after
one (checked for the model), so words can be encoded on their own and equal
words once. Unknown characters become their UTF-8 byte pieces.

Cases: a null text gives null ids and decodes to null; an empty one an empty
list; texts of any length are encoded whole; U+2581 in a text is read as a
space, as the model does, so such a text does not come back unchanged
(``round_trip`` false); repeated rows are encoded alike; an empty table gives an
empty table; extra columns are passed through (the new column names are the
caller's choice).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import process_cache

SPACE = "▁"
#: Longest vocabulary that is broadcast, in bytes of text.
MAX_VOCABULARY_BYTES = 64 << 20
#: Words remembered per Python worker; beyond that the memory starts anew.
REMEMBERED_WORDS = 500_000
#: Fewer words of one length than this are not worth a batch.
FEW_WORDS = 32
#: Characters of words that advance together at most.
BATCH_CHARS = 1 << 18

_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model: plain data, safe to broadcast."""

    kind: str  # "bpe" or "unigram"
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]  # may match text
    byte_ids: tuple[int, ...]  # ids of the 256 byte pieces, or empty
    unknown: int


def load(model_file: str) -> Vocabulary:
    """The vocabulary of a model file; the file is read on the driver only."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    pieces = tuple(m.id_to_piece(i) for i in range(n))
    if sum(len(p.encode()) for p in pieces) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than MAX_VOCABULARY_BYTES")
    normal = tuple(not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n))
    if any(SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, normal) if ok):
        raise ValueError("a piece goes on after a space: words cannot be encoded on their own")
    probe = " A  ﬁé\n"
    if m.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("only models without text normalisation and with a leading space are supported")
    at = {int(_BYTE.fullmatch(p)[1], 16): i for i, p in enumerate(pieces) if m.is_byte(i)}
    scores = tuple(float(m.get_score(i)) for i in range(n))
    return Vocabulary(
        kind_of(pieces, scores, normal), pieces, scores, normal,
        tuple(at[b] for b in range(256)) if len(at) == 256 else (), m.unk_id(),
    )


def kind_of(pieces, scores, normal) -> str:
    """Merge models score their pieces by rank, in whole numbers; unigram models by log probability."""
    whole = all(float(s).is_integer() for s, ok in zip(scores, normal) if ok)
    return "bpe" if whole else "unigram"


class Encoder:
    """Encodes words in batches; holds what it has learnt about words and pairs."""

    _BASE = 0x9E3779B97F4A7C15  # odd, so powers stay distinct modulo 2 ** 64

    def __init__(self, vocabulary: Vocabulary):
        import numpy as np

        self.v = vocabulary
        self.rank = {p: s for p, s, ok in zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal) if ok}
        self.id = {p: i for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.normal)) if ok}
        self.scores = np.array(vocabulary.scores)
        self.words: dict[str, bytes] = {"": b""}  # ids as int32 bytes
        self.parts: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.line_end_alone = not any("\n" in p for p in self.id)
        pairs = {(ord(a) << 21) | ord(b) for p in self.id for a, b in zip(p, p[1:])}
        self.inside = np.array(sorted(pairs) or [0], dtype=np.uint64)
        by_length: dict[int, list[str]] = {}
        for p in self.id:
            by_length.setdefault(len(p), []).append(p)
        self.longest = max(by_length, default=1)
        power = np.ones(self.longest + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, self.longest + 1):
                power[i] = power[i - 1] * np.uint64(self._BASE)
        self.power = power
        self.probe = {}
        for size, ps in by_length.items():
            h = self._prefix_hashes(self._codes(ps))[:, -1]
            order = np.argsort(h)
            ids = np.array([self.id[p] for p in ps], dtype=np.int64)[order]
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a hash")
            self.probe[size] = (h[order], ids)

    @staticmethod
    def _codes(words: list[str]):
        import numpy as np

        flat = "".join(words).encode("utf-32-le")
        return np.frombuffer(flat, dtype="<u4").reshape(len(words), -1).astype(np.uint64)

    def _prefix_hashes(self, codes):
        import numpy as np

        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        base = np.uint64(self._BASE)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                out[:, j + 1] = out[:, j] * base + codes[:, j] + np.uint64(1)
        return out

    # --- the merge rule -----------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """What merging yields: the best-scored adjacent pair first, leftmost among equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.v.pieces[token] if token < len(self.v.pieces) else chr(token - len(self.v.pieces))

    def _stay_apart(self, pairs):
        """For pair codes (left * 2**32 + right; left 2**31 - 1: none): may the two be neighbours."""
        import numpy as np

        codes, back = np.unique(pairs, return_inverse=True)
        known, out = self.apart, np.empty(len(codes), dtype=bool)
        for k, code in enumerate(codes.tolist()):
            ok = known.get(code)
            if ok is None:
                left, right = code >> 32, code & 0xFFFFFFFF
                b = self._text(right)
                if left == 0x7FFFFFFF:
                    ok = self.merge(b) == [b]
                else:
                    a = self._text(left)
                    ok = self.merge(a + b) == [a, b]
                known[code] = ok
            out[k] = ok
        return out[back]

    # --- all words of one length ---------------------------------------------------

    def _advance(self, words: list[str]) -> list[bytes]:
        import numpy as np

        bpe = self.v.kind == "bpe"
        codes = self._codes(words)
        prefix = self._prefix_hashes(codes)
        n, size = codes.shape
        rows = np.arange(n)
        score = np.full((n, size + 1), -np.inf)
        score[:, 0] = 0.0
        last = np.full((n, size + 1), 0x7FFFFFFF, dtype=np.int64)
        back = np.zeros((n, size + 1), dtype=np.int64)
        lowest = float(self.scores.min()) - 10.0
        for j in range(1, size + 1):
            for width in range(min(j, self.longest), 0, -1):
                keys, ids = self.probe.get(width, (None, None))
                token = np.full(n, -1, dtype=np.int64)
                if keys is not None:
                    with np.errstate(over="ignore"):
                        h = prefix[:, j] - prefix[:, j - width] * self.power[width]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    token = np.where(keys[at] == h, ids[at], -1)
                gain = self.scores[np.maximum(token, 0)]
                if width == 1:  # a character no piece has
                    alone = token < 0
                    token = np.where(alone, len(self.v.pieces) + codes[:, j - 1].astype(np.int64), token)
                    gain = np.where(alone, lowest, gain)
                ok = (token >= 0) & np.isfinite(score[:, j - width])
                if bpe:  # one candidate at most passes: rows that have it need no other
                    ok &= ~np.isfinite(score[:, j])
                at = rows[ok]
                if not len(at):
                    continue
                if bpe:
                    at = at[self._stay_apart((last[at, j - width] << 32) | token[at])]
                    total = np.zeros(len(at))
                else:
                    total = score[at, j - width] + gain[at]
                better = total > score[at, j]
                at, total = at[better], total[better]
                score[at, j], last[at, j], back[at, j] = total, token[at], j - width
        return [self._walk(last[r].tolist(), back[r].tolist(), size) for r in range(n)]

    def _advance_one(self, word: str) -> bytes:
        """The same lattice for one word, step by step: for lengths too rare to be worth a batch."""
        bpe, known, none = self.v.kind == "bpe", self.apart, 0x7FFFFFFF
        size, foreign, lowest = len(word), len(self.v.pieces), min(self.v.scores) - 10.0
        last, back = [none] * (size + 1), [-1] * (size + 1)
        score = [0.0] + [None] * size
        for j in range(1, size + 1):
            for width in range(min(j, self.longest), 0, -1):
                i = j - width
                token = self.id.get(word[i:j])
                if score[i] is None or (token is None and width > 1):
                    continue
                gain = lowest if token is None else self.v.scores[token]
                token = foreign + ord(word[i]) if token is None else token
                if bpe:
                    code = (last[i] << 32) | token
                    ok = known.get(code)
                    if ok is None:
                        ok = bool(self._stay_apart([code])[0])
                    if ok:
                        score[j], last[j], back[j] = 0.0, token, i
                        break
                elif score[j] is None or score[i] + gain > score[j]:
                    score[j], last[j], back[j] = score[i] + gain, token, i
        return self._walk(last, back, size)

    def _walk(self, last: list[int], back: list[int], j: int) -> bytes:
        out: list[int] = []
        while j > 0:
            token = last[j]
            if token < len(self.v.pieces):
                out.append(token)
            elif self.v.byte_ids:
                out.extend(self.v.byte_ids[b] for b in reversed(self._text(token).encode("utf-8")))
            else:
                out.append(self.v.unknown)
            j = back[j]
        return array("i", reversed(out)).tobytes()

    def _parts(self, words: list[str]) -> list[list[str]]:
        """Each (non-empty) word cut where no piece spans the two neighbouring characters: nothing can join across."""
        import numpy as np

        flat = "".join(words)
        codes = self._codes([flat])[0]
        pairs = (codes[:-1] << np.uint64(21)) | codes[1:]
        at = np.minimum(np.searchsorted(self.inside, pairs), len(self.inside) - 1)
        cuts = np.flatnonzero(self.inside[at] != pairs) + 1
        ends = np.cumsum([len(w) for w in words])
        edges = np.union1d(cuts, ends)
        marks = edges.tolist()
        pieces = [flat[i:j] for i, j in zip([0, *marks], marks)]
        stops = (np.searchsorted(edges, ends) + 1).tolist()
        return [pieces[i:j] for i, j in zip([0, *stops], stops)]

    def learn(self, words: list[str]) -> None:
        """Encode words not known yet; their parts of equal length advance together."""
        if not words:
            return
        cut = self._parts(words)
        groups: dict[int, list[str]] = {}
        for part in {p for ps in cut for p in ps} - self.parts.keys():
            groups.setdefault(len(part), []).append(part)
        for size, group in groups.items():
            if len(group) < FEW_WORDS:
                self.parts.update((p, self._advance_one(p)) for p in group)
                continue
            at_once = max(FEW_WORDS, BATCH_CHARS // size)
            for i in range(0, len(group), at_once):
                some = group[i : i + at_once]
                self.parts.update(zip(some, self._advance(some)))
        of = self.parts.__getitem__
        self.words.update((w, b"".join(map(of, ps))) for w, ps in zip(words, cut))

    def encode(self, texts: list[str | None]) -> list:
        """Token ids (int32 arrays) per text, None for None."""
        import numpy as np

        split = [None if t is None else self.split(t) for t in texts]
        used = set().union(*[ws for ws in split if ws])
        new = used - self.words.keys()
        if len(self.words) + len(new) > REMEMBERED_WORDS:
            self.words = {"": b""}
            self.parts.clear()
            new = used - self.words.keys()
        if len(self.apart) > 4 * REMEMBERED_WORDS:
            self.apart.clear()
        self.learn(list(new))
        of = self.words.__getitem__
        return [None if ws is None else np.frombuffer(b"".join(map(of, ws)), dtype="<i4") for ws in split]

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it (and, where no piece holds one, line ends apart)."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return _WORD.findall(SPACE + text.replace(" ", SPACE))
        spaced = SPACE + text.replace(" ", " " + SPACE)
        return (spaced.replace("\n", " \n ") if self.line_end_alone else spaced).split(" ")


def encoder_of(key: int, vocabulary: Vocabulary) -> Encoder:
    """The encoder of a broadcast vocabulary, kept by the worker process from task to task."""
    known = process_cache("encoders")
    if key not in known:
        known.clear()
        known[key] = Encoder(vocabulary)
    return known[key]


def decoder(vocabulary: Vocabulary):
    """A function from token ids to text."""
    table = []
    control = {i for i, ok in enumerate(vocabulary.normal) if not ok} - set(vocabulary.byte_ids)
    byte_of = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    for i, p in enumerate(vocabulary.pieces):
        if i == vocabulary.unknown:
            table.append(" ⁇ ".encode())
        elif i in byte_of:
            table.append(byte_of[i])
        else:
            table.append(b"" if i in control else p.replace(SPACE, " ").encode())

    def decode(ids) -> str | None:
        if ids is None:
            return None
        text = b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text

    return decode


def _batches(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch so that about ``limit`` characters are in hand at once."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    yield first, len(texts)


def _sent(spark: SparkSession, vocabulary: Vocabulary):
    """Broadcast as a plain tuple: unlike functions, broadcast values name their classes' module, which workers need not have."""
    return spark.sparkContext.broadcast(tuple(getattr(vocabulary, f.name) for f in fields(vocabulary)))


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "token_ids", round_trip: str | None = None,
) -> DataFrame:
    """``docs`` plus ``ids`` (array<int>); with ``round_trip``, also whether decoding gives the text back."""
    spark: SparkSession = docs.sparkSession
    shared = _sent(spark, vocabulary)
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if round_trip:
        extra.append(T.StructField(round_trip, T.BooleanType()))
    docs = docs.drop(*[f.name for f in extra if f.name != text])
    at = docs.columns.index(text)
    key = hash((vocabulary.pieces, vocabulary.scores))

    def run(parts):
        import numpy as np
        import pyarrow as pa

        given = Vocabulary(*shared.value)
        encoder, decode = encoder_of(key, given), decoder(given)
        for batch in parts:
            texts = batch.column(at).to_pylist()
            for a, b in _batches(texts):
                tokens = encoder.encode(texts[a:b])
                sizes = np.cumsum([0] + [0 if t is None else len(t) for t in tokens], dtype=np.int32)
                flat = np.concatenate([t for t in tokens if t is not None] or [np.empty(0, np.int32)])
                lists = pa.ListArray.from_arrays(
                    pa.array(sizes, mask=np.array([t is None for t in tokens] + [False])), pa.array(flat, pa.int32())
                )
                columns, names = [*batch.slice(a, b - a).columns, lists], [*batch.schema.names, ids]
                if round_trip:
                    back = [None if t is None else decode(t.tolist()) == s for t, s in zip(tokens, texts[a:b])]
                    columns, names = [*columns, pa.array(back, pa.bool_())], [*names, round_trip]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + extra))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` plus the decoded text of a column of token ids."""
    shared = _sent(df.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def to_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = decoder(Vocabulary(*shared.value))
        for series in parts:
            yield pd.Series([back(x) for x in series], dtype=object)

    return df.withColumn(text, to_text(F.col(f"`{ids}`")))
