"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search keeps best scores and backpointers only from the last committed boundary on. Where
no piece crosses a place, or all paths that can still go on come from one boundary, the ids before
it are committed; what is held then starts anew there. For unigram models a path's score is the
sum of its pieces' scores. For merge (BPE) models a step is legal only between two pieces that
merging leaves as they are; one legal path reaches each place, which is the merged encoding.
"""

from __future__ import annotations

import functools
import importlib.util
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, schema_of, table

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a worker remembers, besides as many that it met before those; characters of a remembered one at most.
REMEMBERED, REMEMBERED_CHARS = 150_000, 64
#: Characters that are handed to the search at once where a text has no certain boundaries.
SLICE = 1024
#: Pairs of pieces of which a worker remembers whether merging leaves them.
REMEMBERED_PAIRS = 250_000
#: Rows that are encoded into one batch.
BATCH_ROWS = 512


def default_model() -> str:
    """The public 32,000-piece model, where that package is installed."""
    found = importlib.util.find_spec("public_tokenizers")
    if found is None:
        raise FileNotFoundError("no public_tokenizers package; give a model file's path")
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Pieces with scores, and the rules by which a text is normalised."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        self.byte_fallback, self.type = False, UNIGRAM
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                for n, v in _fields(value):
                    self.byte_fallback = bool(v) if n == 35 else self.byte_fallback
                    self.type = v if n == 3 else self.type
            elif number == 3:
                for n, v in _fields(value):
                    charsmap = v if n == 2 else charsmap
                    self.dummy_prefix = bool(v) if n == 3 else self.dummy_prefix
                    self.squeeze = bool(v) if n == 4 else self.squeeze
                    self.escape = bool(v) if n == 5 else self.escape
        if charsmap:
            raise ValueError("models that rewrite characters aren't supported, only those with the identity rule")
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.byte_fallback &= len(self.bytes) == 256
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        top, self.unknown_score = max(normal, default=0.0), min(normal, default=0.0) - UNKNOWN_PENALTY
        #: By character a list of the dict of what may follow, the id of the piece that ends (-1: none), and its score.
        self.root: dict[str, list] = {}
        self.longest, chars = 1, set()
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k not in (NORMAL, USER) or not p:
                continue
            kids = self.root
            for c in p:
                node = kids.setdefault(c, [{}, -1, 0.0])
                kids = node[0]
            node[1:] = i, self.scores[i] if k == NORMAL else len(p) * top - 0.1
            self.longest = max(self.longest, len(p))
            chars |= set(p)
        usable = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)]
        #: No piece goes on over a blank after another character, so texts fall apart at such places.
        blank = f" {SPACE}" if self.escape else SPACE
        self.parts_at_space = "\n" not in chars and not any(SPACE in p.lstrip(SPACE) for p in usable)
        self.chunk = re.compile(f"\n|[{blank}]+[^{blank}\n]*|[^{blank}\n]+" if self.parts_at_space else f"(?s).{{1,{SLICE}}}")
        #: What stands together with the blank put before a text.
        self.head = re.compile(f"[{blank}]*[^{blank}\n]*" if self.parts_at_space else "")
        #: Ids of chunks met lately, and of those met in the time before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.score_of = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k in (NORMAL, USER)}
        self.stays: dict[int, dict[int, bool]] = {}
        self.pairs = self.streamed = 0
        #: The last merge inside a piece, and whether there is one; pieces are not more than the model has.
        self.derived: dict[str, tuple[str, str] | None] = {}

    def normalise(self, text: str) -> str:
        return self._spaced("".join(self._chunks(text)))

    def _unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unknown]

    def _derived(self, text: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to make ``text`` (empty for a character); None where it never does."""
        known = self.derived.get(text, 0)
        if known != 0:
            return known
        parts, score_of, last = list(text), self.score_of, ("", "")
        while len(parts) > 1:
            best, at, before = None, 0, parts[0]
            for i in range(1, len(parts)):
                part = parts[i]
                score = score_of.get(before + part)
                if score is not None and (best is None or score > best):
                    best, at = score, i
                before = part
            if best is None:
                last = None
                break
            last = parts[at - 1], parts[at]
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
        self.derived[text] = last
        return last

    def _legal(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces as they are; left is -1 at a text's start and after an unknown character.

        Merges inside both pieces are undone, the later one first. The pieces part where they meet
        if a merge over that place would have come before the one just undone.
        """
        row = self.stays.setdefault(left, {})
        known = row.get(right)
        if known is None:
            if self.pairs >= REMEMBERED_PAIRS:
                self.stays.clear()
                self.pairs = 0
            known = row[right] = self._apart(self.pieces[left] if left >= 0 else "", self.pieces[right])
            self.pairs += 1
        return known

    def _apart(self, a: str, b: str) -> bool:
        halves_a, halves_b, score_of = self._derived(a) if a else (), self._derived(b), self.score_of
        if halves_a is None or halves_b is None:
            return False
        if not a:
            return True
        limit, ties = -np.inf, False  # the merge just undone: its score, and whether one of that score further left comes first
        while True:
            over = score_of.get(a + b)
            if over is not None and (over > limit or (ties and over == limit)):
                return False
            whole_a, whole_b = len(a) == 1, len(b) == 1
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and score_of[a] < score_of[b]):
                limit, ties, a = score_of[a], False, self._derived(a)[1]
            else:
                limit, ties, b = score_of[b], True, self._derived(b)[0]

    def stream(self, parts: Iterator[str], held: list[int] | None = None) -> Iterator[list[int]]:
        """Lists of ids, each as soon as it is certain, of the text that ``parts`` make together.

        ``held`` gets the most characters that were kept at once.
        """
        window = ""  # characters from the last boundary that is certain
        back: list[tuple[int, int] | None] = [(0, -1)]  # where the best path to a place comes from, and its last piece
        far = start = size = 0  # furthest end of a piece; first place not yet left; characters in the window
        longest, merges, stays, root, lost = self.longest, self.type == BPE, self.stays, self.root, self.unknown_score
        best: list[float] = [0.0]  # scores of the best paths, where scores decide
        limit = 4 * longest  # paths are traced back when the search has come so far
        nothing, ended = ({}, -1, 0.0), False
        while True:
            while not ended and size - start < longest:
                part = next(parts, None)
                if part is None:
                    ended = True
                else:
                    window += part
                    size += len(part)
                    back += [None] * len(part)
                    if not merges:
                        best += [-np.inf] * len(part)
            if held is not None:
                held[0] = max(held[0], size)
            # All pieces that begin before this place end inside the window.
            stop = min(limit, size if ended else size - longest + 1)
            while start < stop:
                came, one = back[start], start + 1
                if came is not None:
                    kids, at = root, start
                    if merges:
                        left = came[1]
                        row = stays.get(left) or stays.setdefault(left, {})
                        for c in window[start : start + longest]:
                            if c not in kids:
                                break
                            kids, piece, _ = kids[c]
                            at += 1
                            if piece >= 0 and back[at] is None and (row[piece] if piece in row else self._legal(left, piece)):
                                back[at] = (start, piece)
                        if back[one] is None and root.get(window[start], nothing)[1] < 0:
                            back[one], at = (start, -1), max(at, one)
                    else:
                        here, known = best[start], False
                        for c in window[start : start + longest]:
                            node = kids.get(c)
                            if node is None:
                                break
                            kids, piece, score = node
                            at += 1
                            if piece >= 0:
                                known |= at == one
                                if here + score > best[at]:
                                    best[at], back[at] = here + score, (start, piece)
                        if not known and here + lost > best[one]:
                            best[one], back[one], at = here + lost, (start, -1), max(at, one)
                    if at > far:
                        far = at
                start = one
            if ended and start == size:
                meet = size
            elif start < limit:
                continue
            else:
                # All places that a later piece can begin at, traced back until they are one.
                alive = {p for p in range(start, min(far, size) + 1) if back[p] is not None}
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0])
                meet = alive.pop()
                if not meet:
                    limit *= 2
                    continue
            ids: list[int] = []
            at = meet
            while at:
                before, piece = back[at]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += self._unknown(window[before])[::-1]
                at = before
            ids.reverse()
            yield ids
            if ended and meet == size:
                return
            window, size = window[meet:], size - meet
            back = [(0, back[meet][1]), *(x and (max(0, x[0] - meet), x[1]) for x in back[meet + 1 :])]
            if not merges:
                zero = best[meet]
                best = [b - zero for b in best[meet:]]
            start, far, limit = start - meet, far - meet, 4 * longest

    def _chunks(self, text: str) -> Iterator[str]:
        """The normalised text, cut where no piece goes on, one part after another; slices where there are no such places."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return
        at = 0
        if self.dummy_prefix:
            at = self.head.match(text).end()
            yield " " + text[:at]
        for found in self.chunk.finditer(text, at):
            yield found[0]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Chunks met lately are recalled, all others go through the streaming search."""
        out = bytearray()
        if not self.parts_at_space:
            for ids in self.stream(self._spaced(c) for c in self._chunks(text)):
                out += array("i", ids).tobytes()
            return np.frombuffer(out, np.int32)
        known, before = self.known, self.before
        for chunk in self._chunks(text):
            ids = known.get(chunk)
            if ids is None:
                ids = before.get(chunk)
                if ids is None:
                    self.streamed += len(chunk)
                    found = self.stream(iter((self._spaced(chunk),)))
                    if len(chunk) > REMEMBERED_CHARS:
                        for part in found:
                            out += array("i", part).tobytes()
                        continue
                    ids = b"".join([array("i", part).tobytes() for part in found])
                if len(known) >= REMEMBERED:
                    before, known = known, {}
                    self.before, self.known = before, known
                known[chunk] = ids
            out += ids
        return np.frombuffer(out, np.int32)

    def _spaced(self, part: str) -> str:
        return part.replace(" ", SPACE) if self.escape else part

    @functools.cached_property
    def _table(self) -> list[bytes]:
        return [
            b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else self.byte_of[i] if k == BYTE else self._raw(i)
            for i, k in enumerate(self.kinds)
        ]

    def _raw(self, i: int) -> bytes:
        return self.pieces[i].replace(SPACE, " ").encode("utf-8")

    def decode(self, ids) -> str:
        """The text of ``ids``. Control pieces say nothing; unknown ones are written " ⁇ "."""
        text = b"".join(map(self._table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.cache
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def _read(spark: SparkSession, model: str | None) -> bytes:
    """The model file's bytes, by Spark where the path names a store."""
    path = model or default_model()
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, made: dict[str, tuple[str, pa.DataType]], of) -> DataFrame:
    df = df.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, BATCH_ROWS) for i in range(0, whole.num_rows, BATCH_ROWS)):
                new = [pa.array(x, kind) for x, (_, kind) in zip(of(b), made.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *made])

    return df.mapInArrow(run, schema_of(df, set(), ", ".join(f"`{name}` {kind}" for name, (kind, _) in made.items())))


_IDS, _TEXT = ("array<int>", pa.list_(pa.int32())), ("string", pa.string())


def encode(df: DataFrame, text: str = "text", out: str = "ids", model: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with the ids (array of int) of column ``text``; a column of that name is replaced.

    A null text gives null, an empty one no ids. Texts are taken whole, of any length; the search
    holds a window that the longest piece bounds, wherever paths converge. ``model`` is the path of
    a model file, by default the public one. With ``decoded`` a column of that name gets what the ids
    decode to, in the same pass.
    """
    data = _read(df.sparkSession, model)

    def of(b: pa.RecordBatch) -> Iterator[list]:
        m = _model(data)
        ids, back = [], []
        for t in column(b, text):
            t = t.as_py()
            found = None if t is None else m.encode(t)
            ids.append(None if t is None else found)
            if decoded:
                back.append(None if t is None else m.decode(found.tolist()))
        yield ids
        if decoded:
            yield back

    return _mapped(df, {out: _IDS, decoded: _TEXT} if decoded else {out: _IDS}, of)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the text of column ``ids``. Null gives null, no ids an empty text."""
    data = _read(df.sparkSession, model)

    def of(b: pa.RecordBatch) -> Iterator[list]:
        m = _model(data)
        yield [m.decode(x.values.to_pylist()) if x.is_valid else None for x in column(b, ids)]

    return _mapped(df, {out: _TEXT}, of)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's ids and what they decode to, digested."""
    both = encode(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), decoded="decoded")
    return both.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"), F.coalesce(F.col("decoded") == F.col("text"), F.lit(True)).alias("round_trip"),
    )
