"""SentencePiece encoding and decoding (BPE with byte fallback) over whole texts.

Method: a table holds, for each prefix of a chunk, the one token that ends the encoding of that prefix. An Aho-Corasick
automaton gives the tokens that end at a position; the one whose left neighbour (the last token of the prefix before it) forms a
compatible pair with it is the entry. A pair is compatible if merging the two strings alone gives back just that pair: the merges inside
each are known from it alone, so that only those at the border are tried. The ids are then read backwards from the end of the table. The automaton's
moves are worked out as texts need them.

No vocabulary piece holds the word mark after another character, so a text falls apart, without loss, at word marks; equal chunks
are encoded once per task, as long as it remembers them. Runs of marks have the worst score of all pieces and so merge last, from the left.

Null text counts as empty, an empty table gives an empty one. Extra columns are dropped by `encode`, which returns one row per input row.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillframe.llm.common import frugal, model_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Distinct chunks, pairs, and moves of the automaton, that a task remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED = 400_000
PAIRS = 400_000
MOVES = 200_000
#: The score of a pair that isn't a piece.
NEVER = float("-inf")


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        width = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, blob[at : at + width]
        at += width


class PieceModel:
    """Vocabulary and merge order of a BPE model file with identity normalisation, byte fallback and a leading word mark."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for field, value in _fields(blob):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4) != 0 or not norm.get(3, 1):
                    raise ValueError("only identity normalisation with a leading word mark and kept spaces is supported")
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds the word mark after another character")
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.pieces.index("</s>")
        self.runs = sorted((len(p) for p in self.id if not p.strip(MARK)), reverse=True)
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.decimal = {p: str(i) for p, i in self.id.items()}
        self.prefixes = {p[:n] for p in self.id for n in range(len(p) + 1)}
        self.moves: dict[str, tuple[str, tuple[tuple[str, int, dict[str, bool]], ...]]] = {}
        self.merges: dict[str, tuple[bool, list[tuple[float, str, str]]]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def merging(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Plain merging of a piece, again and again the leftmost pair of the best score: whether one part is left, and after each merge its score and the first and last part."""
        got = self.merges.get(piece)
        if got is not None:
            return got
        parts, score, steps = list(piece), self.score, []
        near = [score.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while near and (best := max(near)) > NEVER:
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
            if i < len(near):
                near[i] = score.get(parts[i] + parts[i + 1], NEVER)
            steps.append((best, parts[0], parts[-1]))
        got = len(parts) == 1, steps
        if len(piece) > 1:  # pieces only: characters outside the vocabulary aren't bounded by it
            self.merges[piece] = got
        return got

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging left + right merges nothing over their border. Each is a character, or a piece that merging gives."""
        ours, theirs = self.merging(left)[1], self.merging(right)[1]
        i = j = 0
        low, high = left[-1], right[0]
        while True:
            x = ours[i][0] if i < len(ours) else NEVER
            y = theirs[j][0] if j < len(theirs) else NEVER
            border = self.score.get(low + high, NEVER)
            if border > x and border >= y:
                return False
            if x > NEVER and x >= y:
                low = ours[i][2]
                i += 1
            elif y > NEVER:
                high = theirs[j][1]
                j += 1
            else:
                return True

    def tested(self, left: str, right: str) -> bool:
        """compatible(), remembered."""
        if self.n_pairs > PAIRS:
            for each in self.pairs.values():
                each.clear()
                each[""] = True
            self.n_pairs = 0
        self.n_pairs += 1
        got = self.pairs[right][left] = self.compatible(left, right)
        return got

    def move(self, read: str) -> tuple[str, tuple[tuple[str, int, dict[str, bool]], ...]]:
        """After a state and a character: the new state, which is the longest end that begins a piece, and the tokens that end there, longest first, with the pairs known of each."""
        state = read
        while state not in self.prefixes:
            state = state[1:]
        ends = [state[k:] for k in range(len(state))]
        tokens = tuple((t, len(t), self.pairs.setdefault(t, {"": True})) for t in ends if t in self.id and self.merging(t)[0])
        if len(self.moves) >= MOVES:
            self.moves.clear()
        got = self.moves[read] = (state, tokens)
        return got

    def tokens(self, text: str) -> list[str]:
        """Tokens of a chunk with a word mark at most at its start. A character that isn't in the vocabulary stays alone."""
        last = [""]  # a token may stand after the start
        moves, state, end = self.moves, "", 0
        for c in text:
            end += 1
            read = state + c
            state, tokens = moves.get(read) or self.move(read)
            for token, size, pairs in tokens:
                left = last[end - size]
                got = pairs.get(left)
                if got or got is None and self.tested(left, token):
                    last.append(token)
                    break
            else:
                last.append(c)
        out = []
        while end:
            token = last[end]
            out.append(token)
            end -= len(token)
        return out[::-1]

    def ids(self, chunk: str) -> list[int]:
        """Ids of word marks and the word after them."""
        word = chunk.lstrip(MARK)
        marks = len(chunk) - len(word)
        tokens = self.tokens(MARK + word if marks and word else word) if word else []
        if marks and word and tokens[0] != MARK:
            marks -= 1
        elif marks and word:
            tokens = tokens[1:]
        out = []
        while marks:
            run = next(n for n in self.runs if n <= marks)
            out.append(self.id[MARK * run])
            marks -= run
        for token in tokens:
            got = self.id.get(token)
            out += [got] if got is not None else [self.byte[b] for b in token.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the leading one goes, bytes join to characters and bad ones show as U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if kind == CONTROL:
                continue
            text = " ⁇ " if kind == UNKNOWN else self.shown[i]
            out.append(text[1:] if first and text[:1] == " " and kind == NORMAL else text)
            first = False
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def chunk(self, text: str) -> str:
        """Decimal ids of one chunk, which is remembered; so is its decoded text if that isn't the chunk with spaces for marks."""
        if text[1:2] != MARK:
            decimal = self.decimal
            try:  # pieces show as they are
                got = self.known[text] = " ".join([decimal[t] for t in self.tokens(text)])
                return got
            except KeyError:
                pass
        ids = self.ids(text)
        shown = self.decode([self.end, *ids]) if text[0] != MARK else " " + self.decode(ids)
        if shown != text.replace(MARK, " "):
            self.odd[text] = shown
        got = self.known[text] = " ".join(map(str, ids))
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return [self.end]
        return [i for c in CHUNK.findall(MARK + text.replace(" ", MARK)) for i in self.ids(c)] + [self.end]

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the decimal ids and of the decoded text, and the decimal ids."""
        if not text:
            return 1, _sha(str(self.end)), _sha(""), str(self.end)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
            self.odd.clear()
        known, slow = self.known.get, self.chunk
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        ids = " ".join([known(c) or slow(c) for c in chunks]) + f" {self.end}"
        shown = text.replace(MARK, " ")
        if self.odd:
            shown = "".join([self.odd[c] if c in self.odd else c.replace(MARK, " ") for c in chunks])[1:]
        return ids.count(" ") + 1, _sha(ids), _sha(shown), ids


#: Word marks and the characters up to the next mark.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace") if _valid(raw) else "".join(_pieces(raw))


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _pieces(raw: bytes) -> Iterator[str]:
    """Characters of bytes that aren't all UTF-8: every byte outside a character shows as U+FFFD."""
    at = 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            if _valid(raw[at : at + n]) and len(raw[at : at + n]) == n:
                yield raw[at : at + n].decode()
                at += n
                break
        else:
            yield "�"
            at += 1


def load(path: str) -> PieceModel:
    return PieceModel(model_bytes(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row of docs: its id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids (the end id last).

    Null and empty texts have the end id only. Repeated rows give repeated results. There is no shuffle; a task keeps one batch,
    the vocabulary and at most REMEMBERED chunks.
    """
    blob = frugal(docs.sparkSession).sparkContext.broadcast(model_bytes(path))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(blob.value)  # of one task: a worker that goes on to other work keeps none of it
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = list(zip(*map(model.digest, texts), strict=True)) or [(), (), (), ()]
            cols = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if ids:
                cols.append(pa.array([np.fromstring(r, dtype=np.int32, sep=" ") for r in rows[3]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
