"""SentencePiece encoding and decoding with a streaming Viterbi trellis.

The trellis has a node per character boundary.  Every piece that ends at a
boundary is a candidate; its score is the piece's rank in the model if it may
follow the best piece ending where it starts, and nothing otherwise: in a
merge model (BPE) a segmentation is the model's own exactly if every two
neighbouring pieces are what the model makes of their joined text, so at most
one path survives at each boundary.  Backpointers are kept for a window of the
longest piece only.  As soon as one boundary is on all surviving paths and no
piece can still reach across it, the ids before it are committed.

No piece of the model has its space mark after another character, so the paths
meet where a space mark follows another character, at the latest.  They also meet between characters that no
chain of neighbours within pieces connects, as between a word and the punctuation after it.  The text is streamed
in such parts; ids of parts met lately are remembered (bounded).  Characters that no piece
covers are encoded as bytes.

Null and empty texts have no ids.  Rows are independent; repeated rows get
equal results and other columns are not read.  Decoding restores every text
without the space mark U+2581 itself, which comes back as a space.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bound of the remembered pairs, which are emptied when full, and of the two tables of remembered parts.
#: Workers keep these tables for the stages that follow, so they are kept small.
REMEMBERED_PAIRS, REMEMBERED_PARTS = 500_000, 120_000


def part_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Parts of a text that no piece reaches across: characters of one group, with the space marks before them.

    Characters that stand side by side in a piece are of one group; one that stands beside no other is a part.
    """
    group: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in pairwise(piece.lstrip(SPACE)):
            one, two = sorted((group.setdefault(a, {a}), group.setdefault(b, {b})), key=len)
            if one is not two:
                two |= one
                group |= dict.fromkeys(one, two)
    groups = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
    runs = [f"[{re.escape(''.join(sorted(g)))}]+" for g in groups]
    return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+")


def automaton(pieces: dict[str, tuple]) -> list:
    """Start of the automaton (Aho-Corasick) that finds every piece ending at a character.

    A state is a beginning of pieces: states by the next character, the state of its longest end that begins a piece too,
    what is known of the pieces ending here, longest first, and its own size.
    """
    root: list = [{}, None, (), 0]
    for piece, known in pieces.items():
        node = root
        for size, c in enumerate(piece, 1):
            node = node[0].setdefault(c, [{}, root, (), size])
        node[2] = (known,)
    layer = [root]
    while layer:
        for node in layer:
            for c, state in node[0].items():
                shorter = node[1]
                while shorter and c not in shorter[0]:
                    shorter = shorter[1]
                state[1] = shorter[0][c] if shorter else root
                state[2] += state[1][2]
        layer = [state for node in layer for state in node[0].values()]
    return root


class Pieces:
    """A model's pieces and the streaming search."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.scores, self.bytes = {}, {}
        ids = {}
        for i, piece in enumerate(self.texts):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.scores[piece] = model.get_score(i)
                ids[piece] = i
        self.may_follow: dict[int, dict[int, bool]] = {i: {} for i in ids.values()}  # by piece: pieces before it
        self.pairs = 0  # remembered in these
        self.root, self.window = automaton({t: (i, len(t), self.may_follow[i]) for t, i in ids.items()}), 4 * max(map(len, ids))
        self.part = part_pattern(self.scores)
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.pieces = [byte_of.get(i, t.encode()) for i, t in enumerate(self.texts)]
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the last full table; what is met again comes back from it

    def merged(self, text: str) -> list[str]:
        """What the model makes of a short text: join the best-scored neighbours, leftmost first."""
        score, none = self.scores.get, float("-inf")
        parts = list(text)
        scores = [score(a + b, none) for a, b in pairwise(parts)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def _text(self, piece: int) -> str:
        """Text of a piece; characters outside the model have negative ids, 0 is the start."""
        return "" if piece == 0 else self.texts[piece] if piece > 0 else chr(-piece - 1)

    def follows(self, a: int | None, b: int) -> bool:
        """Whether piece b may follow piece a."""
        if a is None:
            return False
        first, second = self._text(a), self._text(b)
        known = self.merged(first + second) == ([first, second] if first else [second])
        if self.pairs >= REMEMBERED_PAIRS:
            for pieces in self.may_follow.values():
                pieces.clear()
            self.pairs = 0
        if b > 0:
            self.may_follow[b][a] = known
            self.pairs += 1
        return known

    def stream(self, characters: str) -> Iterator[list[int]]:
        """Pieces of a part, committed as the paths meet; ``best`` starts at the last commit."""
        root = state = self.root
        best, sizes = [0], [0]  # last piece of the path that survives at each boundary, and its size; None if none survives
        at, full = 0, self.window
        for c in characters:
            while (node := state[0].get(c)) is None and state is not root:
                state = state[1]
            state = node or root
            at += 1
            for b, size, may_follow in state[2]:
                a = best[at - size]
                known = may_follow.get(a)
                if known if known is not None else self.follows(a, b):
                    best.append(b)
                    sizes.append(size)
                    break
            else:
                b = -1 - ord(c)  # to be encoded as bytes
                best.append(b if c not in self.scores and self.follows(best[at - 1], b) else None)
                sizes.append(1)
            if at >= full:
                # Pieces can still start from these boundaries; where their paths meet is on every path that can be made.
                meet = at
                for k in range(at - state[3], at):
                    while best[k] is not None and meet != k:
                        if meet > k:
                            meet -= sizes[meet]
                        else:
                            k -= sizes[k]
                if meet:
                    yield self._way(best, sizes, meet)
                    best, sizes, at = best[meet:], sizes[meet:], at - meet
                full = at + self.window
        if at:
            yield self._way(best, sizes, at)

    @staticmethod
    def _way(best: list[int | None], sizes: list[int], end: int) -> list[int]:
        """Pieces of the path that survives at a boundary, from the last commit on."""
        way = []
        while end:
            way.append(best[end])
            end -= sizes[end]
        way.reverse()
        return way

    def encode_part(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit numbers."""
        known = self.older.get(part)
        if known is None:
            out = []
            for way in self.stream(part):
                if min(way) > 0:
                    out += way
                    continue
                for piece in way:
                    out += [piece] if piece > 0 else [self.bytes[b] for b in chr(-piece - 1).encode("utf-8", "surrogatepass")]
            known = struct.pack(f"<{len(out)}i", *out)
        if len(part) <= 64:
            if len(self.parts) >= REMEMBERED_PARTS:
                self.older, self.parts = self.parts, {}
            self.parts[part] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: a space mark is put before it and for every space."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        get, encode = self.parts.get, self.encode_part
        parts = self.part.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join([get(p) or encode(p) for p in parts]), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        return out.decode("utf-8", "replace").replace(SPACE, " ")[1:]


_loaded: dict[str, Pieces] = {}


def pieces(path: str = MODEL) -> Pieces:
    """The model of this worker, read once."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, n_ids, restored`` per row; ``restored``: decoding gives the text again."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [model.encode(t) for t in texts]
                same = [model.decode(i) == t for i, t in zip(ids, texts)]
                sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "restored"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>, n_ids int, restored boolean")
