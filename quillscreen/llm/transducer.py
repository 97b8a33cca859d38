"""A weighted finite-state transducer for SentencePiece models.

Three machines are compiled from a model. The normaliser rewrites the longest prefix that the model's character map knows, squeezes spaces
where the model asks for it, writes the dummy prefix and turns each space into U+2581. The piece machine is a trie whose final states emit a piece;
its arcs cost minus the piece's score in a unigram model. The byte machine reads any one character and emits the byte pieces of its UTF-8
form, at a cost beyond any path of pieces. Their union is composed with each input, and the shortest path in the tropical semiring (min, +) is
taken; every arc leads forward, so one pass over the positions finds it.

A BPE model merges the best-ranked neighbours first, which no weight of single pieces can say. Its result is still recognised by a finite
automaton over pieces, since merging inside a span is never influenced by the text around it until something merges across the span's edge:
a sequence of pieces is the model's result if and only if each piece alone and each pair of neighbours is its own result. The composition
then keeps, for every state (position, last piece), only arcs with an admissible pair, each at cost one. All states reached at a position have the
same last piece, that of the position's own result, so a position is a state, and its distance is settled when a later one asks for it.

Input is cut where no piece can reach across: before a U+2581 that follows another character, provided no piece holds one
there. Each distinct chunk is composed once per cache; the cache is bounded, and dropping it changes no result.

Not compiled, and refused with an error: models of words or characters, spaces as suffixes, user-defined and unused pieces.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Byte b is shown as the lone surrogate LOW + b.
LOW = 0xDC00
BYTES = re.compile("[\udc00-\udcff]+")
#: Chunks in each of a worker's two generations; the young one becomes the old one when full, so frequent chunks stay; and pairs.
CACHE, PAIRS = 200_000, 400_000


class CharsMap:
    """The normaliser's map from strings to strings: a double-array trie over UTF-8 bytes, as the model format stores it.

    A unit holds its label in the low byte (with bit 31), whether a value hangs below it in bit 8, and the offset of its children from bit 10 on,
    shifted by eight where bit 9 is set.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = array("I", blob[4 : 4 + size])
        if sys.byteorder == "big":
            self.units.byteswap()
        self.strings = blob[4 + size :]
        # Printable characters that stand for themselves, unless a mark follows that could join them.
        self.plain = re.compile("[" + "".join(re.escape(chr(c)) for c in range(33, 127) if self.prefix(bytes([c]), 0) in ((1, chr(c)), (0, ""))) + "]+(?=[!-~ ]|$)")

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def prefix(self, data: bytes, at: int) -> tuple[int, str]:
        """Bytes read and their rewriting for the longest known prefix of ``data[at:]``; (0, '') if there is none."""
        units, node, found, value = self.units, 0, 0, 0
        unit = units[0]
        node ^= self._offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return 0, ""
        return found, self.strings[value : self.strings.index(0, value)].decode()

    def rewrite(self, text: str) -> str:
        out, i, data, at = [], 0, text.encode(), 0
        while i < len(text):
            if m := self.plain.match(text, i):
                out.append(m[0])
                i, at = m.end(), at + len(m[0])
                continue
            n, to = self.prefix(data, at)
            if not n:
                to = text[i]
                n = len(to.encode())
            i += len(data[at : at + n].decode())
            at += n
            out.append(to)
        return "".join(out)


class Transducer:
    """Compiled form of a model; plain dictionaries, so it travels with a task."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        norm = m.normalizer_spec
        self.chars = CharsMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.squeeze, self.space = norm.remove_extra_whitespaces, SPACE if norm.escape_whitespaces else " "
        if m.trainer_spec.model_type not in (UNIGRAM, BPE) or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with a prefix for spaces are compiled")
        if any(p.type in (USER, UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.dummy_prefix, self.bpe = norm.add_dummy_prefix, m.trainer_spec.model_type == BPE
        self.pieces = [p.piece for p in m.pieces]
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == UNKNOWN), 0)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE} if m.trainer_spec.byte_fallback else {}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, p in enumerate(m.pieces) if p.type == CONTROL}
        self.trie, self.back = self._trie(False), self._trie(True)
        # Byte pieces decode to lone surrogates, which no text holds, and runs of those to UTF-8.
        self.shown = [m.trainer_spec.unk_surface if i == self.unknown else "" if i in self.silent else chr(LOW + self.id_bytes[i]) if i in self.id_bytes else p for i, p in enumerate(self.pieces)]
        s = self.space
        self.cut = re.compile(f"{s}*[^{s}]+|{s}+") if not any(s in p.lstrip(s) for p in self.ids) else re.compile("(?s).+")
        worst = min(self.score.values(), default=0.0)
        self.miss = 10.0 - worst
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.old_chunks: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def _trie(self, backward: bool) -> dict:
        """Nodes by the first (or last) character; a node is [piece that ends (or begins) here or None, next nodes]."""
        root: dict = {}
        for piece in self.ids:
            nodes, node = root, None
            for c in reversed(piece) if backward else piece:
                node = nodes.setdefault(c, [None, {}])
                nodes = node[1]
            node[0] = piece
        return root

    def normalise(self, text: str) -> str:
        """The normaliser's output; a text without characters that count stays empty."""
        if self.chars:
            text = self.chars.rewrite(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", self.space)

    def merged(self, text: str) -> list[str]:
        """Greedy merges of a short text: the definition that decides which pairs are admissible."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a`` ('' at the start); asked once per pair and cache, which encode() empties between texts."""
        self.n_pairs += 1
        known = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def compose(self, chunk: str) -> list[str]:
        """Labels of the shortest path through the composition with ``chunk``: pieces, and characters left to the byte machine.

        Positions are settled from left to right; an arc relaxes the position it leads to.
        """
        n = len(chunk)
        last = self._settle_pairs(chunk, n) if self.bpe else self._settle_scores(chunk, n)
        out, e = [], n
        while e:
            piece = last[e]
            out.append(piece)
            e -= len(piece)
        return out[::-1]

    def _settle_scores(self, chunk: str, n: int) -> list[str]:
        """The last piece of the cheapest path to each position; an arc costs minus the score of its piece."""
        inf, root, ids, score, miss = float("inf"), self.trie, self.ids, self.score, self.miss
        cost, last = [0.0] + [inf] * n, [""] * (n + 1)
        for s in range(n):
            base = cost[s]
            if base == inf:
                continue
            if chunk[s] not in ids and base + miss < cost[s + 1]:
                cost[s + 1], last[s + 1] = base + miss, chunk[s]
            after, e = root, s
            while e < n and (node := after.get(chunk[e])):
                piece, after = node
                e += 1
                if piece is not None and base - score[piece] < cost[e]:
                    cost[e], last[e] = base - score[piece], piece
        return last

    def _settle_pairs(self, chunk: str, n: int) -> list[str]:
        """The same where an arc costs one and must be admissible after the last piece of the position it leaves.

        Distances are settled on demand, from the end: a position asks for those its arcs leave, the longest arc first. One piece alone can
        end at a position, so the first admissible arc gives its distance, and most positions are never asked for.
        """
        root, ids, pairs, ask = self.back, self.ids, self.pairs, self.admissible
        last: list = [None] * (n + 1)
        last[0], e, waiting, arcs = "", n, [], None
        while True:
            if arcs is None:
                after, at, arcs = root, e - 1, []
                if chunk[at] not in ids:
                    arcs.append(chunk[at])
                while at >= 0 and (node := after.get(chunk[at])) is not None:
                    piece, after = node
                    at -= 1
                    if piece is not None:
                        arcs.append(piece)
            while True:
                piece = arcs[-1]
                before = last[e - len(piece)]
                if before is None:
                    waiting.append((e, arcs))
                    e, arcs = e - len(piece), None
                    break
                known = pairs.get(before)
                ok = None if known is None else known.get(piece)
                if ask(before, piece) if ok is None else ok:
                    last[e] = piece
                    if not waiting:
                        return last
                    e, arcs = waiting.pop()
                    break
                arcs.pop()

    def emit(self, labels: list[str]) -> tuple[int, ...]:
        """Ids of the pieces; a character that is none becomes its bytes, or, with its like beside it, one unknown piece where the model has no bytes."""
        ids = tuple(map(self.ids.get, labels))
        if None not in ids:
            return ids
        out: list[int] = []
        for i, label in zip(ids, labels, strict=True):
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in label.encode()]
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.n_pairs >= PAIRS:
            self.pairs, self.n_pairs = {}, 0
        young = self.chunks
        for chunk in self.cut.findall(self.normalise(text)):
            ids = young.get(chunk)
            if ids is None:
                ids = self.old_chunks.get(chunk) or self.emit(self.compose(chunk))
                if len(chunk) <= 64:
                    if len(young) >= CACHE:
                        self.old_chunks, self.chunks = young, {}
                        young = self.chunks
                    young[chunk] = ids
            if ids[0] == self.unknown and out[-1:] == [self.unknown]:
                ids = ids[1:]
            out += ids
        return out

    def forget(self) -> None:
        """Empty the memory of chunks and pairs; workers idle on after a task and would hold it."""
        self.chunks, self.old_chunks, self.pairs, self.n_pairs = {}, {}, {}, 0

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse: runs of byte pieces are read as UTF-8, spaces restored, the dummy prefix dropped."""
        return self.finish("".join(map(self.shown.__getitem__, ids)))

    def finish(self, shown: str) -> str:
        text = BYTES.sub(lambda m: bytes(ord(c) - LOW for c in m[0]).decode("utf-8", "replace"), shown)
        if (self.dummy_prefix or self.squeeze) and text.startswith(self.space):
            text = text[1:]
        return text.replace(SPACE, " ")
