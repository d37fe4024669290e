"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is a lattice of the vocabulary's pieces over its UTF-8 bytes, after a dummy space in front. Forward Viterbi
scores of its prefixes are exact heuristics for an A* search that runs backward from the end, so that whole
segmentations leave the heap in order of score (``nbest``).

No piece spans a pair of bytes that occurs in no piece, so a text falls into segments there, and a segmentation of the
text is one of each segment. The best two scores of all distinct segments of a block come from one forward pass over
all of them at once; the N best segmentations of a text change only the N - 1 segments where a change
costs least, and A* runs on these alone.

A character without a piece of its own is spelled in byte pieces, so decoding restores every text exactly, the sign
U+2581 included. The vocabulary is a file of a public tokenizer and is never trained; its rows, a fixed number, go to
the tasks with the function.
"""

from __future__ import annotations

import array
import functools
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import BYTE_BASE, BYTE_CODES, blocks, mixed, powers, text_bytes
from loamwork.sources.tables import table

N_BEST = 4
#: Bytes of a segment beyond which it goes by itself, and what scores are multiples of, so that sums are exact.
LONG, UNIT = 512, 2.0**-16
SLOT_BITS, SLOT_FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose distinct segments are looked up together.
ENCODE_BYTES = 1 << 20
RESULT = "doc_id long, n_pieces int, score double, ids array<int>, nbest_scores array<double>, alternatives array<array<struct<at:int,drop:int,ids:array<int>>>>, round_trip boolean"


class Vocabulary(NamedTuple):
    """``pieces``: bytes by id, the word mark as a space. ``byte_ids``: the byte pieces. ``fallback``: score of such a byte."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    fallback: float


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file that has byte pieces; by default the 32k one of the public set."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    bytes_at, pieces = np.full(256, -1, np.int32), []
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        pieces.append(piece.replace("▁", " ").encode() if plain else b"")
    if (bytes_at < 0).any():
        raise ValueError(f"{path} lacks byte pieces")
    scores = np.array([model.get_score(i) for i in range(size)], np.float64)
    plain_scores = scores[[bool(p) for p in pieces]]
    return Vocabulary(tuple(pieces), scores, bytes_at, float(plain_scores[plain_scores > -1e8].min()) - 10.0)


class Lattice:
    """Lookups of a vocabulary that the passes need, built once a Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.sizes = sorted({len(p) for p in self.ids})
        self.widths = self.sizes[::-1]
        self.scores = np.round(vocabulary.scores / UNIT) * UNIT
        self.costs, self.fallback = self.scores.tolist(), round(vocabulary.fallback / UNIT) * UNIT
        joined = np.zeros((256, 256), bool)
        for p in self.ids:
            for a, b in zip(p[:-1], p[1:], strict=True):
                joined[a, b] = True
        self.joined = joined.ravel()
        known, hashes = list(self.ids), np.zeros(len(self.ids), np.uint64)
        for k, p in enumerate(known):
            b = np.frombuffer(p, np.uint8)
            hashes[k] = (BYTE_CODES[b] * powers(BYTE_BASE, len(b))[0][: len(b)]).sum()
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], np.array([self.ids[known[k]] for k in order], np.int32)
        slot = ((self.hashes * SLOT_FACTOR) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        clash = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.slots[clash] = -2  # found by bisection instead
        self.flat = np.frombuffer(b"".join(p if p else b"" for p in self.spelled()), np.uint8)
        sizes = np.array([len(p) for p in self.spelled()], np.int64)
        self.piece_size, self.piece_at = sizes, np.cumsum(sizes) - sizes
        self.remembered = functools.lru_cache(1 << 16)(self._nbest)

    def spelled(self) -> list[bytes]:
        out = list(self.v.pieces)
        for b, i in enumerate(self.v.byte_ids):
            out[i] = bytes([b])
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces with these hashes, -1 where there is none."""
        k = self.slots[((hashes * SLOT_FACTOR) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        if (k == -2).any():
            at = np.flatnonzero(k == -2)
            k[at] = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = (k >= 0) & (self.hashes[np.maximum(k, 0)] == hashes)
        return np.where(hit, self.by_hash[np.maximum(k, 0)], -1)

    def spelled_out(self, segment: bytes) -> bytearray:
        """For each byte of the segment, whether it belongs to a character without a piece of its own."""
        size_of = lambda b: 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        out, i = bytearray(len(segment)), 0
        while i < len(segment):
            n = size_of(segment[i]) if segment[i] >= 0xC0 or segment[i] < 0x80 else 1
            if segment[i : i + n] not in self.ids:
                out[i : i + n] = b"\1" * len(segment[i : i + n])
            i += n
        return out

    def edges_at(self, segment: bytes, spell: bytearray, end: int) -> list[tuple[int, float, int]]:
        """(start, score, id) of the lattice's edges that end there, the longest first."""
        out = []
        for width in self.widths:
            if width <= end:
                piece = self.ids.get(segment[end - width : end])
                if piece is not None:
                    out.append((end - width, self.costs[piece], piece))
        if spell[end - 1]:
            out.append((end - 1, self.fallback, int(self.v.byte_ids[segment[end - 1]])))
        return out

    def edges(self, segment: bytes) -> list[list[tuple[int, float, int]]]:
        spell = self.spelled_out(segment)
        return [[], *(self.edges_at(segment, spell, end) for end in range(1, len(segment) + 1))]

    def forward(self, segment: bytes) -> tuple[list[float], list[float], array.array, array.array]:
        """For each place in the segment: best and second-best score of its prefix, and the best one's last width and piece."""
        n, spell, lost = len(segment), self.spelled_out(segment), float("-inf")
        best, second = array.array("d", [lost]) * (n + 1), array.array("d", [lost]) * (n + 1)
        width, taken = array.array("i", [0]) * (n + 1), array.array("i", [0]) * (n + 1)
        best[0] = 0.0
        for end in range(1, n + 1):
            one = two = lost
            for start, score, piece in self.edges_at(segment, spell, end):
                s, t = best[start] + score, second[start] + score
                if s > one:
                    one, two, width[end], taken[end] = s, max(one, t), end - start, piece
                else:
                    two = max(two, s, t)
                two = max(two, t)
            best[end], second[end] = one, two
        return best, second, width, taken

    def _nbest(self, segment: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations as (score, ids), best first.

        Scores are exact multiples of ``UNIT``, so the forward score of a prefix and the cost behind it add up to the
        same total all along a path. Of equal totals the search follows the one that is nearest to the beginning, so a
        segmentation costs a step a piece, however many are as good; a path is a chain of back-pointers.
        """
        spell, forward, count = self.spelled_out(segment), self.forward(segment)[0], 0
        heap: list[tuple] = [(-forward[-1], len(segment), 0, 0.0, None)]
        found = []
        while heap and len(found) < n:
            _, end, _, behind, path = heapq.heappop(heap)
            if end == 0:
                ids = []
                while path is not None:
                    piece, path = path
                    ids.append(piece)
                found.append((behind, tuple(ids)))
                continue
            for start, score, piece in self.edges_at(segment, spell, end):
                if forward[start] > float("-inf"):
                    count += 1
                    heapq.heappush(heap, (-(forward[start] + score + behind), start, count, behind + score, (piece, path)))
        return found

    def nbest(self, segment: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return self._nbest(segment, n) if len(segment) > LONG else self.remembered(segment, n)

    def segments(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the segments of the rows whose bytes, dummy space first, lie between the offsets."""
        cut = np.ones(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = ~self.joined[data[:-1].astype(np.int32) * 256 + data[1:]]
        cut[at] = True
        edge = np.flatnonzero(cut)
        return edge[:-1], edge[1:]

    def viterbi(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best and second-best score of each segment of ``data``, and the best one's piece ids, with their numbers.

        Segments of more than ``LONG`` bytes go one by one, in time proportional to their length; all others together.
        """
        long = np.flatnonzero(size > LONG)
        if not len(long):
            return self.viterbi_together(data, size)
        begin, short = np.cumsum(size) - size, np.flatnonzero(size <= LONG)
        best, second, count, ids = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), np.int64), [np.zeros(0, np.int32)] * len(size)
        best[short], second[short], some, count[short] = self.viterbi_together(spread(data, begin[short], size[short]), size[short])
        for i, part in zip(short.tolist(), np.split(some, np.cumsum(count[short])[:-1]), strict=True) if len(short) else ():
            ids[i] = part
        for i in long.tolist():
            one, two, width, taken = self.forward(data[begin[i] : begin[i] + size[i]].tobytes())
            best[i], second[i], end, back = one[-1], two[-1], int(size[i]), []
            while end:
                back.append(taken[end])
                end -= width[end]
            ids[i], count[i] = np.array(back[::-1], np.int32), len(back)
        return best, second, np.concatenate(ids), count

    def viterbi_together(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``viterbi`` of all segments at once.

        Nodes are the places between bytes, ``size + 1`` a segment. Edges go by their place within their segment and
        their length, so that no two of a group meet and all segments advance together.
        """
        n, begin = len(size), np.cumsum(size) - size
        segment = np.repeat(np.arange(n), size)
        within = np.arange(len(data)) - begin[segment]
        left = size[segment] - within
        up, down = powers(BYTE_BASE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
        lead = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)[data]
        spell = np.ones(len(data), bool)  # bytes of characters without a piece of their own
        places, widths, pieces, scores = [], [], [], []
        for width in self.sizes:
            at = np.flatnonzero(left >= width)
            found = self.find((sums[at + width] - sums[at]) * down[at])
            hit = found >= 0
            at, found = at[hit], found[hit]
            places.append(at)
            widths.append(np.full(len(at), width, np.int32))
            pieces.append(found)
            scores.append(self.scores[found])
            if width <= 4:
                alone = at[lead[at] == width]
                for j in range(width):
                    spell[alone + j] = False
        at = np.flatnonzero(spell)
        place, width = np.concatenate([*places, at]), np.concatenate([*widths, np.ones(len(at), np.int32)])
        piece = np.concatenate([*pieces, self.v.byte_ids[data[at]]])
        score = np.concatenate([*scores, np.full(len(at), self.fallback)])
        key = (within[place] + width) * 64 + (63 - np.minimum(width, 63))
        order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        place, width, piece, score, key = place[order], width[order], piece[order], score[order], key[order]
        source = place + segment[place]
        target = source + width
        nodes = len(data) + n
        best, second = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        back, taken = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
        best[begin + np.arange(n)] = 0
        bounds = np.flatnonzero(np.diff(key, prepend=-1, append=-1)) if len(key) else np.zeros(0, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            to = target[a:b]
            one, two, old = best[source[a:b]] + score[a:b], second[source[a:b]] + score[a:b], best[to]
            second[to] = np.maximum(np.maximum(second[to], two), np.minimum(one, old))
            better = one > old
            to, at = to[better], np.flatnonzero(better) + a
            best[to], back[to], taken[to] = one[better], width[at], piece[at]
        last = begin + np.arange(n) + size
        steps, count, node, live = [], np.zeros(n, np.int64), last.copy(), np.flatnonzero(size > 0)
        while len(live):
            steps.append((live, count[live].copy(), taken[node[live]]))
            count[live] += 1
            node[live] -= back[node[live]]
            live = live[node[live] > begin[live] + live]
        ids, first = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
        for some, nth, piece_ids in steps:
            ids[first[some] + count[some] - 1 - nth] = piece_ids
        return best[last], second[last], ids, count

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces without the dummy space."""
        ids = np.asarray(ids, np.int64)
        return spread(self.flat, self.piece_at[ids], self.piece_size[ids]).tobytes()[1:]


def spread(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    total = int(sizes.sum())
    index = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    return pool[index]


def cheapest(options: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` cheapest ways to choose one cost of each list, as (sum, choices)."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for costs in options:
        out = sorted([(c + cost, (*chosen, k)) for c, chosen in out for k, cost in enumerate(costs)])[:n]
    return out


def encode_block(lattice: Lattice, texts: pa.Array, n: int = N_BEST) -> list:
    """Columns of RESULT after doc_id for a block of texts."""
    raw, at = text_bytes(texts)
    rows, lengths = len(at) - 1, np.diff(at)
    some = np.flatnonzero(lengths > 0)
    data = np.full(len(raw) + len(some), 0x20, np.uint8)
    shift = np.zeros(rows, np.int64)
    shift[some] = 1
    begins = at[:-1] + np.cumsum(shift) - shift
    keep = np.ones(len(data), bool)
    keep[begins[some]] = False
    data[keep] = raw
    edges = np.append(begins, len(data))
    starts, ends = lattice.segments(data, edges) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    up, down = powers(BYTE_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    key = mixed((sums[ends] - sums[starts]) * down[starts]) ^ mixed((ends - starts).astype(np.uint64))
    _, sample, code = np.unique(key, return_index=True, return_inverse=True)
    size = (ends - starts)[sample]
    best, second, pieces, count = lattice.viterbi(spread(data, starts[sample], size), size)
    ids_at = np.cumsum(count) - count
    flat = spread(pieces, ids_at[code], count[code])
    first = np.searchsorted(starts, edges)  # by row: its first segment
    upto = np.concatenate([[0], np.cumsum(count[code])])
    offsets = upto[first]
    gap = (best - second)[code]
    scores, nbest, others = [], [], []
    for r in range(rows):
        a, b = int(first[r]), int(first[r + 1])
        score = float(np.round(best[code[a:b]].sum(), 6)) if b > a else 0.0
        scores.append(score)
        open_ = a + np.argpartition(gap[a:b], min(n - 2, b - a - 1))[: n - 1] if b > a and n > 1 else np.zeros(0, np.int64)
        open_ = sorted(int(j) for j in open_ if np.isfinite(gap[j]))
        options, found = [], []
        for j in open_:
            segment = data[starts[j] : ends[j]].tobytes()
            chosen = tuple(pieces[ids_at[code[j]] : ids_at[code[j]] + count[code[j]]].tolist())
            rest = [x for x in lattice.nbest(segment, n) if x[1] != chosen][: n - 1]
            found.append([(0.0, chosen), *rest])
            options.append([0.0, *(float(best[code[j]]) - s for s, _ in rest)])
        ranked = cheapest(options, n)
        nbest.append([score - cost for cost, _ in ranked])
        others.append([[{"at": int(upto[open_[k]] - offsets[r]), "drop": int(count[code[open_[k]]]), "ids": list(found[k][c][1])} for k, c in enumerate(choices) if c] for _, choices in ranked[1:]])
    restored = spread(lattice.flat, lattice.piece_at[flat], lattice.piece_size[flat])
    restored_at = np.concatenate([[0], np.cumsum(lattice.piece_size[flat])])[offsets]
    same = [np.array_equal(restored[restored_at[r] : restored_at[r + 1]], data[edges[r] : edges[r + 1]]) for r in range(rows)]
    null = np.array(texts.is_null().to_pylist(), bool)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    if null.any():
        lists = pa.array([None if x else y for x, y in zip(null, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
    kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))
    return [pa.array(np.diff(offsets), pa.int32()), pa.array(scores), lists, pa.array(nbest, pa.list_(pa.float64())), pa.array(others, kind), pa.array(same, pa.bool_())]


@functools.lru_cache(2)
def _lattice(pieces: tuple[bytes, ...], scores: bytes, byte_ids: bytes, fallback: float) -> Lattice:
    return Lattice(Vocabulary(pieces, np.frombuffer(scores, np.float64), np.frombuffer(byte_ids, np.int32), fallback))


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's best segmentation and up to ``n`` best scores, with the alternatives as edits of the best.

    ``ids`` is the best; ``alternatives[k]`` says which pieces differ in the (k + 2)-nd best; ``round_trip`` whether
    decoding ``ids`` gives the text. A null text has null ids, an empty one no pieces; both score 0. Among equal scores
    the best one takes the longest last piece; which of equal alternatives come is fixed by the search. Rows are encoded
    each for itself, whole, in time proportional to their length, so repeated rows get equal pieces; other columns are
    left out, and an empty table gives no rows.
    """
    v = vocabulary or load_vocabulary()
    packed = (v.pieces, v.scores.tobytes(), v.byte_ids.tobytes(), v.fallback)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*packed)
        for block in blocks(batches, "text", ENCODE_BYTES):
            yield pa.record_batch([block.column("doc_id"), *encode_block(lattice, block.column("text"), n)], names=[x.split()[0] for x in RESULT.replace("<at:int,drop:int,ids:array<int>>", "").split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, RESULT)


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The alternative segmentation that ``edits`` of the best one describe."""
    out, behind = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += [*ids[behind : e["at"]], *e["ids"]]
        behind = e["at"] + e["drop"]
    return [*out, *ids[behind:]]


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    v = vocabulary or load_vocabulary()
    packed = (v.pieces, v.scores.tobytes(), v.byte_ids.tobytes(), v.fallback)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*packed)
        for batch in batches:
            texts = [None if x is None else lattice.decode(np.array(x, np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(decoded, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
