"""SentencePiece encoding by sampled segmentation, and decoding.

A text is one space and the text itself, spaces written as U+2581. Pieces hold that sign only at
their start, so no piece crosses from a word into the next space and the lattice of a text falls
apart into those of its chunks (spaces and the word after them). Per distinct chunk the lattice
is built once: all pieces at all places, with weight exp(alpha * log probability). A worker keeps
the lattices from batch to batch, the most used ones where they would be more than HELD_EDGES.
Forward filtering sums the weights of all segmentations of every prefix; backward sampling
draws the last piece of a prefix in proportion to its share and goes on from that piece's start.
So every segmentation comes out with its exact probability. The draws are a counter-based hash
of seed, row key and character position, shares are cut into whole numbers chunk by chunk: they
do not depend on batches, tasks or retries.

The pieces of a unigram model bring their log probabilities. Those of a BPE model only have an
order, so they get Zipf's law over it. Characters without a piece, and U+2581 itself, become
byte pieces, so decoding gives back every text exactly.

Defined cases: a null text has null pieces; an empty text has none. The row key is doc_id, for
rows without one a hash of the text; repeated rows get the same pieces. Very long chunks are
filtered by the same recursion in running scale.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain, compress, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed
from .hashing import splitmix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 1
SPACE_SIGN = "▁"
BATCH_CHARS = 2_000_000
HELD_EDGES = 5_000_000
CHUNKS_AT_ONCE = 8192
DRAW_BITS = 26
DRAWS = 1 << DRAW_BITS
SHORT = 64
PREFIX = -2
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = 0x9FB21C651E98DF25
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a position-weighted hash and the factors that undo the position."""
    power = np.full(len(points) + 1, _BASE, _U)
    undo = np.full(len(points) + 1, _BASE_INVERSE, _U)
    power[0] = undo[0] = 1
    power, undo = np.multiply.accumulate(power), np.multiply.accumulate(undo)
    sums = np.zeros(len(points) + 1, _U)
    np.cumsum(splitmix(points.astype(_U) + _STEP) * power[:-1], out=sums[1:])
    return sums, undo


@dataclass
class Vocabulary:
    """Piece texts with weights, and the ids of the byte pieces."""

    texts: list[str]
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    sounds: list[bytes]  # by id, what the piece decodes to

    def __post_init__(self):
        self.held: Lattices | None = None  # a worker's, for the batches it gets
        self.sound = np.frombuffer(b"".join(self.sounds), np.uint8)
        self.sound_at = np.concatenate([[0], np.cumsum(list(map(len, self.sounds)))])
        self.longest = max(map(len, self.texts))
        self.single = {t for t in self.texts if len(t) == 1}
        self.by_text = dict(zip(self.texts, range(len(self.texts))))
        # Beginnings of pieces are held too, so that a search ends where no piece goes on.
        held = {t[:n]: PREFIX for t in self.texts for n in range(1, len(t))} | self.by_text
        slots = 1 << (2 * len(held)).bit_length()
        self.low = _U(slots - 1)
        self.keys, self.at = np.zeros(slots, _U), np.zeros(slots, np.int32)
        for text, k in held.items():
            key = self.hash(text)
            slot = key & (slots - 1)
            while self.keys[slot]:
                slot = (slot + 1) & (slots - 1)
            self.keys[slot], self.at[slot] = key, k

    @staticmethod
    def hash(text: str) -> int:
        sums, _ = _prefix_sums(_points(text))
        return int(splitmix(sums[-1:] + _U(len(text)))[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each key, PREFIX if pieces only begin like that, -1 if none does."""
        slot = keys & self.low
        held = self.keys[slot]
        hit = held == keys
        out = np.where(hit, self.at[slot], np.int32(-1))
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            slot[left] = (slot[left] + _U(1)) & self.low
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out


def vocabulary(model_file: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in plain])
    order = np.empty(len(plain))
    order[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
    # Whole-number scores are places in an order, not log probabilities.
    logs = -np.log(order + 2.0) if np.all(scores == np.round(scores)) else scores.astype(float)
    logs = logs - np.log(np.exp(logs - logs.max()).sum()) - logs.max()
    byte_ids = np.zeros(256, np.int32)
    sounds = [b""] * size
    for i in range(size):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value], sounds[i] = i, bytes([value])
    texts = [model.id_to_piece(i) for i in plain]
    for i, t in zip(plain, texts):
        sounds[i] = t.replace(SPACE_SIGN, " ").encode()
    return Vocabulary(texts, np.array(plain, np.int32), np.exp(alpha * logs), byte_ids, sounds)


class Lattices:
    """Filtered lattices of distinct chunks, each the text after its first space, kept from batch to batch.

    Chunk c has places ``first[c]`` to ``first[c] + size[c]`` and edges ``edge[c]`` up to ``edge[c + 1]``, sorted by
    the place they end at; ``top`` is the last edge of a place. Edge e is drawn by numbers from ``low[e]`` up to that
    of the next edge of the place (out of ``DRAWS``), and begins ``back[e]`` characters earlier. Its ``piece`` is an
    id, or ``-1 - c`` for the bytes of character c. A chunk's numbers do not depend on the others.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.numbers: dict[str, int] = {}
        self.first, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edge, self.top = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.low, self.back, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.int32)

    def codes(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; new ones are filtered, or all but the frequent ones dropped before."""
        if len(self.low) > HELD_EDGES:
            self._thin_out()
        if "\0" in " ".join(chunks):  # factorize takes texts that differ after a NUL for equal
            numbers = dict(zip(dict.fromkeys(chunks), count()))
            which, texts = np.fromiter(map(numbers.__getitem__, chunks), np.int64, len(chunks)), np.array(list(numbers), dtype=object)
        else:
            which, texts = pd.factorize(np.array(chunks, dtype=object))
        codes = np.fromiter(map(self.numbers.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = texts[missing].tolist()
            self._add([filtered(new[k : k + CHUNKS_AT_ONCE], self.vocab) for k in range(0, len(new), CHUNKS_AT_ONCE)])
            codes[missing] = np.arange(len(self.numbers), len(self.size))
            self.numbers.update(zip(new, codes[missing].tolist()))
        codes = codes[which]
        self.used += np.bincount(codes, minlength=len(self.used))
        return codes

    def _add(self, parts: list[Lattices]) -> None:
        places, edges = len(self.top), len(self.low)
        first, edge, top = [self.first], [self.edge], [self.top]
        for part in parts:
            first.append(part.first + places)
            edge.append(part.edge[1:] + edges)
            top.append(part.top + np.int32(edges))
            places, edges = places + len(part.top), edges + len(part.low)
        self.first, self.edge, self.top = np.concatenate(first), np.concatenate(edge), np.concatenate(top)
        for name in ("size", "used", "low", "back", "piece"):
            setattr(self, name, np.concatenate([getattr(x, name) for x in [self, *parts]]))

    def _thin_out(self) -> None:
        """Keeps the chunks used most often, up to half of HELD_EDGES, none that was used once."""
        edges = np.diff(self.edge)
        order = np.argsort(-self.used, kind="stable")
        keep = np.zeros(len(order), bool)
        keep[order[np.cumsum(edges[order]) <= HELD_EDGES // 2]] = True
        keep &= self.used > 1
        of_edge, of_place = np.repeat(keep, edges), np.repeat(keep, self.size + 1)
        moved = self.edge[:-1][keep]
        self.numbers = dict(zip(compress(self.numbers, keep.tolist()), range(len(moved))))
        self.size, self.used = self.size[keep], self.used[keep] // 2
        self.first = np.cumsum(self.size + 1) - self.size - 1
        self.edge = np.concatenate([[0], np.cumsum(edges[keep])])
        self.top = self.top[of_place] - np.repeat(moved - self.edge[:-1], self.size + 1).astype(np.int32)
        self.low, self.back, self.piece = self.low[of_edge], self.back[of_edge], self.piece[of_edge]


def filtered(chunks: list[str], vocab: Vocabulary) -> Lattices:
    """Forward filtering for distinct chunks."""
    out = Lattices(vocab)
    size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
    joined = _points(" " + " ".join(chunks))
    lead = np.zeros(len(joined), bool)  # the spaces in front of each word
    first_char = np.cumsum(size) - size
    at, ends_at = first_char, first_char + size
    while len(at):
        lead[at] = True
        on = (at + 1 < ends_at) & (joined[np.minimum(at + 1, len(joined) - 1)] == 32)
        at, ends_at = at[on] + 1, ends_at[on]
    # U+2581 in a text must not pass for a space: no piece holds the sign that replaces it.
    points = np.where(lead, ord(SPACE_SIGN), np.where(joined == ord(SPACE_SIGN), 0x110000, joined)).astype(np.int64)
    sums, undo = _prefix_sums(points)
    ends = np.repeat(first_char + size, size)
    start_all, end_all, piece_all, weight_all = [], [], [], []
    covered = np.zeros(len(points), bool)
    going = np.arange(len(points))
    for length in range(1, vocab.longest + 1):
        start = going[going + length <= ends[going]]
        if not len(start):
            break
        keys = splitmix((sums[start + length] - sums[start]) * undo[start] + _U(length))
        found = vocab.find(keys)
        going, hit = start[found != -1], found >= 0
        start, found = start[hit], found[hit]
        if length == 1:
            covered[start] = True
        start_all.append(start)
        end_all.append(start + length)
        piece_all.append(vocab.ids[found])
        weight_all.append(vocab.weights[found])
    bare = np.flatnonzero(~covered)
    if len(bare):
        start_all.append(bare)
        end_all.append(bare + 1)
        piece_all.append(-1 - joined[bare].astype(np.int32))
        weight_all.append(np.full(len(bare), vocab.weights.min()))
    start, end = np.concatenate(start_all), np.concatenate(end_all)
    order = np.argsort(end, kind="stable")
    start, end = start[order], end[order]
    weight = np.concatenate(weight_all)[order]
    # Place numbers leave one more than its characters to every chunk.
    chunk = np.repeat(np.arange(len(chunks)), size)[start]
    start_place, end_place = start + chunk, end + chunk
    part = _forward(start_place, end_place, weight, chunk, first_char, size, len(points) + len(chunks))
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(end_place)) + 1])
    counts = np.diff(np.concatenate([bounds, [len(part)]]))
    share = part / np.repeat(np.add.reduceat(part, bounds), counts)
    low = np.zeros(len(share))
    for k in range(1, counts.max()):
        at = bounds[counts > k] + k
        low[at] = low[at - 1] + share[at - 1]
    out.first, out.size, out.used = first_char + np.arange(len(chunks)), size, np.zeros(len(chunks), np.int64)
    out.edge = np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=len(chunks)))])
    out.top = np.zeros(len(points) + len(chunks), np.int32)
    out.top[end_place[bounds]] = bounds + counts - 1
    out.low = np.ceil(np.minimum(low, 1.0) * DRAWS).astype(np.int32)
    out.back, out.piece = (end - start).astype(np.int16), np.concatenate(piece_all)[order]
    return out


def _forward(start: np.ndarray, end: np.ndarray, weight: np.ndarray, chunk: np.ndarray, first_char: np.ndarray, size: np.ndarray, places: int) -> np.ndarray:
    """Mass of all segmentations that end with each edge, up to a factor common to its end place.

    ``start`` and ``end`` are place numbers sorted by ``end``. Short chunks go together, place by
    place; a long one goes on its own, masses held with an exponent beside them.
    """
    mass, part = np.zeros(places), np.zeros(len(start))
    base = first_char + np.arange(len(first_char))
    mass[base] = 1.0
    depth = end - base[chunk]
    short = size[chunk] <= SHORT
    order = np.flatnonzero(short)[np.argsort(depth[short].astype(np.int16), kind="stable")]
    cuts = np.searchsorted(depth[order], np.arange(1, SHORT + 2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            e = order[a:b]
            part[e] = mass[start[e]] * weight[e]
            np.add.at(mass, end[e], part[e])
    for k in np.flatnonzero(size > SHORT):
        a, b = np.searchsorted(chunk, [k, k + 1])
        starts, ends, weights = start[a:b].tolist(), end[a:b].tolist(), weight[a:b].tolist()
        held = {int(base[k]): (1.0, 0)}  # mass and its binary exponent
        i = 0
        while i < len(ends):
            stop, j = ends[i], i
            while j < len(ends) and ends[j] == stop:
                j += 1
            entries = [(held[starts[e]][0] * weights[e], held[starts[e]][1]) for e in range(i, j)]
            top = max(x for _, x in entries)
            scaled = [math.ldexp(m, x - top) for m, x in entries]
            part[a + i : a + j] = scaled
            total, more = math.frexp(sum(scaled))
            held[stop] = (total, top + more)
            held.pop(stop - SHORT, None)  # no piece is that long
            i = j
    return part


def _split(text: str) -> list[str]:
    """The chunks of a text, without their first spaces."""
    if text == "":
        return []
    if "  " in text or text[0] == " ":
        return [c[1:] for c in re.findall(r" +[^ ]*", " " + text)]
    return text.split(" ")


def drawn(texts: list[str], keys: np.ndarray, held: Lattices, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, drawn by each one's key, and where each text's begin and the last one's end."""
    split = list(map(_split, texts))
    counts = np.fromiter(map(len, split), np.int64, len(split))
    if not counts.sum():
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes = held.codes(list(chain.from_iterable(split)))
    lengths, base = held.size[codes], held.first[codes]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    after = np.concatenate([[0], np.cumsum(counts)])
    row_key = np.repeat(splitmix(keys.astype(_U) * _STEP + _U(seed)), counts)
    place = upto[1:] - np.repeat(upto[after[:-1]], counts)  # the character position in the row's text
    left, alive = lengths, np.arange(len(codes))
    steps = []
    while len(alive):
        mixed = splitmix(row_key + (place.astype(_U) + _U(1)) * _STEP)
        draw = (mixed >> _U(64 - DRAW_BITS)).astype(np.int32)
        edge = held.top[base + left]  # likely, as it is the longest piece
        down = np.flatnonzero(held.low[edge] > draw)
        while len(down):
            edge[down] -= 1
            down = down[held.low[edge[down]] > draw[down]]
        steps.append((alive, held.piece[edge]))
        back = held.back[edge]
        left = left - back
        on = np.flatnonzero(left)
        alive, left, place, row_key, base = alive[on], left[on], (place - back)[on], row_key[on], base[on]
    taken = np.zeros(len(codes), np.int64)
    for k, (which, _) in enumerate(steps):
        taken[which] = k + 1
    upto = np.concatenate([[0], np.cumsum(taken)])
    out = np.empty(upto[-1], np.int32)
    for k, (which, piece) in enumerate(steps):
        out[upto[which + 1] - 1 - k] = piece
    cuts = upto[after]
    bare = np.flatnonzero(out < 0)
    if len(bare):
        kinds, which = np.unique(-1 - out[bare], return_inverse=True)
        spelt = [held.vocab.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in kinds]
        sizes = np.ones(len(out), np.int64)
        sizes[bare] = np.array(list(map(len, spelt)))[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.repeat(out, sizes)
        for k, ids in enumerate(spelt):
            at = ends[bare[which == k]]
            for j, i in enumerate(ids):
                out[at + j] = i
        cuts = ends[cuts]
    return out, cuts


def sampled(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int = SEED) -> list[np.ndarray]:
    """Piece ids of each text, drawn by its key."""
    ids, cuts = drawn(texts, keys, Lattices(vocab), seed)
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def lossless(texts: list[str], ids: np.ndarray, cuts: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Whether each text is what its pieces decode to."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    lengths = vocab.sound_at[ids + 1] - vocab.sound_at[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    said = vocab.sound[np.repeat(vocab.sound_at[ids] - ends[:-1], lengths) + np.arange(ends[-1])]
    sizes, starts = np.fromiter(map(len, raw), np.int64, len(raw)), ends[cuts]
    same = np.diff(starts) == sizes
    if same.all():
        wrong = np.flatnonzero(said != np.frombuffer(b"".join(raw), np.uint8))
        same[np.searchsorted(starts, wrong, side="right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        same[i] = said[starts[i] : starts[i + 1]].tobytes() == raw[i]
    return same


def spelled(ids, vocab: Vocabulary) -> bytes:
    """The bytes of a sequence of piece ids, with the space in front."""
    return b"".join(map(vocab.sounds.__getitem__, ids))


def decoded(ids, vocab: Vocabulary) -> str:
    """The text of a sequence of piece ids."""
    return spelled(ids, vocab)[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, *, model_file: str = MODEL, alpha: float = ALPHA, seed: int = SEED, check: bool = True) -> DataFrame:
    """``_row``, ``pieces`` and, with ``check``, ``lossless``: whether they decode to the text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file, alpha))

    @F.arrow_udf("pieces array<int>, lossless boolean")
    def segment(texts: pa.Array, keys: pa.Array) -> pa.Array:
        vocab = sent.value
        if vocab.held is None:
            vocab.held = Lattices(vocab)
        null = texts.is_null().to_numpy(False)
        rows = np.flatnonzero(~null)
        held, keys = texts.take(pa.array(rows)).to_pylist(), keys.to_numpy(False).astype(np.int64)[rows]
        found, sizes, same = [np.zeros(0, np.int32)], np.zeros(len(null), np.int64), np.zeros(len(null), bool)
        a = 0
        while a < len(held):
            b, chars = a, 0
            while b < len(held) and chars <= BATCH_CHARS:
                chars += len(held[b])
                b += 1
            ids, cuts = drawn(held[a:b], keys[a:b], vocab.held, seed)
            found.append(ids)
            sizes[rows[a:b]] = np.diff(cuts)
            if check:
                same[rows[a:b]] = lossless(held[a:b], ids, cuts, vocab)
            a = b
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)), mask=pa.array(null))
        return pa.StructArray.from_arrays([pieces, pa.array(same, mask=null | (not check))], names=["pieces", "lossless"])

    key = F.coalesce(F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))), F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key)
    rows = packed(docs, F.col("text").cast("string").alias("_text"), key.alias("_key"))
    rows = rows.select("_row", segment("_text", "_key").alias("_found"))
    return rows.select("_row", "_found.pieces", "_found.lossless")


def decode(encoded: DataFrame, *, model_file: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``pieces``."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_file))

    @F.pandas_udf("string")
    def spell(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ids: None if ids is None else decoded(ids, sent.value))

    return encoded.withColumn("decoded", spell("pieces"))
