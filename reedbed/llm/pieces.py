"""N-best segmentation with the pieces of a SentencePiece model.

A text with a space before it is a chain of chunks (spaces, then other characters); no piece crosses from one chunk to
the next, so each chunk has a lattice of its own. Forward Viterbi gives the best score up to every node; it is the exact
heuristic of an A-star search backward from the end, which meets the N best paths of a chunk in order. The N best
segmentations of a whole text deviate from the best one only in chunks of smallest regret (best less second best), so
the search runs on those chunks alone and their lists are joined in order of score. New chunks are cut where no piece
holds both neighbours, and the forward and backward passes run over many parts of one length at once.

A BPE model holds ranks, not probabilities: a piece of rank r gets the Zipf score log(1 / ((r + 1) * H)), in millionths,
as an integer, so that sums do not depend on their order. Characters without a piece are spelled in bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .tokens import some, vocabulary_path
from .words import held

MARK = "▁"
#: Stands for a mark that the text itself holds; the model has no piece with it.
OWN_MARK = "\uf8ff"
CHUNK = re.compile(r" +[^ ]*|[^ ]+")
MICRO = 1_000_000
LIMIT = 500_000
#: A chunk of more characters is searched in parts.
LONG = 64
N_BEST = 3
NONE = -(1 << 60)
#: Multiplier of the 64-bit hashes by which substrings of many segments are looked up at once.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.model = model
        self.spelled: list[bytes] = []
        self.faults: set[str] = set()
        self.bytes = {}
        plain = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and not re.search(f"[^{MARK}]{MARK}", piece) and OWN_MARK not in piece:
                plain.append((-model.get_score(i), i, piece))
        norm = sum(1 / (r + 1) for r in range(len(plain)))
        self.scores = {piece: (i, -round(MICRO * log((r + 1) * norm))) for r, (_, i, piece) in enumerate(sorted(plain))}
        self.byte_score = -round(MICRO * (log(len(plain) * norm) + 5))
        self.longest = max(map(len, self.scores), default=1)
        pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        letters = sorted(set("".join(pairs)))
        #: The place of a character among those that some piece holds with a neighbour (0: none), and which two it holds.
        self.kinds = np.zeros(0x110000, dtype=np.uint16)
        self.kinds[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for one, other in pairs:
            self.together[self.kinds[ord(one)], self.kinds[ord(other)]] = True
        short = [(p, *v) for p, v in self.scores.items() if all(ord(c) < 0x10000 for c in p)]
        hashes = np.array([self._hashes([p])[-1][0, 0] for p, _, _ in short], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        assert len(np.unique(self.keys)) == len(short)
        self.values = np.array([(i, s) for _, i, s in short], dtype=np.int64)[order]
        self.segments: dict[str, tuple[int, int, bytes]] = {}
        self.ways: dict[tuple[str, int], list] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.numbers = np.zeros((0, 2), dtype=np.int64)

    @staticmethod
    def _hashes(texts: list[str], longest: int = 64) -> list[np.ndarray]:
        """Hashes of all substrings of texts of one length, by their length: (texts, starts)."""
        codes = np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), dtype=np.uint16).reshape(len(texts), -1).astype(np.uint64)
        out = [(codes + np.uint64(1)) * FACTOR]
        for size in range(2, min(longest, codes.shape[1]) + 1):
            h = out[-1][:, :-1]
            out.append(((h ^ (h >> np.uint64(31))) + codes[:, size - 1 :] + np.uint64(1)) * FACTOR)
        return out

    def best_of_many(self, texts: list[str]) -> list[tuple[int, int, bytes]]:
        """``best`` of texts of one length, all of whose characters are pieces, side by side."""
        n, length = len(texts), len(texts[0])
        found = []  # by piece length: ids and scores (texts, starts)
        for h in self._hashes(texts, self.longest):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            there = self.keys[at] == h
            found.append((self.values[at, 0], np.where(there, self.values[at, 1], NONE)))
        row = np.arange(n)
        forward, back = np.zeros((n, length + 1), dtype=np.int64), np.zeros((n, length + 1), dtype=np.int64)
        backward = np.full((n, length + 1), NONE, dtype=np.int64)
        backward[:, length] = 0
        for end in range(1, length + 1):
            sizes = range(min(end, len(found)), 0, -1)  # on a tie the longest piece
            ways = np.stack([forward[:, end - k] + found[k - 1][1][:, end - k] for k in sizes])
            top = ways.argmax(0)
            forward[:, end] = ways[top, row]
            back[:, end] = sizes[0] - top
        for start in range(length - 1, -1, -1):
            backward[:, start] = np.stack([backward[:, start + k] + found[k - 1][1][:, start] for k in range(1, min(length - start, len(found)) + 1)]).max(0)
        used = [np.zeros(s.shape, dtype=bool) for _, s in found]
        at, steps = np.full(n, length), []
        while at.any():
            size = back[row, at]
            step = np.full(n, -1, dtype=np.int64)
            for k in np.unique(size[at > 0]).tolist():
                own = np.flatnonzero((size == k) & (at > 0))
                step[own] = found[k - 1][0][own, at[own] - k]
                used[k - 1][own, at[own] - k] = True
            steps.append(step)
            at = np.where(at > 0, at - size, 0)
        second = np.full(n, NONE, dtype=np.int64)
        for k, (_, s) in enumerate(found, 1):
            whole = np.where(used[k - 1], NONE, forward[:, : length - k + 1] + s + backward[:, k:])
            second = np.maximum(second, whole.max(1))
        ids = np.stack(steps[::-1], axis=1)
        counts = (ids >= 0).sum(1).tolist()
        data = ids.astype("<u4")
        width = data.shape[1]
        scores, regrets = forward[:, length].tolist(), np.where(second > NONE // 2, forward[:, length] - second, -1).tolist()
        return [(scores[i], regrets[i], data[i, width - counts[i] :].tobytes()) for i in range(n)]

    def edges(self, chunk: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end, the (start, score, ids) of pieces that end there."""
        text = chunk.replace(MARK, OWN_MARK).replace(" ", MARK)
        out: list[list] = [[]]
        get, longest = self.scores.get, self.longest
        for end in range(1, len(text) + 1):
            own = []
            for start in range(max(0, end - longest), end):
                found = get(text[start:end])
                if found:
                    own.append((start, found[1], (found[0],)))
            if not own or own[-1][0] != end - 1:
                raw = (chunk[end - 1]).encode("utf-8", "surrogatepass")
                own.append((end - 1, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)))
            out.append(own)
        return out

    def best(self, chunk: str) -> tuple[int, int, bytes]:
        """(score, regret, ids) of the best segmentation; regret -1: there is no other."""
        edges = self.edges(chunk)
        n = len(edges)
        forward, back = [0] * n, [None] * n
        for end in range(1, n):
            top = None
            for e in edges[end]:
                s = forward[e[0]] + e[1]
                if top is None or s > top:
                    top, back[end] = s, e
            forward[end] = top
        ids, at, used = [], n - 1, set()
        while at:
            e = back[at]
            used.add((e[0], at))
            ids.append(e[2])
            at = e[0]
        backward = [None] * (n - 1) + [0]
        second = None
        for end in range(n - 1, 0, -1):
            rest = backward[end]
            if rest is None:
                continue
            for start, score, _ in edges[end]:
                s = score + rest
                if backward[start] is None or s > backward[start]:
                    backward[start] = s
                if (start, end) not in used:
                    whole = forward[start] + s
                    if second is None or whole > second:
                        second = whole
        flat = [i for e in reversed(ids) for i in e]
        return forward[-1], -1 if second is None else forward[-1] - second, np.array(flat, dtype="<u4").tobytes()

    def n_best(self, chunk: str, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best (score, ids) by A-star from the end; equal scores in the order in which they are reached."""
        edges = self.edges(chunk)
        forward = [0] * len(edges)
        for end in range(1, len(edges)):
            forward[end] = max(forward[e[0]] + e[1] for e in edges[end])
        # cost, node, number; of equal costs the nearest to the start first. A path is its last piece and the path behind it.
        heap = [(-forward[-1], len(edges) - 1, 0, 0, None)]
        made, out = 0, []
        while heap and len(out) < n:
            cost, node, _, done, path = heapq.heappop(heap)
            if not node:
                ids: list[int] = []
                while path is not None:
                    own, path = path
                    ids.extend(own)
                out.append((-cost, np.array(ids, dtype="<u4").tobytes()))
                continue
            for start, score, own in edges[node]:
                made += 1
                heapq.heappush(heap, (-(done + score + forward[start]), start, made, done + score, (own, path)))
        return out

    def cut(self, chunks: list[str]) -> list[list[str]]:
        """Each chunk between neighbours that no piece holds together; its best path is made of the parts' best paths."""
        text = "".join(chunks).replace(" ", MARK)
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        apart = ~self.together[kinds[:-1], kinds[1:]]
        lengths = np.cumsum([len(c) for c in chunks])
        apart[lengths[:-1] - 1] = True
        bounds = [0, *(np.flatnonzero(apart) + 1).tolist(), len(text)]
        parts = [text[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        ends = np.searchsorted(bounds, lengths).tolist()
        return [parts[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def learn(self, chunks: set[str], block: int = 8192) -> None:
        if len(self.index) > LIMIT:
            self._reset()
        if len(self.segments) > LIMIT:
            self.segments.clear()
        new = list(chunks.difference(self.index))
        if not new:
            return
        whole = "".join(new)
        own_marks = {c for c in new if MARK in c or OWN_MARK in c} if MARK in whole or OWN_MARK in whole else ()
        plain = [None if c in own_marks else parts for c, parts in zip(new, self.cut(new), strict=True)]
        by_length: dict[int, list[str]] = {}
        for s in {s for parts in plain if parts for s in parts}.difference(self.segments):
            if len(s) <= 48 and all(map(self.scores.__contains__, s)) and ord(max(s)) < 0x10000:
                by_length.setdefault(len(s), []).append(s)
            else:
                self.segments[s] = self.best(s.replace(MARK, " "))
        for own in by_length.values():
            for at in range(0, len(own), block):
                self.segments.update(zip(own[at : at + block], self.best_of_many(own[at : at + block]), strict=True))
        numbers = []
        for chunk, parts in zip(new, plain, strict=True):
            self.index[chunk] = len(self.ids)
            if parts and len(parts) == 1:
                score, regret, ids = self.segments[parts[0]]
                self.ids.append(ids)
                numbers.append((score, regret))
                continue
            known = [self.segments[s] for s in parts] if parts else [self.best(chunk)]
            self.ids.append(b"".join([k[2] for k in known]))
            numbers.append((sum(k[0] for k in known), min((k[1] for k in known if k[1] >= 0), default=-1)))
        self.numbers = np.concatenate((self.numbers, np.array(numbers, dtype=np.int64)))
        # all new chunks are decoded in one go; if their chain differs, each is tried
        if self.spelling(b"".join(self.ids[-len(new) :])) != whole.encode("utf-8", "surrogatepass"):
            for chunk in new:
                self._try(chunk, self.ids[self.index[chunk]])

    def several(self, chunk: str, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best of a chunk. A long one is searched in its parts of smallest regret, joined in order of score."""
        if len(self.ways) > LIMIT // 10:
            self.ways.clear()
        if (chunk, n) not in self.ways:
            parts = [] if len(chunk) <= LONG or MARK in chunk or OWN_MARK in chunk else self.cut([chunk])[0]
            if len(parts) > 1:
                known = [self.segments.get(s) or self.best(s.replace(MARK, " ")) for s in parts]
                numbers = np.array([k[:2] for k in known], dtype=np.int64)
                self.ways[chunk, n] = joined(numbers, [k[2] for k in known], lambda at: self.n_best(parts[at].replace(MARK, " "), n), n)
            else:
                self.ways[chunk, n] = self.n_best(chunk, n)
            for _, ids in self.ways[chunk, n]:
                self._try(chunk, ids)
        return self.ways[chunk, n]

    def segment(self, texts: list[str | None], n: int = N_BEST) -> list[list[tuple[int, bytes]]]:
        """For each text its up to ``n`` best (score, ids). An empty or null text has one, empty."""
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        seen: set[str] = set()
        seen.update(*split)
        self.learn(seen)
        out = []
        for chunks in split:
            index = list(map(self.index.__getitem__, chunks))
            numbers = self.numbers[index] if index else np.zeros((0, 2), dtype=np.int64)
            out.append(joined(numbers, list(map(self.ids.__getitem__, index)), lambda at, own=chunks: self.several(own[at], n), n))
        return out

    def _try(self, chunk: str, ids: bytes) -> None:
        if self.spelling(ids) != chunk.encode("utf-8", "surrogatepass"):
            self.faults.add(chunk)

    def sound(self, text: str | None) -> bool:
        """Whether each segmentation found of this text decodes to it. Chunks are decoded when they are segmented first;
        every text is the chain of its chunks, so it decodes if all of them do."""
        return not self.faults or self.faults.isdisjoint(CHUNK.findall(" " + text) if text else ())

    def spelling(self, ids: bytes) -> bytes:
        """UTF-8 of a segmentation, with the space before the text."""
        if not self.spelled:
            self.spelled = [self.model.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.model.get_piece_size())]
            for b, i in self.bytes.items():
                self.spelled[i] = bytes([b])
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation, whichever it is."""
        return self.spelling(ids).decode("utf-8", "surrogatepass")[1:]


def joined(numbers: np.ndarray, parts: list[bytes], ways, n: int) -> list[tuple[int, bytes]]:
    """The ``n`` best of a chain of parts with the (score, regret) and ids of their best segmentations; ``ways`` gives a
    part's own ``n`` best. Only the parts of smallest regret, of equal regrets the earlier ones, can deviate."""
    top = [(int(numbers[:, 0].sum()), {})]
    if n > 1 and parts:
        regrets = np.where(numbers[:, 1] < 0, np.iinfo(np.int64).max, numbers[:, 1])
        near = range(len(regrets))
        if len(regrets) >= n:
            bound = np.partition(regrets, n - 2)[n - 2]
            under = np.flatnonzero(regrets < bound).tolist()
            near = sorted(under + np.flatnonzero(regrets == bound)[: n - 1 - len(under)].tolist())
        for at in near:
            if numbers[at, 1] < 0:
                continue
            mine = int(numbers[at, 0])
            found = [(score - mine + w[0], {**picked, at: w[1]} if k else picked) for score, picked in top for k, w in enumerate(ways(at))]
            found.sort(key=lambda x: (-x[0], sorted(x[1])))
            top = found[:n]
    out = []
    for score, picked in top:
        mine = parts
        if picked:
            mine = parts[:]
            for at, ids in picked.items():
                mine[at] = ids
        out.append((score, b"".join(mine)))
    return out


def lattice(path: str) -> Lattice:
    return held(("lattice", path), lambda: Lattice(path))


def segmented(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N_BEST, path: str | None = None) -> DataFrame:
    """doc_id, scores (millionths of log-probability, best first) and segmentations (ids as little-endian 32-bit
    numbers) of each row's up to ``n`` best. A null or empty text has one, empty, of score 0. Repeated rows give equal rows."""
    where = path or vocabulary_path("piece_bpe_32k.model")

    def cut(batches):
        for b in batches:
            for names, texts in zip(some(b.column("i").to_pylist(), 256), some(b.column("t").to_pylist(), 256), strict=True):
                found = lattice(where).segment(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64())), pa.array([[i for _, i in f] for f in found], pa.list_(pa.binary()))],
                    ["doc_id", "scores", "segmentations"],
                )

    return docs.select(docs[doc_id].cast("long").alias("i"), docs[text].alias("t")).mapInArrow(cut, "doc_id long, scores array<long>, segmentations array<binary>")


def decoded(segmentations: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the texts of the arrays of ids in (doc_id, segmentations); a null array gives null, an empty
    segmentation the empty text. Ids that the model lacks fail."""
    where = path or vocabulary_path("piece_bpe_32k.model")

    def spell(batches):
        for b in batches:
            own = lattice(where)
            texts = [None if s is None else [own.decode(i) for i in s] for s in b.column("segmentations").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "texts"])

    return segmentations.select(F.col("doc_id").cast("long").alias("doc_id"), "segmentations").mapInArrow(spell, "doc_id long, texts array<string>")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_pieces of the best segmentation; scores, digests and whether they decode to the text, for each of the best."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    where = vocabulary_path("piece_bpe_32k.model")

    def digest(batches):
        for b in batches:
            for names, texts in zip(some(b.column("doc_id").to_pylist(), 256), some(b.column("text").to_pylist(), 256), strict=True):
                own = lattice(where)
                found = own.segment(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()), pa.array([len(f[0][1]) // 4 for f in found], pa.int64()), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[zlib.crc32(i) for _, i in f] for f in found], pa.list_(pa.int64())), pa.array(list(map(own.sound, texts)), pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "scores", "ids_crc32", "round_trip"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_pieces long, scores array<long>, ids_crc32 array<long>, round_trip boolean")
