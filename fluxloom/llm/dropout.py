"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Blanks become ``▁`` and no vocabulary piece holds ``▁`` behind another character, so merges never leave a
chunk: a word with the blanks before it. In a chunk the agenda takes the best candidate merge
first, the leftmost of equals; a keyed hash of seed, text, the chunk's number in the text and the
candidate's number decides whether the candidate is skipped for good, so every occurrence is
dealt with on its own. All that the hash decides is one bit per candidate: what a chunk becomes
under given bits is computed once and remembered. Characters outside the vocabulary, and
``▁`` itself, become byte pieces, so that decoding restores every text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, DROP = 17, 0.1
TABLE_SIZE = 120_000  # chunks remembered per worker; a full table is emptied
OUTCOMES = 60_000  # outcomes of chunks under given skips remembered per worker; likewise
WIDEST = 23  # characters of a chunk that is merged together with others, 3 * 23 - 6 candidates fit 64 bits; longer ones go alone
NONE, NEVER = 0xFFFF, np.int32(2**31 - 1)
_CHUNK = re.compile("▁*[^▁]+|▁+")
_A, _B, _C = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_B)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Numbers chunks in the order of their first sight; ``new`` collects those that were not known."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = k = len(self)
        return k


class Pieces:
    """The vocabulary: bytes of every piece, the ids of byte pieces, and ids and scores of all others."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.piece_bytes = [b""] * n
        self.byte_ids, self.ids, self.scores = [0] * 256, {}, {}
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.piece_bytes[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.piece_bytes[k] = piece.replace("▁", " ").encode()
                self.ids[piece], self.scores[piece] = k, model.get_score(k)

    def decode(self, ids: bytes) -> str:
        whole = b"".join(map(self.piece_bytes.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return whole.removeprefix(b" ").decode("utf-8", "surrogatepass")


class Codec(Pieces):
    def __init__(self, path: str, seed: int = SEED, drop: float = DROP):
        import xxhash

        super().__init__(path)
        self.hash = xxhash.xxh64_intdigest
        self.seed, self.limit = seed, int(drop * 2**64)
        ids, scores = self.ids, self.scores
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        merges = [((ids[piece[:s]] << 16) | ids[piece[s:]], order[scores[piece]], k) for piece, k in ids.items() for s in range(1, len(piece)) if piece[:s] in ids and piece[s:] in ids]
        self.by_pair = {pair: (rank, k) for pair, rank, k in merges}
        self._lay_out(merges)
        self.of_char = np.full(0x110000, NONE, np.uint16)
        for piece, k in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = k
        self._forget()

    def _lay_out(self, merges: list[tuple[int, int, int]]) -> None:
        """Merges in an open hash table: a pair stands at its hash or one of the next places."""
        self.shift = np.uint32(32 - (4 * len(merges)).bit_length())
        size = 1 << (32 - int(self.shift))
        self.pairs, self.ranks, self.merged = np.full(size + 64, 0xFFFFFFFF, np.uint32), np.full(size + 64, NEVER, np.int32), np.zeros(size + 64, np.uint16)
        for (pair, rank, k), at in zip(merges, self._place(np.array([m[0] for m in merges], np.uint32)).tolist(), strict=True):
            while self.pairs[at] != 0xFFFFFFFF:
                at += 1
            self.pairs[at], self.ranks[at], self.merged[at] = pair, rank, k

    def _place(self, pair: np.ndarray) -> np.ndarray:
        return (pair * np.uint32(_C & 0xFFFFFFFF)) >> self.shift

    def _forget(self) -> None:
        """Number 0 stands for a ``▁`` of the text, which is bytes. A chunk's number is given at its first sight."""
        self.number = _Numbers({"": 0})
        self.plain: list[bytes | None] = [np.array(self._bytes("▁"), "<u2").tobytes()]
        self.needed, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)  # needed is -1 until the plain agenda is known
        self.outcomes: dict[tuple[int, int], bytes] = {}

    def _grow(self) -> None:
        """Room for the chunks numbered since the last call."""
        new = self.number.new
        self.plain += [None] * len(new)
        self.needed = np.concatenate([self.needed, np.full(len(new), -1, np.int64)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
        self.number.new = []

    # --- one chunk alone
    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def _alone(self, chunk: str, skips: int | np.ndarray) -> bytes:
        """Ids of a chunk whose candidate k is skipped if bit (or item) k of ``skips`` is set."""
        n, offered = len(chunk), 0
        ids = [int(self.of_char[ord(c)]) for c in chunk]
        left, right, stop = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        live, agenda = [True] * n, []

        def offer(i: int, j: int) -> None:
            nonlocal offered
            if i < 0 or j >= n:
                return
            if found := self.by_pair.get((ids[i] << 16) | ids[j]):
                if not (skips >> offered & 1 if isinstance(skips, int) else skips[offered]):
                    heapq.heappush(agenda, (found[0], i, j, stop[j], found[1]))
                offered += 1

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, end, merged = heapq.heappop(agenda)
            if not (live[i] and j < n and live[j] and right[i] == j and stop[j] == end):
                continue
            ids[i], stop[i], live[j], right[i] = merged, stop[j], False, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i, right[i])
            offer(left[i], i)
        out: list[int] = []
        for i in range(n):
            if live[i]:
                out += [ids[i]] if ids[i] != NONE else self._bytes(chunk[i])
        return np.array(out, "<u2").tobytes()

    # --- many chunks at once
    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = left.shape
        pair = ((left.astype(np.uint32) << np.uint32(16)) | right).ravel()
        at = self._place(pair).astype(np.int32)
        there = self.pairs[at]
        more = np.flatnonzero((there != pair) & (there != 0xFFFFFFFF))
        while len(more):
            at[more] += 1
            there = self.pairs[at[more]]
            more = more[(there != pair[more]) & (there != 0xFFFFFFFF)]
        return self.ranks[at].reshape(shape), self.merged[at].reshape(shape)

    def _together(self, chunks: list[str], skips: int | np.ndarray) -> list[bytes]:
        return self._merged(chunks, skips)[0]

    def _merged(self, chunks: list[str], skips: int | np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of every chunk under its bits of ``skips``, and how many candidates it met.

        Each chunk has a row of ``wide`` cells with an empty one on either side; all arrays are flat, and
        ``left`` and ``right`` hold the cells of the neighbours.
        """
        w, lengths = len(chunks), np.array([len(c) for c in chunks])
        wide = int(lengths.max()) + 2
        skips = np.broadcast_to(np.asarray(skips, np.uint64), w)
        cells, place = np.arange(w * wide, dtype=np.int32), np.arange(wide)
        live = ((place > 0) & (place <= lengths[:, None])).ravel()
        ids = np.full(w * wide, NONE, np.uint16)
        ids[live] = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        left, right = cells - 1, cells + 1
        rank, merged = np.full(w * wide, NEVER, np.int32), np.zeros(w * wide, np.uint16)
        rank[:-1], merged[:-1] = self._find(ids[:-1], ids[1:])
        first = np.flatnonzero(rank != NEVER)
        of = first // wide
        offered = np.bincount(of, minlength=w).astype(np.uint64)
        order = np.arange(len(of)) - (np.cumsum(offered) - offered).astype(np.int64)[of]
        rank[first[(skips[of] >> order.astype(np.uint64) & np.uint64(1)) != 0]] = NEVER
        row, table = np.arange(w), rank.reshape(w, wide)
        while len(row):
            at = row * wide + (table if len(row) == w else table[row]).argmin(1)
            some = rank[at] != NEVER
            row, at = row[some], at[some]
            mid = right[at]
            end = right[mid]
            ids[at], live[mid], rank[mid], right[at], left[end] = merged[at], False, NEVER, end, at
            before, bits, met = left[at], skips[row], offered[row]
            for a, b in ((at, end), (before, at)):
                found, piece = self._find(ids[a], ids[b])
                gone = (bits >> met & np.uint64(1)) != 0
                met += found != NEVER
                rank[a], merged[a] = np.where(gone, NEVER, found), piece
            offered[row] = met
        out = ids[live]
        ends = np.cumsum(live.reshape(w, wide).sum(1))
        raw = out.tobytes()
        strange = np.zeros(w, bool)
        strange[np.searchsorted(ends, np.flatnonzero(out == NONE), side="right")] = True
        result = [raw[a:b] for a, b in zip([0, *(2 * ends[:-1]).tolist()], (2 * ends).tolist(), strict=True)]
        for k in np.flatnonzero(strange).tolist():
            own = range(k * wide + 1, k * wide + 1 + len(chunks[k]))
            pieces = [[int(ids[c])] if ids[c] != NONE else self._bytes(chunks[k][c - own.start]) for c in own if live[c]]
            result[k] = np.array([x for part in pieces for x in part], "<u2").tobytes()
        return result, offered.astype(np.int64)

    def _learn(self, chunks: list[str], skips: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """``_merged`` of any number of chunks up to ``WIDEST``, in portions of similar width."""
        results: list[bytes] = [b""] * len(chunks)
        offered = np.zeros(len(chunks), np.int64)
        width = np.searchsorted([5, 7, 9, 12], np.array([len(c) for c in chunks], np.int64))
        for k in range(5):
            own = np.flatnonzero(width == k)
            for at in range(0, len(own), 5_000):
                part = own[at : at + 5_000]
                ids, offered[part] = self._merged([chunks[i] for i in part.tolist()], skips[part])
                for i, x in zip(part.tolist(), ids, strict=True):
                    results[i] = x
        return results, offered

    def _skips(self, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bit k is set if candidate k of an occurrence is skipped, for the first ``most`` candidates of each."""
        skips = np.zeros(len(keys), np.uint64)
        order = np.argsort(-most, kind="stable")
        keys, counts = keys[order], np.searchsorted(-most[order], -np.arange(64), side="left")
        bits = np.zeros(len(keys), np.uint64)
        for k in range(int(most.max(initial=0))):
            own = counts[k]  # the occurrences with more than k candidates stand first
            bits[:own] |= (self._drawn(keys[:own], k) < np.uint64(self.limit)).astype(np.uint64) << np.uint64(k)
        skips[order] = bits
        return skips

    def _drawn(self, keys, k) -> np.ndarray:
        return _mixed(np.atleast_1d(keys) ^ _mixed(np.atleast_1d(k).astype(np.uint64) * np.uint64(_C) + np.uint64(_A)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, two bytes each."""
        chunks, counts, first = [], [], []
        for text in texts:
            before = len(chunks)
            for k, part in enumerate(text.split("▁")):
                part = part.replace(" ", "▁")
                if k:
                    chunks.append("")
                chunks += _CHUNK.findall("▁" + part if k == 0 and text else part)
            counts.append(len(chunks) - before)
            first.append(self.hash(text.encode("utf-8", "surrogatepass"), self.seed))
        if len(self.number) > TABLE_SIZE:
            self._forget()
        number = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        self._grow()
        ends = np.cumsum(counts)
        place = np.arange(len(chunks)) - np.repeat(ends - counts, counts)
        keys = _mixed(np.repeat(np.array(first, np.uint64), counts) + place.astype(np.uint64) * np.uint64(_C))
        size = self.size[number]
        new = (self.needed < 0) & (self.size <= WIDEST)
        times = np.bincount(number, minlength=len(self.size))
        once = np.flatnonzero((new & (times == 1))[number])
        own = [chunks[k] for k in once.tolist()]
        # a new chunk that stands here once is merged once, under its own skips; if they skip nothing that is its plain form
        skips = self._skips(keys[once], _most(size[once]))
        alone, met = self._learn(own, skips)
        self._remember(number[once], alone, met, (skips & ((np.uint64(1) << met.astype(np.uint64)) - np.uint64(1))) == 0)
        several = np.flatnonzero(new & (times > 1))
        where = np.zeros(len(self.size), np.int64)
        where[number] = np.arange(len(chunks))
        plain, met = self._learn([chunks[k] for k in where[several].tolist()], np.zeros(len(several), np.uint64))
        self._remember(several, plain, met, np.ones(len(several), bool))
        out = list(map(self.plain.__getitem__, number.tolist()))
        for k, ids in zip(once.tolist(), alone, strict=True):
            out[k] = ids
        needed = self.needed[number]
        needed[once] = 0
        at = np.flatnonzero(needed > 0)
        at = at[self._skips(keys[at], needed[at]) != 0]  # else no candidate of the plain agenda is skipped
        self._vary(chunks, out, at, number[at], self._skips(keys[at], _most(size[at])))
        for k in np.flatnonzero(size > WIDEST).tolist():  # merged at each occurrence
            out[k] = self._alone(chunks[k], self._drawn(keys[k], np.arange(3 * len(chunks[k]))) < np.uint64(self.limit))
        return [b"".join(out[end - n : end]) for end, n in zip(ends.tolist(), counts, strict=True)]

    def _remember(self, number: np.ndarray, ids: list[bytes], met: np.ndarray, plain: np.ndarray) -> None:
        """Keep the plain forms among ``ids`` with the number of candidates that they meet."""
        self.needed[number[plain]] = met[plain]
        for k in np.flatnonzero(plain).tolist():
            self.plain[number[k]] = ids[k]

    def _vary(self, chunks: list[str], out: list[bytes], at: np.ndarray, number: np.ndarray, skips: np.ndarray) -> None:
        """Set ``out`` at the places of chunks of which a candidate is skipped; each (chunk, skips) is merged once."""
        if not len(at):
            return
        order = np.lexsort((skips, number))
        n, s = number[order], skips[order]
        head = np.r_[True, (n[1:] != n[:-1]) | (s[1:] != s[:-1])]
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(head) - 1
        pairs = list(zip(n[head].tolist(), s[head].tolist(), strict=True))
        found = list(map(self.outcomes.get, pairs))
        new = [k for k, x in enumerate(found) if x is None]
        some = at[order[head]]
        ids, _ = self._learn([chunks[some[k]] for k in new], s[head][new])
        for k, x in zip(new, ids, strict=True):
            found[k] = x
        if len(self.outcomes) + len(new) > OUTCOMES:
            self.outcomes.clear()
        self.outcomes.update((pairs[k], found[k]) for k in new[:OUTCOMES])
        for place, k in zip(at.tolist(), which.tolist(), strict=True):
            out[place] = found[k]


@lru_cache(maxsize=2)
def codec(path: str, seed: int = SEED, drop: float = DROP) -> Codec:
    return Codec(path, seed, drop)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _most(size: np.ndarray) -> np.ndarray:
    """Most candidates that a chunk of so many characters can meet."""
    return np.maximum(3 * size - 6, size - 1)


def _portions(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    own, total = [], 0
    for text in texts:
        own.append(text)
        total += len(text)
        if total > size:
            yield own
            own, total = [], 0
    if own:
        yield own


def encode(docs: DataFrame, path: str, seed: int = SEED, drop: float = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, n_pieces, ids`` per row; ``ids`` holds two bytes per piece.

    The same text gets the same ids under the same seed, wherever it stands. A null text is empty, an
    empty text has no pieces. Repeated rows are encoded each; other columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, seed, drop)
        for batch in batches:
            ids = [x for part in _portions([t or "" for t in batch.column(1).to_pylist()]) for x in own.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "text_sha256", "n_pieces", "ids"])

    rows = docs.select(id_col, text_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_sha256 string, n_pieces bigint, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with the decoded ``text``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            texts = pa.array([own.decode(x.as_py()) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    return coded.mapInArrow(run, f"{fields}, text string")
