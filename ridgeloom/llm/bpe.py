"""Byte-level BPE encoding and decoding with padded numpy matrices.

Every distinct pre-token becomes a row of a matrix of its length bucket. In each round every row merges its
leftmost pair of minimum rank; pair ranks come from a hashed table, and the cell a merge leaves behind is compacted
away. A row without a known pair is done. Rows of more than LONG / 2 bytes make in one round the merges of as many
rounds as keep their minimum rank, which are the same merges in the same order.

Rows are independent, so the job is one narrow stage: no shuffle, memory bounded by a slice of rows and by
the bounded caches of a Python worker. A lost executor only repeats its own partitions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ridgeloom.llm.shared import Ragged, encode_by, map_texts, slices, texts_of

_NONE = np.int32(2**31 - 1)
_PAD = np.int32(2**31 - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Upper bounds of the length buckets of a matrix; from LONG on they double. Cells of a matrix, about.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, *(1 << k for k in range(8, 32)))
LONG, CELLS = 256, 1 << 18


class HashedPairs:
    """Open-addressing table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        self.probes, pending = 0, np.arange(len(keys))
        while len(pending):
            slot = (self._home(keys[pending]) + self.probes) & self.mask
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[pending[free]]
            won = self.keys[slot] == keys[pending]
            self.values[slot[won]] = values[pending[won]]
            pending = pending[~won]
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._home(key)
        at = self.keys[slot]
        out = np.where(at == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((at != key) & (at != -1))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            k = key.ravel()[open_]
            s = (slot.ravel()[open_] + probe) & self.mask
            at = self.keys[s]
            hit = at == k
            out.ravel()[open_[hit]] = self.values[s[hit]]
            open_ = open_[~hit & (at != -1)]
        return out


class ByteBpe:
    """A rank vocabulary; ids are ranks, as in the rank-file format (base64 token, space, rank per line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = HashedPairs(np.array(keys, np.int64), np.array(values, np.int32))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        top = max(ranks.values()) + 1
        spelled = [b""] * top
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spelled = spelled
        self.bytes_of = Ragged.of_bytes(spelled)
        self.digits_of = Ragged.of_bytes([b"%d," % i for i in range(top)])

    # -- encoding ---------------------------------------------------------------------------------

    def encode_pretokens(self, found: list[bytes]) -> Ragged:
        """The ids of each pre-token, bucket by bucket of length."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        raw = np.frombuffer(b"".join(found), np.uint8)
        bucket = np.searchsorted(BUCKETS, sizes)
        whole = np.fromiter((self.ranks.get(x, -1) for x in found), np.int32, len(found))
        known = np.flatnonzero(whole >= 0)
        bucket[known] = bucket[sizes == 0] = -1
        flats, members, lengths = [whole[known]], [known], [np.ones(len(known), np.int64)]
        for k in np.unique(bucket[bucket >= 0]).tolist():
            own = np.flatnonzero(bucket == k)
            width = int(sizes[own].max())
            merge = self._merge_places if BUCKETS[k] >= LONG else self._merge_rows
            step = max(1, min(8192, CELLS // width))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                inside = np.arange(width) < sizes[rows][:, None]
                m = np.full(inside.shape, _PAD, np.int32)
                m[inside] = self.byte_ids[Ragged(raw, sizes).take(rows).flat]
                for ended, who in merge(m, rows):
                    real = ended != _PAD
                    flats.append(ended[real])
                    members.append(who)
                    lengths.append(real.sum(1))
        back = np.empty(len(found), np.int64)
        back[:] = -1
        who = np.concatenate(members)
        back[who] = np.arange(len(who))
        size = np.append(np.concatenate(lengths), 0)  # the last stands for empty pre-tokens
        return Ragged(np.concatenate(flats).astype(np.uint32), size).take(back)

    def _merge_rows(self, m: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rounds over one padded matrix; yields finished rows with their members as they finish."""
        r = self.pairs.ranks(m[:, :-1], m[:, 1:])
        places = np.arange(m.shape[1])
        while len(m):
            if r.shape[1]:
                rows = np.arange(len(m))
                j = r.argmin(1)
                best = r[rows, j]
                going = best != _NONE
            else:
                going = np.zeros(len(m), bool)
            if not going.all():
                yield m[~going], members[~going]
                m, members, r = m[going], members[going], r[going]
                if not len(m):
                    return
                rows, j, best = np.arange(len(m)), j[going], best[going]
            m[rows, j] = best
            ahead = places[: r.shape[1]] <= j[:, None]
            m = np.where(ahead, m[:, :-1], m[:, 1:])
            r = np.where(ahead[:, 1:], r[:, :-1], r[:, 1:])
            left = np.flatnonzero(j > 0)
            if len(left):
                jl = j[left]
                r[left, jl - 1] = self.pairs.ranks(m[left, jl - 1], m[left, jl])
            right = np.flatnonzero(j < r.shape[1])
            if len(right):
                jr = j[right]
                r[right, jr] = self.pairs.ranks(m[right, jr], m[right, jr + 1])

    def _merge_places(self, m: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same, but a round merges many places of a row's minimum rank, the left of two that overlap.

        It stops at the first place where the merged token and a neighbour, as they stand once the places before it
        are merged, have a lower rank: that pair would be next. So the merges are those of single ones, in their order.
        """
        for row, who in zip(m, members, strict=True):
            ids = row[row != _PAD]
            r = self.pairs.ranks(ids[:-1], ids[1:])
            while len(r) and (best := r.min()) != _NONE:
                places = np.flatnonzero(r == best)
                order = np.arange(len(places))
                run = np.maximum.accumulate(np.where(np.diff(places, prepend=-2) != 1, order, 0))
                places = places[(order - run) % 2 == 0]
                merged = np.full(len(places), best, np.int32)
                left = ids[np.maximum(places - 1, 0)]
                left[1:][np.diff(places) == 2] = best
                lower = (self.pairs.ranks(left, merged) < best) & (places > 0)
                lower |= (self.pairs.ranks(merged, ids[np.minimum(places + 2, len(ids) - 1)]) < best) & (places + 2 < len(ids))
                if lower.any():
                    places = places[: int(lower.argmax()) + 1]
                ids[places] = best
                keep = np.ones(len(ids), bool)
                keep[places + 1] = False
                ids = ids[keep]
                r = np.delete(r, places)  # a merged pair's own rank; the ranks beside it change
                now = places - np.arange(len(places))
                for beside in (now[now > 0] - 1, now[now < len(r)]):
                    r[beside] = self.pairs.ranks(ids[beside], ids[beside + 1])
            yield ids[None], np.array([who])

    def encode(self, texts: list[str]) -> Ragged:
        """Ids of each whole text, every match of the pattern encoded separately."""
        return encode_by(self.pattern, texts, lambda parts: self.encode_pretokens([x.encode() for x in parts]))

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.take(ids).flat.tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal digits, joined by commas."""
        return self.digits_of.take(ids).flat.tobytes()[:-1]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file, once per Python process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encodes every whole text, decodes the ids again and digests both.

    Returns id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded
    bytes), and with ``with_ids`` also ids (array<int>). A null or empty text has no ids. A null id stays null,
    repeated rows give repeated rows, an empty table gives an empty table, and other columns are not read.
    ``ranks_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in slices(batches, text_col):
            n, ids_sha, text_sha, lists = [], [], [], []
            found = bpe.encode(texts_of(batch, text_col))
            for i in range(batch.num_rows):
                ids = found[i]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.decimals(ids)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [batch.column(id_col), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs.select(id_col, text_col), work, schema)
