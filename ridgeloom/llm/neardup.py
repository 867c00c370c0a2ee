"""Near-duplicate classes: MinHash bands find candidates, odd sketches sift them, full sets confirm them.

1. One pass over the texts: each document's set of word shingles gives its size, a 128-bit fingerprint of the
   set, BANDS band hashes of BAND_ROWS MinHash values each, and an odd sketch: every MinHash value, salted with
   its place, flips one bit of a SKETCH_BITS bitmap. Equal values cancel, so the population count of the XOR of
   two sketches is that of their differing values, which estimates a high similarity closely.
2. Documents with one fingerprint are one class; only its smallest id goes on (a partial minimum, so a class
   may hold any share of the rows).
3. The sets of all bucket members are written once, in buckets by id, so that confirmations shuffle pairs alone and
   one set of each. A bucket's hub is its smallest member. Every document is compared with the smallest of its hubs:
   one candidate a document. The sketch and the sizes sift them, the full sets confirm them, and the confirmed links
   give components.
4. In buckets that still hold several components, one member of each is compared with the hub in the same way.
5. Two members of a bucket in different components may still be similar to each other, though not to the hub.
   They alone are compared last, where their sizes are near enough: sizes fall into classes so that similar sets lie
   in the same or the next one. A group of a bucket and a class is dealt into blocks of about BLOCK members, and each
   pair of blocks is a key of its own, so that a group of any size is spread over many tasks. Besides the odd sketch of
   its MinHash values each member carries the parity bitmap of its set, in which every shingle flips one bit: the
   population count of the XOR of two never exceeds the number of shingles that only one of the sets has, so sets under
   PARITY_SET shingles are ruled out without error, and larger ones by a hashed part of their shingles. Both bitmaps
   and the sizes stand within the join condition, so that few pairs but the linked ones leave the join; those are
   confirmed. Pairs within a component need no look: they cannot change it.

So every pair that shares a bucket is confirmed, ruled out, or already connected. A pair at 0.8 shares no bucket
with probability (1 - 0.8**5)**40, below 2e-7, and is sifted out by its sketch with about as much. ``sift=False`` asks
no sketch and no hashed part of a bitmap: what then rules pairs out of a bucket is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.llm.shared import drop_staged, map_texts, slices, staged, staged_by, texts_of, word_codes
from ridgeloom.operators.graph import labels

BANDS, BAND_ROWS, SKETCH_BITS = 40, 5, 512
_HASHES, _WORDS = BANDS * BAND_ROWS, SKETCH_BITS // 64
#: Candidates whose sketches estimate less than the asked similarity minus this are dropped (over four and a half sigma).
SLACK = 0.14
#: Bits of a set's parity bitmap; sets from PARITY_SET shingles on are halved by hash until they are smaller.
PARITY_BITS, PARITY_SET = 2048, 1024
_PARITY_WORDS = PARITY_BITS // 64
#: Standard deviations that a hashed part may hold more differing shingles than expected at the asked similarity.
PARITY_SIGMAS = 6
#: Members of a block of the last comparison.
BLOCK = 4096

_seeds = np.random.default_rng(20240229)
_MULTIPLY = _seeds.integers(0, 1 << 32, _HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _seeds.integers(0, 1 << 32, _HASHES, dtype=np.uint64).astype(np.uint32)
_SALT = _seeds.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, by polynomial rounds over its bytes, eight at a time."""
    raw = [w.encode() for w in words.to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    out = _mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    short = size <= 64
    padded = b"".join(w.ljust(64, b"\0") for w, s in zip(raw, short.tolist(), strict=True) if s)
    chunk = np.frombuffer(padded, "<u8").reshape(-1, 8)
    h = out[short]
    for k in range(8):
        live = size[short] > 8 * k
        h[live] = _mix(h[live] * np.uint64(0x9FB21C651E98DF25) + chunk[live, k])
    out[short] = h
    for i in np.flatnonzero(~short):
        out[i] = int.from_bytes(hashlib.blake2b(raw[i], digest_size=8).digest(), "little")
    return out


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct 64-bit shingle hashes of each text, one text after another.

    Shingles are runs of ``n`` words, A-Z lower-cased; a text with fewer words has its whole word sequence as
    its only shingle, one without words has none.
    """
    codes, owner, words = word_codes(texts, fold=True)
    h = _word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(texts))
    step = np.uint64(0xA24BAED4963EE407)
    place = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]) if len(owner) >= n else np.empty(0, np.int64)
    found = np.full(len(place), n, np.uint64)
    for k in range(n):
        found = _mix(found * step + h[place + k])
    at = owner[place]
    few = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(few):
        starts = np.cumsum(sizes) - sizes
        whole = sizes[few].astype(np.uint64)
        for k in range(n - 1):
            live = sizes[few] > k
            whole[live] = _mix(whole[live] * step + h[starts[few[live]] + k])
        found, at = np.concatenate([found, whole]), np.concatenate([at, few])
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
    return found[first], np.bincount(at[first], minlength=len(texts))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, _HASHES) MinHash values of 32 bits; rows of empty sets are left at the maximum."""
    out = np.full((len(sizes), _HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    starts = (np.cumsum(sizes) - sizes)[full]
    for at in range(0, len(full)):
        x = low[starts[at] : starts[at] + sizes[full[at]]]
        row = out[full[at]]
        for a in range(0, len(x), 4096):
            v = (x[a : a + 4096, None] ^ _FLIP) * _MULTIPLY
            v ^= v >> np.uint32(15)
            np.minimum(row, v.min(0), out=row)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(BAND_ROWS):
        h = _mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, k::BAND_ROWS].astype(np.uint64))
    return (_mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 64) words of the parity bitmaps."""
    bit = (_mix(sig.astype(np.uint64) ^ _SALT) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    flat = bit + np.arange(len(sig))[:, None] * SKETCH_BITS
    odd = (np.bincount(flat.ravel(), minlength=len(sig) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(sig), _WORDS)


def parity_bitmaps(hashes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, level, words) of the parity bitmaps of each set: at level j, of the shingles whose hash ends in j zero bits.

    A set's own level is the first that leaves less than PARITY_SET shingles to expect. It has a second bitmap, one
    level up, only if a set large enough for that level can be as similar as ``percent``.
    """
    mixed = _mix(hashes)
    bit = (mixed >> np.uint64(40)).astype(np.int64) % PARITY_BITS
    starts = np.cumsum(sizes) - sizes
    texts, levels, maps = [], [], []
    for i, (at, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        own = max(0, size.bit_length() - PARITY_SET.bit_length() + 1)
        for level in (own, own + 1) if size * 100 >= percent * (PARITY_SET << own) else (own,):
            part = mixed[at : at + size] & np.uint64((1 << level) - 1) == 0
            texts.append(i)
            levels.append(level)
            maps.append(np.packbits(np.bincount(bit[at : at + size][part], minlength=PARITY_BITS).astype(np.uint8) & 1, bitorder="little"))
    words = np.concatenate(maps).view("<i8").reshape(-1, _PARITY_WORDS) if maps else np.empty((0, _PARITY_WORDS), np.int64)
    return np.array(texts, np.int64), np.array(levels, np.int32), words


def _lists(rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """A list array of the rows, null where ``keep`` is false."""
    width = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.where(keep, width, 0))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows[keep].ravel(), pa.int64()))


def features(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, fp (fingerprint of the set; null if empty), bands and sketch (empty if empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, sizes = shingle_sets(texts_of(batch), n)
            starts = np.cumsum(sizes) - sizes
            fps = [hashlib.blake2b(hashes[s : s + k].tobytes(), digest_size=16).digest() if k else None for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
            sig = signatures(hashes, sizes)
            full = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), _lists(bands_of(sig), full), _lists(odd_sketches(sig), full)],
                ["doc_id", "n_shingles", "fp", "bands", "sketch"],
            )

    return map_texts(docs, work, "doc_id bigint, n_shingles bigint, fp binary, bands array<bigint>, sketch array<bigint>")


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and the sorted shingle hashes of its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, sizes = shingle_sets(texts_of(batch), n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "shingles"])

    return map_texts(docs, work, "doc_id bigint, shingles array<bigint>")


def parity_table(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, size, own (its set's own level), level and parity (the words of the bitmap) of each parity bitmap of a set."""
    names = ["doc_id", "size", "own", "level", "parity"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            hashes, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            texts, levels, words = parity_bitmaps(hashes, sizes, percent)
            own = np.full(len(sizes), levels.max(initial=0), np.int32)
            np.minimum.at(own, texts, levels)
            columns = [batch.column("doc_id").take(pa.array(texts)), pa.array(sizes[texts].astype(np.int64)), pa.array(own[texts]), pa.array(levels), _lists(words, np.ones(len(words), bool))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(sets, work, "doc_id bigint, size bigint, own int, level int, parity array<bigint>")


def differing_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches held as columns a0.. and b0.."""
    total = F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0")))
    for k in range(1, _WORDS):
        total = total + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return total


def most_differing_bits(similarity: float) -> int:
    """Differing bits expected at a similarity: m/2 (1 - (1 - 2/m)**(2k(1-s))) with k values in m bits."""
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * _HASHES * (1 - similarity))))


def differing_parity(a: str, b: str) -> Column:
    """The same of two bitmaps held as arrays: as many columns would make a method too long to be compiled."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def parity_allows(level: Column, sizes: Column, differing: Column, percent: int, sift: bool = True) -> Column:
    """Whether bitmaps of a level that differ in so many bits leave sets of so many shingles in all similar enough."""
    most = sizes * (100 - percent) / (100 + percent)
    expected = most / F.pow(F.lit(2.0), level)
    return F.when(level == 0, differing <= most).otherwise(differing <= expected + PARITY_SIGMAS * F.sqrt(expected) if sift else F.lit(True))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union.

    The pairs may be as many as the documents, so no side is broadcast by a guess of its size; the sets lie in buckets.
    A hub may have any share of the pairs: its join goes by a computed key, so that it is shuffled, not read by bucket,
    and a skewed partition of it can be split.
    """
    hubs = pairs.select(F.col("a").alias("doc_id")).distinct().hint("merge")
    left = sets.join(hubs, "doc_id", "left_semi").select(F.col("doc_id").bitwiseXOR(F.lit(0)).alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.hint("merge").join(right, "b").hint("merge").join(left, "a")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.where(100 * shared.cast("long") >= percent * union.cast("long")).select("a", "b").distinct()


def _block_pairs(held: DataFrame, percent: int) -> DataFrame:
    """The rows as ``held`` has them (bucket, level, size, rep, c and more), once for each pair of blocks they take part in.

    Adds class, i, j and block. Two rows of one bucket and level whose sizes allow the similarity meet in exactly one
    (class, i, j), in which they stand in the blocks i and j; rows that could meet none of another component are left out.
    """
    own = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("int")
    ranged = held.withColumn("own_class", own).withColumn("class", F.explode(F.array(F.col("own_class"), F.col("own_class") - 1)))
    group = ["bucket", "level", "class"]
    stats = ranged.groupBy(*group).agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    blocks = stats.select(*group, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = ranged.join(blocks, group).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"))
    return placed.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).select("*", "pair.i", "pair.j").drop("pair", "blocks")


def classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sift: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is
    the smallest id reachable, kept marks the row that carries it. A null or wordless text has an empty set and
    is its own component. Rows that repeat an id are one document: links of any of its texts count, and all its
    rows get one component. A row without an id joins the component of an equal set, or stays null; it is kept
    only when it has no such component. Ties cannot arise, ids are ordered. Other columns are not read, and an
    empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(features(docs, shingle_words), "features")
    sets = found.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    words = [f"s{k}" for k in range(_WORDS)]
    reps = staged(
        found.where("fp is not null").join(sets, "fp").where("doc_id = rep").dropDuplicates(["rep", "fp"])
        .select("rep", "bands", F.col("n_shingles").alias("size"), *[F.col("sketch")[k].alias(f"s{k}") for k in range(_WORDS)]),
        "reps",
    )
    sketches = reps.select("rep", "size", *words)
    most = most_differing_bits(percent / 100 - SLACK)
    # No pair whose sizes differ more can be similar enough; the sketch sifts the rest.
    near = 100 * F.least("asize", "bsize") >= percent * F.greatest("asize", "bsize")
    if sift:
        near = near & (differing_bits("a", "b") <= most)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[c for c in rows.columns if c not in ("rep", "size", *words)], F.col("rep").alias(name), F.col("size").alias(f"{name}size"), *[F.col(f"s{k}").alias(f"{name}{k}") for k in range(_WORDS)])

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are sifted and confirmed, written once."""
        return staged(_confirmed(pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").where(near).select("a", "b"), bucketed, percent), "links")

    def open_members(members: DataFrame, placed: DataFrame) -> DataFrame:
        """bucket, hub, rep and its component c of the buckets that hold several components."""
        rows = members.join(placed, members.rep == placed.node, "left").select("bucket", "hub", "rep", F.coalesce("component", "rep").alias("c"))
        several = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
        return rows.join(several, "bucket", "left_semi")

    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last")
    members = staged(rows.join(shared.select("bucket", "hub"), "bucket"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    bucketed, table = staged_by(set_table(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), shingle_words), "doc_id", "sets")
    first = links(members.groupBy("rep").agg(F.min("hub").alias("hub")).where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))

    rest = staged(open_members(members, labels(first)), "open")
    one = rest.groupBy("bucket", "hub", "c").agg(F.min("rep").alias("rep")).where("rep <> hub")
    second = first.union(links(one.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()))

    last = staged(open_members(rest.select("bucket", "hub", "rep"), labels(second)), "open")
    of_last = bucketed.join(last.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    parity = staged(parity_table(of_last.select("doc_id", "shingles"), percent), "parity").withColumnRenamed("doc_id", "rep")
    held = _block_pairs(last.select("bucket", "rep", "c").join(sketches, "rep").join(parity, ["rep", "size"]), percent)
    left = side(held.where("block = i"), "a").withColumnRenamed("parity", "aparity")
    right = side(held.where("block = j"), "b").withColumnsRenamed({"parity": "bparity", **{k: f"{k}_" for k in ("bucket", "level", "class", "i", "j", "own", "own_class", "block", "c")}})
    across = near & (F.col("c") != F.col("c_")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    for k in ("bucket", "level", "class", "i", "j"):
        across = across & (F.col(k) == F.col(f"{k}_"))
    # Two sets meet at the higher of their levels and the lower of their classes; a repeated id has bitmaps of each of its texts.
    across = across & (F.col("level") == F.greatest("own", "own_")) & (F.col("class") == F.least("own_class", "own_class_"))
    allowed = parity_allows(F.col("level"), F.col("asize") + F.col("bsize"), differing_parity("aparity", "bparity"), percent, sift)
    pairs = staged(left.join(right, across & allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    final = labels(second.union(_confirmed(pairs, bucketed, percent)))

    back = sets.join(final, sets.rep == final.node, "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component"))
    same = found.select("doc_id", "n_shingles", "fp").join(back, F.col("fp") == F.col("of"), "left")
    component = F.coalesce("component", "doc_id")
    out = staged(same.select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.isnull(component)).alias("kept"),
    ), "classes")
    drop_staged(found, reps, members, first, rest, last, parity, pairs, bucketed)
    docs.sparkSession.sql(f"drop table {table}")
    return out
