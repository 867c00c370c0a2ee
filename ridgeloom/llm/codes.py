"""Vector codes by product quantisation, with codebooks from Lloyd rounds that move only what changed.

Vectors of whole numbers are cut into equal parts; every part position has a codebook. What lasts from round to round is
written: the rows with the entry that each part was last assigned to, and for each (position, entry) the running integer
count and sums of its parts. A round

1. assigns every part to its nearest entry, and writes the new assignment beside the one before,
2. lets each task add up, for parts whose assignment changed alone, plus their components at the new entry and minus them
   at the old one, and shuffles those sums (at most positions x entries x (width + 1) numbers from a task),
3. adds them to the running sums, and replaces each entry that has parts by floor(sum / count).

In the first round no part was assigned before, so all of them are plus. All arithmetic is on whole numbers, so that the
result is that of full sums, whatever the order of rows. A codebook has ``entries`` rows of a vector's length in all (64
vectors), which is what the driver and each task hold of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.llm.shared import drop_staged, staged

#: Largest whole number of a component whose distances stay exact in 64 bits.
LARGEST = 1 << 27


def whole_vectors(rows: DataFrame, parts: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and x (whole numbers floor(scale * component)) of the vectors that can be coded.

    Left out are vectors that are null, empty, hold a null or a non-finite component, or have another length than the
    one of the smallest id that is a multiple of ``parts``.
    """
    vector = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.where(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).where(F.forall(vector, finite))
    found = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    first = found.where("id is not null").agg(F.min(F.struct("id", F.size("x").alias("n")))["n"]).first()[0]
    if first is None:  # no row has an id: any length will do, as there is no codebook
        return found.limit(0)
    return found.where(F.size("x") == first)


def start_entries(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the ``entries`` smallest ids, ascending (of one id by components): at most that many rows."""
    rows = vectors.where("id is not null").orderBy("id", "x").limit(entries).select("x").collect()
    return np.array([r.x for r in rows], np.int64)


def _nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance) of vectors (n, parts, width) and books (parts, entries, width); the lower
    entry on ties. Products of floats are used where they are exact."""
    width = x.shape[2]
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if largest > LARGEST:
        raise ValueError(f"a component is {largest}; distances are whole 64-bit numbers only up to {LARGEST}")
    kind = np.float64 if 4 * width * largest * largest < 1 << 53 else np.int64
    codes, gaps = np.empty(x.shape[:2], np.int16), np.empty(x.shape[:2], np.int64)
    for p in range(len(books)):
        a, b = x[:, p].astype(kind), books[p].astype(kind)
        gap = (b * b).sum(1) - 2 * (a @ b.T)
        codes[:, p] = gap.argmin(1)
        gaps[:, p] = (a * a).sum(1) + np.take_along_axis(gap, codes[:, p : p + 1].astype(np.int64), 1)[:, 0]
    return codes, gaps


def _matrix(column: pa.Array, columns: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def _list(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def assigned(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, x, code (an entry for each part), before (the code that the rows came with, or -1s) and error."""
    parts, _, width = books.shape
    id_type, label_type = dict(vectors.dtypes)["id"], dict(vectors.dtypes)["label"]
    held = "code" in vectors.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                x = _matrix(rows.column("x"), parts * width)
                code, gap = _nearest(x.reshape(-1, parts, width), books)
                before = rows.column("code") if held else _list(np.full(code.shape, -1, np.int16), pa.int16())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), rows.column("x"), _list(code, pa.int16()), before, pa.array(gap.sum(1))],
                    ["id", "label", "x", "code", "before", "error"],
                )

    kept = vectors.select("id", "label", "x", *(["code"] if held else []))
    return kept.mapInArrow(work, f"id {id_type}, label {label_type}, x array<bigint>, code array<smallint>, before array<smallint>, error bigint")


def changes(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, place, total): what the parts whose assignment changed add to the sums; place ``width`` counts them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            code, before = _matrix(batch.column("code"), parts).astype(np.int64), _matrix(batch.column("before"), parts).astype(np.int64)
            x = _matrix(batch.column("x"), parts * width).reshape(-1, parts, width)
            row, part = np.nonzero(code != before)
            moved = np.concatenate([x[row, part], np.ones((len(row), 1), np.int64)], 1)
            np.add.at(total, part * entries + code[row, part], moved)
            had = before[row, part] >= 0
            np.subtract.at(total, (part * entries + before[row, part])[had], moved[had])
        cell, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((cell // entries).astype(np.int32)), pa.array((cell % entries).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[cell, place])],
            ["part", "entry", "place", "total"],
        )

    return rows.select("x", "code", "before").mapInArrow(work, "part int, entry int, place int, total bigint")


def moved_books(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The entries as floor(sum / count) of their parts; one without parts stays. ``sums`` has as many numbers as the books."""
    parts, entries, width = books.shape
    total = np.zeros((parts, entries, width + 1), np.int64)
    found = sums.toArrow()
    total[tuple(found.column(c).to_numpy() for c in ("part", "entry", "place"))] = found.column("total").to_numpy()
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def encode(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every vector that can be coded, and the books (parts, entries, width).

    Codebooks start from the vectors of the smallest ids and move ``rounds`` times; fewer vectors than entries give
    smaller books. Ties go to the lower entry. Rows that repeat an id are rows of their own, each counted; rows without
    an id are coded and counted but start no entry. Labels may be null. Other columns are not read, whatever their
    names, and an empty table (or one without any vector to code) gives an empty one. A component beyond 2**27 after
    scaling is an error, as its distances have no exact 64-bit value.
    """
    if not 0 < entries <= 1 << 15:
        raise ValueError("entries must be between 1 and 32,768")
    vectors = staged(whole_vectors(rows, parts, scale, id_col, vector_col, label_col), "vectors")
    flat = start_entries(vectors, entries)
    books = flat.reshape(len(flat), parts, -1).transpose(1, 0, 2) if len(flat) else np.zeros((parts, 0, 0), np.int64)
    if not len(flat):
        return vectors.select("id", "label", F.array().cast("array<smallint>").alias("code"), F.lit(0).cast("long").alias("error")), books
    _, entries, width = books.shape
    sums = None
    for _ in range(rounds):
        now = staged(assigned(vectors, books), "assigned")
        new = changes(now, parts, entries, width)
        kept = staged((new if sums is None else sums.union(new)).groupBy("part", "entry", "place").agg(F.sum("total").alias("total")), "sums")
        drop_staged(vectors, *([] if sums is None else [sums]))
        vectors, sums = now, kept
        books = moved_books(books, sums)
    out = staged(assigned(vectors, books).select("id", "label", "code", "error"), "codes")
    drop_staged(vectors, *([] if sums is None else [sums]))
    return out, books


def hex_code(code: Column) -> Column:
    """The entries of a code as two lower-case hex digits each, or as many more as entries over 255 need."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def digests(rows: DataFrame, **settings) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of ``encode``'s rows.

    Errors are summed by label first, so that a label of any share of the rows is a sum for each task; the join back to
    the rows is one that the session may split.
    """
    coded, books = encode(rows, **settings)
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = coded.hint("merge").join(of_label.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select(F.col("id").alias("vec_id"), hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: The same in SQL, with full sums in each round.
ORACLE = """
with x as (select vec_id, label, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x from embeddings
           where embedding is not null and len(embedding) > 0 and len(embedding) % 16 = 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
v as (select row_number() over () as r, vec_id, label, x, len(x) // 16 as w from x where len(x) = (select len(x) from x where vec_id is not null order by vec_id, len(x) limit 1)),
p as (select r, g.p as p, list_slice(x, g.p * w + 1, g.p * w + w) as x from v, (select unnest(range(16)) as p) g),
first as (select row_number() over (order by vec_id, x) - 1 as e, x, w from v where vec_id is not null order by vec_id, x limit 64),
b0 as (select g.p as p, e, list_slice(x, g.p * w + 1, g.p * w + w) as y from first, (select unnest(range(16)) as p) g),
"""


def _round(k: int) -> str:
    gap = "list_sum(list_transform(list_zip(x, y), lambda s: (s[1] - s[2]) * (s[1] - s[2])))"
    assign = f"a{k} as (select r, p, min(struct_pack(d := d, e := e)) as m from (select r, p.p as p, e, cast({gap} as bigint) as d from p join b{k} b on p.p = b.p) group by r, p)"
    if k == 2:
        return assign
    return f"""{assign},
s{k} as (select p, e, j, cast(floor(cast(sum(z) as double) / count(*)) as bigint) as z from (select a.p as p, m.e as e, unnest(range(1, len(x) + 1)) as j, unnest(x) as z from a{k} a join p on a.r = p.r and a.p = p.p) group by p, e, j),
n{k} as (select p, e, list(z order by j) as y from s{k} group by p, e),
b{k + 1} as (select b.p as p, b.e as e, coalesce(n.y, b.y) as y from b{k} b left join n{k} n on b.p = n.p and b.e = n.e),
"""


ORACLE += "".join(map(_round, range(3))) + """,
c as (select r, string_agg(format('{:02x}', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from a2 group by r),
books as (select sha256(string_agg(cast(z as varchar), ',' order by p, e, j)) as h from (select p, e, unnest(range(1, len(y) + 1)) as j, unnest(y) as z from b2))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from v join c using (r), books"""
