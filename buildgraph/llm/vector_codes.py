"""Product codes of vectors: codebooks learnt in integers, with norm-of-sum bounds between rounds.

Components become integers, floor(scale * x), and vectors are cut into equal parts, each with a
codebook of its own.  Each round gives every part to the nearest entry of its codebook (the
lowest index of equals) and moves each entry to the floor of the mean of its parts.

Looking at all entries again in every round is mostly wasted.  A row keeps, for each part, its entry,
a lower bound on the distance to any other entry, and the round in which that bound was
exact (its stamp).  All codebooks so far are kept.  For an entry that moved from c_s, at the stamp, to
c_t now, the bound shrinks by |c_t - c_s|, the norm of the sum of its moves, and not by the sum of
the norms of its moves: an entry that wanders and comes back loosens nothing.  The distance to
the own entry is always computed.  If it is below the bound, the entry is still the only nearest one;
if not, the part is compared with all entries and stamped anew.  So codes are those of full scans.

What travels to the tasks are the codebooks of all rounds, whose size depends on rounds, entries and
the width of a vector, not on rows.  What comes back are sums and counts per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.skew import lookup_join
from buildgraph.functions.storage import materialize, materialize_counted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows compared at once.
ROWS = 512


def is_kept(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def widest(width: int) -> int:
    """The largest integer component whose squared distances over a vector surely fit in 64 bits."""
    return int((2**30) / max(width, 1) ** 0.5)


def as_integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """(rows, width) integers; huge components are held at the largest exact value."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.floor(flat.reshape(-1, width) * scale)
    most = widest(width)
    return np.clip(whole, -most, most).astype(np.int64)


class Codebooks:
    """The codebooks of all rounds so far: history[t] is (parts, entries, part width)."""

    def __init__(self, first: np.ndarray):
        self.history = [first]

    @property
    def now(self) -> np.ndarray:
        return self.history[-1]

    def drift(self) -> np.ndarray:
        """(stamp, part, own entry): how far any other entry has come, net, since the round of the stamp."""
        net = np.stack([np.sqrt(((self.now - then).astype(np.float64) ** 2).sum(axis=2)) for then in self.history])
        n = net.shape[2]
        if n == 1:
            return np.zeros_like(net)
        order = np.sort(net, axis=2)
        largest = np.repeat(order[:, :, -1:], n, axis=2)
        return np.where(np.arange(n) == net.argmax(axis=2)[:, :, None], order[:, :, -2:-1], largest)

    def moved(self, sums: dict[tuple[int, int], tuple[int, np.ndarray]]) -> Codebooks:
        """With one more round: entries at the floor of their means; unused ones stay."""
        new = self.now.copy()
        for (part, entry), (count, total) in sums.items():
            new[part, entry] = total // count
        out = Codebooks(self.history[0])
        out.history = [*self.history, new]
        return out

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.now.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance to the nearest other entry) by comparing with the whole book."""
    d = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    entry = d.argmin(axis=1)
    if len(book) == 1:
        return entry, np.full(len(parts), np.inf)
    d[np.arange(len(d)), entry] = np.iinfo(np.int64).max
    return entry, np.sqrt(d.min(axis=1).astype(np.float64))


def assign(x: np.ndarray, books: Codebooks, code=None, bound=None, stamp=None) -> tuple:
    """(codes, bounds, stamps, squared errors, parts scanned) of rows of integers.

    Without earlier codes every part is compared with its whole book.
    """
    book = books.now
    parts, _, width = book.shape
    x = x.reshape(len(x), parts, width)
    round_now = len(books.history) - 1
    first = code is None
    if first:
        code = np.zeros((len(x), parts), dtype=np.int64)
        bound = np.zeros((len(x), parts))
        stamp = np.zeros((len(x), parts), dtype=np.int64)
        scan = np.ones((len(x), parts), dtype=bool)
    else:
        at = np.arange(parts)[None, :]
        own = np.sqrt(((x - book[at, code]) ** 2).sum(axis=2).astype(np.float64))
        left = bound - books.drift()[stamp, at, code]
        # Rounding of roots and differences is far below this margin.
        scan = own * (1 + 1e-9) + 1e-6 >= left
    for p in range(parts):
        rows = np.flatnonzero(scan[:, p])
        for lo in range(0, len(rows), ROWS):
            some = rows[lo : lo + ROWS]
            code[some, p], bound[some, p] = nearest(x[some, p], book[p])
    stamp[scan] = round_now
    error = ((x - book[np.arange(parts)[None, :], code]) ** 2).sum(axis=(1, 2))
    return code, bound, stamp, error, scan.sum(axis=1)


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Codebooks from the vectors of the smallest ids (a null id is the largest; ties go by content)."""

    def smallest(rows: DataFrame) -> pa.Array:
        found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow()
        return found.column(0).combine_chunks()

    vectors = smallest(kept)
    if not len(vectors):
        return None
    width = len(vectors[0])
    if any(len(v) != width for v in vectors):
        vectors = smallest(kept.where(F.size("vec") == width))
    x = as_integers(vectors, width, scale)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, width // parts).swapaxes(0, 1)))


def assigned(rows: DataFrame, books: Codebooks, scale: int, last: bool) -> DataFrame:
    """One pass: rows (vec_id, label, vec and, after the first pass, code, bound, stamp) with their new codes."""
    shared = rows.sparkSession.sparkContext.broadcast(books.history)
    parts = books.now.shape[0]
    width = parts * books.now.shape[2]
    old = "code" in rows.columns

    def listed(a: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), kind), parts).cast(pa.list_(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Codebooks(shared.value[0])
        mine.history = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_integers(batch.column(2), width, scale)
            before = []
            if old:
                before = [batch.column(i).flatten().to_numpy().reshape(-1, parts) for i in (3, 4, 5)]
                before = [before[0].astype(np.int64), before[1].copy(), before[2].astype(np.int64)]
            code, bound, stamp, error, scanned = assign(x, mine, *before)
            if last:
                text = [bytes(c).hex() if books_fit else ".".join(map(str, c)) for c in code.astype(np.uint8 if books_fit else np.int64).tolist()]
                arrays = [batch.column(0), batch.column(1), pa.array(text), pa.array(error), pa.array(scanned)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "code", "error", "scanned"])
            else:
                state = [listed(code, pa.int16()), listed(bound, pa.float64()), listed(stamp, pa.int16())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *state], ["vec_id", "label", "vec", "code", "bound", "stamp"])

    books_fit = books.now.shape[1] <= 256
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label", "vec")}
    base = f"vec_id {kind['vec_id']}, label {kind['label']}"
    state = f"{base}, vec {kind['vec']}, code array<smallint>, bound array<double>, stamp array<smallint>"
    return rows.mapInArrow(run, f"{base}, code string, error long, scanned long" if last else state)


def entry_sums(rows: DataFrame, books: Codebooks, scale: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(count, sum of parts) of every used entry: each task sums its rows, Spark sums the tasks."""
    parts, entries, part_width = books.now.shape
    width = parts * part_width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, dtype=np.int64)
        total = np.zeros((parts * entries, part_width), dtype=np.int64)
        for batch in batches:
            x = as_integers(batch.column(0), width, scale).reshape(-1, part_width)
            at = batch.column(1).flatten().to_numpy().reshape(-1, parts) + np.arange(parts) * entries
            np.add.at(n, at.ravel(), 1)
            np.add.at(total, at.ravel(), x)
        used = np.flatnonzero(n)
        where = np.repeat(used, part_width)
        columns = [where, np.tile(np.arange(part_width), len(used)), n[where], total[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["e", "i", "n", "s"])

    sums = rows.select("vec", "code").mapInArrow(run, "e long, i long, n long, s long")
    # One row per entry and position, however many vectors there are.  Totals may need more than 64 bits.
    found = sums.groupBy("e", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for r in found:
        key = divmod(r["e"], entries)
        out.setdefault(key, (r["n"], np.zeros(part_width, dtype=object)))[1][r["i"]] = int(r["s"])
    return out


def encode(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error, scanned), codebooks) of the vectors that can be encoded.

    Left out: null vectors, those with a null or non-finite component, and those that cannot be
    cut like the kept vector of the smallest id (another width, or one that ``parts`` does not
    divide).  A table with none left gives no rows and no codebooks.  With fewer kept vectors than ``entries`` the
    codebooks are as small.  Repeated ids are rows of their own; a null id sorts last.  Components beyond
    the range that 64-bit distances hold (:func:`widest`) count as its border.  ``scanned`` is the number of
    parts that the last pass compared with all entries.  Other columns, whatever their names, are not read.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vec"))
    kept = rows.where(is_kept(F.col("vec")) & (F.size("vec") > 0) & (F.size("vec") % parts == 0))
    books = first_books(kept, parts, entries, scale)
    if books is None:
        kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
        none = f"vec_id {kind[0]}, label {kind[1]}, code string, error long, scanned long"
        return vectors.sparkSession.createDataFrame([], none), None
    width = parts * books.now.shape[2]
    state = kept.where(F.size("vec") == width)
    for _ in range(rounds):
        state = materialize(assigned(state, books, scale, last=False), "vector-state")
        books = books.moved(entry_sums(state, books, scale))
    return assigned(state, books, scale, last=True), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` (…, label, error) with label_error, the error summed over equal labels, nulls together."""
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    named = materialize(codes.withColumn("_l", name), "vector-codes")
    sums = materialize(named.groupBy("_l").agg(F.sum("error").alias("label_error")), "label-errors")
    return lookup_join(named, sums, ["_l"], "left").drop("_l")


def op13(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    codes, books = encode(vectors)
    out = with_label_error(codes).withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
