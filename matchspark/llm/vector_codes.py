"""Vector code compression: each of 16 parts of a vector becomes the number of an entry in that part's codebook.

Components become whole numbers, floor(256 x), so all distances are exact. Codebooks begin as the parts of the vectors with
the smallest ids and follow Lloyd's rounds: assign, then replace each entry by the floor of the mean of its parts; an entry
without parts stays. The assignments after the first one look at active entries only: where the entry of a part did not
move, its stored distance is still exact and still beats the other entries that did not move, so only moved entries are
compared with it; where it moved, the part is compared with all entries again. Ties go to the lower index.

Each assignment is written with its distances to the shared folder, as the next one starts from it. Sums are added up in
the tasks and meet as one row for each entry and component, ``ENTRIES`` times the width of a vector, on the driver.

Rows are left out if the vector is NULL or empty, holds a NULL or a non-finite number, or has another length than the
vector of the smallest id that is a multiple of ``PARTS`` long. Rows that repeat an id stay; among equal ids the
codebooks start in the order of the components; NULL ids come last. Components beyond a million stop at 2^28. With fewer
than ``ENTRIES`` vectors the codebooks are shorter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm import common

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 28
STATE = "vec_id bigint, label_key string, ints array<int>, code array<int>, distance array<bigint>"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label_key (NULL labels as ``-``) and ints of the rows that are kept."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & good)
    first = rows.select(F.size("embedding").alias("n"), "vec_id").orderBy(F.asc_nulls_last("vec_id"), "n").first()
    scaled = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(float(LIMIT))), F.lit(-float(LIMIT))).cast("int")
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    kept = rows.filter(F.size("embedding") == (first["n"] if first else 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label_key"), F.transform("embedding", scaled).alias("ints"))


def first_books(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) from the smallest ids."""
    chosen = [r["ints"] for r in rows.select("vec_id", "ints").orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()]
    if not chosen:
        return np.zeros((PARTS, 0, 0), np.int64)
    return np.array(chosen, np.int64).reshape(len(chosen), PARTS, -1).transpose(1, 0, 2)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - book[None, :, k]
        out += gap * gap
    return out


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its distance, the lower index on ties."""
    all_of = distances(x, book)
    nearest = all_of.argmin(axis=1)
    return nearest, all_of[np.arange(len(x)), nearest]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same result as ``assign`` from an earlier assignment and the entries that moved since."""
    code, distance = code.copy(), distance.copy()
    again = moved[code]
    lost, held, active = np.flatnonzero(again), np.flatnonzero(~again), np.flatnonzero(moved)
    if len(lost):
        code[lost], distance[lost] = assign(x[lost], book)
    if len(held) and len(active):
        near, far = assign(x[held], book[active])
        near = active[near]
        better = (far < distance[held]) | ((far == distance[held]) & (near < code[held]))
        code[held[better]], distance[held[better]] = near[better], far[better]
    return code, distance


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(rows, -1)


def encode(rows: DataFrame, books: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """Rows with code and distance of every part; with the codebooks ``before`` from the codes that rows hold already."""
    moved = None if before is None else (books != before).any(axis=2)

    def run(batch: pa.RecordBatch):
        n = batch.num_rows
        x = _matrix(batch.column("ints"), n).reshape(n, PARTS, -1)
        codes, far = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64)
        held = None if moved is None else (_matrix(batch.column("code"), n), _matrix(batch.column("distance"), n))
        for p in range(PARTS):
            own = np.ascontiguousarray(x[:, p])
            if held is None:
                codes[:, p], far[:, p] = assign(own, books[p])
            else:
                codes[:, p], far[:, p] = reassign(own, books[p], moved[p], held[0][:, p], held[1][:, p])
        edges = pa.array(np.arange(0, n * PARTS + 1, PARTS), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(codes.ravel(), pa.int32())), pa.ListArray.from_arrays(edges, pa.array(far.ravel(), pa.int64()))]
        columns = [batch.column(c) for c in ("vec_id", "label_key", "ints")]
        yield pa.RecordBatch.from_arrays([*columns, *lists], ["vec_id", "label_key", "ints", "code", "distance"])

    common.ship(rows.sparkSession)
    return common.stored(common.map_arrow(rows, run, STATE, "ints"), "vector-codes")


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of its parts."""
    shape = books.shape

    def run(batches):
        sums = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64).reshape(shape[0], shape[1], shape[2] + 1)
        for batch in batches:
            n = batch.num_rows
            x, code = _matrix(batch.column("ints"), n).reshape(n, PARTS, -1), _matrix(batch.column("code"), n)
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                held, first = np.unique(code[order, p], return_index=True)
                if n:
                    sums[p, held, :-1] += np.add.reduceat(x[order, p], first, axis=0)
                    sums[p, held, -1] += np.diff(np.r_[first, n])
        place = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(sums.ravel()[place], pa.int64())], ["place", "total"])

    made = state.select("ints", "code").mapInArrow(run, "place bigint, total bigint").groupBy("place").agg(F.sum("total").alias("total"))
    sums = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for r in made.collect():  # a row for each entry and component
        sums[r["place"]] = r["total"]
    sums = sums.reshape(shape[0], shape[1], shape[2] + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes and distances of all kept vectors (``STATE``), and the final codebooks (part, entry, component)."""
    rows = whole_numbers(vectors)
    books = first_books(rows, entries)
    if not books.size:
        return vectors.sparkSession.createDataFrame([], STATE), books
    state, before = encode(rows, books), books
    for _ in range(rounds):
        books = moved_books(state, before)
        state, before = encode(state, books, before), books
    return state, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hexadecimal, error, error summed over its label, and the digest of the codebooks."""
    state, books = compress(vectors)
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = state.select("vec_id", "label_key", text.alias("code"), F.aggregate("distance", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    totals = common.stored(rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-codes")
    joined = common.join_groups(rows, totals, "label_key", "n", "left")
    single = joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
    return single


def report_sql() -> str:
    """The same rows in DuckDB SQL, every part compared with every entry in each round."""
    size = f"CAST(len(v) / {PARTS} AS BIGINT)"
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS (SELECT vec_id, label, CAST(p AS INTEGER) AS p, v[p * {size} + 1 : (p + 1) * {size}] AS x FROM kept, range({PARTS}) t(p))""",
        f"""b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
 WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))""",
    ]
    for k in range(ROUNDS + 1):
        gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"""d{k} AS (SELECT vec_id, label, p, x, e, CAST({gap} AS BIGINT) AS d FROM parts JOIN b{k} USING (p)),
 a{k} AS (SELECT vec_id, label, p, x, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if k < ROUNDS:
            mean = "SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, 1 + len(x)) r(i) GROUP BY ALL) GROUP BY ALL".format(k=k)
            steps.append(f"m{k} AS ({mean}), b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    last = ROUNDS
    steps.append(f"""books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})""")
    steps.append(f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label)""")
    return f"""WITH {', '.join(steps)}
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""
