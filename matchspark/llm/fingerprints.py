"""Document fingerprints by winnowing, in DataFrame expressions only.

Each k-gram of code points gets its CRC-32, a polynomial (Karp-Rabin) fingerprint that the JVM computes in one
instruction per word; a gram is read by its place in fixed-width code units, so the cost does not grow with its
distance from the start of the text. Of every ``WINDOW`` neighbouring grams the one with the smallest
hash is chosen, the rightmost on ties, and kept with its position: value = hash * 2^31 + (2^31 - 1 - position), so
that one ``least`` decides both. Two texts that share ``GRAM + WINDOW - 1`` code points share a chosen hash.

Texts are cut into runs of ``RUN`` windows, each run one row, so the hashes and minima of a run are straight compiled
code. A text of fewer than ``WINDOW`` grams is one window, one of fewer than ``GRAM`` code points one gram, the
empty text (and NULL) has no fingerprint. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 12
WINDOW = 16
RUN = 32
NOTHING = (1 << 63) - 1
POSITION_BITS = 31


def runs(rows: DataFrame, text: str, about: Column | None = None) -> DataFrame:
    """One row for each run of windows of a text: the other columns, ``run`` (its number) and ``chosen`` values.

    ``about`` is worked out once for each text and stands in the row of run 0.
    """
    others = [c for c in rows.columns if c != text]
    n, gram = F.length(text), F.least(F.length(text), F.lit(GRAM))
    # what belongs to the text as a whole is held in a one-element array while the inner lambda cuts the runs:
    # outside of it, generated code would work it out again for each run
    whole = F.array(F.struct(
        F.encode(text, "UTF-32").alias("units"), gram.alias("gram"), F.when(n > 0, n - gram).otherwise(-1).alias("last"),
        F.greatest(n - gram + 1 - WINDOW, F.lit(0)).alias("end"), (F.lit(0) if about is None else about).alias("about"),
    ))
    cut = F.transform(whole, lambda w: F.transform(
        F.sequence(F.lit(0), w["end"], F.lit(RUN)),
        lambda s: F.struct(
            F.substring(w["units"], 4 * s + 1, F.lit(4 * (RUN + WINDOW - 1 + GRAM - 1))).alias("_units"),
            (4 * w["gram"]).alias("_bytes"),
            ((1 << POSITION_BITS) - 1 - s.cast("long")).alias("_back"),
            (w["last"] - s).alias("_grams"),
            (w["end"] - s).alias("_windows"),
            (s / RUN).cast("int").alias("run"),
            F.when(s == 0, w["about"]).alias("about"),
        ),
    ))[0]
    spread = rows.select(*others, F.inline(cut))
    others = [*others, "run", "about"]
    # a step whose generated code grows too long is not compiled by the JVM: the lambda keeps each step out of
    # whole-stage code, where its expressions are cut into short methods
    windows = F.transform(F.array("_windows"), lambda x: x)[0].alias("_windows")
    names = [f"_h{j}" for j in range(RUN + WINDOW - 1)]
    level = spread.select(*others, windows, *[
        F.expr(f"if({j} <= _grams, shiftleft(crc32(substring(_units, {4 * j + 1}, _bytes)), {POSITION_BITS}) | (_back - {j}L), {NOTHING}L) AS {n}")
        for j, n in enumerate(names)
    ])
    reach = 1
    while reach < WINDOW:
        pairs = list(zip(names, names[reach:]))
        names = [f"_m{reach}_{j}" for j in range(len(pairs))]
        level = level.select(*others, windows, *[F.expr(f"if({a} < {b}, {a}, {b}) AS {n}") for (a, b), n in zip(pairs, names, strict=True)])
        reach *= 2
    chosen = [F.expr(f"if({j} <= _windows, {n}, {names[0]})") for j, n in enumerate(names[:RUN])]
    return level.select(*others, F.array_distinct(F.array(*chosen)).alias("chosen"))


def gather(lists: Column | str) -> Column:
    """All chosen values of a text, in order, from the lists of its runs."""
    return F.array_sort(F.array_remove(F.array_distinct(F.flatten(lists)), F.lit(NOTHING)))


def hashes(chosen: Column | str) -> Column:
    """Distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes by all hashes of two fingerprints; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / F.greatest(either, F.lit(1)))


def digest(chosen: Column) -> Column:
    """Short text form of a fingerprint with its positions: count and 128 bits."""
    parts = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), chosen)), 16, "0")) for seed in (1, 2)]
    return F.concat(F.size(chosen).cast("string"), F.lit("-"), *parts)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and ``chosen`` of every text; repeated rows of one id with one text are one row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("_key", F.xxhash64("text"))
    grouped = runs(keyed, "text").groupBy("doc_id", "_key").agg(F.collect_list("chosen").alias("lists"))
    return grouped.select("doc_id", gather("lists").alias("chosen"))


def with_neighbours(docs: DataFrame, cells: int = 256) -> DataFrame:
    """Rows in cells of neighbouring ids, each cell ending in a copy (``ghost``) of the row that follows it.

    Cells are cut at about even ranks of the id. Their first ids (one number per cell) go to the driver; the
    text is shuffled once, with its cell. NULL ids come first, equal ids follow the order of their texts.
    """
    lowest = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("_id"))
    ids = rows.select("_id")
    cuts = ids.agg(F.percentile_approx("_id", [k / cells for k in range(1, cells)], 20 * cells)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[step - 1 :: step]

    def cell_of(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("_cell", F.lit(0))
        below = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in coarse]), lambda c: c <= F.col("_id"))) * step
        part = F.slice(F.array(*[F.lit(c).cast("long") for c in cuts]), below + 1, F.lit(step))
        return df.withColumn("_cell", below + F.size(F.filter(part, lambda c: c <= F.col("_id"))))

    firsts = {r["_cell"]: r["first"] for r in cell_of(ids).groupBy("_cell").agg(F.min("_id").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[c]: order[k - 1] for k, c in enumerate(order)}
    ghost_of = F.lit(None).cast("int")
    if before:
        ghost_of = F.create_map(*[F.lit(x).cast("long") if k % 2 == 0 else F.lit(x).cast("int") for pair in before.items() for k, x in enumerate(pair)])[F.col("_id")]
    places = F.filter(
        F.array(
            F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("ghost")),
            F.struct(ghost_of.alias("cell"), F.lit(True).alias("ghost")),
        ),
        lambda p: p["cell"].isNotNull(),
    )
    spread = cell_of(rows).select("doc_id", "text", "_id", F.explode(places).alias("p"))
    return spread.select(F.col("p.cell").alias("cell"), F.col("p.ghost").alias("ghost"), "doc_id", "_id", "text")


def compare_with_next(docs: DataFrame, cells: int = 256) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    Edited: the last floor(n/2) code points give way to the first as many of the next document by id; the last
    document is followed by the first, a single one by itself.
    """
    w = Window.partitionBy("cell").orderBy("ghost", "_id", "text")
    placed = with_neighbours(docs, cells).select(
        "cell", "ghost", "doc_id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next_text")
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    kinds = placed.select(
        "cell", "ghost", "place", "doc_id", n.cast("long").alias("n_chars"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))).alias("k"),
    )
    about = F.struct("ghost", "doc_id", "n_chars", F.when(F.col("kind") == 1, F.sha2("t", 256)).alias("sha"))
    texts = kinds.select("cell", "place", "ghost", "doc_id", "n_chars", "k.*").filter("kind = 0 OR NOT ghost")
    slim = runs(texts, "t", about).select("cell", "place", "kind", "chosen", "about")
    per_text = slim.groupBy("cell", "place").agg(
        F.collect_list(F.when(F.col("kind") == 0, F.col("chosen"))).alias("own"),
        F.collect_list(F.when(F.col("kind") == 1, F.col("chosen"))).alias("edited"),
        F.first(F.when(F.col("kind") == 0, F.col("about")), ignorenulls=True).alias("about"),
        F.first(F.when(F.col("kind") == 1, F.col("about.sha")), ignorenulls=True).alias("edited_sha256"),
    )
    prints = per_text.select("cell", "place", "about", "edited_sha256", gather("own").alias("own"), gather("edited").alias("edited"))
    prints = prints.withColumns({"own_hashes": hashes("own"), "edited_hashes": hashes("edited")})
    follow = Window.partitionBy("cell").orderBy("place")
    beside = prints.withColumn("next_hashes", F.lead("own_hashes").over(follow)).filter("NOT about.ghost")
    return beside.select(
        "about.doc_id", "about.n_chars", "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.coalesce("next_hashes", "own_hashes")).alias("near_next"),
    )
