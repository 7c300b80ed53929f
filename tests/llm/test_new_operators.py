"""Personal data, vector codes and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import FOLDER, ODD, empty, odd
from pyspark.sql import functions as F

from matchspark.llm import common, personal, queries, resampling, vector_codes

# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_personal(text):
    out = [(m.start(), k, m.end()) for k, (kind, rx) in enumerate(PLAIN.items()) for m in re.finditer(rx, text) if holds(kind, m[0])]
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(out))


PERSONAL = [
    "a@b.c_d@e.f.g..h x@y z@-.- .@a.b a@b.c@d.e", "é😀 mail: né.e@x.io, tel +1 (017) 555-7713 +++12345678901 +1()2 +12", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.00255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 79927398713 0000000000000000 12", "+1 555 555 5555 5555 5555", "a@" * 50 + "b.c" + ".d" * 300 + " " + "1-" * 40,
    "x" * 4000 + "@" + "y" * 4000, "9" * 4000, "+1" + "(" * 20000, "e@f.gh " * 700,
]


def test_personal_data_equals_plain_patterns(spark):
    rows = list(enumerate(PERSONAL + [t for _, t in ODD]))
    got = {r.doc_id: r for r in personal.digests(personal.find(odd(spark, rows))).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        want = plain_personal(text or "")
        base = ",".join(s for s in got[k].spans.split(",") if s.split(":")[0] in PLAIN)
        assert base == want, text
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind in PLAIN] == [want.count(kind + ":") for kind in PLAIN]


def test_checksums_and_context_decide(spark):
    texts = {
        1: "pay to IBAN DE89 3704 0044 0532 0130 00 today", 2: "DE89370400440532013001", 3: "GB82WEST12345698765432",
        4: "her SSN is 219-09-9999", 5: "part 219-09-9999", 6: "SSN 000-09-9999", 7: "Card 4111111111111111", 8: "see 4111111111111111",
    }
    got = {r.doc_id: r for r in personal.digests(personal.find(odd(spark, list(texts.items())))).collect()}
    assert (got[1].n_iban, got[2].n_iban, got[3].n_iban) == (1, 0, 1)
    assert (got[1].spans, got[1].scores) == ("iban:12:39", "1.10")
    assert (got[4].n_ssn, got[5].n_ssn, got[6].n_ssn) == (1, 0, 0)
    assert (got[7].scores, got[8].scores) == ("0.90", "0.60")


def test_personal_data_in_sql(spark):
    """The SQL twin on texts that the tables don't hold."""
    import duckdb
    from oracle import differences

    more = ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "GB82WEST12345698765432 GB82 WEST 1234 5698 7654 32 and", "SSN 219-09-9999 x219-09-9998 219-09-9999_", ""]
    rows = list(enumerate(PERSONAL + more)) + [(None, "a@b.de"), (3, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert differences(spark, con, "", lambda *_: personal.digests(personal.find(odd(spark, rows))), queries.SQL["op11_pii"]) == []


def test_op11_pii(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_pii"](spark, FOLDER).collect()}
    docs = common.table(spark, FOLDER, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].base_sha256 == hashlib.sha256(plain_personal(r.text or "").encode()).hexdigest()
    assert personal.digests(personal.find(empty(spark))).count() == 0


# vector codes

def plain_codes(rows, rounds=2):
    """Every part compared with every entry in each round; rows of (vec_id, ints)."""
    rows = sorted(rows)
    width = len(rows[0][1]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(part(v, p)) for _, v in rows[:64]] for p in range(16)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for k in range(rounds + 1):
        held = [[nearest(part(v, p), p) for p in range(16)] for _, v in rows]
        if k == rounds:
            return {i: ("".join(f"{e:02x}" for _, e in h), sum(d for d, _ in h)) for (i, _), h in zip(rows, held, strict=True)}, books
        for p in range(16):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v), h in zip(rows, held, strict=True) if h[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "code", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, distance int")


@pytest.mark.parametrize("n", [1, 5, 300])
def test_codes_equal_full_scans(spark, n):
    rng = np.random.default_rng(n)
    # coarse values, so that many distances tie
    rows = [(7 * k, [float(x) / 64 for x in rng.integers(-3, 4, 32)], int(k % 3) if k % 4 else None) for k in range(n)]
    bad = [(1, None, 1), (2, [], 1), (3, [None] + [0.0] * 31, 1), (4, [float("nan")] * 32, 1), (5, [float("inf")] * 32, 1), (9999, [0.0] * 16, 1), (9998, [0.0] * 17, 1)]
    got = vector_codes.report(vectors(spark, bad + rows)).collect()
    want, books = plain_codes([(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows])
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    labels, total = {i: lab for i, _, lab in rows}, Counter()
    for i, (_, error) in want.items():
        total[labels[i]] += error
    assert all(r.label_error == total[labels[r.vec_id]] for r in got)
    flat = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}


def test_active_entries_give_the_full_answer():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, before = rng.integers(-3, 4, (200, 3)), rng.integers(-3, 4, (12, 3))
        after = before.copy()
        some = rng.random(12) < 0.4
        after[some] += rng.integers(-1, 2, (int(some.sum()), 3))
        code, distance = vector_codes.assign(x, before)
        got = vector_codes.reassign(x, after, (before != after).any(axis=1), code, distance)
        want = vector_codes.assign(x, after)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_vectors_repeat_or_lack(spark):
    rows = [(1, [0.5] * 16, 1), (1, [0.25] * 16, None), (None, [0.5] * 16, None), (2, [1e30] * 16, 5)]
    got = vector_codes.report(vectors(spark, rows)).collect()
    assert len(got) == 4 and sum(r.vec_id is None for r in got) == 1
    assert vector_codes.report(vectors(spark, [])).count() == 0


# importance resampling

def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20):
    s, t = Counter(b for _, x in rows for b in plain_buckets(x)), Counter(b for x in target for b in plain_buckets(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out, order = [], []
    for i, x in rows:
        buckets = plain_buckets(x)
        weight = sum(gain(b) for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(buckets), weight, score, None])
        if len(plain_words(x)) >= least:
            order.append((-score, i is None, i or 0, len(buckets), len(out) - 1))
    for rank, key in enumerate(sorted(order)[: percent * len(order) // 100], 1):
        out[key[-1]][-1] = rank
    return Counter(map(tuple, out))


def test_runs_of_words_have_the_right_crcs():
    texts = ["", "A b", "x" * 70 + " y " + "Z" * 200 + "-é漢😀w", "end", "one2 THREE four\tfive\n", "x" * 64 + " " + "y" * 65, " . "]
    data = [t.encode() for t in texts]
    counts, crcs, there = resampling.runs(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        w = plain_words(text)
        assert n == len(w)
        for size in (1, 2, 3):
            got = [int(c) for c, ok in zip(crcs[size - 1][at : at + n], there[size - 1][at : at + n], strict=True) if ok]
            assert got == [zlib.crc32(" ".join(w[k : k + size]).encode()) for k in range(n - size + 1)]
        at += n


def test_op13_resampling(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, FOLDER, "documents").collect()]
    target = [r.text for r in common.table(spark, FOLDER, "benchmark").collect()]
    got = queries.QUERIES["op13_resampling"](spark, FOLDER)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_resample(rows, target)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_draws_from_odd_rows(spark, percent):
    """NULL ids and texts, repeated rows (also at the cutoff), clashing columns, one text for many ids."""
    text = " ".join(f"w{k}" for k in range(25))
    rows = [*ODD, *[(k // 3, text + f" {k % 2}") for k in range(60)], (None, text), (None, text), (70, None)]
    got = resampling.resample(odd(spark, rows), spark.createDataFrame([("w1 w2", 1), (None, 2)], "text string, score int"), percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_resample(rows, ["w1 w2", None], percent)


def test_draws_from_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), none).count() == 0
    got = resampling.resample(odd(spark, [(1, "a " * 30)]), none, 100).collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(1, 1)]


@pytest.mark.parametrize("k", [1, 2, 999, 5000, 19999, 20000])
def test_kth_key(spark, k):
    rows = spark.range(20000).select((F.hash("id") % 50).cast("long").alias("a"), (F.hash("id", F.lit(1)) % 900).cast("long").alias("b")).repartition(13)
    keys = common.stored(rows, "test", "keys")
    want = sorted((r.a, r.b) for r in keys.collect())
    assert resampling.kth_key(keys, k, few=10) == want[k - 1]
