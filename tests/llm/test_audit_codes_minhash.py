"""Filter audit, vector codes and MinHash against plain restatements; edge cases of each."""

import hashlib
import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from momentloom.llm import filter_audit, jaccard, minhash, queries, vector_codes
from tests.llm.test_llm import EDGES, SF, brute_components
from tests.oracle import duck_rows, rows_of


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_vector_codes", "op13_minhash"])
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == duck_rows(queries.SQL[name], SF)


def plain_audit(rows, labels):
    """rows: (id, text, part). Every order walked document by document."""
    by_text = {}
    for i, t, _ in rows:
        if i is not None:
            by_text[t or ""] = min(i, by_text.get(t or "", i))
    docs = []
    for i, t, p in rows:
        t = t or ""
        words = [w for w in t.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > by_text[t]}
        docs.append((p or "", {k for k, v in fails.items() if v}, *(max([x[k] == 1 for x in labels if x[0] == i and i is not None], default=False) for k in (1, 2))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone, stay = [d for d in left if letter in d[1]], [d for d in left if letter not in d[1]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = (len(stay), len(gone), sum(letter in d[1] for d in own) - len(gone), sum(d[1] == {letter} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
                left = stay
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, total[order[step - 1]])
    return out


def test_filter_audit_against_plain_walk(spark):
    rng = random.Random(3)
    pool = ["", None, "A B C", "word " * 120, " ".join(map(str, range(150))), " ".join(f"W{k}X" for k in range(140)), "x # y", "  \x1c a　b ", " ".join(f"k{k}&" for k in range(101))]
    rows = [(rng.choice([*range(40), None]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(150)] + [(41, "tail " * 30_000, "fr"), (42, "é" * 9 + "A", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 50, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, h1 string, n int").repartition(5)
    found = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(df, found).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 600 * 4
    assert filter_audit.filter_audit(df.filter("false"), found).count() == 0
    assert all(r.good_lost == 0 for r in filter_audit.filter_audit(df, found.filter("false")).collect())


def test_removal_polynomials():
    rng = random.Random(1)
    counts = [rng.randint(0, 9) for _ in range(32)]
    p = filter_audit.removal_polynomial(counts)
    removed = [sum(n for m, n in enumerate(counts) if m & s) for s in range(32)]
    assert [filter_audit.at_corner(p, s) for s in range(32)] == removed
    for k in range(5):
        share = sum((Fraction(n, m.bit_count()) for m, n in enumerate(counts) if m >> k & 1), Fraction(0))
        assert filter_audit.integral(filter_audit.partial_on_diagonal(p, k)) == share


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label), whole ones only; plain integers."""
    ints = sorted(((i is None, i or 0, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], lab) for i, v, lab in rows), key=lambda r: r[:3])
    width = len(ints[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[2])[p] for r in ints[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for p, x in enumerate(cut(r[2]))] for r in ints]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [cut(r[2])[p] for r, c in zip(ints, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    error = [sum(far(x, books[p][c[p]]) for p, x in enumerate(cut(r[2]))) for r, c in zip(ints, codes, strict=True)]
    by_label = {}
    for r, e in zip(ints, error, strict=True):
        by_label[r[3]] = by_label.get(r[3], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(None if r[0] else r[1]), bytes(c).hex(), e, by_label[r[3]], digest) for r, c, e in zip(ints, codes, error, strict=True))


@pytest.mark.parametrize("spread, rounds", [(0.01, 4), (0.5, 4), (3.0, 2), (0.5, 0)])
def test_vector_codes_against_plain_lloyd(spark, spread, rounds):
    """Small spreads make many equal integers: ties and equal entries."""
    rng = np.random.default_rng(int(spread * 100))
    rows = [(k, (rng.normal(0, spread, 8) + rng.integers(0, 3)).astype(np.float32).tolist(), int(rng.integers(3)) if k % 7 else None) for k in range(150)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[5][1], 2), (500, [0.0] * 8, 9)]
    bad = [(600, None, 1), (601, [float("nan")] + [0.0] * 7, 1), (602, [float("inf")] + [0.0] * 7, 1), (603, [None] + [0.0] * 7, None)]
    df = spark.createDataFrame([(i, v, lab, "x", "c") for i, v, lab in rows + bad], "vec_id long, embedding array<float>, label int, x string, code string").repartition(4)
    got = vector_codes.vector_codes(df, entries=16, rounds=rounds).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, 4, 16, rounds, 1024)


def test_vector_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(1, [0.5, 1.0, 1.5, 2.0], 1), (2, [0.5], None), (3, [], 1)], schema)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.vector_codes(few).collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, None), 3: (None, None, 0)}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5, 1.0, 1.5], 1)], schema))
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1)], schema)).collect()


def test_bounds_spare_scans_and_never_change_a_code():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 30, (400, 5)) for c in rng.normal(0, 400, (20, 5))]).astype(np.int64)
    now, before = x[rng.choice(len(x), 32, replace=False)][None].copy(), None
    code, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
    scans = []
    for _ in range(8):
        books = vector_codes.Books(now, before)
        scans.append(books.assign(0, x, code, upper, lower))
        d = ((x[:, None] - now[0][None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        assert (upper**2 >= d[np.arange(len(x)), code]).all()
        before, now = now, now.copy()
        for e in range(32):
            if (code == e).any():
                now[0, e] = x[code == e].sum(0) // (code == e).sum()
    assert scans[0] == len(x) and scans[-1] < len(x) / 4


def test_minhash_against_all_pairs(spark):
    rng = random.Random(8)
    rows, base = [], [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(90)]
    for i in range(160):
        words = list(base) if i % 3 else [rng.choice("qrstuvwxyz") * rng.randint(1, 5) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            if words:
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One  TWO"), (204, "w " * 3000), (205, "one"), (206, " ".join(map(str, range(40_000))))]
    df = spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, n int, kept boolean").repartition(3)
    for width, threshold, block in ((3, 85, 2000), (3, 85, 9), (5, 80, 2000)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_components(df, width=width, threshold=threshold, block=block).collect()}
        assert got == {i: (n, c, i == c) for i, (n, c) in brute_components(rows, width, threshold).items()}


def test_minhash_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in EDGES], "doc_id long, text string")
    got = minhash.minhash_components(df).collect()
    assert len(got) == len(EDGES) and all((r.component_id is None) == (r.doc_id is None) for r in got)
    assert minhash.minhash_components(df.filter("false")).count() == 0


def test_signatures_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    n = minhash.bands(85)
    assert n == 32 and 60 < minhash.least_agreeing(85) < 100
    words = lambda s: np.frombuffer(minhash.signature(s, 85) + jaccard.parity_bitmap(s), np.uint64)[None]
    for size in (40, 400):
        for _ in range(60):
            common, own = rng.integers(0, 1 << 63, size, np.uint64), rng.integers(0, 1 << 63, 2 * (size * 15 // 200), np.uint64)
            x, y = (words(np.concatenate([common[: size - len(own)], o])) for o in np.split(own, 2))
            total = np.array([2 * size - len(own)])
            assert minhash.signature_bound(x, y, total, 85)[0] and minhash.signature_bound(x, y[0], total, 85)[0] and (x == y)[:, :n].any()
    far = [words(rng.integers(0, 1 << 63, 200, np.uint64)) for _ in range(40)]
    assert not any(minhash.signature_bound(a, b, np.array([400]), 85)[0] or (a == b)[:, :n].any() for a, b in zip(far, far[1:], strict=False))
