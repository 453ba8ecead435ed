"""Product resolution against comparing every name with every product."""

import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from ledgerloom.functions import text
from ledgerloom.operators import names, products
from ledgerloom.plans import parties


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def numbers(name):
    return sorted(Decimal(x.replace(",", ".")).normalize() for x in re.findall(r"\d+(?:[.,]\d+)?", name))


def score(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def some_names(seed, n):
    r = random.Random(seed)
    words = ["CANTAL", "AOP", "BAGUETTE", "BLANCHE", "GINGERBEER", "BIO", "JNE", "ED", "ÉTÉ", "x", "AAAAAAA", "ABABAB"]
    out = ["", " ", "A", "AB", "a", "1", "1.50", "VIN 1,5", "VIN 1.50", "VIN 01.5", "AAAAAAAAAAAAAAAAAAAAA", "AAAAAAAAAAAAAAAAAAAAAA"]
    while len(out) < n:
        w = r.choices(words, k=r.randrange(1, 7)) + r.choices(["1L", "1.5L", "x6", "12", ""], k=1)
        r.shuffle(w)
        out.append(" ".join(w))
        edited = list(out[-1])
        for _ in range(r.randrange(1, 4)):
            i = r.randrange(len(edited) + 1)
            edited[i : i + r.randrange(2)] = r.choice(["", "A", "B", " ", "É"])
        out.append("".join(edited))
    return out


@pytest.mark.parametrize("least", [94, 90])
def test_no_pair_is_lost(spark, least):
    r = random.Random(least)
    rows = [(i, r.randrange(2), x) for i, x in enumerate(some_names(least, 260))]
    frame = spark.createDataFrame([*rows, (9999, 0, None)], "id long, supplier_id long, name string").repartition(5)
    got = {(x.read_id, x.known_id): round(x.score, 9) for x in products.alike(frame, frame, least).collect()}
    want = {(i, j): round(score(a, b), 9) for i, s, a in rows for j, t, b in rows if s == t and numbers(a) == numbers(b) and score(a, b) >= least}
    assert got == want and sum(i != j for i, j in want) > 30
    with pytest.raises(ValueError):
        products.alike(frame, frame, 80)


def test_letters_in_common():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abé ") for _ in range(r.randrange(0, 90))) for _ in range(2))
        assert text.common_letters(a, b) == lcs(a, b)


def plain(lines, known, folds):
    """Rounds over all lines and all products; ``folds`` are names as misreadings see them."""
    of, spelled = {}, defaultdict(set)
    for p in known:
        spelled[p.supplier_id, p.product_id].add(folds[p.name])
    for line in lines:
        mine = sorted((p for p in known if p.supplier_id == line.supplier_id), key=lambda p: p.product_id)
        name = (line.name or "").strip().lower()
        same = [p.product_id for p in mine if p.name.strip().lower() == name] if line.name is not None else []
        number = [p.product_id for p in mine if line.ean and p.ean == line.ean]
        like = sorted((-score(line.name, p.name), p.product_id) for p in mine if line.name is not None and numbers(p.name) == numbers(line.name) and score(line.name, p.name) >= 94)
        if same or number or like:
            of[line.line_id] = (same[0], "exact", 0) if same else (number[0], "ean", 0) if number else (like[0][1], "alike", 0)
    for line in lines:
        if line.line_id in of and line.name is not None:
            spelled[line.supplier_id, of[line.line_id][0]].add(folds[line.name])
    n = 0
    while True:
        n += 1
        new = {}
        for line in lines:
            if line.line_id not in of and (line.name or "").strip():
                a = folds[line.name]
                costs = sorted((min(names.misread_cost(a, b, names.budget(a)) for b in s), p) for (supplier, p), s in spelled.items() if supplier == line.supplier_id)
                costs = [c for c in costs if c[0] <= names.budget(a)]
                if costs and (len(costs) == 1 or costs[1][0] - costs[0][0] >= 0.5):
                    new[line.line_id] = (costs[0][1], "misread", n)
        if not new:
            return {line.line_id: of.get(line.line_id, (None, "new", 0)) for line in lines}
        of |= new
        for line in lines:
            if line.line_id in new:
                spelled[line.supplier_id, of[line.line_id][0]].add(folds[line.name])


def fold_all(spark, frames):
    from ledgerloom.functions.text import ocr_fold

    out = {}
    for f in frames:
        out |= {r.name: r.f for r in f.select("name", ocr_fold(f["name"]).alias("f")).distinct().collect()}
    return out


def test_resolve_is_the_plain_rounds(spark):
    known = [(1, 1, "BAGUETTE BLAND", "111"), (2, 1, "GINGERBEER 1L", ""), (3, 1, "GINGERBEER 1L BIO", ""), (4, 2, "BAGUETTE BLAND", ""), (5, 1, "1/16CANTAL AOP ED", ""), (6, 1, "PAIN", "222"), (7, 1, "pain", "")]
    lines = [(1, "AGUETTE BLANC", ""), (2, "AGUETTE BLAND", ""), (3, "BAGUETTE BLAVD", ""), (4, "GUETTE BLANC", ""), (5, "GINGERBEER 1.5L", ""), (6, "1L GINGERBEER", ""), (7, "1/16CANTAL AOP JNE", ""), (8, "Pain ", ""), (9, "something", "222"), (10, None, "111"), (11, None, ""), (12, " ", ""), (13, "GINGERBFER 1L", ""), (14, "UETTE BLANC", ""), (1, "AGUETTE BLANC", "")]
    k = spark.createDataFrame(known, "product_id long, supplier_id long, name string, ean string").repartition(3)
    x = spark.createDataFrame([(i, 1, n, e) for i, n, e in lines], "line_id long, supplier_id long, name string, ean string").repartition(3)
    got = products.resolve(x, k).collect()
    assert len(got) == len(lines)
    want = plain(x.collect(), k.collect(), fold_all(spark, (x, k)))
    assert {r.line_id: (r.product_id, r.how, r.round) for r in got} == want
    assert {want[i][1] for i in (1, 2, 3, 4)} == {"misread"} | ({"alike"} & {want[i][1] for i in (1, 2, 3, 4)}) and want[4][2] > 1 and want[8][:2] == (6, "exact")
    assert products.resolve(x.limit(0), k).count() == 0 and {r.how for r in products.resolve(x, k.limit(0)).collect()} == {"new"}


def test_query_is_the_plain_rounds(spark, data_dir):
    lines, known = parties._printed(spark, data_dir)
    got = parties.products_resolved(spark, data_dir).collect()
    asked = lines.unionByName(parties._half_way(known))
    want = plain(asked.collect(), known.collect(), fold_all(spark, (asked, known)))
    assert {r.line_id: (r.product_id, r.how, r.round) for r in got} == want
    kinds = Counter(v[1] for v in want.values())
    assert min(kinds[k] for k in ("exact", "ean", "alike", "misread", "new")) > 3 and max(v[2] for v in want.values()) > 1
