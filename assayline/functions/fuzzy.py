"""Restricted Damerau-Levenshtein (optimal string alignment) distance with a bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str, bound: int) -> int:
    """The distance, or bound + 1 if it is larger; only cells near the diagonal are filled."""
    bound = max(0, bound)
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    far = bound + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [far] * len(b)
        for j in range(max(1, i - bound), min(len(b), i + bound) + 1):
            y = b[j - 1]
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        before, last = last, now
    return min(last[-1], far)


#: Characters of the pattern that fit the bits of a long, with room for the carry of the sum.
_WORD = 61


def _bits(pattern: Column, text: Column) -> Column:
    """The distance by bit vectors (Hyyrö's form with transpositions), for patterns of 1 to ``_WORD`` characters.

    A column of the distance table is two words: where it rises (vp) and falls (vn). Each character of the text turns
    them into the next column's, and the last row's change is added to the distance.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")

    def folded(bound: Column) -> Column:
        p, t = bound["p"], bound["t"]
        full, top = bound["full"], bound["top"]
        both, any_ = (lambda a, b: a.bitwiseAND(b)), (lambda a, b: a.bitwiseOR(b))
        not_ = lambda a: full.bitwiseXOR(a)
        up = lambda a: both(F.shiftleft(a, 1), full)
        places = lambda c: F.aggregate(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), zero, lambda m, e: F.when(e["x"] == c, any_(m, F.call_function("shiftleft", one, e["i"]))).otherwise(m))
        start = F.struct(full.alias("vp"), zero.alias("vn"), zero.alias("d"), zero.alias("pm"), F.size(p).alias("n"))

        def step(s: Column, c: Column) -> Column:
            with_mask = F.transform(F.array(places(c)), lambda pm: F.struct(pm.alias("pm"), any_(any_(any_(
                both(both(both(pm, s["vp"]) + s["vp"], full).bitwiseXOR(s["vp"]), full), pm), s["vn"]), both(up(both(not_(s["d"]), pm)), s["pm"])).alias("d")))[0]
            return F.transform(F.array(with_mask), lambda w: _next(s, w))[0]

        def _next(s: Column, w: Column) -> Column:
            hp, hn = any_(s["vn"], not_(any_(w["d"], s["vp"]))), both(w["d"], s["vp"])
            x = any_(up(hp), one)
            moved = F.when(both(hp, top) != 0, 1).when(both(hn, top) != 0, -1).otherwise(0)
            return F.struct(any_(up(hn), not_(any_(w["d"], x))).alias("vp"), both(x, w["d"]).alias("vn"), w["d"].alias("d"), w["pm"].alias("pm"), (s["n"] + moved).alias("n"))

        return F.aggregate(t, start, step, lambda s: s["n"])

    n = F.length(pattern)
    words = F.struct(chars(pattern).alias("p"), chars(text).alias("t"), (F.call_function("shiftleft", one, n) - 1).alias("full"), F.call_function("shiftleft", one, n - 1).alias("top"))
    return F.transform(F.array(words), folded)[0]


def _table(a: Column, b: Column) -> Column:
    """The distance by the table's rows, for texts of any length: the last two rows are the fold's state."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")

    def folded(bound: Column) -> Column:
        p, t = bound["p"], bound["t"]
        start = F.struct(F.sequence(F.lit(0), F.size(p)).alias("last"), F.array().cast("array<int>").alias("before"), F.lit("").alias("was"))

        def step(s: Column, c: Column) -> Column:
            def cell(row: Column, j: Column) -> Column:
                x, back = F.get(p, j - 1), F.get(p, j - 2)
                plain = F.least(F.get(s["last"], j) + 1, F.get(row, j - 1) + 1, F.get(s["last"], j - 1) + (x != c).cast("int"))
                turned = F.when((x == s["was"]) & (back == c), F.get(s["before"], j - 2) + 1)
                return F.concat(row, F.array(F.least(plain, F.coalesce(turned, plain))))

            row = F.aggregate(F.sequence(F.lit(1), F.size(p)), F.array(F.get(s["last"], F.lit(0)) + 1), cell)
            return F.struct(F.when(F.size(p) > 0, row).otherwise(F.array(F.get(s["last"], F.lit(0)) + 1)).alias("last"), s["last"].alias("before"), c.alias("was"))

        return F.aggregate(t, start, step, lambda s: F.get(s["last"], F.size(p)))

    return F.transform(F.array(F.struct(chars(a).alias("p"), chars(b).alias("t"))), folded)[0]


def osa_distance(a: Column, b: Column, bound: Column) -> Column:
    """``osa`` of two columns inside the JVM: bit vectors where one side fits a long, else the table."""
    small, large = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    limit = F.greatest(bound, F.lit(0))
    far = F.abs(F.length(a) - F.length(b)) > limit
    exact = F.when(F.length(small) == 0, F.length(large)).when(F.length(small) <= _WORD, _bits(small, large)).otherwise(_table(small, large))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(far, limit + 1).otherwise(F.least(exact, limit + 1)).cast("int")


def deletions(text: Column, most: int) -> Column:
    """The text and what is left of it after up to ``most`` deletions, each once.

    Two texts within k edits, transpositions of neighbours included, share one of these: every edit is undone by a deletion on either side.
    """
    one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, 1, i - 1), F.substr(t, i + 1)))
    found = F.array(text)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, one))))
    return found


def fuzzy_bound(label: Column) -> Column:
    """Edits allowed for a label of this length."""
    n = F.length(label)
    return F.when(n < 5, 0).when(n <= 7, 1).otherwise(2)


def may_be_near(a: Column, b: Column, bound: Column) -> Column:
    """A cheap necessary condition: OSA <= Levenshtein <= 2 * OSA."""
    return (F.abs(F.length(a) - F.length(b)) <= bound) & (F.levenshtein(a, b) <= 2 * bound)
