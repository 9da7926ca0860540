"""Texts as numbers, without loss, where a column's texts have few forms: what comes before the number at their end, and whether it is filled up with noughts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms of a column's texts, at most, that are told apart by a number; digits of a number, at most; texts from which a column is known to have more forms.
FORMS, DIGITS, FIRST = 256, 13, 10_000
#: What a number follows.
BEFORE = (":", "#")


def _number(digits: Column, width: int = 0) -> Column:
    """The number that digits are, plainly or filled up to a width; null for other texts."""
    n = digits.try_cast("long")
    same = (n >= 0) & (n < 10**DIGITS) & ((n.cast("string") if width == 0 else F.lpad(n.cast("string"), width, "0")) == digits)
    return F.when(same & F.startswith(digits, F.lit("0")) if width else same, n)


def forms_of(df: DataFrame, column: str) -> DataFrame:
    """(form): a text's width of the number at its end (0: plain, -1: none) and what is before it, for each row; null for null."""
    c, tail = F.col(column), F.lit(None).cast("string")
    for mark in reversed(BEFORE):
        tail = F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, -1)).otherwise(tail)
    # step by step, so that each is made once a row
    steps = df.select(c, tail.alias("_tail")).withColumn("_n", F.col("_tail").try_cast("long")).withColumn("_text", F.col("_n").cast("string")).withColumn("_size", F.length("_tail"))
    known = (F.col("_n") >= 0) & (F.col("_n") < 10**DIGITS)
    plain = F.col("_text") == F.col("_tail")
    filled = F.startswith("_tail", F.lit("0")) & (F.col("_size") <= DIGITS) & (F.lpad("_text", F.greatest("_size", F.lit(1)), F.lit("0")) == F.col("_tail"))
    width = F.when(known & plain, 0).when(known & filled, F.col("_size")).otherwise(-1)
    steps = steps.withColumn("_width", width)
    head = F.when(F.col("_width") < 0, c).otherwise(F.substr(c, F.lit(1), F.length(c) - F.col("_size")))
    return steps.select(F.concat(F.col("_width").cast("string"), F.lit("|"), head).alias("form"))


@dataclass(frozen=True)
class Coding:
    """The forms of one or more columns' texts, in order, those without a number first: a text is its number, shifted by their bits, and its form's place."""

    forms: tuple[str, ...]

    @property
    def bits(self) -> int:
        return max(len(self.forms) - 1, 0).bit_length()

    @property
    def parts(self) -> list[tuple[int, str]]:
        return [(int(w), head) for w, _, head in (x.partition("|") for x in self.forms)]

    def code(self, c: Column) -> Column:
        """A text's number; null for null and for texts of other forms, which are none of the columns'."""
        whole, out = [head for w, head in self.parts if w < 0], None
        for place, (w, head) in enumerate(self.parts):
            if w >= 0:
                number = _number(F.substr(c, F.lit(len(head) + 1)), w)
                n = F.when(F.startswith(c, F.lit(head)), F.shiftleft(number, self.bits).bitwiseOR(F.lit(place).cast("long")))
                out = n if out is None else F.coalesce(out, n)
        if whole:
            at = F.array_position(F.array(*[F.lit(x) for x in whole]), c).cast("long") - 1
            n = F.when(at >= 0, at)
            out = n if out is None else F.coalesce(out, n)
        return F.lit(None).cast("long") if out is None else out

    def text(self, c: Column) -> Column:
        """The text that code has made a number."""
        parts, number = self.parts, F.shiftright(c, self.bits)

        def told(w: int, head: str) -> Column:
            digits = number.cast("string") if w == 0 else F.lpad(number.cast("string"), w, "0")
            return F.lit(head) if w < 0 else F.concat(F.lit(head), digits)

        if not parts:
            return F.lit(None).cast("string")
        if len(parts) == 1:
            return F.when(c.isNotNull(), told(*parts[0]))
        place, whole = c.bitwiseAND(F.lit((1 << self.bits) - 1).cast("long")), [head for w, head in parts if w < 0]
        out = F.when(place < len(whole), F.element_at(F.array(*[F.lit(h) for h in whole]), F.least(place, F.lit(len(whole) - 1)).cast("int") + 1)) if whole else None
        for i, p in enumerate(parts[len(whole) :], len(whole)):
            out = F.when(place == i, told(*p)) if out is None else out.when(place == i, told(*p))
        return out


def codings(df: DataFrame, groups: list[list[str]]) -> list[Coding | None]:
    """For each group of columns that are to share a coding the one of their texts; None where they have more than FORMS forms, or where others' are too many to be told.

    A column's first texts tell most forms, and most columns that have too many; only texts of others are looked at again.
    FORMS a group, at most, reach the driver.
    """
    if not groups:
        return []

    def told(df: DataFrame, known: dict[int, Coding], most: int) -> dict[int, set[str]] | None:
        every = None
        for i in known:
            for c in groups[i]:
                some = forms_of(df.select(c).where(F.col(c).isNotNull() & known[i].code(F.col(c)).isNull()), c).select(F.lit(i).alias("i"), "form")
                every = some if every is None else every.union(some)
        rows = every.distinct().limit(most + 1).collect()
        found: dict[int, set[str]] = {i: set(known[i].forms) for i in known}
        for r in rows:
            found[r["i"]].add(r["form"])
        return found if len(rows) <= most else None

    def coding(forms: set[str]) -> Coding:
        return Coding(tuple(sorted(forms, key=lambda form: (not form.startswith("-1|"), form))))

    first = told(df.select(*dict.fromkeys(c for g in groups for c in g)).limit(FIRST), {i: Coding(()) for i in range(len(groups))}, FIRST * sum(map(len, groups)))
    few = {i: coding(forms) for i, forms in first.items() if len(forms) <= FORMS}
    found = (told(df, few, FORMS * len(few)) if few else {}) or {}
    return [coding(found[i]) if i in found and len(found[i]) <= FORMS else None for i in range(len(groups))]
