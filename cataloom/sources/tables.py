"""Tables of pages and documents turned into SKU rows and product fields. Column expressions only.

A table is an array of rows, each an array of cell texts. SKU rows are (weight_lbs, rg, differential, mass_bias).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

TABLE = "array<array<string>>"
# What names a weight, and the labels of the metrics.
WEIGHT_CELL = r"^\s*\d{1,2}\s*(?i:lbs?)\.?\s*$"
WEIGHT_HEADER = r"(\d{1,2})\s*(?i:lb)"
WEIGHT_TOKEN = r"(\d{1,2})\s*lbs?"
WEIGHT_LINE = r"(?:\d{1,2}\s*lbs?\s*){2,}"
SHEET_NUMBER = r"-?\d+\.\d+"
METRICS = {"rg": ("rg",), "differential": ("diff", "differential"), "mass_bias": ("psa", "mb", "massbias")}
TEXT_ROW = r"(?m)^\d{1,2}\s+(?:-?\d*\.\d+|-?\d+)\s+(?:-?\d*\.\d+|-?\d+)(?:\s+(?:-?\d*\.\d+|-?\d+))?\s*$"
NUMBER = r"-?(?:\d+\.?\d*|\.\d+)"
SUBLABEL = r"^(?i:RG\s+(?:MAX|INT|MIN|DIFF|ASY)\b)"


def to_number(c: Column) -> Column:
    """The first number of a text."""
    return F.regexp_extract(c, NUMBER, 0).try_cast("double")


def sheet_number(c: Column) -> Column:
    """The first number of a text that has digits on both sides of a point; .050 and 16 are none."""
    return F.nullif(F.regexp_extract(c, SHEET_NUMBER, 0), F.lit("")).try_cast("double")


def _whole(c: Column) -> Column:
    return F.regexp_extract(c, r"\d{1,2}", 0).try_cast("int")


def _sku(weight: Column, rg: Column, differential: Column, bias: Column) -> Column:
    return F.struct(weight.alias("weight_lbs"), rg.alias("rg"), differential.alias("differential"), bias.alias("mass_bias"))


def _filled(row: Column) -> Column:
    """The cells of a row that aren't blank, trimmed."""
    return F.filter(F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def html_tables(html: Column) -> Column:
    """All tables of a page, none for null; tables within tables aren't told apart."""

    def clean(c: Column) -> Column:
        bare = F.regexp_replace(c, r"(?s)<[^>]*>", "")
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(name), F.lit(char))
        return F.trim(F.regexp_replace(bare, r"\s+", " "))

    def parts(c: Column, tag: str) -> Column:
        return F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))

    made = F.transform(parts(html, "table"), lambda t: F.transform(parts(t, "tr"), lambda r: F.transform(parts(r, "t[hd]"), clean)))
    return F.coalesce(made, F.array().cast(f"array<{TABLE}>"))


def spec_table(tables: Column, labels: tuple[str, ...], least: int = 3) -> Column:
    """The first of the tables with most rows that begin with a known label, if it has enough; else null."""
    known = F.array(*map(F.lit, labels))
    hits = lambda t: F.size(F.filter(t, lambda r: F.array_contains(known, F.lower(F.coalesce(F.get(r, 0), F.lit(""))))))
    scored = F.transform(tables, lambda t, i: F.struct(hits(t).alias("n"), (-i).alias("at"), t.alias("rows")))
    return F.array_max(F.filter(scored, lambda s: s["n"] >= least))["rows"]


def first_table(tables: Column, labels: tuple[str, ...], least: int = 4) -> Column:
    """The first of the tables with least rows or more that begin with a known label; null if none."""
    known = F.array(*map(F.lit, labels))
    return F.get(F.filter(tables, lambda t: F.size(F.filter(t, lambda r: F.array_contains(known, F.lower(F.coalesce(F.get(r, 0), F.lit("")))))) >= least), 0)


def spec_fields(table: Column, labels: tuple[str, ...]) -> Column:
    """Map of known labels to values from rows of two cells or more; of equal labels the last counts."""

    def entry(label: Column) -> Column:
        return F.struct(label.alias("k"), _last(F.filter(table, lambda r: (F.size(r) >= 2) & (F.lower(F.get(r, 0)) == label)))[1].alias("v"))

    return F.map_from_entries(F.filter(F.transform(F.array(*map(F.lit, labels)), entry), lambda e: e["v"].isNotNull()))


def core_numbers(tables: Column) -> Column:
    """SKU rows of the first table whose first row names two weights or more; a weight without rg and differential is left out."""
    headed = F.filter(tables, lambda t: F.size(F.filter(F.coalesce(F.get(t, 0), F.array().cast("array<string>")), lambda c: c.rlike(WEIGHT_HEADER))) >= 2)

    def rows(t: Column) -> Column:
        def named(label: str) -> Column:
            return _last(F.filter(F.slice(t, F.lit(2), F.size(t)), lambda r: F.lower(F.get(r, 0)) == label)).alias(label)

        def sku(c: Column, i: Column, of: Column) -> Column:
            value = lambda label: F.nullif(F.get(of[label], i), F.lit(""))
            diff, bias = F.coalesce(value("diff"), value("differential")), F.coalesce(value("asy"), value("mb"))
            known = c.rlike(WEIGHT_HEADER) & (value("rg").isNotNull() | diff.isNotNull())
            return F.when(known, _sku(F.regexp_extract(c, WEIGHT_HEADER, 1).try_cast("int"), to_number(value("rg")), to_number(diff), to_number(bias)))

        metrics = F.struct(*map(named, ("rg", "diff", "differential", "asy", "mb")))
        return let(metrics, lambda of: F.filter(F.transform(F.get(t, 0), lambda c, i: sku(c, i, of)), lambda s: s.isNotNull()))

    return let(F.get(headed, 0), rows)


def grid_skus(table: Column) -> Column:
    """SKU rows of a table with its weights in a header row or, where none is, with one weight a row.

    A header row has two filled cells or more, all of them weights; each of its columns is a SKU, also without values. In a
    row of its own, a weight that stands beside another is skipped.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    weight = lambda c: c.rlike(WEIGHT_CELL)

    def read(r: Column) -> Column:
        return let(_filled(r), lambda filled: F.struct(r.alias("cells"), filled.alias("filled")))

    def by_column(rows: Column, header: Column) -> Column:
        def metric(field: str, i: Column, named: Column) -> Column:
            names = F.array(*map(F.lit, METRICS[field]))
            return to_number(F.get(_last(F.filter(named, lambda x: F.array_contains(names, x["name"]) & ~blank(F.get(x["cells"], i))))["cells"], i))

        def skus(named: Column) -> Column:
            return F.transform(header, lambda c, i: F.when(~blank(c), _sku(_whole(c), *(metric(f, i, named) for f in METRICS))))

        name = lambda x: F.regexp_replace(F.lower(F.coalesce(F.get(x["filled"], 0), F.lit(""))), "[^a-z]", "")
        return let(F.transform(rows, lambda x: F.struct(name(x).alias("name"), x["cells"].alias("cells"))), skus)

    def by_row(rows: Column) -> Column:
        def long(r: Column, at: Column) -> Column:
            def sku(others: Column) -> Column:
                return F.when(~F.exists(others, weight), _sku(_whole(F.get(r, at)), *(to_number(F.get(others, F.lit(k))) for k in range(3))))

            return F.when(weight(F.coalesce(F.get(r, at), F.lit(""))), let(_filled(F.filter(r, lambda c, i: i != at)), sku))

        weight_at = lambda x: F.array_position(F.transform(x["cells"], lambda c: weight(F.coalesce(c, F.lit("")))), F.lit(True))
        first = F.get(F.filter(F.transform(rows, weight_at), lambda i: i > 0), 0).cast("int") - 1
        return let(first, lambda at: F.transform(rows, lambda x: long(x["cells"], at)))

    def skus(rows: Column) -> Column:
        header = F.get(F.filter(rows, lambda x: (F.size(x["filled"]) >= 2) & F.forall(x["filled"], weight)), 0)["cells"]
        return let(header, lambda h: F.filter(F.when(h.isNotNull(), by_column(rows, h)).otherwise(by_row(rows)), lambda s: s.isNotNull()))

    return let(F.transform(table, read), skus)


def text_skus(text: Column) -> Column:
    """SKU rows of lines that hold a weight, rg, differential and perhaps a mass bias, and nothing else."""

    def sku(line: Column) -> Column:
        n = F.split(F.trim(line), r"\s+")
        return _sku(F.get(n, 0).try_cast("int"), *(F.get(n, F.lit(k)).try_cast("double") for k in (1, 2, 3)))

    return F.transform(F.regexp_extract_all(text, F.lit(TEXT_ROW), F.lit(0)), sku)


def weight_table(text: Column) -> Column:
    """SKU rows from a line of two weights or more and lines that begin RG, DIFF and ASY, the last of each.

    The weights stand side by side, or the line holds nothing but weights and commas. Lines RG MIN, RG DIFF and RG ASY come
    before RG, DIFF and ASY. A value needs digits on both sides of its point, else it is unknown. A weight without rg and
    differential is left out.
    """
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    tokens = lambda x: F.regexp_extract_all(x, F.lit(WEIGHT_TOKEN), F.lit(1))
    heads = lambda x: x.rlike(WEIGHT_LINE) | F.replace(x, F.lit(","), F.lit("")).rlike(f"^{WEIGHT_LINE}$")
    weights = tokens(F.get(F.filter(lines, heads), 0))

    def values(label: str, legacy: str) -> Column:
        old = _last(F.filter(lines, lambda x: x.rlike(rf"^(?i:RG\s+{legacy}\b)")))
        bare = _last(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{label} ")) & ~x.rlike(SUBLABEL)))
        rest = F.coalesce(F.regexp_replace(old, rf"^(?i:RG\s+{legacy}\b)", ""), F.substr(bare, F.lit(len(label) + 2)))
        return F.transform(F.filter(F.split(rest, r"\s+"), lambda x: x != ""), sheet_number)

    rg, diff, asy = values("RG", "MIN"), values("DIFF", "DIFF"), values("ASY", "ASY")
    made = F.transform(weights, lambda w, i: _sku(w.try_cast("int"), F.get(rg, i), F.get(diff, i), F.get(asy, i)))
    return F.filter(made, lambda s: s["rg"].isNotNull() | s["differential"].isNotNull())


def image_urls(sources: Column, least_width: int = 300) -> Column:
    """Distinct URLs of array<struct<src, srcset>> in order: no inline data, none whose widest entry is under least_width."""

    def widest(s: Column) -> Column:
        n = F.transform(F.regexp_extract_all(s["srcset"], F.lit(r"\s(\d+)w"), F.lit(1)), lambda x: x.try_cast("int"))
        return F.array_max(n)

    good = F.filter(sources, lambda s: s["src"].isNotNull() & ~F.startswith(s["src"], F.lit("data:")) & (F.coalesce(widest(s), F.lit(least_width)) >= least_width))
    return F.array_distinct(F.transform(good, lambda s: s["src"]))
