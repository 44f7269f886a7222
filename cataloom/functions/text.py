"""Column functions over text: cleaning, names, tokens, classification, dates and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a product, and keyword tables in order of precedence.
STOPWORDS = ("bowling", "ball", "the", "and", "a", "an", "of", "-", "/")
GENERIC = ("bowling", "ball", "balls", "edition")
MATERIALS = (("urethane", "urethane"), ("polyester", "polyester_plastic"), ("plastic", "polyester_plastic"), ("reactive", "reactive_resin"))
CRAFT_MATERIALS = tuple(m for m in MATERIALS if m[0] != "plastic")
COVERS = (("solid", "solid"), ("pearl", "pearl"), ("hybrid", "hybrid"))
LATE_COVERS = COVERS[::-1]
DATE_FORMATS = {
    "craft": ("MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy"),
    "woo": ("MMMM yyyy", "MMM yyyy"),
    "netsuite": ("M/d/yyyy",),
    "shopify": ("MMMM d, yyyy",),
}


def let(value: Column, body) -> Column:
    """body of the value, which is computed once: inside lambdas each mention of an expression is computed anew, and for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cover_name(c: Column) -> Column:
    return F.nullif(clean(F.regexp_replace(c, "[™®©]", "")), F.lit(""))


def normalize_name(c: Column) -> Column:
    return clean(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def loose_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def token_key(c: Column) -> Column:
    """Canonical key of a name: two names differ in generic words only exactly when their keys are equal."""
    return F.array_join(F.array_sort(F.array_except(loose_tokens(c), F.array(*map(F.lit, GENERIC)))), " ")


def significant_tokens(c: Column) -> Column:
    return F.array_except(loose_tokens(c), F.array(*map(F.lit, STOPWORDS)))


def score_match(title: Column, brand: Column, product: Column) -> Column:
    def hit(name: Column) -> Column:
        return F.exists(significant_tokens(F.coalesce(name, F.lit(""))), lambda t: F.contains(F.lower(title), t))

    return F.when(hit(brand) & hit(product), "high").otherwise("low")


def strip_generic(c: Column) -> Column:
    return F.array_join(F.filter(F.split(clean(c), " "), lambda w: ~F.lower(w).isin(*GENERIC)), " ")


def search_query(brand: Column, product: Column, video: bool = False) -> Column:
    return F.concat_ws(" ", brand, product, *([F.lit("bowling ball")] if video else []))


def slug(c: Column, drop_slash: bool = False) -> Column:
    base = F.lower(F.trim(c))
    return F.regexp_replace(F.regexp_replace(base, "/", "") if drop_slash else base, r"\s+", "-")


def name_and_color(c: Column) -> Column:
    parts = F.split(c, " - ", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("color"))


def resource_key(c: Column) -> Column:
    return F.concat(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("_url"))


def without_brand_code(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(c, "^[SRG]_", ""), F.lit("_"), F.lit(" ")))


def first_keyword(c: Column, table: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    low = F.lower(c)
    out = reduce(lambda w, kv: w.when(F.contains(low, F.lit(kv[0])), kv[1]), table, F.when(F.lit(False), ""))
    return F.when(F.coalesce(low, F.lit("")) != "", out.otherwise(F.lit(default)))


def cover_class(platform: str, name: Column, kind: Column | None = None) -> Column:
    """(material, type) by the platform's own keywords; the platforms differ on purpose."""
    kind = name if kind is None else kind
    both = F.concat_ws(" ", name, kind)
    material, cover = {
        "craft": (first_keyword(name, CRAFT_MATERIALS), first_keyword(name, COVERS)),
        "woo": (first_keyword(kind, MATERIALS), first_keyword(name, COVERS)),
        "netsuite": (first_keyword(name, MATERIALS), first_keyword(name, COVERS)),
        "shopify": (first_keyword(both, MATERIALS), first_keyword(both, COVERS)),
        "commercebuild": (first_keyword(name, MATERIALS[:3], "reactive_resin"), first_keyword(name, LATE_COVERS)),
    }[platform]
    return F.struct(material.alias("material"), cover.alias("type"))


def core_type(c: Column, has_skus: Column | None = None, any_bias: Column | None = None) -> Column:
    said = first_keyword(c, (("asymmetric", "asymmetric"), ("symmetric", "symmetric")))
    if has_skus is None:
        return said
    return F.coalesce(said, F.when(has_skus, F.when(any_bias, "asymmetric").otherwise("symmetric")))


def release_date(c: Column, platform: str) -> Column:
    if platform == "commercebuild":  # two-digit years from 69 on are of the last century
        d = F.try_to_date(c, "M/d/yy")
        return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    text = F.regexp_replace(c, "(?i)^available ", "") if platform == "netsuite" else F.trim(c)
    return F.coalesce(*[F.try_to_date(text, f) for f in DATE_FORMATS[platform]])


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO 8601 duration of hours, minutes and seconds; null if it is none."""
    shape = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, shape, i), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))

    return F.when(c.rlike(shape), part(1) * 3600 + part(2) * 60 + part(3))


def price(c: Column) -> Column:
    """The first amount with cents, else the first whole number."""
    cents, whole = (F.nullif(F.regexp_extract(c, r, 1), F.lit("")) for r in (r"(\d[\d,]*\.\d{2})", r"(\d[\d,]*)"))
    return F.replace(F.coalesce(cents, whole), F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def number(c: Column, signed: bool = True) -> Column:
    return F.nullif(F.regexp_extract(c, r"-?(?:\d+\.?\d*|\.\d+)" if signed else r"[\d.]+", 0), F.lit("")).try_cast("double")


def weight_range(c: Column) -> Column:
    n = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.struct(F.array_min(n).alias("lo"), F.array_max(n).alias("hi"))


def range_text(lo: Column, hi_exclusive: Column) -> Column:
    return F.when(lo.isNotNull() & hi_exclusive.isNotNull(), F.concat(lo.cast("string"), F.lit("-"), (hi_exclusive - 1).cast("string"), F.lit(" lb")))


def status_text(c: Column) -> Column:
    """current or retired from a production status; discontinued and retired count before production."""
    t = F.lower(c)
    return F.when(F.contains(t, F.lit("discontinu")) | F.contains(t, F.lit("retired")), "retired").when(F.contains(t, F.lit("production")), "current")


def url_status(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/products/balls/(current|retired)/", 1), F.lit(""))


def product_type(url: Column) -> Column:
    """bag or shoe by the first category in the URL, else ball."""
    found = F.regexp_extract(url, r"/products/(balls|bags|shoes)/", 1)
    return F.when(found == "bags", "bag").when(found == "shoes", "shoe").otherwise("ball")


def image_type(alt: Column, position: Column) -> Column:
    """By alternative text (performance before core), else main for the first position."""
    t = F.lower(F.coalesce(alt, F.lit("")))
    return F.when(F.contains(t, F.lit("performance")), "performance_badge").when(F.contains(t, F.lit("core")), "core_callout").when(position == 1, "main").otherwise("other")


def callout_weights(url: Column) -> Column:
    """(high, low) of an image whose file name has a weight range of a core."""
    shape = r"(\d{1,2})-(\d{1,2})_lb_Core"
    return F.when(url.rlike(shape), F.struct(*(F.regexp_extract(url, shape, i).try_cast("int").alias(k) for i, k in ((1, "high"), (2, "low")))))


def color_and_part(name: Column, lines: Column) -> Column:
    """(color, part_number) of a bag from its name and part number lines, each cut at its last " - ".

    A single line decides; of several, the one with the color of the name.
    """
    shape = r"(?s)^(.*) - (.*)$"
    title = F.when(name.rlike(shape), F.trim(F.regexp_extract(name, shape, 2)))
    split = lambda x: F.struct(F.trim(F.regexp_extract(x, shape, 2)).alias("color"), F.trim(F.regexp_extract(x, shape, 1)).alias("part_number"))
    parsed = F.transform(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.rlike(shape)), split)
    match = F.get(F.filter(parsed, lambda x: F.lower(x["color"]) == F.lower(title)), F.lit(0))
    alone = F.struct(title.alias("color"), F.lit(None).cast("string").alias("part_number"))
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0))).otherwise(F.coalesce(match, alone))


def breadcrumb_status(trail: Column) -> Column:
    """current or retired by the last but one entry of a trail; null for other categories and short trails."""
    category = F.when(F.size(trail) >= 2, F.get(trail, F.size(trail) - 2))
    return F.when(category == "Bowling Balls", "current").when(category == "Bowling Balls Archive", "retired")


def is_tech_data(href: Column) -> Column:
    name = F.lower(F.element_at(F.split(href, "/"), -1))
    return F.contains(F.regexp_replace(name, r"[\s_\-]|%20", ""), F.lit("techdata"))


def mass_bias(c: Column) -> Column:
    """A number only if the whole text is one."""
    return F.when(F.trim(c).rlike(r"^-?(\d+\.?\d*|\.\d+)$"), F.trim(c).try_cast("double"))


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from base: absolute, of the same scheme, from the root, or from the folder of base; dots aren't resolved."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(root, r"^[^:]*:", 0), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href)).when(href == "", base)
        .when(F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")), F.concat(page, href)).otherwise(F.concat(folder, href))
    )


def summary_prompt(name: Column, summaries: Column, context: Column) -> Column:
    """What is asked about one summary or several, with the context if there is any."""
    head = F.when(F.size(summaries) == 1, F.concat(F.lit("Summarize this review of "), name)).otherwise(F.concat(F.lit("Combine these "), F.size(summaries).cast("string"), F.lit(" reviews of "), name))
    return F.concat_ws("\n\n", head, F.array_join(summaries, "\n---\n"), F.when(context != "", F.concat(F.lit("Context: "), context)))


def iso_date(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(c))


def brand_of_flat_url(url: Column, prefixes: tuple[tuple[str, str], ...]) -> Column:
    """The brand whose prefix comes first among those that the slug of a one-segment URL begins with."""
    slug = F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)/?$", 1)
    out = F.lit(None).cast("string")
    for prefix, brand in reversed(prefixes):
        out = F.when(F.startswith(slug, F.lit(prefix)), brand).otherwise(out)
    return F.when(slug != "", out)


def triage(confidence: Column) -> Column:
    """high for high confidence, low for everything else and for none."""
    return F.when(confidence == "high", "high").otherwise("low")


def first_cost(costs: Column) -> Column:
    """The first cost of an array that is known and not zero."""
    return F.get(F.filter(costs, lambda c: c.isNotNull() & (c != 0)), F.lit(0))
