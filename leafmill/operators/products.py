"""One product record per page, from JSON-LD, OpenGraph or microdata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.markup import attr, inside, page_events, text_of
from leafmill.functions.numbers import price_count, price_number
from leafmill.functions.sqltext import blank_to_null, each, first, fold, keep, let, quote, some
from leafmill.functions.text import ATTRIBUTES, attribute, strip_comments, strip_hidden, strip_space
from leafmill.functions.urls import resolve

FIELDS = {
    "name": "STRING",
    "price": "DOUBLE",
    "currency": "STRING",
    "availability": "STRING",
    "brand": "STRING",
    "sku": "STRING",
    "image": "STRING",
    "rating": "DOUBLE",
    "review_count": "BIGINT",
    "description": "STRING",
    "source": "STRING",
}
NO_PRODUCT = "no structured product data on this page"
NESTING = 3  # arrays and @graph wrappers opened in any case; deeper ones only where some are left

# The script type and the image suffixes that are trusted.
_LD_JSON = quote(
    r"""(?is)<script(?=[^>]*\stype\s*=\s*["']?application/ld\+json["']?[\s>/])[^>]*>(.*?)(?:</script\s*>|\z)"""
)
_IMAGE = quote(r"(?i)^(?:https?://|/)|\.(?:jpe?g|png|gif|webp|avif|svg|bmp|tiff?)(?:[?#]|$)")


def _record(**values: str) -> str:
    cells = [f"CAST({values.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in FIELDS.items()]
    return f"struct({', '.join(cells)})"


def _get(value: str, name: str) -> str:
    return f"try_variant_get({value}, {quote(f'$[{chr(39)}{name}{chr(39)}]')}, 'variant')"


def _is_list(value: str) -> str:
    return f"startswith(coalesce(schema_of_variant({value}), ''), 'ARRAY')"


def _is_object(value: str) -> str:
    return f"startswith(coalesce(schema_of_variant({value}), ''), 'OBJECT')"


def _items(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>')"


def _string(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def _scalar(value: str) -> str:
    """Text of a scalar; lists and objects are not text."""
    return let(
        value,
        lambda v: f"CASE WHEN NOT {_is_list(v)} AND NOT {_is_object(v)} THEN {blank_to_null(strip_space(_string(v)))} END",
    )


def _first_of(value: str, pick) -> str:
    """``pick`` of the value, or of the first list item for which it is not NULL."""

    def choose(v: str) -> str:
        listed = first(keep(each(_items(v), pick), lambda x: f"{x} IS NOT NULL"))
        return f"CASE WHEN {_is_list(v)} THEN {listed} ELSE {pick(v)} END"

    return let(value, choose)


def _is_product(value: str) -> str:
    def named(kind: str) -> str:
        return f"endswith(lower({_string(kind)}), 'product')"

    def test(kind: str) -> str:
        return f"coalesce(CASE WHEN {_is_list(kind)} THEN {some(_items(kind), named)} ELSE {named(kind)} END, false)"

    return let(_get(value, "@type"), test)


def _unwrapped(value: str) -> str:
    """A Product stays as it is; a list or @graph gives its members in order."""
    inner = let(
        _get(value, "@graph"),
        lambda g: f"coalesce({_items(g)}, CASE WHEN {g} IS NOT NULL THEN array({g}) END, CAST(array() AS ARRAY<VARIANT>))",
    )
    return let(
        _items(value),
        lambda items: f"CASE WHEN {items} IS NOT NULL THEN {items} WHEN {_is_product(value)} THEN array({value}) ELSE {inner} END",
    )


def _without_schema(text: str) -> str:
    return let(text, lambda t: f"CASE WHEN startswith({t}, 'http') THEN element_at(split({t}, '/', -1), -1) ELSE {t} END")


def _json_ld_product(html: str) -> str:
    """First Product node of the ld+json scripts in page order; malformed ones skipped."""
    scripts = f"regexp_extract_all({strip_comments(html)}, {_LD_JSON}, 1)"
    nodes = keep(each(scripts, lambda s: f"try_parse_json({s})"), lambda v: f"{v} IS NOT NULL")
    for _ in range(NESTING):
        nodes = f"flatten({each(nodes, _unwrapped)})"

    def wrapped(v: str) -> str:
        return f"({_items(v)} IS NOT NULL OR ({_get(v, '@graph')} IS NOT NULL AND NOT {_is_product(v)}))"

    def opened(left: str) -> str:
        # A page cannot nest deeper than it has opening brackets and graphs.
        rounds = f"sequence(1, greatest(1, regexp_count({html}, {quote(r'\[|@graph')})))"
        step = lambda n, _: f"CASE WHEN {some(n, wrapped)} THEN flatten({each(n, _unwrapped)}) ELSE {n} END"
        return f"CASE WHEN {some(left, wrapped)} THEN {fold(rounds, left, step)} ELSE {left} END"

    return first(keep(let(nodes, opened), _is_product))


def _json_ld_record(node: str) -> str:
    def object_only(value: str) -> str:
        return f"CASE WHEN {_is_object(value)} THEN {value} END"

    def image(value: str) -> str:
        linked = f"coalesce({_scalar(_get(value, 'url'))}, {_scalar(_get(value, 'contentUrl'))})"
        return f"CASE WHEN {_is_object(value)} THEN {linked} ELSE {_scalar(value)} END"

    def brand(value: str) -> str:
        return f"CASE WHEN {_is_object(value)} THEN {_scalar(_get(value, 'name'))} ELSE {_scalar(value)} END"

    def nonzero(value: str) -> str:
        """A scalar, unless it is a number or flag that counts as nothing."""
        nothing = f"schema_of_variant({value}) <> 'STRING' AND {_string(value)} IN ('0', 'false')"
        return f"CASE WHEN {nothing} THEN NULL ELSE {_scalar(value)} END"

    def either(value: str, one: str, two: str) -> str:
        return f"coalesce({let(_get(value, one), nonzero)}, {_scalar(_get(value, two))})"

    def build(p: str) -> str:
        offer, rating = f"{p}.offer", f"{p}.rating"
        return _record(
            name=_scalar(_get(node, "name")),
            price=price_number(_scalar(_get(offer, "price"))),
            currency=_scalar(_get(offer, "priceCurrency")),
            availability=_without_schema(_scalar(_get(offer, "availability"))),
            brand=let(
                _get(node, "brand"),
                lambda b: let(f"CASE WHEN {_is_list(b)} THEN {first(_items(b))} ELSE {b} END", brand),
            ),
            sku=either(node, "sku", "mpn"),
            image=_first_of(_get(node, "image"), image),
            rating=price_number(_scalar(_get(rating, "ratingValue"))),
            review_count=price_count(either(rating, "reviewCount", "ratingCount")),
            description=_scalar(_get(node, "description")),
            source="'json-ld'",
        )

    parts = (
        f"struct({_first_of(_get(node, 'offers'), object_only)} AS offer, "
        f"{let(_get(node, 'aggregateRating'), object_only)} AS rating)"
    )
    return f"CASE WHEN {node} IS NOT NULL THEN {let(parts, build)} END"


def _opengraph_record(html: str) -> str:
    def entry(tag: str) -> str:
        key = f"lower(coalesce({blank_to_null(attribute(tag, 'property'))}, {attribute(tag, 'name')}))"
        return f"struct({key} AS name, {strip_space(attribute(tag, 'content'))} AS content)"

    tags = f"regexp_extract_all({strip_hidden(html)}, {quote('(?is)<meta' + ATTRIBUTES + '>')}, 1)"
    entries = keep(each(tags, entry), lambda e: f"{e}.name IS NOT NULL AND {e}.content IS NOT NULL")

    def build(found: str) -> str:
        def value(name: str) -> str:
            return first(keep(found, lambda e: f"{e}.name = {quote(name)}")) + ".content"

        def either(one: str, two: str) -> str:
            return f"coalesce({blank_to_null(value(one))}, {value(two)})"

        def record(price: str) -> str:
            titled = f"coalesce({value('og:title')}, '') <> '' AND {value('og:type')} <=> 'product'"
            filled = _record(
                name=value("og:title"),
                price=price_number(price),
                currency=either("product:price:currency", "og:price:currency"),
                availability=either("product:availability", "og:availability"),
                brand=value("product:brand"),
                sku=value("product:retailer_item_id"),
                image=value("og:image"),
                description=value("og:description"),
                source="'opengraph'",
            )
            return f"CASE WHEN coalesce({price}, '') <> '' OR ({titled}) THEN {filled} END"

        return let(either("product:price:amount", "og:price:amount"), record)

    return let(entries, build)


def _microdata_record(events: str) -> str:
    """First schema.org Product scope; only the image reads a link attribute."""

    def is_scope(e: str) -> str:
        return f"({e}.kind = 'open' AND coalesce(regexp_like({attr(e, 'itemtype')}, '(?i)schema[.]org/Product'), false))"

    def build(scope: str) -> str:
        def prop(name: str, attributes: tuple[str, ...] = ("content",)) -> str:
            held = keep(inside(events, scope), lambda e: f"{e}.kind = 'open' AND {attr(e, 'itemprop')} <=> {quote(name)}")

            def read(node: str) -> str:
                written = [blank_to_null(strip_space(attr(node, a))) for a in attributes]
                return f"coalesce({', '.join(written)}, {blank_to_null(text_of(events, node, ''))})"

            return first(each(f"slice({held}, 1, 1)", read))

        record = _record(
            name=prop("name"),
            price=price_number(prop("price")),
            currency=prop("priceCurrency"),
            availability=_without_schema(prop("availability")),
            brand=prop("brand"),
            sku=prop("sku"),
            image=prop("image", ("content", "src", "href")),
            description=prop("description"),
            source="'microdata'",
        )
        return f"CASE WHEN {scope} IS NOT NULL THEN {record} END"

    return let(first(keep(events, is_scope)), build)


def clean_image(value: str, url: str) -> str:
    """Absolute image URL, if the value looks like a URL or an image path at all."""
    return f"CASE WHEN NOT contains({value}, ' ') AND regexp_like({value}, {_IMAGE}) THEN {resolve(url, value)} END"


def product_records(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The product record of every page in one pass; ``error`` says where there is none.

    The first source that yields a record wins. Only pages that name a schema.org
    Product and have neither JSON-LD nor OpenGraph data are parsed for microdata.
    """
    keys = ["url", *carry]
    json_ld = f"CASE WHEN contains(lower(html), 'ld+json') THEN {let(_json_ld_product('html'), _json_ld_record)} END"
    opengraph = f"CASE WHEN regexp_like(html, {quote(r'(?i)<meta\s')}) THEN {_opengraph_record('html')} END"
    read = pages.select(*keys, "html", F.expr(f"coalesce({json_ld}, {opengraph})").alias("__linked"))
    needs_scope = F.col("__linked").isNull() & F.col("html").rlike("(?i)schema[.]org/product")
    read = read.withColumn("__events", page_events(F.when(needs_scope, F.col("html")))).drop("html")
    record = f"coalesce(__linked, CASE WHEN size(__events) > 0 THEN {_microdata_record('__events')} END)"
    image = let(blank_to_null(strip_space("__p.image")), lambda v: clean_image(v, "url"))
    columns = [F.expr(image).alias(n) if n == "image" else F.col(f"__p.{n}").alias(n) for n in FIELDS]
    # Exploding an array of at most one record keeps it computed once; a filter on the
    # record would be pushed below its projection and compute it again.
    present = keep(f"array({record})", lambda r: f"{r} IS NOT NULL")
    error = F.when(F.col("__p").isNull(), NO_PRODUCT).alias("error")
    return read.select(*keys, F.explode_outer(F.expr(present)).alias("__p")).select(*keys, *columns, error)


def extract_products(pages: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(product records, errors) of ``product_records``."""
    every = product_records(pages, carry)
    found = every.filter("error IS NULL").drop("error")
    return found, every.filter("error IS NOT NULL").select("url", *carry, "error")
