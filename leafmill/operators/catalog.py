"""Shop catalogues captured as JSON pages: paging rule, variants, collections, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.numbers import catalog_number
from leafmill.sources.captures import latest_captures

# Fixed value: items of a full page of the catalogue endpoint.
PAGE_SIZE = 250

PRODUCTS = (
    "struct<products:array<struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,"
    "tags:string,images:array<struct<src:string>>,variants:array<struct<id:bigint,title:string,sku:string,"
    "price:string,compare_at_price:string,available:string,option1:string,option2:string,option3:string>>>>>"
)
COLLECTIONS = "struct<collections:array<struct<title:string,handle:string,products_count:int>>>"


def store_base(store_url: Column) -> Column:
    url = F.trim(store_url)
    full = F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.concat(F.rtrim(full, F.lit("/")), F.lit("/"))


def _store_root(store_url: Column) -> Column:
    """Scheme and host, which a rooted path replaces everything after."""
    return F.regexp_extract(store_base(store_url), r"^(https?://[^/?#]*)", 1)


def page_series(
    pages: DataFrame, key: str, schema: str, page_size: int = PAGE_SIZE, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of each store's captured pages, read in page order, each by its latest capture.

    Reading stops after a short page, before an empty or uncaptured one, or once ``limit``
    items are in. A 404, another refusal or a body that is not JSON on a page that is reached
    makes the whole store an error.

    Page numbers, sizes and states are all that is ordered per store, in a window over slim
    rows. Bodies stay where they were scanned and meet the verdict on their page in a join.
    """
    body = F.col("body")
    parsed = F.when(F.col("status_code") == 200, F.try_parse_json(body))
    items = F.when(parsed.isNotNull(), F.from_json(body, schema)[key])
    problem = (
        F.when(F.col("status_code") == 404, F.lit("not_exposed"))
        .when(F.col("status_code") != 200, F.concat(F.lit("http_"), F.col("status_code").cast("string")))
        .when(parsed.isNull(), F.lit("not_json"))
    )
    seen = [F.col("seen_at")] if "seen_at" in pages.columns else []
    read = pages.filter(F.col("page") >= 1).select(
        "store_url", F.col("page").cast("int").alias("page"), *seen, problem.alias("problem"), items.alias("items")
    )
    read = latest_captures(read, "store_url", "page")
    sizes = read.groupBy("store_url", "page").agg(
        F.max(F.coalesce(F.size("items"), F.lit(0))).alias("n"), F.max("problem").alias("problem")
    )
    by_page = Window.partitionBy("store_url").orderBy("page")
    earlier = by_page.rowsBetween(Window.unboundedPreceding, -1)
    last = (F.col("n") < page_size) | F.col("problem").isNotNull()
    placed = sizes.select(
        "store_url", "page", "n", "problem", F.row_number().over(by_page).alias("rank"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.coalesce(F.max(last).over(earlier), F.lit(False)).alias("ended"),
    )
    # Pages are numbered from 1 without a gap as long as a page's number is its rank.
    reached = placed.filter((F.col("page") == F.col("rank")) & ~F.col("ended"))
    if limit is not None:
        reached = reached.filter(F.col("start") < limit)
    failed = reached.filter(F.col("problem").isNotNull())
    errors = failed.select("store_url", _message(key).alias("error"))
    good = reached.filter(F.col("problem").isNull()).join(failed.select("store_url"), "store_url", "left_anti")
    kept = read.join(good.select("store_url", "page", "start"), ["store_url", "page"])
    rows = kept.select("store_url", "page", "start", F.posexplode("items").alias("i", "item"))
    if limit is not None:
        rows = rows.filter(F.col("start") + F.col("i") < limit)
    return rows.select("store_url", "page", (F.col("start") + F.col("i")).cast("int").alias("pos"), "item"), errors


def _message(key: str) -> Column:
    base, endpoint = store_base(F.col("store_url")), f"{key}.json"
    return (
        F.when(
            F.col("problem") == "not_exposed",
            F.concat(base, F.lit(f" has no {endpoint}, so it is no store of this kind")),
        )
        .when(F.col("problem") == "not_json", F.concat(base, F.lit(endpoint), F.lit(" is not JSON")))
        .otherwise(
            F.concat(base, F.lit(endpoint), F.lit(" answered with status "), F.regexp_replace("problem", "^http_", ""))
        )
    )


def store_products(pages: DataFrame, page_size: int = PAGE_SIZE, max_products: int | None = None):
    return page_series(pages, "products", PRODUCTS, page_size, max_products)


def variant_rows(products: DataFrame) -> DataFrame:
    """One row per variant; a product without variants gives none."""
    p, v = F.col("item"), F.col("variant")
    tags = F.when(p["tags"].startswith("["), F.array_join(F.from_json(p["tags"], "array<string>"), ", ")).otherwise(
        p["tags"]
    )
    options = F.concat_ws(" / ", *[F.nullif(v[f"option{i}"], F.lit("")) for i in (1, 2, 3)])
    handle = F.nullif(p["handle"], F.lit(""))
    rows = products.select("store_url", "pos", "item", F.explode(p["variants"]).alias("variant"))
    return rows.select(
        "store_url",
        p["title"].alias("product_title"),
        v["title"].alias("variant_title"),
        F.nullif(v["sku"], F.lit("")).alias("sku"),
        F.expr(catalog_number("variant.price")).alias("price"),
        F.expr(catalog_number("variant.compare_at_price")).alias("compare_at_price"),
        F.coalesce(~v["available"].isin("false", "", "0"), F.lit(False)).alias("available"),
        F.nullif(options, F.lit("")).alias("options"),
        p["vendor"].alias("vendor"),
        p["product_type"].alias("product_type"),
        tags.alias("tags"),
        F.get(p["images"], F.lit(0))["src"].alias("image"),
        F.concat(_store_root(F.col("store_url")), F.lit("/products/"), handle).alias("product_url"),
        p["id"].alias("product_id"),
        v["id"].alias("variant_id"),
    )


def collections(pages: DataFrame, page_size: int = PAGE_SIZE, max_collections: int | None = None):
    """(collections with counts and URL, errors)."""
    rows, errors = page_series(pages, "collections", COLLECTIONS, page_size, max_collections)
    c = F.col("item")
    listed = rows.select(
        "store_url",
        c["title"].alias("title"),
        c["handle"].alias("handle"),
        c["products_count"].alias("products_count"),
        F.concat(_store_root(F.col("store_url")), F.lit("/collections/"), c["handle"]).alias("url"),
    )
    return listed, errors


def store_summary(variants: DataFrame) -> DataFrame:
    """Price range, vendors and variants out of stock per store."""
    return variants.groupBy("store_url").agg(
        F.count("*").alias("variants"),
        F.countDistinct("product_id").alias("products"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.countDistinct("vendor").alias("vendors"),
        F.sum((~F.col("available")).cast("int")).alias("out_of_stock"),
    )
