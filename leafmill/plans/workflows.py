"""Composed jobs: site scrape, catalogue export, contact finder, price comparison."""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.urls import authority_of
from leafmill.operators import catalog, extract, products, signals, site
from leafmill.session import durable
from leafmill.sources.captures import latest_captures
from leafmill.sources.tables import NoRows, ResultTables, TableInfo

# What a contact page is called and which mailboxes are shared ones.
CONTACT_WORDS = ("contact", "about", "team", "support")
SHARED_MAILBOXES = ("info", "contact", "hello", "sales", "support", "admin", "office", "webmaster", "noreply", "no-reply")


@dataclass
class SiteScrape:
    profiles: DataFrame
    pages: DataFrame
    counts: DataFrame


def scrape_sites(sites: DataFrame, documents: DataFrame, captures: DataFrame, limit: int | None = None) -> SiteScrape:
    """Profile of each site, its pages (all, or the first ``limit``) with their signals and markdown, and counts."""
    mapped = durable(site.sitemap_pages(sites, documents))
    listed = site.site_pages(sites, documents, captures, limit, mapped)
    # The capture is chosen before it is read: none but the latest is parsed, and counts need no markdown.
    found = listed.select("site", "source", "rank", "url").join(latest_captures(captures), "url")
    pages = signals.with_markdown(signals.page_signals(found)).select(
        "site", "source", "rank", "url", "title", "status_code", "blocked", "block_reason", "links_count", "markdown"
    )
    return SiteScrape(site.site_profiles(sites, documents, captures, mapped), pages, _counts(pages))


def _counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site", "source").agg(
        F.count("*").alias("pages"),
        F.sum(F.col("blocked").cast("int")).alias("blocked_pages"),
        F.sum("links_count").alias("links"),
    )


def save_scrape(tables: ResultTables, name: str, done: SiteScrape, append: bool = False) -> dict[str, TableInfo]:
    """Save a scrape as ``<name>_pages``, ``<name>_pages_errors`` (refused pages), ``<name>_profiles`` and ``<name>_counts``.

    Pages are read and written by one job; their errors and counts are taken from what it wrote.
    """
    out = {"pages": tables.emit("site_scrape", done.pages, table=f"{name}_pages", append=append)}
    written = tables.read(f"{name}_pages")
    refused = written.filter("blocked").select("url", F.concat(F.lit("blocked: "), F.col("block_reason")).alias("error"))
    with contextlib.suppress(NoRows):
        out["errors"] = tables.save(f"{name}_pages_errors", refused)
    out["profiles"] = tables.emit("site_scrape", done.profiles, table=f"{name}_profiles", append=append)
    out["counts"] = tables.save(f"{name}_counts", _counts(written))
    return out


@dataclass
class CatalogExport:
    collections: DataFrame
    variants: DataFrame
    summary: DataFrame
    errors: DataFrame


def export_catalogs(catalog_pages: DataFrame, collection_pages: DataFrame, page_size: int = catalog.PAGE_SIZE) -> CatalogExport:
    listed, listing_errors = catalog.collections(collection_pages, page_size)
    items, errors = catalog.store_products(catalog_pages, page_size)
    variants = catalog.variant_rows(items)
    return CatalogExport(listed, variants, catalog.store_summary(variants), errors.unionByName(listing_errors))


def save_catalogs(tables: ResultTables, name: str, done: CatalogExport, append: bool = False) -> dict[str, TableInfo]:
    """Save an export as ``<name>_variants`` with its errors, ``<name>_collections`` and ``<name>_summary``, which is taken from the variants saved."""
    out = {"variants": tables.emit("catalog", done.variants, done.errors, f"{name}_variants", append)}
    with contextlib.suppress(NoRows):
        out["collections"] = tables.emit("catalog", done.collections, table=f"{name}_collections", append=append)
    out["summary"] = tables.save(f"{name}_summary", catalog.store_summary(tables.read(f"{name}_variants")))
    return out


def contact_pages(pages: DataFrame, per_site: int) -> DataFrame:
    """At most ``per_site`` pages of each site, contact-like URLs first."""
    path = F.lower(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*(.*)$", 1))
    liked = F.lit(False)
    for word in CONTACT_WORDS:
        liked = liked | path.contains(word)
    ranked = pages.withColumn("liked", liked)
    order = Window.partitionBy("site").orderBy(F.desc("liked"), "url")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_site)


def find_contacts(captures: DataFrame, per_site: int | None = None) -> DataFrame:
    """site, type, value, pages, shared: contacts of each site's pages, or of its ``per_site`` preferred ones.

    Preferred pages are chosen on their URLs alone, and only chosen ones are searched, all kinds in one pass.
    """
    pages = captures.select(F.expr(authority_of("url")).alias("site"), "url", "html")
    if per_site is not None:
        chosen = contact_pages(pages.select("site", "url").distinct(), per_site).select("url")
        pages = pages.join(chosen, "url", "left_semi")
    found = extract.extract_all_contacts(pages, carry=("site",))
    mailbox = F.lower(F.substring_index("value", "@", 1))
    return found.groupBy("site", "type", "value").agg(F.countDistinct("url").alias("pages")).withColumn(
        "shared", (F.col("type") == "email") & mailbox.isin(*SHARED_MAILBOXES)
    )


def contact_summary(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("type").agg(
        F.count("*").alias("contacts"),
        F.countDistinct("site").alias("sites"),
        F.sum(F.col("shared").cast("int")).alias("shared"),
    )


def compare_prices(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products cheapest first with stock marked, pages without product data)."""
    found, missed = products.extract_products(pages)
    stock = F.lower(F.coalesce("availability", F.lit("")))
    offers = found.select(
        "url", "name", "price", "currency", "source",
        stock.rlike("outofstock|soldout|discontinued").alias("out_of_stock"),
    )
    return offers.orderBy(F.asc_nulls_last("price"), "url"), missed
