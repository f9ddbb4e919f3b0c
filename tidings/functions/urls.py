"""Addresses of filings, list pages and their targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.fixed_values import ARCHIVE_ROOT, RNS_HOST
from tidings.functions.text import TO_END


def pad_cik(c: Column) -> Column:
    """Issuer number as ten digits or more; null if it is not a number."""
    number = c.try_cast("bigint").cast("string")
    # Padding would also cut, and a longer number cut short is another issuer's.
    return F.when(F.length(number) < 10, F.lpad(number, 10, "0")).otherwise(number)


def archive_key(cik: Column, accession: Column) -> Column:
    """``number/accession`` of one filing, as its archive folder has it."""
    return F.concat(
        cik.try_cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")))


def archive_folder(cik: Column, accession: Column) -> Column:
    """Folder of one filing, with a trailing slash (PJ1)."""
    return F.concat(F.lit(ARCHIVE_ROOT), archive_key(cik, accession), F.lit("/"))


def primary_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(archive_folder(cik, accession), document)


def index_url(cik: Column, accession: Column) -> Column:
    return F.concat(archive_folder(cik, accession), accession, F.lit("-index.html"))


def folder_of(url: Column) -> Column:
    """Everything up to and including the last slash."""
    return F.regexp_extract(url, r"^(.*/)", 1)


def list_url(epic: Column, page_no: Column, host: str = RNS_HOST) -> Column:
    """Address of one list page of an issuer (SC10)."""
    return F.concat(F.lit(host + "/stock/"), epic, F.lit("/company-news?page="), page_no.cast("string"))


def host_url(href: Column, host: str = RNS_HOST) -> Column:
    """Prefix the host to a path; absolute addresses stay (TX14)."""
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("/"), F.concat(F.lit(host), href))
        .otherwise(F.concat(F.lit(host + "/"), href))
    )


def join_url(base: Column, href: Column) -> Column:
    """Resolve a reference against the page it stands on (TX15, RFC 3986)."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(folder_of(page))
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )
    dotted = r"^[^?#]*/\.\.?(?:[/?#]|$)"
    return F.when(joined.rlike(dotted), _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1)
    steps = F.split(F.substring(path, 2, TO_END), "/")
    # A trailing dot segment leaves an empty last step, hence a trailing slash.
    ends_open = F.element_at(steps, -1).isin(".", "..")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(step))),
    )
    kept = F.when(ends_open, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), rest)
