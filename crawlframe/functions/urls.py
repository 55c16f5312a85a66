"""URL and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MULTI_PART_TLDS = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "com.tr", "co.nz", "co.in"]
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac"]


def with_scheme(url: Column) -> Column:
    return F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case host, without port."""
    return F.lower(F.regexp_extract(with_scheme(F.trim(url)), r"//([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(with_scheme(F.trim(url)), r"//[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def normalised(url: Column) -> Column:
    """Without fragment and trailing slash, scheme and host in lower case."""
    whole = F.regexp_replace(with_scheme(F.trim(url)), "#.*$", "")
    head = F.regexp_extract(whole, "^([^/]*//[^/?]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(whole, F.length(head) + 1, F.length(whole))), "/$", "")


def registrable(host_: Column) -> Column:
    """The domain that is registered: two labels, or three under a suffix of several labels."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host_)), r"\.+$", ""), r"^www\.", "")
    h = F.split(h, ":").getItem(0)
    parts = F.filter(F.split(h, r"\."), lambda x: x != "")
    n = F.size(parts)
    tail = lambda k: F.array_join(F.slice(parts, n - (k - 1), F.lit(k)), ".")
    second = F.get(parts, n - 2)
    special = tail(2).isin(*MULTI_PART_TLDS) | (F.get(parts, n - 1).rlike("^[a-z]{2}$") & second.isin(*SECOND_LEVEL))
    return F.when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (n <= 2), h).when(special, tail(3)).otherwise(tail(2))


def zone(domain: Column) -> Column:
    last = F.lower(F.element_at(F.split(domain, r"\."), -1))
    return F.when((F.instr(domain, ".") > 0) & F.length(last).between(2, 10), last).otherwise("other")


def is_homepage(url: Column) -> Column:
    return (url != "") & path(url).isin("", "/")


def is_own(target: Column, own: str) -> Column:
    return (target == own) | target.endswith(f".{own}")


def policy(pages: DataFrame, allowed: list[str], needed: list[str]) -> DataFrame:
    """``pages(page_id, url)`` against a policy: letters, index files, slashes, parameters that are too many or lacking."""
    p, url = path(F.col("url")), F.col("url")
    keys = F.transform(F.filter(F.split(query_string(url), "&"), lambda x: x != ""), lambda x: F.get(F.split(x, "="), 0))
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    return pages.select(
        "page_id",
        p.rlike("[A-Z]").alias("upper_case"),
        p.rlike(r"/(index|default)\.[a-z]+$").alias("index_file"),
        p.rlike("//").alias("double_slash"),
        F.array_join(F.array_sort(F.array_except(keys, names(allowed))), ",").alias("extra_params"),
        ((F.size(keys) > 0) & (F.size(F.array_except(names(needed), keys)) > 0)).alias("lacks_params"),
    )
