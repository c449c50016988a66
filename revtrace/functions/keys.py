"""Identifiers, versions, dates and author lists as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, let, strip

# Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
NO_VERSION = 10 ** 6
DOI_PATTERN = r"(?i)\b10\.\d{4,9}/[^\s\"<>,;]+"
AUTHOR_TYPE = "array<struct<name:string,orcid:string,affiliation:string>>"


def normalize_doi(c: Column) -> Column:
    """Trim, lower-case, drop one resolver or scheme prefix; empty becomes null."""
    return blank_to_null(F.regexp_replace(F.lower(strip(c)), r"^(https://doi\.org/|http://doi\.org/|doi:)", ""))


def key_of(*cols: Column) -> Column:
    """Parts joined by '::'; null when a part is null."""
    present = cols[0].isNotNull()
    for c in cols[1:]:
        present = present & c.isNotNull()
    return F.when(present, F.concat_ws("::", *[c.cast("string") for c in cols]))


def uuid5(name: Column, namespace_hex: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of a name: SHA-1 of namespace and name with version and variant bits set."""
    def shape(d: Column) -> Column:
        variant = F.substring(F.lit("89ab"), F.conv(F.substring(d, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
        return F.concat_ws(
            "-",
            F.substring(d, 1, 8),
            F.substring(d, 9, 4),
            F.concat(F.lit("5"), F.substring(d, 14, 3)),
            F.concat(variant, F.substring(d, 18, 3)),
            F.substring(d, 21, 12),
        )

    return let(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8"))), shape)


def event_id(preprint_doi: Column, published_doi: Column, prefix: str = "v1-vs-published:") -> Column:
    """Deterministic id of a DOI pair. Pass the prefix an existing library was built with to get its ids."""
    return uuid5(F.concat(F.lit(prefix), F.lower(preprint_doi), F.lit(":"), F.lower(F.coalesce(published_doi, F.lit("")))))


def normalize_version(c: Column) -> Column:
    """Null or empty is v1; 'published' and v... stay; anything else gets a v in front."""
    t = strip(c.cast("string"))
    return (
        F.when(t.isNull() | (t == ""), F.lit("v1"))
        .when((t == "published") | t.startswith("v"), t)
        .otherwise(F.concat(F.lit("v"), t))
    )


def version_num(c: Column) -> Column:
    """First run of digits of a version label; 10^6 without one."""
    digits = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"\d+", 0)
    return F.when(digits == "", F.lit(NO_VERSION)).otherwise(digits.cast("int"))


def parse_date(c: Column) -> Column:
    """ISO text: with a T it stays, Y-m-d becomes midnight UTC, anything else stays as given; empty is null."""
    t = strip(c)
    day = F.try_to_timestamp(t, F.lit("yyyy-M-d"))
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(F.contains(t, F.lit("T")), t)
        .when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & day.isNotNull(), F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'"))
        .otherwise(t)
    )


def date_parts_to_iso(parts: Column) -> Column:
    """[year], [year, month] or [year, month, day] as Y-m-d; missing parts are 1; no part gives null."""
    p = F.filter(parts, lambda x: x.isNotNull())
    part = lambda i: F.lpad(F.coalesce(F.get(p, F.lit(i)).cast("string"), F.lit("1")), 2, "0")
    return F.when(F.size(p) >= 1, F.concat_ws("-", F.lpad(F.get(p, F.lit(0)).cast("string"), 4, "0"), part(1), part(2)))


def _author(name: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("affiliation"))


def normalize_authors(c: Column) -> Column:
    """One string split on ';' (' and ' counts as ';') into author structs; nameless entries dropped."""
    names = F.transform(F.split(F.regexp_replace(c, " and ", ";"), ";"), strip)
    return F.coalesce(F.transform(F.filter(names, lambda n: n != ""), _author), F.array().cast(AUTHOR_TYPE))


def normalize_author_names(c: Column) -> Column:
    """An array of names into author structs; empty names dropped."""
    names = F.filter(F.transform(c, strip), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.transform(names, _author), F.array().cast(AUTHOR_TYPE))


def normalize_author_structs(c: Column) -> Column:
    """An array of (name, full_name, orcid, affiliation): the name falls back to full_name; nameless dropped."""
    rows = F.transform(c, lambda a: F.struct(
        strip(F.coalesce(blank_to_null(a["name"]), a["full_name"])).alias("name"), a["orcid"].alias("orcid"),
        a["affiliation"].alias("affiliation")))
    return F.coalesce(F.filter(rows, lambda a: a["name"].isNotNull() & (a["name"] != "")), F.array().cast(AUTHOR_TYPE))


def citing_authors(c: Column, keep: int | None = None) -> Column:
    """Author string of a citing work: split at commas before a capital (with `keep` the first ones), e-mail always null."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\.+$", "")
    names = F.filter(F.transform(F.split(text, r"(?U),\s*(?=[A-Z])"), strip), lambda n: n != "")
    return F.transform(names if keep is None else F.slice(names, 1, keep), lambda n: F.struct(
        n.alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("email")))


def doi_in(c: Column) -> Column:
    """First DOI of a text, lower-cased, trailing full stops and brackets removed; null without one."""
    hit = F.regexp_extract(c, DOI_PATTERN, 0)
    return F.lower(blank_to_null(F.regexp_replace(hit, r"[.)]+$", "")))


def classify_ref(c: Column) -> Column:
    """(kind, ref): a PMC or PPR id, else a DOI, else invalid."""
    t = strip(F.coalesce(c, F.lit("")))
    hit = blank_to_null(F.regexp_replace(F.regexp_extract(t, DOI_PATTERN, 0), r"[.)]+$", ""))
    up = F.upper(t)
    kind = (F.when(up.rlike(r"^PMC\d+$"), F.lit("pmcid")).when(up.rlike(r"^PPR\d+$"), F.lit("ppr"))
            .when(hit.isNotNull(), F.lit("doi")).otherwise(F.lit("invalid")))
    return F.struct(kind.alias("kind"), F.when(kind.isin("pmcid", "ppr"), up).when(kind == "doi", hit).alias("ref"))


def paper_id(doi: Column) -> Column:
    """A DOI as a name that is safe in paths."""
    return F.regexp_replace(F.lower(strip(doi)), r"[^A-Za-z0-9.\-]+", "_")
