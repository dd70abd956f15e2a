"""Job-board payloads: raw JSON text in, one posting table out.

A payload is parsed with a schema, never inferred, and exploded in place, so the
job is a scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions.text import first_filled, found, to_posted_date

_NAME = "struct<name:string>"
# --- fixed values: field names of the five payload shapes ----------------------
SCHEMAS = {
    "greenhouse": "struct<jobs:array<struct<title:string,absolute_url:string,"
                  f"location:{_NAME},first_published:string,updated_at:string>>>",
    "ashby": "struct<jobs:array<struct<title:string,jobUrl:string,location:string,"
             "publishedAt:string>>>",
    "lever": "array<struct<text:string,hostedUrl:string,"
             "categories:struct<location:string>,createdAt:string>>",
    "comeet": "array<struct<name:string,url_comeet_hosted_page:string,url_active_page:string,"
              f"position_url:string,location:{_NAME},time_updated:string>>",
    "workable": "struct<jobs:array<struct<title:string,shortlink:string,url:string,city:string,"
                "state:string,country:string,published_on:string,created_at:string>>>",
}


def _filled(*values) -> Column:
    return F.array_join(
        F.array_compact(F.array(*[F.nullif(v, F.lit("")) for v in values])), ", "
    )


def _fields(provider: str, j: Column) -> dict[str, Column]:
    if provider == "greenhouse":
        return {"title": j["title"], "url": j["absolute_url"], "location": j["location"]["name"],
                "posted": first_filled(j["first_published"], j["updated_at"])}
    if provider == "ashby":
        return {"title": j["title"], "url": j["jobUrl"], "location": j["location"],
                "posted": j["publishedAt"]}
    if provider == "lever":
        return {"title": j["text"], "url": j["hostedUrl"],
                "location": j["categories"]["location"], "posted": j["createdAt"]}
    if provider == "comeet":
        return {"title": j["name"],
                "url": first_filled(j["url_comeet_hosted_page"], j["url_active_page"],
                                    j["position_url"]),
                "location": j["location"]["name"], "posted": j["time_updated"]}
    if provider == "workable":
        return {"title": j["title"], "url": first_filled(j["shortlink"], j["url"]),
                "location": _filled(j["city"], j["state"], j["country"]),
                "posted": first_filled(j["published_on"], j["created_at"])}
    raise ValueError(f"unknown provider {provider!r}")


PROVIDERS = list(SCHEMAS)


def _postings(provider: str, payload: Column) -> Column:
    """The postings of one provider's payload as an array; NULL for another shape."""
    is_list = SCHEMAS[provider].startswith("array")
    # A lone object would be read as a list of one, so the root is checked first.
    root = F.ltrim(payload).startswith("[" if is_list else "{")
    parsed = F.when(root, F.from_json(payload, SCHEMAS[provider]))

    def posting(job: Column) -> Column:
        f = _fields(provider, job)
        return F.struct(
            first_filled(f["title"]).alias("title"), first_filled(f["url"]).alias("url"),
            first_filled(f["location"]).alias("location"), to_posted_date(f["posted"]).alias("posted"),
            F.lit(f"{provider}-api").alias("source"),
        )

    return F.transform(parsed if is_list else parsed["jobs"], posting)


def _exploded(raw: DataFrame, postings: Column) -> DataFrame:
    return raw.select("company", F.posexplode(postings).alias("ordinal", "j")).select(
        "company", F.col("ordinal").cast("bigint").alias("ordinal"), "j.*"
    )


def parse_board(raw: DataFrame, provider: str) -> DataFrame:
    """Postings of one provider's payloads; ``raw`` is ``(company, payload)``.

    A payload of the wrong shape yields no rows.
    """
    return _exploded(raw, _postings(provider, F.col("payload")))


def ingest_postings(raw: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """One posting table from ``(company, provider, payload)`` rows of all boards, in one scan."""
    chosen, (first, *others) = F.col("provider"), providers or PROVIDERS
    postings = F.when(chosen == first, _postings(first, F.col("payload")))
    for provider in others:
        postings = postings.when(chosen == provider, _postings(provider, F.col("payload")))
    return _exploded(raw, postings)


def detect_board(api, careers_url) -> Column:
    """``(provider, endpoint)`` a company's board is read from, NULL if unknown."""
    endpoint, page = first_filled(api), first_filled(careers_url)
    # Board hosts and the addresses of their listings.
    hosts = [("greenhouse", "greenhouse"), ("ashbyhq", "ashby"), ("lever.co", "lever"),
             ("comeet.co", "comeet"), ("workable.com", "workable")]
    pages = [
        ("workable", r"apply\.workable\.com/([^/?#]+)",
         "https://apply.workable.com/api/v1/widget/accounts/", ""),
        ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)",
         "https://api.ashbyhq.com/posting-api/job-board/", "?includeCompensation=true"),
        ("lever", r"jobs\.lever\.co/([^/?#]+)", "https://api.lever.co/v0/postings/", ""),
    ]

    def board(provider, url):
        return F.struct(F.lit(provider).alias("provider"), url.alias("endpoint"))

    chain = None
    for host, provider in hosts:
        test = F.contains(endpoint, F.lit(host))
        value = board(provider, endpoint)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    for provider, pattern, before, after in pages:
        account = found(page, pattern)
        chain = chain.when(
            account.isNotNull(),
            board(provider, F.concat(F.lit(before), account, F.lit(after))),
        )
    account = found(page, r"job-boards(?:\.eu)?\.greenhouse\.io/([^/?#]+)")
    return chain.when(
        account.isNotNull() & (endpoint == ""),
        board("greenhouse", F.concat(
            F.lit("https://boards-api.greenhouse.io/v1/boards/"), account, F.lit("/jobs"))),
    )


def board_targets(companies: DataFrame, name_filter: str | None = None):
    """``(targets, skipped)``: companies whose board can be read, and those not.

    A silently skipped company looks like one with nothing open, so it is listed.
    """
    enabled = companies.filter(F.coalesce("enabled", F.lit(True)))
    if name_filter:
        enabled = enabled.filter(F.contains(F.lower("name"), F.lit(name_filter.lower())))
    marked = enabled.withColumn("_b", detect_board("api", "careers_url"))
    targets = marked.filter("_b IS NOT NULL").select("name", "_b.provider", "_b.endpoint")
    return targets, marked.filter("_b IS NULL").select("name")
