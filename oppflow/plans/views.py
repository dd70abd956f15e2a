"""Input views over the driver tables, each one SQL text that Spark and DuckDB share.

The tables hold orders, parts and line items; the views read them as applications,
titles, outcomes, postings and so on.  Nothing is left out: every view covers the
whole of its tables.  Where a view plays a part that only some of its rows should match, the others
carry another name instead of being filtered away.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
AS_OF = "2000-06-30"

# One location text per nation, so that every rule of the place cascade is met.
LOCATIONS = [
    "München, Germany", "Paris | Berlin", "London, UK", "Tel Aviv", "Oslo", "Brussels",
    "Remote - EMEA", "Worldwide", "Remote - United States", "Global, US", "Remote", "",
    "Atlantis", "Łódź", "Wien (Österreich)", "Zürich / Genève", "New York, NY", "Bengaluru, India",
    "Madrid; Barcelona", "Northern Ireland", "Deutschland", "Hybrid", "København", "Anywhere, Europe",
    "São Paulo, Brazil",
]
# Places that only the names of smaller cities tell, for every ninth company.
SMALL_PLACES = [
    "Jena", "St. Gallen", "Winterthur", "Turku", "Naples", "Sophia Antipolis", "Banja Luka", "Stavanger",
]
_PLACE = "CASE WHEN c_custkey % 9 = 0 THEN CASE c_custkey % 8 " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(SMALL_PLACES)
) + " END ELSE CASE n_nationkey " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(LOCATIONS)
) + " ELSE '' END END"

_COMPANY = (
    "CASE WHEN c_acctbal > 0 THEN c_mktsegment || ' ' || n_name ELSE c_name END || "
    "CASE c_custkey % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Technologies' WHEN 2 THEN ' Talent' ELSE '' END"
)

VIEWS = {
    "titles": """
        SELECT p_partkey, p_size,
               CASE p_size % 6 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Lead ' WHEN 2 THEN ''
                    WHEN 3 THEN 'Principal ' WHEN 4 THEN 'Junior ' ELSE 'Sr. ' END
               || p_name ||
               CASE p_partkey % 11 WHEN 0 THEN ' Product Manager, AI' WHEN 1 THEN ' Platform PM (m/w/d)'
                    WHEN 2 THEN ' API Integrations' WHEN 3 THEN ' Product Owner'
                    WHEN 4 THEN ' Technical PM - Security' WHEN 5 THEN ' Developer Platforms - UK'
                    WHEN 6 THEN ' Leiter Vertrieb' WHEN 7 THEN ' Manager'
                    WHEN 8 THEN ' Cloud & AI (Remote)' WHEN 9 THEN ' engineer ' || p_name || ' widget'
                    ELSE '' END AS title
        FROM {part}""",
    "companies": f"""
        SELECT c_custkey, n_nationkey, {_COMPANY} AS company, {_PLACE} AS location
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "app": """
        SELECT o_orderkey AS pos, o_orderkey AS num, CAST(o_orderdate AS DATE) AS date, company,
               title AS role,
               CAST(100 + o_orderkey * 37 % 401 AS DOUBLE) / 100 AS fit,
               CAST(100 + o_orderkey * 53 % 401 AS DOUBLE) / 100 AS odds,
               CAST(100 + o_orderkey * 71 % 401 AS DOUBLE) / 100 AS priority,
               CAST(100 + o_orderkey * 37 % 401 AS DOUBLE) / 100 AS score,
               CASE (o_orderkey * 7 + o_custkey) % 16 WHEN 0 THEN '' WHEN 1 THEN '✅' WHEN 2 THEN '📬'
                    WHEN 3 THEN '🎯' WHEN 4 THEN '💰' WHEN 5 THEN '❌' WHEN 6 THEN '🚫'
                    WHEN 7 THEN '👻' WHEN 8 THEN '⏭️' WHEN 9 THEN 'Applied' WHEN 10 THEN '**Rejected**'
                    WHEN 11 THEN 'aplicado 2026-03-12' WHEN 12 THEN 'monitor' WHEN 13 THEN 'ghosted'
                    WHEN 14 THEN 'in limbo' ELSE 'evaluada' END AS status,
               CASE WHEN o_orderstatus = 'F' THEN '[out](../output/' || CAST(o_orderkey AS STRING) || ')'
                    WHEN o_orderstatus = 'O' THEN '-' ELSE '' END AS output,
               CASE WHEN o_totalprice > 100000 THEN '[' || CAST(o_custkey AS STRING) || '](../reports/'
                    || CAST(o_custkey AS STRING) || '-x.md)' ELSE '' END AS report,
               location,
               CASE o_orderkey % 4 WHEN 0 THEN ''
                    WHEN 1 THEN 'Posted ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '; strong team'
                    WHEN 2 THEN 'Applied on ' || CAST(CAST(o_orderdate AS DATE) + 3 AS STRING)
                         || '. contact: Jane Roe at jane' || CAST(o_custkey AS STRING) || '@example.com'
                    ELSE 'posted ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ', applied '
                         || CAST(CAST(o_orderdate AS DATE) + 9 AS STRING) || ' ;' END AS notes,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'https://www.linkedin.com/jobs/view/role-'
                         || CAST(1000000 + o_custkey AS STRING) || '?ref=x'
                    WHEN '2-HIGH' THEN ''
                    ELSE 'https://jobs.example.com/' || CAST(o_custkey AS STRING) || '/' END AS url,
               CASE WHEN o_orderstatus = 'P' THEN 'archive' ELSE 'live' END AS file,
               o_orderstatus = 'P' AS archived
        FROM {orders} JOIN @companies@ co ON o_custkey = c_custkey
        JOIN @titles@ ti ON p_partkey = o_orderkey % #part#""",
    "outcome": """
        SELECT pos, num + CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS report,
               CASE WHEN url LIKE '%linkedin%' THEN company ELSE 'Unlisted ' || company END AS company, date,
               pos % 6 AS stages_passed,
               CASE pos % 7 WHEN 0 THEN 'screen' WHEN 1 THEN 'hm_round' WHEN 2 THEN 'technical'
                    WHEN 3 THEN 'take_home' WHEN 4 THEN 'final' WHEN 5 THEN '' ELSE 'verbal_offer' END
                    AS furthest_stage
        FROM @app@ ap""",
    "stage": """
        SELECT l_orderkey AS num,
               CASE l_linenumber WHEN 1 THEN 'screen' WHEN 2 THEN 'hm' WHEN 3 THEN 'technical'
                    WHEN 4 THEN 'presentation' WHEN 5 THEN 'Onsite' WHEN 6 THEN 'offer'
                    ELSE 'coffee chat' END AS stage
        FROM {lineitem}""",
    "followup": """
        SELECT l_orderkey AS app_num, CAST(l_shipdate AS DATE) AS date
        FROM {lineitem}""",
    "posting": """
        SELECT o_orderkey AS pos, company, title, location, CAST(o_orderdate AS DATE) AS posted,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'https://de.linkedin.com/jobs/view/x-'
                         || CAST(1000000 + o_custkey AS STRING) || '?trk=1'
                    ELSE 'https://boards.example.com/' || CAST(o_custkey AS STRING) || '/'
                         || CAST(p_partkey % 50 AS STRING) END AS url,
               'board-' || o_orderstatus AS source
        FROM {orders} JOIN @companies@ co ON o_custkey = c_custkey
        JOIN @titles@ ti ON p_partkey = (o_orderkey * 3 + 1) % #part#""",
    "history": f"""
        SELECT 'https://boards.example.com/' || CAST(l_suppkey AS STRING) || '/'
               || CAST(l_partkey % 50 AS STRING) AS url,
               CAST(l_shipdate AS DATE) AS first_seen,
               CAST(year(l_shipdate) * 400 + dayofyear(l_shipdate) AS BIGINT) AS pos,
               'board' AS source, title, l_partkey AS part_no,
               CASE l_linenumber % 5 WHEN 0 THEN 'BUILDING ' WHEN 1 THEN 'MACHINERY ' WHEN 2 THEN 'AUTOMOBILE '
                    WHEN 3 THEN 'HOUSEHOLD ' ELSE 'FURNITURE ' END || n_name AS company
        FROM {{lineitem}} JOIN @titles@ ti ON l_partkey = p_partkey
        JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "exclusion": """
        SELECT c_custkey AS pos,
               CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 2000 THEN company
                    ELSE 'Former ' || c_name END AS company, DATE '1997-01-15' AS date, 'no ' || c_name AS reason,
               CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE title END AS role
        FROM {customer} JOIN @companies@ co USING (c_custkey)
        JOIN @titles@ ti ON p_partkey = c_custkey % #part#""",
    "curated": """
        SELECT DISTINCT CASE WHEN n_nationkey < 6 THEN company ELSE 'Listed ' || company END AS company
        FROM @companies@ co""",
    "addition": """
        SELECT o_orderkey AS file_no, CAST(o_orderdate AS DATE) AS date, company, title AS role,
               CAST(100 + o_orderkey * 41 % 401 AS DOUBLE) / 100 AS fit,
               CAST(100 + o_orderkey * 43 % 401 AS DOUBLE) / 100 AS odds,
               CAST(100 + o_orderkey * 47 % 401 AS DOUBLE) / 100 AS priority,
               '' AS status, '-' AS output,
               '[' || CAST(o_custkey AS STRING) || '](../reports/' || CAST(o_custkey AS STRING) || '-y.md)'
                    AS report,
               location, 'note ' || CAST(o_orderkey AS STRING) AS notes, '-' AS url
        FROM {orders} JOIN @companies@ co ON o_custkey = c_custkey
        JOIN @titles@ ti ON p_partkey = (o_orderkey * 5 + 2) % #part#""",
    "item": """
        SELECT p_partkey AS id, p_partkey AS pos,
               CASE WHEN p_size > 10 THEN 'https://jack.example.com/' || CAST(p_partkey AS STRING)
                    ELSE '' END AS url,
               title || ' @ ' || company || CASE WHEN p_size % 2 = 0 THEN ' | 87% | https://real.example.com/'
                    || CAST(p_partkey AS STRING) ELSE '' END AS notes
        FROM @titles@ ti JOIN @companies@ co ON c_custkey = p_partkey % #customer#""",
    "state": """
        SELECT p_partkey AS id, p_partkey AS pos,
               CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending'
                    ELSE 'completed' END AS status,
               p_size % 3 AS retries,
               CASE WHEN p_size % 4 = 3 THEN '-' ELSE CAST(p_partkey AS STRING) END AS report_num,
               CASE WHEN p_size % 8 = 0 THEN '-' ELSE CAST(CAST(p_size % 5 AS DECIMAL(4,1)) + 0.5 AS STRING) END
                    AS score
        FROM {part}""",
    "report_source": """
        SELECT o_orderkey AS num, p_partkey, p_size, p_name
        FROM {orders} JOIN {part} ON p_partkey = o_orderkey % #part#""",
    "doc": "SELECT doc_id, text, lang, source, n_chars FROM {documents}",
    "page": "SELECT page_id, url, html FROM {pages}",
}


def _resolve(name: str, tables: dict[str, str], counts) -> str:
    """The text of a view with the views it reads put in as subqueries."""
    text = re.sub(r"@(\w+)@", lambda m: f"({_resolve(m.group(1), tables, counts)})", VIEWS[name])
    text = re.sub(r"#(\w+)#", lambda m: str(counts(m.group(1))), text)
    return re.sub(r"\{(\w+)\}", lambda m: tables[m.group(1)], text)


def duck_view(name: str) -> str:
    return _resolve(name, {t: t for t in TABLES}, lambda t: f"(SELECT count(*) FROM {t})")


# Tables of a fixed few rows, whatever the scale.
FIXED_TABLES = ("region", "nation")


def _open(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _few_splits(df: DataFrame) -> bool:
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def _dealt_out(df: DataFrame, few: bool) -> DataFrame:
    """Rows spread over the cores if they come from fewer splits than there are cores.

    A test table kept as one file, and what is joined from such tables, is one task's work
    otherwise.  Only the number of splits decides, so tables of any real size are read,
    and joined, as they lie.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = _open(spark, sf_dir, name)
    return _dealt_out(df, name not in FIXED_TABLES and _few_splits(df))


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The row counts come from the file footers; a subquery would scan again.
    text = _resolve(
        name, {t: "{" + t + "}" for t in TABLES}, lambda t: _open(spark, sf_dir, t).count()
    )
    used = {t: _open(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    few = any(_few_splits(df) for t, df in used.items() if t not in FIXED_TABLES)
    return _dealt_out(spark.sql(text, **used), few)
