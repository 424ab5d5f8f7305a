"""Opportunity tables derived from the driver's business and event tables.

Each view is one SELECT written once and rendered for Spark or for the DuckDB
checker; the few functions the two spell differently come from a dialect. The
views read whole tables: no sampling, no id subsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead import schemas
from fairlead.operators.classify import derive_status

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
AS_OF = "2019-06-15 12:00:00"

COUNTRIES = (
    "Nigeria", "Kenya", "France", "Germany", "Canada", "United States", "India", "Singapore", "Mauritius", "Egypt", "Spain",
    "Norway", "Mexico", "Japan", "Ghana", "Morocco", "Italy", "Poland", "Brazil", "Vietnam", "Rwanda", "Qatar", "Serbia",
    "Greece", "Turkey",
)
REGIONS = ("Africa", "North America", "APAC", "Europe", "EMEA")
WORDS = ("Fellowship", "Internship", "Scholarship", "Grant", "Hackathon")
FIELDS = ("Cloud Security", "Robotics", "Open Source", "Marine Biology", "Machine Learning", "Cyber Security", "AppSec")
SKILLS = (
    "cloud security", "artificial intelligence", "open source", "cybersecurity", "marine biology", "application security",
    "public speaking", "quantum",
)


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def pick(self, values, index: str) -> str:
        listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        return f"([{listed}])[({index}) + 1]" if self.duck else f"element_at(array({listed}), cast({index} as int) + 1)"

    def years_later(self, column: str, years: int) -> str:
        return f"cast({column} + interval '{years * 12} months' as date)" if self.duck else f"cast(add_months({column}, {years * 12}) as date)"

    def minus_days(self, day: str, days: str) -> str:
        return f"cast({day} - cast({days} as integer) as date)" if self.duck else f"date_sub({day}, cast({days} as int))"

    def end_of_day(self, day: str) -> str:
        moment = f"(cast({day} as timestamp) + interval '86399 seconds')"
        return moment if self.duck else f"cast({day} as timestamp) + interval 86399 seconds"

    def text_date(self, day: str) -> str:
        return f"strftime({day}, '%B %-d, %Y')" if self.duck else f"date_format({day}, 'MMMM d, yyyy')"

    def int_floor(self, value: str) -> str:
        return f"cast(floor({value}) as bigint)"


SPARK, DUCK = Dialect(False), Dialect(True)


def notices_sql(d: Dialect) -> str:
    """Orders as opportunity notices: every field is a function of the order, its customer and nation."""
    day = d.years_later("o_orderdate", 20)
    return f"""
    SELECT k AS notice_id, k AS seq, field, word, field || ' ' || word || ' ' || cast(year(day) as varchar(4)) AS title,
           organization, country, region, rolling, mode, min_age, stipend, flights, accommodation, fee, cv,
           CASE WHEN k % 13 <> 0 THEN day END AS deadline_date,
           CASE WHEN k % 13 <> 0 THEN {d.end_of_day('day')} END AS deadline,
           CASE WHEN k % 4 <> 0 THEN {d.minus_days('day', '20 + k % 60')} END AS opening_date,
           'https://Jobs' || cast(k % 50 as varchar(9)) || '.example.org/n/' || cast(k as varchar(20)) AS page_url,
           'https://Jobs' || cast(k % 50 as varchar(9)) || '.example.org/n/' || cast(k as varchar(20))
             || CASE k % 3 WHEN 0 THEN '/?utm_source=feed&b=2&a=1' WHEN 1 THEN '/' ELSE '#top' END AS url,
           'https://jobs' || cast(k % 50 as varchar(9)) || '.example.org/n/' || cast(k as varchar(20))
             || CASE k % 3 WHEN 0 THEN '?a=1&b=2' ELSE '' END AS canonical
    FROM (
      SELECT o_orderkey AS k, {day} AS day,
             {d.pick(FIELDS, 'o_orderkey % 7')} AS field,
             {d.pick(WORDS, "cast(substr(o_orderpriority, 1, 1) as integer) - 1")} AS word,
             CASE WHEN o_orderkey % 7 <> 0 THEN c_name END AS organization,
             {d.pick(COUNTRIES, 'n_nationkey')} AS country, {d.pick(REGIONS, 'n_regionkey')} AS region,
             o_orderkey % 11 = 0 AS rolling, {d.pick(('remote', 'hybrid', 'in_person', 'unknown'), 'o_orderkey % 4')} AS mode,
             CASE WHEN o_orderkey % 3 = 0 THEN cast(16 + o_orderkey % 20 as integer) END AS min_age,
             CASE WHEN o_orderkey % 5 = 0 THEN 'USD ' || cast(1000 + o_orderkey % 9000 as varchar(9)) END AS stipend,
             {d.pick(('covered', 'not_covered', 'reimbursed', 'unknown'), '(o_orderkey / 4) % 4' if not d.duck else '(o_orderkey // 4) % 4')} AS flights,
             {d.pick(('covered', 'unknown', 'partially_covered'), 'o_orderkey % 3')} AS accommodation,
             CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS fee, o_orderkey % 2 = 0 AS cv
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
    ) x"""


def seekers_sql(d: Dialect) -> str:
    """Suppliers as profiles."""
    return f"""
    SELECT s_suppkey AS profile_id, {d.pick(COUNTRIES, 'n_nationkey')} AS nationality,
           {d.pick(COUNTRIES, '(n_nationkey + s_suppkey) % 25')} AS residence, cast(18 + s_suppkey % 23 as integer) AS age,
           {d.pick(SKILLS, 's_suppkey % 8')} AS skill, {d.pick(SKILLS, '(s_suppkey + 3) % 8')} AS second_skill,
           cast(s_suppkey % 5 as integer) AS study_year
    FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey"""


def pairs_sql(d: Dialect) -> str:
    """Which notices a profile's searches met."""
    return "SELECT DISTINCT l_suppkey AS profile_id, l_orderkey AS notice_id FROM {lineitem}"


def hits_sql(d: Dialect) -> str:
    """Line items as search hits of the supplier's queries."""
    return f"""
    SELECT l_suppkey AS profile_id, l_linenumber AS rank, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS seq,
           'https://' || {d.pick(('Jobs.example.org', 'www.linkedin.com', 'grants.example.net', 'x.com', 'blog.example.com'), 'l_partkey % 5')}
             || {d.pick(('/apply/', '/p/', '/privacy/', '/team/', '/cohort-2027/', '/n/'), 'l_partkey % 6')} || cast(l_partkey as varchar(20))
             || CASE l_linenumber % 3 WHEN 0 THEN '/?utm_medium=x' WHEN 1 THEN '/' ELSE '#s' END AS url,
           'https://' || {d.pick(('jobs.example.org', 'www.linkedin.com', 'grants.example.net', 'x.com', 'blog.example.com'), 'l_partkey % 5')}
             || {d.pick(('/apply/', '/p/', '/privacy/', '/team/', '/cohort-2027/', '/n/'), 'l_partkey % 6')} || cast(l_partkey as varchar(20)) AS canonical,
           l_partkey % 5 AS host_no, l_partkey % 6 AS path_no, l_partkey AS part_no,
           p_name || {d.pick((' Grant', ' shop', ' fellowship', ' offer'), 'l_partkey % 4')} AS title,
           {d.pick(('Deadline soon', 'Read on', 'Cohort of 2027'), 'l_partkey % 3')} AS snippet, p_name,
           {d.pick(('match', 'discovery'), 'l_linenumber % 2')} AS query_mode, 'q' || cast(l_linenumber as varchar(2)) AS query,
           'recorded' AS provider
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""


def observations_sql(d: Dialect) -> str:
    """Events as repeated observations of a record."""
    return f"SELECT user_id AS record_id, event_id AS seq, ts AS seen_at, event_type AS status, {d.int_floor('value / 50')} AS bucket FROM {{events}}"


def attempts_sql(d: Dialect) -> str:
    """Events as delivery attempts of message chunks."""
    return """
    SELECT user_id AS plan_no, cast(event_id % 7 as integer) AS chunk_index, event_id AS seq, ts AS attempted_at,
           event_type = 'purchase' AS delivered, CASE WHEN event_type <> 'purchase' THEN event_type END AS error
    FROM {events}"""


VIEWS = {
    "notices": notices_sql, "seekers": seekers_sql, "pairs": pairs_sql, "hits": hits_sql, "observations": observations_sql,
    "attempts": attempts_sql,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name](SPARK).replace("varchar(", "VARCHAR(")
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def with_views(sql: str, *names: str) -> str:
    """The checker's SQL with the named views in front."""
    plain = {t: t for t in TABLES}
    parts = [f"{name} AS ({VIEWS[name](DUCK).format(**plain)})" for name in names]
    return "WITH " + ",\n".join(parts) + "\n" + sql if parts else sql


# --- richer Spark-side forms -------------------------------------------------------

def notice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in the opportunity layout."""
    n = view(spark, sf_dir, "notices")
    none = F.lit(None).cast("string")
    part = lambda status: F.struct(status.alias("status"), none.alias("amount"), none.alias("notes"))
    known = n.select(
        F.col("notice_id").cast("string").alias("opportunity_key"), "seq", "title", "organization",
        F.col("word").alias("category"), F.col("url").alias("source_url"), F.col("page_url").alias("official_url"),
        F.concat("page_url", F.lit("/apply")).alias("application_url"), "country", "opening_date", "deadline",
        F.col("mode").alias("participation_mode"), F.col("rolling").alias("rolling_application"),
        F.concat(F.lit("Work on "), F.lower("field"), F.lit(" with research and training.")).alias("summary"),
        F.lit(AS_OF).cast("timestamp").alias("last_verified_at"),
        derive_status(F.col("deadline"), F.col("opening_date"), F.lit(AS_OF).cast("timestamp"), F.col("rolling")).alias("status"),
        schemas.fill(
            schemas.ELIGIBILITY, minimum_age=F.col("min_age"), regions_allowed=F.array("region"),
            requirements_complete=F.col("cv"),
        ).alias("eligibility"),
        schemas.fill(
            schemas.FUNDING, stipend=F.col("stipend"), flights=part(F.col("flights")), accommodation=part(F.col("accommodation")),
        ).alias("funding"),
        schemas.fill(
            schemas.APPLICATION, application_fee=F.col("fee"), cv_required=F.when(F.col("cv"), True),
        ).alias("application"),
    )
    return schemas.conform(known, schemas.OPPORTUNITY)


def seeker_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seekers in the profile layout."""
    s = view(spark, sf_dir, "seekers")
    stage = schemas.fill(schemas.PROFILE["education"].dataType["current_stage"].dataType, year=F.col("study_year"))
    return s.select(
        F.col("profile_id").cast("string").alias("profile_id"),
        schemas.fill(
            schemas.PROFILE["identity"].dataType, nationality=F.array("nationality"),
            age=schemas.fill(schemas.PROFILE["identity"].dataType["age"].dataType, current=F.col("age")),
            residence=F.create_map(F.lit("country"), F.col("residence")),
        ).alias("identity"),
        schemas.fill(
            schemas.PROFILE["education"].dataType, university=F.lit("Example University"), degree=F.lit("BSc Computing"),
            graduation_year=F.lit(2021), current_stage=stage,
        ).alias("education"),
        schemas.fill(
            schemas.PROFILE["professional_identity"].dataType, primary=F.array("skill"), secondary=F.array("second_skill"),
        ).alias("professional_identity"),
        F.array().cast(schemas.PROFILE["experience"].dataType).alias("experience"),
        F.array().cast(schemas.PROFILE["projects"].dataType).alias("projects"),
        F.concat(F.lit('{"open_source": ["'), "skill", F.lit('", {"deeper": ["web3"]}]}')).alias("extra"),
    )


def notice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pairs")
    return p.select(F.col("profile_id").cast("string").alias("profile_id"), F.col("notice_id").cast("string").alias("opportunity_key"))


def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML page per notice: the text jobs read the notice back out of it."""
    n = view(spark, sf_dir, "notices").repartition("notice_id")  # parsing should not follow the order file's splits
    date = lambda c: F.date_format(c, "MMMM d, yyyy")
    told = {
        "covered": "Flights are covered.", "not_covered": "Flights are not covered.",
        "reimbursed": "We reimburse flights.", "unknown": "Come as you are.",
    }
    housed = {"covered": "Accommodation is provided.", "partially_covered": "Housing is partially covered.", "unknown": "Bring a coat."}
    say = lambda column, table: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col(column))
    row = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"<tr><td>{label}</td><td>"), value, F.lit("</td></tr>"))).otherwise("")
    html = F.concat(
        F.lit("<!doctype html><html><head><title>Notice</title>"),
        F.when(F.col("organization").isNotNull(), F.concat(F.lit('<meta property="og:site_name" content="'), "organization", F.lit('">'))).otherwise(""),
        F.lit('<script type="application/ld+json">{"@type":"Event","name":"'), "title",
        F.lit('","@graph":[{"@type":["Thing","Place"],"name":"'), "country", F.lit('"}]}</script></head><body><h1>'), "title",
        F.lit("</h1><p>Location: Hall "), F.col("notice_id").cast("string"), F.lit(", "), "country", F.lit("</p><h2>Eligibility</h2><ul><li>Open to "),
        F.when(F.col("region") == "Africa", "African citizens").otherwise("European citizens"), F.lit(".</li>"),
        F.when(F.col("min_age").isNotNull(), F.concat(F.lit("<li>Applicants must be at least "), F.col("min_age").cast("string"), F.lit(" years old.</li>"))).otherwise(""),
        F.lit("</ul><h2>Important Dates</h2><table>"), row("Applications open", date("opening_date")),
        row("Application deadline", date("deadline_date")), row("Orientation", F.lit("January 5, 2031")),
        F.lit("</table><h2>Funding</h2><p>"), say("flights", told), F.lit(" "), say("accommodation", housed), F.lit(" Mentorship by staff.</p>"),
        F.when(F.col("stipend").isNotNull(), F.concat(F.lit("<p>A stipend of "), "stipend", F.lit(" per month.</p>"))).otherwise(""),
        F.lit("<h2>How to Apply</h2><p>"), F.when(F.col("fee"), "An application fee of USD 20 applies.").when(~F.col("fee"), "No application fee.").otherwise("Send your papers."),
        F.when(F.col("cv"), " Submit a CV.").otherwise(""), F.lit('</p><a href="/apply/'), F.col("notice_id").cast("string"), F.lit('">Apply now</a>'),
        F.when(F.col("rolling"), "<p>Rolling applications.</p>").otherwise(""), F.lit("</body></html>"),
    )
    return n.select(
        "notice_id", F.col("seq"), F.col("page_url").alias("requested_url"), F.col("page_url").alias("final_url"), html.alias("raw_html"),
        F.lit(AS_OF).cast("timestamp").alias("fetched_at"),
    )
