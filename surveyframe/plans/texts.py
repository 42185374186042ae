"""Registered queries: themes, claims, pages and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.model import dimension
from surveyframe.operators import alignment, audit, themes
from surveyframe.plans import views as v
from surveyframe.plans.registry import query
from surveyframe.sources.readers import paragraphs

_PATTERNS = [r"@|555-", r"(?i)licen[sc]e|copyright", r"(?i)token|secret", r"[0-9]{16}", r"%%%|\$\$\$|###"]
_HITS = ", ".join(f"regexp_matches(text, '{pattern}') AS h{i}" for i, pattern in enumerate(_PATTERNS))
_NAMES = [name for name, _ in v.CODEBOOK]
_NONE = " OR ".join(f"h{i}" for i in range(len(_NAMES)))
_CODED = f"coded AS (SELECT doc_id, lang, {_HITS} FROM documents WHERE length(trim(text)) > 0)"


def _theme_sql(multi: bool) -> str:
    """Rows (lang, theme, ord) of every code given to a document."""
    parts = []
    for i, name in enumerate(_NAMES):
        before = "" if multi else "".join(f" AND NOT h{j}" for j in range(i))
        parts.append(f"SELECT doc_id, lang, '{name}' AS theme, {i + 1} AS ord FROM coded WHERE h{i}{before}")
    parts.append(f"SELECT doc_id, lang, '{themes.UNCODED}', {len(_NAMES) + 1} FROM coded WHERE NOT ({_NONE})")
    return "codes AS (" + " UNION ALL ".join(parts) + ")"


_THEMES = "themes(ord, theme) AS (VALUES " + ", ".join(
    f"({i + 1}, '{name}')" for i, name in enumerate([*_NAMES, themes.UNCODED])
) + ")"
_TALLY = """SELECT b.lang, t.theme, t.ord, count(c.doc_id) AS n, any_value(b.d) AS d, count(c.doc_id) / any_value(b.d) AS pct
  FROM (SELECT lang, count(*) AS d FROM coded GROUP BY 1) b CROSS JOIN themes t
  LEFT JOIN codes c ON c.lang = b.lang AND c.theme = t.theme GROUP BY 1, 2, 3"""


@query("agg18_theme_tally", f"WITH {_CODED}, {_theme_sql(True)}, {_THEMES} {_TALLY}")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    return themes.theme_tally(v.texts(spark, sf), v.CODEBOOK, by=["lang"])


@query("agg18_theme_tally_single", f"WITH {_CODED}, {_theme_sql(False)}, {_THEMES} {_TALLY}")
def agg18_single(spark: SparkSession, sf: str) -> DataFrame:
    return themes.theme_tally(v.texts(spark, sf), v.CODEBOOK, multi=False, by=["lang"])


@query(
    "agg18_codebook_index",
    """WITH words AS (SELECT 'item ' || item_id AS theme, lower(substr(trim(text), 1, 24)) AS word FROM benchmark),
        a AS (SELECT doc_id, lang, lower(text) AS t FROM documents WHERE length(trim(text)) > 0),
        f AS (SELECT DISTINCT doc_id, theme FROM a JOIN words ON word <> '' AND contains(t, word)),
        b AS (SELECT lang, count(*) AS d FROM a GROUP BY 1)
        SELECT lang, coalesce(theme, 'Not specified') AS theme, count(*) AS n, any_value(d) AS d, count(*) / any_value(d) AS pct
        FROM a LEFT JOIN f USING (doc_id) JOIN b USING (lang) GROUP BY 1, 2""",
)
def agg18_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the benchmark item whose opening they quote; every item is a theme with one keyword."""
    words = v.table(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), "item_id").alias("theme"), F.col("item_id").alias("ord"), F.substring(F.trim("text"), 1, 24).alias("word")
    )
    return themes.index_tally(v.texts(spark, sf), words, by=["lang"])


@query(
    "agg19_theme_by_membership",
    f"""WITH {_CODED}, {_theme_sql(True)}, {_THEMES},
        m AS (SELECT d.doc_id, coalesce(quality = 1, false) AS is_member FROM documents d LEFT JOIN labels USING (doc_id)),
        b AS (SELECT (SELECT count(*) FROM coded) AS d, (SELECT count(*) FROM m WHERE is_member) AS d_member)
        SELECT t.theme, count(c.doc_id) AS n, count(c.doc_id) FILTER (WHERE is_member) AS n_member, any_value(b.d) AS d,
               any_value(b.d_member) AS d_member, count(c.doc_id) / any_value(b.d) AS pct,
               count(c.doc_id) FILTER (WHERE is_member) / any_value(b.d_member) AS pct_member
        FROM b CROSS JOIN themes t LEFT JOIN codes c ON c.theme = t.theme LEFT JOIN m ON m.doc_id = c.doc_id
        GROUP BY 1""",
)
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    good = v.table(spark, sf, "labels").select(
        F.col("doc_id").alias("respondent_id"), (F.col("quality") == 1).alias("is_member")
    )
    sample = v.texts(spark, sf).select("respondent_id").join(good, "respondent_id", "left").fillna(False, ["is_member"])
    return themes.theme_by(v.texts(spark, sf), sample, v.CODEBOOK)


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return audit.extract_claims(v.report(spark, sf))


_OK = "abs(pct - n / d * 100) <= 0.5 / pow(10.0, decimals) + 1e-9"
_CHECKED = f"WITH {v.SQL_CLAIMS}"


@query("aud1_extract_claims", f"{_CHECKED} SELECT * FROM claims")
def aud1(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf)


@query("aud2_check_claims", f"{_CHECKED} SELECT doc_id, pos, claim, n / d * 100 AS recomputed FROM claims WHERE NOT ({_OK})")
def aud2(spark: SparkSession, sf: str) -> DataFrame:
    wrong = audit.check_claims(_claims(spark, sf)).filter(~F.col("ok"))
    return wrong.select("doc_id", "pos", "claim", "recomputed")


_RESULTS = f"{v.SQL_CLAIMS}, results AS {v.SQL_RESULTS_LONG.split(', results AS', 1)[1]}"
_SOURCES = """src AS (SELECT n, d, count(*) AS n_sources, min(question_id) AS question_id,
                             min(question_id || ' | ' || option_id) AS source FROM results GROUP BY 1, 2)"""


@query(
    "joi5_match_claims",
    f"""WITH {_RESULTS}, {_SOURCES}
        SELECT doc_id, pos, claim, c.n, c.d, coalesce(n_sources, 0) AS n_sources, question_id, source
        FROM claims c LEFT JOIN src ON src.n = c.n AND src.d = c.d""",
)
def joi5(spark: SparkSession, sf: str) -> DataFrame:
    matched = audit.match_claims(_claims(spark, sf), v.results_long(spark, sf))
    return matched.select("doc_id", "pos", "claim", "n", "d", "n_sources", "question_id", "source")


@query(
    "aud3_number_index",
    f"""WITH {v.SQL_CLAIMS}, {v.SQL_RESULTS_LONG.split(', results AS', 1)[1].join(['results AS', ''])}
        SELECT doc_id, pos, claim, CASE pos WHEN 1 THEN 'finished' ELSE 'urgent' END AS source,
               'respondent_id = ' || doc_id AS filter, r.n AS src_n, r.d AS src_d, r.n || ' / ' || r.d AS formula
        FROM claims c LEFT JOIN results r ON r.option_id = c.doc_id::VARCHAR
         AND r.question_id = CASE pos WHEN 1 THEN 'finished' ELSE 'urgent' END""",
)
def aud3(spark: SparkSession, sf: str) -> DataFrame:
    results = v.results_long(spark, sf).select(
        F.col("option_id").cast("bigint").alias("doc_id"),
        F.when(F.col("question_id") == "finished", 1).otherwise(2).alias("pos"),
        F.col("question_id").alias("source"),
        F.concat(F.lit("respondent_id = "), "option_id").alias("filter"),
        "n",
        "d",
    )
    index = audit.number_index(_claims(spark, sf), results, ["doc_id", "pos"])
    return index.select("doc_id", "pos", "claim", "source", "filter", "src_n", "src_d", "formula")


@query(
    "aud4_source_audit",
    f"""WITH {_RESULTS}, {_SOURCES}
        SELECT doc_id, pos, c.n, c.d, question_id,
               CASE question_id WHEN 'finished' THEN 'customers with orders' WHEN 'urgent' THEN 'all orders' END AS base_rule,
               CASE WHEN n_sources IS NULL THEN 'unmatched' WHEN n_sources > 1 THEN 'ambiguous' ELSE 'matched' END AS status
        FROM claims c LEFT JOIN src ON src.n = c.n AND src.d = c.d""",
)
def aud4(spark: SparkSession, sf: str) -> DataFrame:
    questions = dimension(spark, question_id=["finished", "urgent"], base_rule=["customers with orders", "all orders"])
    audited = audit.source_audit(_claims(spark, sf), v.results_long(spark, sf), questions)
    return audited.select("doc_id", "pos", "n", "d", "question_id", "base_rule", "status")


_STRIP = """regexp_replace(regexp_replace(html,
  '(?is)<script[^<>]*>.*?(?:</script>|\\z)|<style[^<>]*>.*?(?:</style>|\\z)|<!--.*?(?:-->|\\z)', ' ', 'g'), '<[^<>]*>', ' ', 'g')"""


@query(
    "aud5_check_pages",
    f"""WITH {v.SQL_REPORT},
        pages2 AS (SELECT 'page ' || page_id AS page_id, html FROM pages
                   UNION ALL SELECT 'report ' || doc_id, '<html><style>p{{width:99.9%}}</style><p>' || text || '</p></html>' FROM report),
        results AS (SELECT 'report ' || respondent_id AS page_id, n_done AS n, d FROM customer_results
                    UNION ALL SELECT 'report ' || respondent_id, n_urgent, d FROM customer_results),
        forms AS (SELECT page_id, floor(n / d * 100 + 0.5)::BIGINT || '%' AS printed FROM results
                  UNION SELECT page_id, (floor(n / d * 1000 + 0.5)::BIGINT // 10) || '.' || (floor(n / d * 1000 + 0.5)::BIGINT % 10) || '%' FROM results),
        found AS (SELECT page_id, unnest(regexp_extract_all({_STRIP}, '[0-9]+(?:\\.[0-9]+)?%')) AS printed FROM pages2)
        SELECT page_id, printed, count(*) AS times FROM found ANTI JOIN forms USING (page_id, printed) GROUP BY 1, 2""",
)
def aud5(spark: SparkSession, sf: str) -> DataFrame:
    given = v.table(spark, sf, "pages").select(F.concat(F.lit("page "), "page_id").alias("page_id"), "html")
    built = v.report(spark, sf).select(
        F.concat(F.lit("report "), "doc_id").alias("page_id"),
        F.concat(F.lit("<html><style>p{width:99.9%}</style><p>"), "text", F.lit("</p></html>")).alias("html"),
    )
    results = v.results_long(spark, sf).withColumn("page_id", F.concat(F.lit("report "), "option_id"))
    return audit.check_pages(given.unionByName(built), results)


_RESULT_ROWS = """results AS (SELECT 'finished' AS question_id, respondent_id::VARCHAR AS option_id, n_done AS n, d FROM customer_results
  UNION ALL SELECT 'urgent', respondent_id::VARCHAR, n_urgent, d FROM customer_results)"""


@query(
    "aud5_trace_percents",
    f"""WITH {v.SQL_REPORT}, {_RESULT_ROWS},
        pages2 AS (SELECT 'page ' || page_id AS page_id, html FROM pages
                   UNION ALL SELECT 'report ' || doc_id, '<html><style>p{{width:99.9%}}</style><p>' || text || '</p></html>' FROM report
                   UNION ALL SELECT 'summary ' || respondent_id, '<p>About ' || (floor(n_done / d * 10000 + 0.5)::BIGINT // 100) || '.'
                     || lpad((floor(n_done / d * 10000 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || '% done, not 12.345%</p>' FROM customer_results),
        found AS (SELECT page_id, unnest(regexp_extract_all({_STRIP}, '[0-9]+(?:\\.[0-9]+)?%')) AS printed FROM pages2),
        w AS (SELECT page_id, printed, count(*) AS times, length(regexp_extract(printed, '\\.([0-9]+)%', 1)) AS decimals,
                     replace(replace(printed, '.', ''), '%', '')::BIGINT AS bin FROM found GROUP BY 1, 2),
        s AS (SELECT *, (n * 200 * power(10, k)::BIGINT + d) // (2 * d) AS bin FROM results, (SELECT unnest(range(7)) AS k)),
        b AS (SELECT k AS decimals, bin, count(*) AS n_sources, count(DISTINCT (n, d)) AS n_shares, min(question_id || ' | ' || option_id) AS source FROM s GROUP BY 1, 2)
        SELECT page_id, printed, times, coalesce(n_sources, 0) AS n_sources, coalesce(n_shares, 0) AS n_shares, source FROM w LEFT JOIN b USING (decimals, bin)""",
)
def aud5_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages, the report and a summary that quotes shares without their fractions."""
    given = v.table(spark, sf, "pages").select(F.concat(F.lit("page "), "page_id").alias("page_id"), "html")
    built = v.report(spark, sf).select(
        F.concat(F.lit("report "), "doc_id").alias("page_id"),
        F.concat(F.lit("<html><style>p{width:99.9%}</style><p>"), "text", F.lit("</p></html>")).alias("html"),
    )
    units = F.floor(F.col("n_done") / F.col("d") * 10_000 + F.lit(0.5))
    printed = F.concat((units / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(units, F.lit(100)).cast("string"), 2, "0"))
    short = v.customer_results(spark, sf).select(
        F.concat(F.lit("summary "), "respondent_id").alias("page_id"), F.concat(F.lit("<p>About "), printed, F.lit("% done, not 12.345%</p>")).alias("html")
    )
    return audit.trace_percents(given.unionByName(built).unionByName(short), v.results_long(spark, sf))


@query(
    "aud6_translation_check",
    f"""WITH {v.paragraphs_sql()}, {v.paragraphs_sql("upper(replace(text, '555-', '556-'))", "other")},
        a AS (SELECT doc_id, para_no, array_to_string(list_sort(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')), ' ') AS x FROM paras),
        b AS (SELECT doc_id, para_no, array_to_string(list_sort(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')), ' ') AS x FROM other)
        SELECT doc_id, para_no::INT AS para_no, coalesce(a.x, '') AS numbers_source, coalesce(b.x, '') AS numbers_target
        FROM a FULL JOIN b USING (doc_id, para_no) WHERE coalesce(a.x, '') <> coalesce(b.x, '')""",
)
def aud6(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    other = docs.withColumn("text", F.upper(F.replace("text", F.lit("555-"), F.lit("556-"))))
    return audit.translation_check(paragraphs(docs), paragraphs(other))


_PLAIN = r"""list_transform(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.')
  THEN regexp_replace(regexp_replace(x, '^0+([0-9])', '\1'), '\.?0+$', '') ELSE regexp_replace(x, '^0+([0-9])', '\1') END)"""


@query(
    "aud6_align_translation",
    f"""WITH {v.paragraphs_sql()}, {v.paragraphs_sql("upper(replace(text, '555-', '556-'))", "other")},
        a AS (SELECT doc_id, para_no, array_to_string(list_sort({_PLAIN}), ' ') AS x FROM paras),
        b AS (SELECT doc_id, para_no, array_to_string(list_sort({_PLAIN}), ' ') AS x FROM other),
        size AS (SELECT d.doc_id, count(p.doc_id) AS n FROM documents d LEFT JOIN paras p USING (doc_id) GROUP BY 1)
        SELECT doc_id, para_no AS source_no, para_no + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS target_no,
               a.x AS numbers_source, b.x AS numbers_target, 'changed' AS kind
        FROM a JOIN b USING (doc_id, para_no) WHERE a.x <> b.x
        UNION ALL SELECT doc_id, NULL, CASE doc_id % 3 WHEN 0 THEN 1 ELSE n + 1 END, '', (7000000 + doc_id)::VARCHAR, 'only in target'
        FROM size WHERE doc_id % 3 < 2""",
)
def aud6_align(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers misprinted in a translation that has one paragraph more: in front of, behind, or not at all, by document."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    added = F.concat(F.lit("Added: "), F.format_number(F.col("doc_id") + 7_000_000, 0))
    turn = F.pmod("doc_id", F.lit(3))
    parts = F.concat_ws("\n", F.when(turn == 0, added), F.upper(F.replace("text", F.lit("555-"), F.lit("556-"))), F.when(turn == 1, added))
    return alignment.align_translation(paragraphs(docs), paragraphs(docs.withColumn("text", parts)))
