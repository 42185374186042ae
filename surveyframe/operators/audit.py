"""Audits of quoted numbers, consistency of results, and disclosure checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.expressions import share
from surveyframe.functions.joins import dimension_join

# A number is tried from its first digit only and never given back in part, so
# long runs of digits are read once.
WHOLE = r"(?:[0-9]{1,3}(?:,[0-9]{3})++(?![0-9])|[0-9]++)"
NUMBER = rf"(?<![0-9])(?<![0-9],){WHOLE}(?:\.[0-9]++)?"
PERCENT = rf"(?:{NUMBER})[%％]"
# "38% (18/47)", also with a sign (but not the dash of "3-5%"), thousands in groups, full-width signs and loose spacing.
CLAIM = rf"((?:(?<![0-9])[-−](?=[0-9]))?{NUMBER})\s*+[%％]\s*+[(（]\s*+({WHOLE})\s*+[/／]\s*+({WHOLE})\s*+[)）]"
# "the Users: 54" or "Users：1,270" inside a caption.
STATED = rf"([^,:：;|]++)[:：]\s*+({WHOLE})"
# Base sizes from which a row is graded, with use and note.
GRADES = (
    (100, "high", "usable", "Stable for this sample"),
    (30, "medium", "direction only", "Small base, read as a direction"),
    (0, "low", "verify first", "Very small base, check again before use"),
)


def strip_tags(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed.

    What is opened and never closed hides the rest of the page, so no pattern is
    tried again further on, however many are left open.
    """
    hidden = r"(?is)<script[^<>]*+>.*?(?:</script>|\z)|<style[^<>]*+>.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
    return F.regexp_replace(F.regexp_replace(html, hidden, " "), r"<[^<>]*+>", " ")


def extract_claims(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """One row per "percentage (n/d)" in each paragraph, numbered by its place there.

    Texts without a percent sign leave before any pattern is tried.
    """
    keys = [c for c in paragraphs.columns if c != text]
    signs = F.col(text).contains("%") | F.col(text).contains("％")
    found = paragraphs.filter(signs).select(
        *keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(CLAIM), F.lit(0))).alias("pos", "claim")
    )

    def part(i: int) -> Column:
        return F.translate(F.regexp_extract("claim", CLAIM, i), "−,", "-")

    return found.select(
        *keys,
        (F.col("pos") + 1).alias("pos"),
        "claim",
        part(1).cast("double").alias("pct"),
        F.length(F.regexp_extract("claim", r"^[-−]?[0-9,]+\.([0-9]+)", 1)).alias("decimals"),
        part(2).try_cast("bigint").alias("n"),
        part(3).try_cast("bigint").alias("d"),
    )


def check_claims(claims: DataFrame, fail: bool = False) -> DataFrame:
    """Recompute each claim; right means within half a unit of its last printed digit.

    With ``fail`` the job that reads the result stops at the first wrong claim.
    """
    recomputed = share("n", "d") * 100
    half_unit = F.lit(0.5) / F.pow(F.lit(10.0), F.col("decimals"))
    right = F.coalesce(F.abs(F.col("pct") - recomputed) <= half_unit + F.lit(1e-9), F.lit(False))
    checked = claims.withColumns({"recomputed": recomputed, "ok": right})
    if not fail:
        return checked
    stop = F.raise_error(F.concat(F.lit("claim does not add up: "), F.col("claim"))).cast("boolean")
    return checked.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(stop))


def _sources(results: DataFrame) -> DataFrame:
    """Published fractions, one row each: how many results carry it, and the first of them."""
    return results.groupBy("n", "d").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.min("question_id").alias("question_id"),
        F.min(F.concat_ws(" | ", "question_id", "option_id")).alias("source"),
    )


def match_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims with the published fraction they quote; every claim stays, at most one row each.

    Results are reduced to one row per fraction first, so a fraction many
    results share does not multiply the claims quoting it.
    """
    return claims.join(_sources(results), ["n", "d"], "left").fillna(0, ["n_sources"])


def missing_refs(refs: DataFrame, catalogue: DataFrame, known_types: Sequence[str]) -> DataFrame:
    """References to figures that are absent or of a type nothing can show."""
    types = catalogue.select("figure_id", F.col("type").alias("_type"))
    return (
        dimension_join(refs, types, ["figure_id"])
        .withColumn(
            "problem",
            F.when(F.col("_type").isNull(), F.lit("no data")).when(
                ~F.col("_type").isin(list(known_types)), F.lit("unknown type")
            ),
        )
        .filter(F.col("problem").isNotNull())
        .drop("_type")
    )


def number_index(claims: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Where each quoted number stands, its source, filter, numerator, denominator and formula.

    ``key`` names the columns that tie a claim to its result row; results also
    carry ``source`` and ``filter``.
    """
    wanted = results.select(*key, "source", "filter", F.col("n").alias("src_n"), F.col("d").alias("src_d"))
    formula = F.concat(F.col("src_n").cast("string"), F.lit(" / "), F.col("src_d").cast("string"))
    return claims.join(wanted, list(key), "left").withColumn("formula", formula)


def source_audit(claims: DataFrame, results: DataFrame, questions: DataFrame) -> DataFrame:
    """Question and base behind each claim; unmatched and ambiguous claims are named."""
    matched = match_claims(claims, results)
    named = dimension_join(matched, questions.select("question_id", "base_rule"), ["question_id"])
    return named.withColumn(
        "status",
        F.when(F.col("n_sources") == 0, "unmatched").when(F.col("n_sources") > 1, "ambiguous").otherwise("matched"),
    )


def check_pages(pages: DataFrame, results: DataFrame, key: str = "page_id") -> DataFrame:
    """Percentages on pages that none of the page's own results has, printed as whole or one-decimal percents.

    ``results`` carry the ``key`` of the page that shows them: with one set of forms
    for all pages, nearly every percentage would be some result's.
    """
    tenths = F.floor(share("n", "d") * 1000 + F.lit(0.5))
    whole = F.floor(share("n", "d") * 100 + F.lit(0.5))
    one = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    forms = (
        results.select(key, F.explode(F.array(F.concat(whole.cast("string"), F.lit("%")), F.concat(one, F.lit("%")))).alias("printed"))
        .filter(F.col("printed").isNotNull())
        .distinct()
    )
    signs = F.col("html").contains("%") | F.col("html").contains("％")
    found = pages.filter(signs).select(
        key, F.explode(F.regexp_extract_all(strip_tags(F.col("html")), F.lit(PERCENT), F.lit(0))).alias("printed")
    )
    plain = F.translate("printed", "％,", "%")
    counted = found.withColumn("printed", plain).groupBy(key, "printed").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(forms, [key, "printed"], "left_anti")


#: Decimals of a printed percentage up to which it is traced.
MOST_DECIMALS = 6


def trace_percents(pages: DataFrame, results: DataFrame, key: str = "page_id") -> DataFrame:
    """Every percentage on a page with the results that print as it, whether a fraction stands beside it or not.

    Columns: key, printed, times, n_sources (results that round to it, halves up), n_shares
    (different fractions among them) and the first of their names. A printed percentage
    is the interval of shares that round to it; at its number of decimals these intervals
    part the line into bins, so the two sides meet by an equi-join on (decimals, bin).
    Both are added up first: pages to their different percentages, results to one row for
    each bin, so that a share that many results have is not paired with each page that
    quotes it. With more than MOST_DECIMALS decimals nothing is traced; a result without
    a base has no share. ``results`` holds (question_id, option_id, n, d).
    """
    signs = F.col("html").contains("%") | F.col("html").contains("％")
    found = pages.filter(signs).select(
        key, F.explode(F.regexp_extract_all(strip_tags(F.col("html")), F.lit(PERCENT), F.lit(0))).alias("printed")
    )
    found = found.withColumn("printed", F.translate("printed", "％,", "%")).groupBy(key, "printed").agg(F.count(F.lit(1)).alias("times"))
    digits = F.substring_index("printed", "%", 1)
    decimals = F.when(F.instr("printed", ".") > 0, F.length(F.substring_index(digits, ".", -1))).otherwise(0)
    wanted = found.withColumn("decimals", decimals).withColumn("bin", F.replace(digits, F.lit("."), F.lit("")).try_cast("bigint"))

    # the exact share in units of the last digit, halves up, at every number of decimals
    fractions = results.filter("d > 0 and n >= 0").groupBy("n", "d").agg(
        F.count(F.lit(1)).alias("sources"), F.min(F.concat_ws(" | ", "question_id", "option_id")).alias("first_source")
    )
    units = [
        F.struct(F.lit(i).alias("decimals"), F.expr(f"(cast(n as decimal(18, 0)) * {200 * 10**i} + d) div (2 * cast(d as decimal(18, 0)))").cast("bigint").alias("bin"))
        for i in range(MOST_DECIMALS + 1)
    ]
    bins = fractions.select("sources", "first_source", F.inline(F.array(*units))).groupBy("decimals", "bin").agg(
        F.sum("sources").alias("n_sources"), F.count(F.lit(1)).alias("n_shares"), F.min("first_source").alias("source")
    )
    traced = wanted.join(bins, ["decimals", "bin"], "left").fillna(0, ["n_sources", "n_shares"])
    return traced.select(key, "printed", "times", "n_sources", "n_shares", "source")


def translation_check(source: DataFrame, target: DataFrame, key: Sequence[str] = ("doc_id", "para_no")) -> DataFrame:
    """Paragraphs whose numbers differ between two languages.

    Paragraphs are reduced to their sorted numbers, and those without any are
    left out, before the two sides meet.
    """

    def numbers(paragraphs: DataFrame, out: str) -> DataFrame:
        found = F.sort_array(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)))
        return paragraphs.select(*key, F.array_join(found, " ").alias(out)).filter(F.col(out) != "")

    both = numbers(source, "numbers_source").join(numbers(target, "numbers_target"), list(key), "full_outer")
    return both.fillna("", ["numbers_source", "numbers_target"]).filter(
        F.col("numbers_source") != F.col("numbers_target")
    )


def check_consistency(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking an identity, one row per identity broken; a null condition counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return rows.withColumn("broken", F.explode(broken))


def share_rules(tolerance: float = 6e-4) -> dict[str, Column]:
    """A published share is its count over its base, up to the rounding it was stored with."""
    return {
        "count within base": (F.col("n") >= 0) & (F.col("n") <= F.col("d")),
        "share is count over base": F.abs(F.col("pct") - share("n", "d")) <= tolerance,
    }


def parts_gaps(cells: DataFrame, key: Sequence[str] = ("question_id",)) -> DataFrame:
    """Single-answer questions whose counts do not add to their base."""
    sums = cells.groupBy(*key).agg(F.sum("n").alias("n_parts"), F.max("d").alias("d"))
    return sums.filter(F.col("n_parts") != F.col("d"))


def rating_rules() -> dict[str, Column]:
    """Five counts add to the base, and the stored tails are the sums of theirs."""
    c = [F.col(f"c{i}") for i in range(1, 6)]
    return {
        "parts add to base": c[0] + c[1] + c[2] + c[3] + c[4] == F.col("d"),
        "tail from 3": c[2] + c[3] + c[4] == F.col("n3plus"),
        "tail from 4": c[3] + c[4] == F.col("n4plus"),
    }


def segment_total_gaps(by_segment: DataFrame, total: DataFrame, key: Sequence[str]) -> DataFrame:
    """Options whose segment counts or bases do not add up to the total's."""
    summed = by_segment.groupBy(*key).agg(F.sum("n").alias("n_segments"), F.sum("d").alias("d_segments"))
    both = total.select(*key, "n", "d").join(summed, list(key), "full_outer")
    return both.filter(
        ~(F.col("n").eqNullSafe(F.col("n_segments")) & F.col("d").eqNullSafe(F.col("d_segments")))
    )


def stated_bases(captions: DataFrame, note: str = "note") -> DataFrame:
    """The bases a caption names, one row per "label: number" in it."""
    keys = [c for c in captions.columns if c != note]
    pairs = captions.select(*keys, F.explode(F.regexp_extract_all(F.col(note), F.lit(STATED), F.lit(0))).alias("_pair"))
    return pairs.select(
        *keys,
        F.trim(F.regexp_extract("_pair", STATED, 1)).alias("label"),
        F.replace(F.regexp_extract("_pair", STATED, 2), F.lit(","), F.lit("")).try_cast("bigint").alias("stated_d"),
    )


def caption_gaps(captions: DataFrame, cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stated bases that differ from the base in the data. ``captions`` holds the key and ``stated_d``."""
    bases = cells.groupBy(*key).agg(F.max("d").alias("d"))
    return captions.join(bases, list(key), "left").filter(~F.col("stated_d").eqNullSafe(F.col("d")))


def annotate_reliability(results: DataFrame, grades: Sequence[tuple[int, str, str, str]] = GRADES) -> DataFrame:
    """Reliability, decision use and reading note by the size of the base."""

    def pick(i: int) -> Column:
        expr = None
        for grade in grades:
            cond = F.col("d") >= grade[0]
            expr = F.when(cond, grade[i]) if expr is None else expr.when(cond, grade[i])
        return expr

    return results.withColumns({"reliability": pick(1), "decision_use": pick(2), "reading_note": pick(3)})


def small_cells(respondents: DataFrame, quasi_ids: Sequence[str], k: int) -> DataFrame:
    """Combinations of quasi-identifiers held by fewer than ``k`` people."""
    return respondents.groupBy(*quasi_ids).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k)


def suppress(results: DataFrame, k: int, within: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Hide counts below ``k`` together with their share; zero cells reveal nobody and stay.

    ``within`` names the columns that share a published base to which the counts add:
    where only one cell of it is hidden, it could be had by subtraction, so the
    smallest other cell that is not zero is hidden too, ties by ``order``; where there is
    none, the base ``d`` is hidden, as it is that cell's count. The cells of a base are
    those of declared lists. Bases that add up over more than one column are the matter of
    ``disclosure.protect_margins``.
    """
    hide = (F.col("n") > 0) & (F.col("n") < k)
    if within:
        base = Window.partitionBy(*within)
        rank = F.row_number().over(base.orderBy(F.col("_small") | (F.col("n") == 0), "n", *order))
        results = results.withColumn("_small", hide).withColumn("_alone", F.count_if("_small").over(base) == 1)
        if "d" in results.columns:
            bare = F.col("_alone") & (F.count_if((F.col("n") > 0) & ~F.col("_small")).over(base) == 0)
            results = results.withColumn("_bare", bare).withColumn("d", F.when(~F.col("_bare"), F.col("d"))).drop("_bare")
        results = results.withColumn("_next", F.col("_alone") & ~F.col("_small") & (F.col("n") > 0) & (rank == 1))
        results = results.withColumn("_hide", F.col("_small") | F.col("_next")).drop("_small", "_alone", "_next")
        hide = F.col("_hide")
        out = results.withColumns({"suppressed": hide, "pct": F.when(~hide, F.col("pct")), "n": F.when(~hide, F.col("n"))})
        return out.drop("_hide")
    return results.withColumns(
        {
            "suppressed": hide,
            "pct": F.when(~hide, F.col("pct")),
            "n": F.when(~hide, F.col("n")),
        }
    )
