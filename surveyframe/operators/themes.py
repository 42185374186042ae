"""Open-text themes from a keyword codebook.

A codebook is a declared list of (theme, rule) in order of precedence. A rule is
a list of keywords, any of which in any letter case gives the theme, or a
regular expression. Each text gets one flag per theme; there is no join of texts
to keywords. Codebooks of thousands of keywords are tables, looked up through an
index (``code_by_index``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.expressions import share
from surveyframe.functions.joins import dimension_join
from surveyframe.session import settled
from surveyframe.operators.tally import tally_ballots

Codebook = Sequence[tuple[str, Sequence[str] | str]]
UNCODED = "Not specified"


def answered(text: Column) -> Column:
    """A blank text is not an answer."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def _matches(rule: Sequence[str] | str) -> Column:
    if isinstance(rule, str):
        return F.col("text").rlike(rule)
    return reduce(Column.__or__, [F.contains(F.col("_lower"), F.lit(word.lower())) for word in rule])


def theme_flags(texts: DataFrame, codebook: Codebook, multi: bool = True) -> DataFrame:
    """Flags ``o0, o1, ...`` per theme, the last one for answers no theme fits.

    With ``multi`` a text holds every theme it matches, otherwise only the
    first one in codebook order.
    """
    hits = [_matches(rule) for _, rule in codebook]
    lowered = texts.withColumn("_lower", F.lower("text"))
    coded = lowered.withColumns({f"_h{i}": hit for i, hit in enumerate(hits)}).drop("_lower")
    flags, before = [], F.lit(False)
    for i in range(len(codebook)):
        hit = F.col(f"_h{i}")
        flags.append(hit if multi else hit & ~before)
        before = before | hit
    flags.append(~before)
    return coded.withColumns({f"o{i}": f for i, f in enumerate(flags)}).drop(*[f"_h{i}" for i in range(len(hits))])


def theme_names(codebook: Codebook) -> list[str]:
    return [theme for theme, _ in codebook] + [UNCODED]


def theme_tally(texts: DataFrame, codebook: Codebook, multi: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Answers per theme over those who answered; one row per answer expected in ``texts``."""
    coded = theme_flags(texts.filter(answered(F.col("text"))), codebook, multi)
    cells = tally_ballots(coded, theme_names(codebook), by, picked=lambda i: F.col(f"o{i}"))
    return cells.withColumnRenamed("option_id", "theme")


def theme_by(texts: DataFrame, members: DataFrame, codebook: Codebook) -> DataFrame:
    """Each theme over all who answered, and within a membership over all its members.

    ``members`` holds (respondent_id, is_member) for the whole sample, so the
    second base also counts members who wrote nothing. Texts are reduced to one row
    of flags per respondent before the join, so a person with several texts is one
    person, who holds the themes of all of them.
    """
    names = theme_names(codebook)
    flags = [f"o{i}" for i in range(len(names))]
    each = theme_flags(texts.filter(answered(F.col("text"))), codebook)
    coded = each.groupBy("respondent_id").agg(*[F.bool_or(f).alias(f) for f in flags[:-1]])
    uncoded = ~reduce(Column.__or__, [F.col(f) for f in flags[:-1]], F.lit(False))
    coded = coded.withColumn(flags[-1], uncoded)
    counts = (
        members.select("respondent_id", "is_member")
        .join(coded.withColumn("_wrote", F.lit(True)), "respondent_id", "left")
        .agg(
            F.count("_wrote").alias("d"),
            F.count_if("is_member").alias("d_member"),
            *[F.count_if(f).alias(f"n{i}") for i, f in enumerate(flags)],
            *[F.count_if(F.col(f) & F.col("is_member")).alias(f"m{i}") for i, f in enumerate(flags)],
        )
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("theme"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("n_member"))
            for i, t in enumerate(names)
        ]
    )
    return counts.select("d", "d_member", F.inline(rows)).withColumns(
        {"pct": share("n", "d"), "pct_member": share("n_member", "d_member")}
    )


#: Characters of the longest blocks by which keywords are looked up.
GRAM = 16
#: Characters of the pieces that a text is cut into to read at many places of it.
PIECE = 64


def _blocks(text: Column, size: int) -> Column:
    """A text's characters, ``size`` by ``size``; the last block may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _read_at(text: Column, spots: Column) -> Column:
    """The strings of ``_size`` characters after the first ``_at``, for each of the spots; the text is gone through once."""

    def one(pieces: Column, spot: Column) -> Column:
        first, last = F.floor(spot["_at"] / PIECE).cast("int"), F.floor((spot["_at"] + spot["_size"] - 1) / PIECE).cast("int")
        return F.array_join(F.slice(pieces, first + 1, last - first + 1), "").substr(spot["_at"] % PIECE + 1, spot["_size"])

    return F.array_distinct(F.flatten(F.transform(F.array(_blocks(text, PIECE)), lambda pieces: F.transform(spots, lambda spot: one(pieces, spot)))))


def code_by_index(texts: DataFrame, words: DataFrame, multi: bool = True, gram: int = GRAM) -> DataFrame:
    """``texts`` with ``theme`` and ``ord``, a row for each theme of an answer, for codebooks of any size.

    ``words`` holds (theme, ord, word): a text has a theme if it holds any of its words, in
    any letter case, wherever in the text; a text that fits none has UNCODED, with a null
    ``ord``, and without ``multi`` only the theme of smallest ``ord`` counts (by name
    between equals). Blank texts are no answers; empty and null words are no rules.
    Repeated rows are answers of their own.

    Texts are cut into blocks of a power of two of characters, ``gram`` at most, and a
    keyword of twice as many holds a whole block wherever it begins: it is indexed by its
    strings of that many characters at each offset. Blocks meet the index by an
    equi-join, which tells where a keyword of which length may stand; the strings found
    there meet the keywords by another one. So work follows the texts and the codebook,
    not the number of keywords that begin alike.
    """
    rules = words.select("theme", "ord", F.lower("word").alias("_word")).filter(F.length("_word") > 0).distinct()
    size = F.length("_word")
    half = F.lit(1)
    for n in (1 << k for k in range(1, gram.bit_length())):
        half = F.when(size >= 2 * n - 1, n).otherwise(half)
    rules = settled(rules.withColumns({"_size": size, "_half": half}), "rules")
    halves = sorted(r["_half"] for r in rules.select("_half").distinct().collect())  # one for each power of two
    rows = texts.filter(answered(F.col("text"))).withColumn("_row", F.monotonically_increasing_id())
    rows = settled(rows, "answers")
    lowered = rows.select("_row", F.lower("text").alias("_lower"))
    offset = F.explode(F.sequence(F.lit(0), F.col("_half") - 1)).alias("_offset")
    index = rules.select("_word", "_size", "_half", offset).select("_half", F.expr("substr(_word, _offset + 1, _half)").alias("_gram"), "_offset", "_size").distinct()
    index = settled(index, "index")
    spots = [
        dimension_join(lowered.select("_row", F.posexplode(_blocks(F.col("_lower"), n)).alias("_block", "_gram")), index.filter(F.col("_half") == n).select("_gram").distinct(), ["_gram"], "inner")
        .join(index.filter(F.col("_half") == n), "_gram")
        .select("_row", (F.col("_block") * n - F.col("_offset")).alias("_at"), "_size")
        for n in halves
    ]
    none = lowered.select("_row", F.lit(0).alias("_at"), F.lit(0).alias("_size")).limit(0)
    spots = reduce(DataFrame.unionAll, spots, none).filter(F.col("_at") >= 0)
    spots = settled(spots.groupBy("_row").agg(F.collect_set(F.struct("_at", "_size")).alias("_spots")), "spots")
    tried = spots.join(lowered, "_row").select("_row", F.explode(_read_at(F.col("_lower"), F.col("_spots"))).alias("_word"))
    found = dimension_join(tried, rules.select("_word", "theme", "ord"), ["_word"], "inner").select("_row", "theme", "ord").distinct()
    if not multi:
        first = Window.partitionBy("_row").orderBy("ord", "theme")
        found = found.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") == 1).drop("_first")
    return rows.join(found, "_row", "left").withColumn("theme", F.coalesce("theme", F.lit(UNCODED))).drop("_row")


def index_tally(texts: DataFrame, words: DataFrame, multi: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Answers per theme found, over all who answered; one row per answer expected in ``texts``."""
    bases = texts.filter(answered(F.col("text"))).groupBy(*by).agg(F.count(F.lit(1)).alias("d"))
    counted = code_by_index(texts, words, multi).groupBy(*by, "theme").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(bases, list(by)).withColumn("pct", share("n", "d"))
