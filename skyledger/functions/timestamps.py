"""Lenient timestamp parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may follow a date: a clock behind spaces, a comma or T; a zone goes.
_CLOCK = r"(?!\d)[T ,]*(.*?)(?: ?(?:UTC|GMT|Z|[+-]\d{1,2}:?\d{2}))?$"
# Fri, Friday, ...
_WEEKDAY = r"(?i)^(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +(?=\S)"
_WEEKDAY_STEMS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
# 5:00 2021-08-13; 5:00 PM 8/13/2021, 5 PM 8/13/2021
_CLOCK_FIRST = r"^(\d{1,2}:\d{2}(?::\d{2})?) +(\S.*)$"
_HALF_FIRST = r"(?i)^(\d{1,2}(?::\d{2}(?::\d{2})?)?) ?([ap])\.?m\.? +(\S.*)$"
# ... 5 PM, 5:00 p.m., 5:00p
_HALF = r"(?i)(?<=[\d ])([ap])(?:\.?m\.?|(?<=\d[ap]))$"

# English month names, full and short.
_MONTH_NAME = (
    r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?"
    r"|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
)
_MONTH_STEMS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Two-digit years from here on belong to the last century, the others to this one.
YEAR_PIVOT = 69


def _centuries(pivot: int) -> list[tuple[str, str]]:
    """Alternatives of two-digit years, and the century that each lot belongs to."""
    lots = [(range(pivot, 100), "19"), (range(pivot), "20")]
    return [("|".join(f"{year:02d}" for year in years), century) for years, century in lots if years]


def _numeric_forms(pivot: int) -> list[tuple[str, str]]:
    """Dates without names, the usual ones first; what no pattern changes is cast as it is."""
    short = [
        (pattern % years, replacement % century)
        for years, century in _centuries(pivot)
        for pattern, replacement in (
            (r"^(\d{1,2})[/.-](\d{1,2})[/.-](%s)" + _CLOCK, "%s$3-$1-$2 $4"),
            (r"^(\d{1,2})[/.-](\d{1,2})[/.-](%s)" + _CLOCK, "%s$3-$2-$1 $4"),
            (r"^(?=3[2-9]|[4-9])(%s)[/.-](\d{1,2})[/.-](\d{1,2})" + _CLOCK, "%s$1-$2-$3 $4"),
        )
    ]
    return [
        # 8/13/2021 5:00, 8-13-2021; 13.8.2021
        (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _CLOCK, "$3-$1-$2 $4"),
        (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _CLOCK, "$3-$2-$1 $4"),
        # 2021/08/13 5:00, 2021.8.13
        (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _CLOCK, "$1-$2-$3 $4"),
        # 20210813, 20210813 05:00
        (r"^(\d{4})(\d{2})(\d{2})" + _CLOCK, "$1-$2-$3 $4"),
        # 202108130500, 20210813T0500, 20210813050000
        (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})$", "$1-$2-$3 $4:$5"),
        (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
        # 2021/08, 08/2021
        (r"^(\d{4})[/.](\d{1,2})(?![/.])" + _CLOCK, "$1-$2-1 $3"),
        (r"^(\d{1,2})[/-](\d{4})$", "$2-$1-1 "),
        # 8/13/21; the years come from the pivot
        *short,
        # 1/2/3
        (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d)" + _CLOCK, "200$3-$1-$2 $4"),
    ]


def _named_forms(pivot: int) -> list[tuple[str, str]]:
    """Dates with the name of a month, whose number stands in its place between two ``~``."""
    short = [
        (rf"^(\d{{1,2}})[ /.-]~(\d+)~\.?[ /.-]({years})" + _CLOCK, f"{century}$3-$2-$1 $4")
        for years, century in _centuries(pivot)
    ]
    return [
        # Aug 13, 2021 5:00
        (r"^~(\d+)~\.?[ ,/.-]+(\d{1,2})(?:st|nd|rd|th)?[ ,/.-]+(\d{4})" + _CLOCK, "$3-$1-$2 $4"),
        # 13 August 2021, 3rd of Aug 2021, 13-Aug-2021 05:00, 13Aug2021
        (r"^(\d{1,2})(?:st|nd|rd|th)?(?: of)?[ /.-]*~(\d+)~\.?[ ,/.-]*(\d{4})" + _CLOCK, "$3-$2-$1 $4"),
        # 2021-Aug-13, 2021 Aug 13
        (r"^(\d{4})[ /.-]+~(\d+)~\.?[ ,/.-]+(\d{1,2})" + _CLOCK, "$1-$2-$3 $4"),
        # August 2021 13
        (r"^~(\d+)~\.?[ ,/.-]+(\d{4}) +(\d{1,2})(?![\d:])" + _CLOCK, "$2-$1-$3 $4"),
        # Aug 2021, 2021 Aug
        (r"^~(\d+)~\.?[ ,/-]+(\d{4})" + _CLOCK, "$2-$1-1 $3"),
        (r"^(\d{4})[ /-]+~(\d+)~$", "$1-$2-1 "),
        # 2021 13 Aug
        (r"^(\d{4}) (\d{1,2}) ~(\d+)~" + _CLOCK, "$1-$3-$2 $4"),
        # 13-Aug-21
        *short,
    ]


def _as_timestamp(text: Column) -> Column:
    """ISO text to a local timestamp; a failed cast is NULL and costs no exception."""
    return text.try_cast("timestamp_ntz")


def _first_fit(text: Column, forms: list[tuple[str, str]]) -> Column:
    """The first form that makes the text a timestamp; the later ones are not tried then.

    Evaluated by a function over an array of one element, and so outside the code that Spark generates
    for a stage: with a chain this long that would be one method beyond what the JVM compiles.
    """
    one = F.transform(
        F.array(text),
        lambda x: F.coalesce(*(_as_timestamp(F.regexp_replace(x, pattern, to)) for pattern, to in forms)),
    )
    return F.get(one, F.lit(0))


def _month_number(name: Column) -> Column:
    stem = F.lower(F.substring(name, 1, 3))
    number = ((F.instr(F.lit(_MONTH_STEMS), stem) + 2) / 3).cast("int")
    return F.when(name.rlike(_MONTH_NAME), number)


def parse_mixed_timestamp(
    readings: DataFrame, source: str, target: str | None = None, year_pivot: int = YEAR_PIVOT
) -> DataFrame:
    """Parse a text column whose format may change from row to row; NULL where nothing fits.

    ISO text needs one cast. Any other text is told by what it looks like (where it has letters, how
    it ends, where its first colon stands), so it meets only the patterns of its kind, the usual ones
    first, and none after the one that fits; those steps see NULL for rows already parsed, so they
    cost nothing there. Ambiguous numeric dates are month first, day first only where month first is
    impossible. A zone is dropped, since readings are in local time. Two-digit years below
    ``year_pivot`` are of this century, the others of the last. A month without a day is its first;
    names of weekdays are read over.
    """
    target = target or source
    kept = readings.columns
    # Each step reads the one before more than once, so they stay separate projections.
    staged = readings.withColumn("__iso", _as_timestamp(F.col(source)))
    staged = staged.withColumn(
        "__text",
        F.when(F.col("__iso").isNull(), F.trim(F.regexp_replace(F.col(source), r"\s+", " "))),
    )
    text = F.col("__text")
    weekday = F.lower(F.substring(text, 1, 3)).isin(_WEEKDAY_STEMS)
    staged = staged.withColumn("__text", F.when(weekday, F.regexp_replace(text, _WEEKDAY, "")).otherwise(text))
    letters = F.lower(text) != F.upper(text)
    swapped = (
        F.when(letters & F.lower(text).rlike(r"^[0-9: ]+[ap]"), F.regexp_replace(text, _HALF_FIRST, "$3 $1$2m"))
        .when(F.instr(text, ":").between(2, 3), F.regexp_replace(text, _CLOCK_FIRST, "$2 $1"))
        .otherwise(text)
    )
    staged = staged.withColumns({"__text": swapped, "__letters": letters})
    ends = F.col("__letters") & F.lower(F.right(text, F.lit(1))).isin("m", ".", "a", "p")
    staged = staged.withColumn("__half", F.when(ends, F.lower(F.regexp_extract(text, _HALF, 1))).otherwise(""))
    body = F.when(F.col("__half") != "", F.trim(F.regexp_replace(text, _HALF, ""))).otherwise(text)
    staged = staged.withColumn("__body", body)
    name = F.regexp_extract("__body", "[A-Za-z]{3,}", 0)
    staged = staged.withColumn("__name", F.when(F.col("__letters"), name).otherwise(""))
    staged = staged.withColumn("__month", F.when(F.col("__name") != "", _month_number(F.col("__name"))))
    numbered = F.replace("__body", "__name", F.concat(F.lit("~"), "__month", F.lit("~")))
    staged = staged.withColumn("__named", F.when(F.col("__month").isNotNull(), numbered))
    staged = staged.withColumn(
        "__loose",
        F.when(F.col("__named").isNotNull(), _first_fit(F.col("__named"), _named_forms(year_pivot))).when(
            F.substring("__body", 1, 1).between("0", "9"), _first_fit(F.col("__body"), _numeric_forms(year_pivot))
        ),
    )
    hour = F.hour("__loose")
    half_day = (
        F.when((F.col("__half") == "p") & (hour < 12), 12)
        .when((F.col("__half") == "a") & (hour == 12), -12)
        .otherwise(0)
    )
    loose = F.when(F.col("__half") == "", F.col("__loose")).when(
        hour <= 12, F.col("__loose") + F.make_dt_interval(hours=half_day)
    )
    staged = staged.withColumn("__moment", F.coalesce(F.col("__iso"), loose))
    moment = F.when(F.year("__moment") <= 9999, F.col("__moment"))
    # A later filter on the result stops at this explode of one element. Pushed further down, it
    # would hold a copy of every step above.
    parsed = F.explode(F.array(moment)).alias(target)
    columns = [parsed if name == target else F.col(name) for name in kept]
    return staged.select(*columns, *([] if target in kept else [parsed]))


def date_parts(moment: Column) -> dict[str, Column]:
    """Hour, month and year of a timestamp."""
    return {"hour": F.hour(moment), "month": F.month(moment), "year": F.year(moment)}


def month_label(year: Column, month: Column) -> Column:
    """``MM/YYYY``."""
    return F.format_string("%02d/%d", month, year)
