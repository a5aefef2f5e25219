"""Event time from text: a cascade over sentences, as native expressions.

The title counts as the first sentence. Order: an absolute date near a trigger sentence (not in an aftermath one), then in any
other sentence that isn't about the aftermath; a month, in the sentences near triggers (those about the aftermath too) and then in the
others; a relative expression near a trigger; for droughts ``since``; a relative one anywhere; vague words (this and last week are their
Monday, others the month's first day); the article's date (not for droughts or retrospectives). Dates more than five years from
the article's are refused. Document order decides among several; without an article date nothing relative is resolved.
Each step is one expression that gives its date, granularity, kind, words and method; coalesce stops at the first that finds any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.durable import spread
from hazmill.functions.exprs import body_of, sentences, title_of

# Trigger, aftermath and date vocabulary.
TRIGGERS = r"(?i)\b(struck|hit|made landfall|broke out|broken out|swept|battered|devastated|ravaged|killed|claimed|destroyed|flooded|inundated|submerged|erupted|triggered|caused|started|ignited|forced|ripped|slammed|pounded|lashed|tore|displaced|affected|braced|approaching|intensif|strengthen|washed away|jolted|shook|shaken|rattled|rocked|quake|temblor|made its way|struck down|cut off|overwhelmed)\b"
AFTERMATH = r"(?i)\b(clean.?up|cleanup|recovery|rebuild|aftermath|restoration|damage assessment|reopen(?:ed)?|resum(?:ed)?|month(?:s)? (?:have |has )?pass|weeks? (?:have |has )?pass|year(?:s)? (?:have |has )?pass|months? later|years? later|anniversary|commemor|in the wake of)\b"
COMPARISON = r"(?i)\b(?:driest|wettest|hottest|coldest|worst|best|highest|lowest|biggest|largest|deepest|rarest|most severe|record)\b.{0,40}\bsince\s+\d{4}"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
ABSOLUTE = rf"(?i)(?:(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:\s*,\s*\d{{4}})?)|(?:\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\.?(?:\s+\d{{4}})?)|\d{{4}}-\d{{2}}-\d{{2}}"
MONTH_ONLY = rf"(?i)\bin\s+(?:early\s+|late\s+|mid-?\s*)?(?:{MONTHS})(?:\s+\d{{4}})?"
SINCE = rf"(?i)since\s+(?:early\s+|late\s+|mid-?\s*)?(?:(?:{MONTHS})(?:\s+\d{{4}})?|\d{{4}})"
DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
RELATIVE = rf"(?i)\b(yesterday|last (?:{DAYS})|on (?:{DAYS})|(?:{DAYS})(?:\s+(?:morning|afternoon|evening|night))?|\d+ days? ago|\d+ weeks? ago)\b"
VAGUE = r"(?i)\b(this week|last week|recent days|recent weeks|in recent|over the past|the past few|past several|past \d+ weeks|past \d+ days)\b"
LIMIT = 1825


def _month(text: Column) -> Column:
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    word = F.lower(F.substring(F.regexp_extract(text, f"(?i)({MONTHS})", 1), 1, 3))
    return F.array_position(F.array(*map(F.lit, names)), word).cast("int")


def _year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b(\d{4})\b", 1).try_cast("int")


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))


def absolute_date(text: Column, base: Column) -> Column:
    """A date with a day; without a year it is in the article's."""
    iso = F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")))
    day = F.regexp_extract(text, r"\b(\d{1,2})(?:st|nd|rd|th)?\b", 1).try_cast("int")
    named = _made(F.coalesce(_year(text), F.year(base)), _month(text), day)
    got = F.coalesce(iso, F.when(_month(text) > 0, named))
    return F.when(base.isNull() | (F.abs(F.datediff(got, base)) <= LIMIT), got)


def month_start(text: Column, base: Column) -> Column:
    """The first of a named month, within five years of the article; one that lies after it is taken a year earlier."""
    got = F.when(_month(text) > 0, _made(F.coalesce(_year(text), F.year(base)), _month(text), F.lit(1)))
    got = F.when(base.isNull() | (F.abs(F.datediff(got, base)) <= LIMIT), got)
    return F.when(got > base, F.add_months(got, -12)).otherwise(got)


def relative_date(text: Column, base: Column) -> Column:
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    low = F.lower(text)
    names = F.array(*[F.lit(d.lower()) for d in DAYS.split("|")])
    wanted = F.array_position(names, F.regexp_extract(low, f"({DAYS.lower()})", 1)).cast("int")
    today = F.weekday(base) + 1
    back = F.pmod(today - wanted + 6, F.lit(7)) + 1
    got = F.when(low == "yesterday", F.date_sub(base, 1)).when(low.contains("day") & low.contains("ago"), F.date_sub(base, n)).when(low.contains("ago"), F.date_sub(base, n * 7)).otherwise(F.date_sub(base, back))
    return F.when(F.abs(F.datediff(got, base)) <= LIMIT, got)


FOUND = "struct<date:date,granularity:string,time_type:string,raw:string,method:string>"


def _found(date: Column, granularity: Column | str, kind: str, raw: Column, method: Column | str) -> Column:
    granularity, method = (F.lit(x) if isinstance(x, str) else x for x in (granularity, method))
    return F.struct(date.alias("date"), granularity.alias("granularity"), F.lit(kind).alias("time_type"), raw.alias("raw"), method.alias("method")).cast(FOUND)


def _first(texts: Column, pattern: str, made) -> Column:
    """The first match in document order that has a date. made: match to the found struct."""
    matches = F.flatten(F.transform(texts, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))))
    return F.get(F.filter(F.transform(matches, made), lambda x: x["date"].isNotNull()), F.lit(0))


def _since(match: Column, base: Column) -> Column:
    """A drought's beginning: the year's first day, whichever year, or the month's."""
    named = _month(match) > 0
    year = F.when(_year(match) > 0, _made(_year(match), F.lit(1), F.lit(1)))
    return _found(F.when(named, month_start(match, base)).otherwise(year), F.when(named, "month").otherwise("year"), "date_range", match, F.when(named, "step3_since_month").otherwise("step3_since_year"))


def _vague(match: Column, base: Column) -> Column:
    low, monday = F.lower(match), F.to_date(F.date_trunc("week", base))
    week = low.contains("this week") | low.contains("last week")
    date = F.when(low.contains("this week"), monday).when(low.contains("last week"), F.date_sub(monday, 7)).otherwise(F.to_date(F.date_trunc("month", base)))
    return _found(date, F.when(week, "day").otherwise("month"), "event_date", match, "step4_vague")


def event_time(df: DataFrame, text: str = "text", base: str = "base", code: str = "type", title: str | None = None) -> DataFrame:
    """With event_date, granularity, time_type, date_raw and method. base: the article's date.

    Without a title column, what stands before " [SEP] " in the text is the title.
    """
    b, drought = F.col(base), F.coalesce(F.col(code) == "DR", F.lit(False))
    head = F.coalesce(F.col(title), F.lit("")) if title else title_of(F.coalesce(text, F.lit("")))
    body = F.coalesce(F.col(text), F.lit("")) if title else body_of(F.coalesce(text, F.lit("")))
    whole = F.when(head != "", F.concat(head, F.lit(". "), body)).otherwise(body)
    s, near, rest = F.col("__s"), F.col("__near"), F.col("__rest")
    hit = lambda x: F.coalesce(x.rlike(TRIGGERS), F.lit(False))
    idle = lambda x: x.rlike(AFTERMATH)
    close = F.filter(s, lambda x, i: hit(x) | hit(F.get(s, i - 1)) | hit(F.get(s, i + 1)))
    day = lambda parse, method: lambda m: _found(parse(m, b), "day", "event_date", m, method)
    month = lambda m: _found(month_start(m, b), "month", "event_date", m, "step1_month_only")
    steps = [
        _first(F.filter(near, lambda x: ~idle(x)), ABSOLUTE, day(absolute_date, "step1_absolute")),
        _first(rest, ABSOLUTE, day(absolute_date, "step1_absolute")),
        _first(F.concat(near, rest), MONTH_ONLY, month),
        _first(near, RELATIVE, day(relative_date, "step2_trigger_relative")),
        F.when(drought, _first(F.array(F.regexp_replace(F.col("__whole"), COMPARISON, "")), SINCE, lambda m: _since(m, b))),
        _first(s, RELATIVE, day(relative_date, "step4_fulltext_relative")),
        F.get(F.transform(F.slice(F.regexp_extract_all(F.array_join(s, " "), F.lit(VAGUE), F.lit(0)), 1, 1), lambda m: _vague(m, b)), F.lit(0)),
    ]
    early = F.exists(F.slice(s, 1, 3), hit)
    retro = F.exists(s, idle) & ~early
    fallback = F.when(~drought & ~retro & b.isNotNull(), _found(b, "day", "event_date", F.lit(None).cast("string"), "step5_fallback"))
    dated = [F.when(x["date"].isNotNull(), x) if k == len(steps) - 1 else x for k, x in enumerate(steps)]
    out = spread(df).withColumn("__whole", whole).withColumn("__s", sentences(F.col("__whole"))).withColumn("__near", close)
    out = out.withColumn("__rest", F.filter(s, lambda x: ~F.array_contains(near, x) & ~idle(x))).withColumn("__t", F.coalesce(*dated, fallback))
    unknown = lambda c: F.coalesce(F.col(f"__t.{c}"), F.lit("unknown")).alias(c)
    return out.select(*df.columns, F.col("__t.date").alias("event_date"), unknown("granularity"), unknown("time_type"), F.col("__t.raw").alias("date_raw"), F.coalesce("__t.method", F.lit("none")).alias("method"))
