"""Calendar periods as column functions. All take and return dates; windows are inclusive at both ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a lifetime covers.
LIFETIME = ("0001-01-01", "9999-12-31")
KINDS = (
    "benefit_year", "policy_anniversary", "rolling_months", "consecutive_benefit_years", "lifetime", "per_visit",
    "per_admission",
)


def _col(x: Column | str | int | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def parse_date(text: Column) -> Column:
    """An ISO date of year 1 or later, or null."""
    d = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.year(d) >= 1), d)


#: The formats that free dates are tried in, after the ISO prefix.
FREE_FORMATS = ("MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "yyyy/M/d")


def parse_free_date(text: Column) -> Column:
    """A date by the first format that fits."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    return F.coalesce(parse_date(F.substring(t, 1, 10)), compact, *[F.try_to_date(t, f) for f in FREE_FORMATS])


def is_leap_year(year: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def anchor_on(year: Column, month: Column, day: Column) -> Column:
    """The anchor's date in a year; a day that its month lacks falls on the month's last."""
    return F.make_date(year, month, F.least(day, days_in_month(year, month)))


@dataclass(frozen=True)
class Period:
    """A period's columns; ``kind`` is one of KINDS, as a string where all rows have the same, which spares the rest."""

    kind: Column | str
    months: Column | int | None = None
    years: Column | int | None = None
    start_month: Column | int | None = None
    start_day: Column | int | None = None


@dataclass(frozen=True)
class Plan:
    """What windows need of a plan."""

    effective: Column
    kind: Column
    start_month: Column | None = None
    start_day: Column | None = None


def anniversary(plan: Plan) -> tuple[Column, Column]:
    return F.coalesce(F.month(plan.effective), F.lit(1)), F.coalesce(F.day(plan.effective), F.lit(1))


def benefit_year_anchor(period: Period, plan: Plan) -> tuple[Column, Column]:
    """The period's own start, else the plan's benefit year's, else the anniversary if the plan runs by it, else January 1."""
    if isinstance(period.start_month, int):
        return F.lit(period.start_month), F.lit(1 if period.start_day is None else period.start_day)
    own_month, own_day = _col(period.start_month), _col(period.start_day)
    plan_month, plan_day = _col(plan.start_month), _col(plan.start_day)
    month, day = anniversary(plan)
    by_plan = (plan.kind == "benefit_year") & plan_month.isNotNull()
    by_date = plan.kind == "policy_anniversary"

    def pick(own: Column, of_plan: Column, of_date: Column) -> Column:
        return F.when(own_month.isNotNull(), own).when(by_plan, of_plan).when(by_date, of_date).otherwise(1).cast("int")

    one = F.lit(1)
    return pick(own_month, plan_month, month), pick(F.coalesce(own_day, one), F.coalesce(plan_day, one), day)


def year_start(date: Column, month: Column, day: Column) -> Column:
    """Year of the latest anchor that is not after ``date``."""
    y = F.year(date)
    return F.when(anchor_on(y, month, day) <= date, y).otherwise(y - 1)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def years_from(first: Column, count: Column, month: Column, day: Column) -> Column:
    """Window of ``count`` years from the anchor of year ``first``."""
    return _span(anchor_on(first, month, day), F.date_sub(anchor_on(first + count, month, day), 1))


def period_window(period: Period, date: Column, plan: Plan) -> Column:
    """struct<start, end>: the window of ``date``; null for periods in which each service stands alone.

    Rolling windows end on the date; runs of years count from the plan's first benefit year, also for dates before it.
    """
    month, day = benefit_year_anchor(period, plan)
    a_month, a_day = anniversary(plan)
    one = F.lit(1)
    by_year = years_from(year_start(date, month, day), one, month, day)
    by_anniversary = years_from(year_start(date, a_month, a_day), one, a_month, a_day)
    months = F.coalesce(_col(period.months).cast("int"), F.lit(12))
    rolling = _span(F.date_add(F.add_months(date, -months), 1), date)
    years = F.greatest(F.coalesce(_col(period.years).cast("int"), one), one)
    first = F.coalesce(year_start(plan.effective, month, day), one)
    elapsed = year_start(date, month, day) - first
    start = first + (F.floor(elapsed / years) * years).cast("int")
    lifetime = _span(F.lit(LIFETIME[0]).cast("date"), F.lit(LIFETIME[1]).cast("date"))
    windows = {
        "benefit_year": by_year, "policy_anniversary": by_anniversary, "rolling_months": rolling,
        "consecutive_benefit_years": years_from(start, years, month, day), "lifetime": lifetime,
    }
    if isinstance(period.kind, str):
        return windows.get(period.kind, F.when(F.lit(False), lifetime))
    return F.coalesce(*[F.when(period.kind == k, w) for k, w in windows.items()])


def current_period(date: Column, plan: Plan) -> Column:
    """The plan's own window of ``date``; the calendar year where it has none or a lifetime."""
    one = F.lit(1)
    own = period_window(Period(plan.kind, start_month=plan.start_month, start_day=plan.start_day), date, plan)
    calendar = years_from(F.year(date), one, one, one)
    return F.when(plan.kind == "lifetime", calendar).otherwise(F.coalesce(own, calendar))


def next_reset(period: Period, date: Column, plan: Plan) -> Column:
    """The day after the window; null for windows that slide, never end or don't exist."""
    end = period_window(period, date, plan)["end"]
    return F.when(~_col(period.kind).isin("rolling_months", "lifetime"), F.date_add(end, 1))


def claim_deadline(date: Column, plan: Plan, submission_days: Column, days_after_end: Column) -> Column:
    """The later of ``submission_days`` after the service and ``days_after_end`` after the plan's window."""
    own = Period(plan.kind, start_month=plan.start_month, start_day=plan.start_day)
    end = F.when(plan.kind != "lifetime", period_window(own, date, plan)["end"])
    return F.greatest(F.date_add(date, submission_days), F.date_add(end, days_after_end))


def waiting_ends(months: Column, coverage_start: Column, effective: Column) -> Column:
    """First covered day after a waiting period; null if there is none."""
    return F.when(months > 0, F.add_months(F.coalesce(coverage_start, effective), months))


#: Words of periods that stand for a visit, and texts that stand for the plan's own year.
VISIT_WORDS = ("visit", "treatment", "service", "trip", "occurrence", "session")
OWN_YEAR = ("benefit_year", "per_benefit_year", "plan_year", "year", "yearly", "annual", "annually", "per_year", "benefit_period")


def map_period(text: Column, months: Column | None = None, default: str = "benefit_year",
               start_month: Column | None = None, start_day: Column | None = None) -> Column:
    """struct<kind, months, years, start_month, start_day, guessed> from free text and a number of months, by the first
    rule that fits; ``default``, with the plan's start, where none says more.

    Months are clamped to 1 to 120, years to 1 to 10. A number of years alone is taken for rolling months, as a guess.
    """
    t = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"[\s\-]+", "_")
    none = F.lit(None).cast("int")
    clamp = lambda x, top: F.least(F.greatest(x, F.lit(1)), F.lit(top))
    given = none if months is None else F.when(months > 0, clamp(months, 120))
    number = F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).try_cast("int")
    own_month, own_day = (none if x is None else x for x in (start_month, start_day))
    has = lambda *words: t.rlike("|".join(words))

    def made(kind: str, months: Column = none, years: Column = none, month: Column = none, day: Column = none, guessed: bool = False) -> Column:
        fields = {"kind": F.lit(kind), "months": months, "years": years, "start_month": month, "start_day": day}
        typed = [(v if k == "kind" else v.cast("int")).alias(k) for k, v in fields.items()]
        return F.struct(*typed, F.lit(guessed).alias("guessed"))

    plan = lambda guessed: made(default, month=own_month, day=own_day, guessed=guessed)
    run = F.coalesce(F.bround(given / 12), number)
    consecutive = lambda years, guessed: made("consecutive_benefit_years", years=years, month=own_month, day=own_day, guessed=guessed)
    length = F.coalesce(given, number)
    rules = [
        (t == "", plan(True)),
        (has("calendar"), made("benefit_year", month=F.lit(1), day=F.lit(1))),
        (has("consecutive") & (run > 0), consecutive(clamp(run, 10), False)),
        (has("consecutive"), consecutive(F.lit(2), True)),
        (has("anniversary", "policy_year", "membership_year"), made("policy_anniversary")),
        (has("lifetime"), made("lifetime")),
        (has("admission", "hospital_stay"), made("per_admission")),
        (has(*VISIT_WORDS), made("per_visit")),
        (has("rolling", "month") & (length > 0), made("rolling_months", months=clamp(length, 120))),
        (has("rolling", "month"), plan(True)),
        (t.isin(*OWN_YEAR), plan(False)),
        (has("year") & (number > 0), made("rolling_months", months=clamp(number.cast("bigint") * 12, 120), guessed=True)),
        (has("year"), plan(False)),
    ]
    out = F.when(*rules[0])
    for condition, period in rules[1:]:
        out = out.when(condition, period)
    return out.otherwise(plan(True))


def seconds_to_midnight(ts: Column) -> Column:
    """Seconds to the next UTC midnight."""
    return F.unix_timestamp(F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")) - F.unix_timestamp(ts)
