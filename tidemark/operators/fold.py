"""The claims ledger replayed in order, for plans whose limits, pools, shares and frequencies act on one another.

The fold is plain Python over one family's lines; Spark hands each family to ``applyInPandas``. Sums in fixed windows
are kept as running totals by (rule, owner, window), so that a line costs the rules that touch it; only rolling windows
look back over the entries of their benefit.
"""

from __future__ import annotations

import calendar
import functools
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIFETIME = (date.min, date.max)


@dataclass(frozen=True)
class Period:
    kind: str
    months: int = 12
    years: int = 1
    start_month: int | None = None
    start_day: int = 1


@dataclass(frozen=True)
class Limit:
    value: int
    period: Period
    unit: str = "cents"
    scope: str = "per_person"


@dataclass(frozen=True)
class Share:
    name: str
    kind: str
    amount: int
    period: Period | None = None
    scope: str = "per_person"


@dataclass(frozen=True)
class Coverage:
    kind: str
    percent: float | None = None
    cap: int | None = None
    amount: int = 0
    schedule: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Benefit:
    coverage: Coverage
    limits: tuple[Limit, ...] = ()
    shares: tuple[Share, ...] = ()
    pool: str | None = None
    frequency: Limit | None = None  # its value is how many services
    waiting_months: int = 0


@dataclass(frozen=True)
class PlanRules:
    benefits: dict[object, Benefit]
    pools: dict[str, Limit] = field(default_factory=dict)
    period: Period = Period("benefit_year")
    effective: date | None = None
    submission_days: int | None = None
    days_after_end: int | None = None
    hospital: frozenset = frozenset()  # benefits whose estimates are a guide only


def half_up(n: float, d: int = 1) -> int:
    if float(n).is_integer():
        return (2 * int(n) + d) // (2 * d)
    return math.floor(n / d + 0.5 + 1e-9)


def percent_of(cents: int, percent: float) -> int:
    return half_up(cents * round(percent * 100), 10_000)


@functools.lru_cache(100_000)
def anchored(year: int, month: int, day: int) -> date:
    if year < 1:
        return date.min
    return date.max if year > 9999 else date(year, month, min(day, calendar.monthrange(year, month)[1]))


def add_months(d: date, months: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return anchored(y, m + 1, d.day)


def window(period: Period, d: date, plan: PlanRules) -> tuple[date, date] | None:
    """Inclusive window of a date, None for periods in which each service stands alone."""
    return _window(period, d, plan.period, plan.effective)


@functools.lru_cache(100_000)
def _window(period: Period, d: date, of_plan: Period, eff: date | None) -> tuple[date, date] | None:
    by_date = (eff.month, eff.day) if eff else (1, 1)
    if period.start_month is not None:
        anchor = (period.start_month, period.start_day)
    elif of_plan.kind == "benefit_year" and of_plan.start_month is not None:
        anchor = (of_plan.start_month, of_plan.start_day)
    else:
        anchor = by_date if of_plan.kind == "policy_anniversary" else (1, 1)

    def first_year(x: date, a: tuple[int, int]) -> int:
        return x.year if anchored(x.year, *a) <= x else x.year - 1

    def span(y: int, n: int, a: tuple[int, int]) -> tuple[date, date]:
        return anchored(y, *a), anchored(y + n, *a) - timedelta(1)

    if period.kind == "benefit_year":
        return span(first_year(d, anchor), 1, anchor)
    if period.kind == "policy_anniversary":
        return span(first_year(d, by_date), 1, by_date)
    if period.kind == "rolling_months":
        return add_months(d, -period.months) + timedelta(1), d
    if period.kind == "consecutive_benefit_years":
        n, first = max(1, period.years), first_year(eff, anchor) if eff else 1
        return span(first + (first_year(d, anchor) - first) // n * n, n, anchor)
    return LIFETIME if period.kind == "lifetime" else None


@dataclass
class Entry:
    claim: object
    line: object
    member: object
    benefit: object
    day: date
    quantity: float
    paid: int
    limited_by: str | None
    shares: dict[str, int]


class Ledger:
    """Running totals for every rule in a fixed window, and the entries that rolling windows look back over; all entries
    only if they are to be ``listed``."""

    def __init__(self, plan: PlanRules, listed: bool = True):
        self.plan, self.entries, self.listed = plan, [], listed
        rules = [x for b in plan.benefits.values() for x in (*b.limits, *([b.frequency] if b.frequency else []))] + list(plan.pools.values())
        self.reach = max((x.period.months for x in rules if x.period.kind == "rolling_months"), default=0)
        self.swept = date.min
        self.of_benefit: dict[object, list[Entry]] = defaultdict(list)
        self.totals: dict[tuple, float] = defaultdict(float)
        self.members_of_pool: dict[str, set] = defaultdict(set)
        for name, b in plan.benefits.items():
            if b.pool in plan.pools:
                self.members_of_pool[b.pool].add(name)

    def _rules(self, benefit: object) -> Iterable[tuple[tuple, Limit]]:
        b = self.plan.benefits[benefit]
        for i, limit in enumerate(b.limits):
            yield ("limit", benefit, i), limit
        if b.pool in self.plan.pools:
            yield ("pool", b.pool), self.plan.pools[b.pool]
        if b.frequency:
            yield ("frequency", benefit), b.frequency

    @staticmethod
    def _measure(e: Entry, unit: str) -> float:
        if unit == "cents":
            return e.paid
        if e.paid <= 0:
            return 0
        return max(1, math.ceil(e.quantity)) if unit == "services" else e.quantity

    def _count(self, e: Entry, sign: int) -> None:
        for key, limit in self._rules(e.benefit):
            if limit.period.kind != "rolling_months" and (w := window(limit.period, e.day, self.plan)):
                owner = e.member if limit.scope == "per_person" else None
                self.totals[(*key, owner, w)] += sign * self._measure(e, limit.unit)

    def forget(self, first: date) -> None:
        """Let go, now and then, of what no line on ``first`` or later can ask for: windows that have ended, and entries
        before the longest rolling window."""
        if self.listed or first < add_months(self.swept, 3):
            return
        self.swept = first
        for key in [k for k in self.totals if k[-1][1] < first]:
            del self.totals[key]
        since = add_months(first, -self.reach)
        for benefit, held in self.of_benefit.items():
            self.of_benefit[benefit] = [e for e in held if e.day >= since] if self.reach else []

    def add(self, e: Entry) -> None:
        if self.listed:
            self.entries.append(e)
        self.of_benefit[e.benefit].append(e)
        self._count(e, 1)
        for share in self.plan.benefits[e.benefit].shares:
            if e.shares.get(share.name) and (w := self._share_window(share, e.day)):
                self.totals[("share", share.name, e.member if share.scope == "per_person" else None, w)] += e.shares[share.name]

    def repay(self, e: Entry, cents: int) -> None:
        """Replace what an entry was paid."""
        self._count(e, -1)
        e.paid = cents
        self._count(e, 1)

    def _share_window(self, share: Share, day: date) -> tuple[date, date] | None:
        if share.period:
            return window(share.period, day, self.plan)
        w = window(self.plan.period, day, self.plan)
        return w if w and w != LIFETIME else (date(day.year, 1, 1), date(day.year, 12, 31))

    def used(self, key: tuple, limit: Limit, member: object, day: date) -> float | None:
        """What is used of a rule at a date; None where it has no window."""
        w = window(limit.period, day, self.plan)
        if w is None:
            return None
        owner = member if limit.scope == "per_person" else None
        if limit.period.kind != "rolling_months":
            return self.totals.get((*key, owner, w), 0)
        names = self.members_of_pool[key[1]] if key[0] == "pool" else [key[1]]
        return sum(
            self._measure(e, limit.unit) for n in names for e in self.of_benefit[n]
            if (owner is None or e.member == owner) and w[0] <= e.day <= w[1]
        )

    def share_left(self, share: Share, member: object, day: date) -> int:
        w = self._share_window(share, day)
        met = self.totals.get(("share", share.name, member if share.scope == "per_person" else None, w), 0) if w else 0
        return int(max(0, share.amount - met))


def covered(c: Coverage, charged: int, quantity: float, code: str | None) -> tuple[int, int, bool]:
    """(first amount, amount within cap and charge, known to the schedule)."""
    charged = max(0, charged)
    if c.kind in ("percent", "percent_capped"):
        raw = percent_of(charged, c.percent or 0)
        cap = half_up(c.cap * quantity) if c.kind == "percent_capped" and c.cap is not None else raw
        return raw, min(raw, cap), True
    if c.kind == "schedule":
        plain = lambda x: (x or "").strip().lower().removeprefix("item").strip()
        amounts = {plain(k): v for k, v in reversed(c.schedule)}
        if plain(code) and plain(code) in amounts:
            raw = half_up(amounts[plain(code)] * quantity)
        elif c.percent is not None:
            raw = percent_of(charged, c.percent)
        else:
            return 0, 0, False
    else:
        raw = half_up(c.amount * quantity)
    return raw, min(charged, raw), True


def estimate(ledger: Ledger, benefit: object, member: object, day: date, charged: int, other: int = 0,
             quantity: float = 1, code: str | None = None) -> tuple[int, str | None, dict[str, int]]:
    """(plan pays, what limited it, applied to shares) for one line on the ledger so far."""
    plan, b = ledger.plan, ledger.plan.benefits.get(benefit)
    if b is None or (plan.effective and day < plan.effective):
        return 0, "not_covered", {}
    quantity = quantity if quantity and quantity > 0 else 1
    charged = max(0, charged)
    other = min(charged, max(0, other))
    balance = charged - other
    pays, amount, known = covered(b.coverage, charged, quantity, code)
    reason = None if pays >= charged else "schedule" if b.coverage.kind == "schedule" else "coverage"
    if not known:
        reason = "schedule"
    if b.coverage.kind == "percent_capped" and amount < pays:
        pays, reason = amount, "per_service_cap"
    elif pays > charged:
        pays, reason = charged, None
    applied: dict[str, int] = {}

    def lower(to: int, why: str) -> None:
        nonlocal pays, reason
        if to < pays:
            pays, reason = max(0, to), why

    if other:
        lower(balance, "other_plan")
    for share in b.shares:
        if share.kind == "coinsurance" or share.amount <= 0:
            continue
        if share.kind == "copay":
            lower(pays - half_up(share.amount * quantity), "deductible")
            continue
        own = min(ledger.share_left(share, member, day), balance)
        applied[share.name] = own
        if own:
            lower(min(covered(b.coverage, charged - own, quantity, code)[1], balance - own), "deductible")
    rules = [(("frequency", benefit), b.frequency)] if b.frequency else []
    rules += [(("limit", benefit, i), limit) for i, limit in enumerate(b.limits)]
    rules += [(("pool", b.pool), plan.pools[b.pool])] if b.pool in plan.pools else []
    for key, limit in rules:
        used = ledger.used(key, limit, member, day)
        if key[0] == "frequency" and used is None:
            used = 0
        left = limit.value - (used or 0)
        if limit.unit == "cents":
            lower(int(max(0, left)), key[0])
        elif left <= 0:
            lower(0, key[0])
        elif quantity > left:
            lower(half_up(pays * left, int(quantity)) if float(quantity).is_integer() else half_up(pays * left / quantity), key[0])
    if b.waiting_months > 0 and plan.effective and day < add_months(plan.effective, b.waiting_months):
        pays, reason = 0, "waiting_period"
    elif pays == charged:
        reason = None
    return pays, reason, applied


@dataclass(frozen=True)
class Quote:
    """An estimate of one line: what is eligible, who pays what, what limits it, what is left after it, by when to claim,
    and warnings as (code, date or None)."""

    eligible: int
    pays: int
    member_pays: int
    limited_by: str | None
    shares: dict[str, int]
    limit_left: int | None
    pool_left: int | None
    deadline: date | None
    warnings: tuple[tuple[str, date | None], ...]


def deadline(plan: PlanRules, day: date) -> date | None:
    """The later of so many days after the service and after the end of the plan's own window, as far as there are rules."""
    own = window(plan.period, day, plan)
    ends = [day + timedelta(plan.submission_days)] if plan.submission_days is not None else []
    ends += [own[1] + timedelta(plan.days_after_end)] if plan.days_after_end is not None and own and own != LIFETIME else []
    return max(ends, default=None)


def next_eligible(ledger: Ledger, benefit: object, member: object, day: date) -> date | None:
    """The first day on which a benefit's frequency, over rolling months and already used up, allows a service again."""
    rule = ledger.plan.benefits[benefit].frequency
    if rule is None or rule.period.kind != "rolling_months" or rule.value <= 0:
        return None
    w = window(rule.period, day, ledger.plan)
    mine = [e for e in ledger.of_benefit[benefit] if e.paid > 0 and w[0] <= e.day <= w[1] and (rule.scope != "per_person" or e.member == member)]
    days = sorted(e.day for e in mine for _ in range(max(1, math.ceil(e.quantity))))
    if len(days) < rule.value:
        return None
    leaves = days[len(days) - int(rule.value)]
    after = add_months(leaves, rule.period.months)
    # the first day whose window no longer reaches back to it
    return next(d for d in (after + timedelta(k) for k in range(5)) if add_months(d, -rule.period.months) >= leaves)


def quote(ledger: Ledger, benefit: object, member: object, day: date, charged: int, other: int = 0, quantity: float = 1,
          code: str | None = None, today: date | None = None) -> Quote:
    """``estimate`` with all that is told beside it; windows are those of the service's day."""
    plan, b = ledger.plan, ledger.plan.benefits.get(benefit)
    eligible = max(0, charged)
    balance = eligible - min(eligible, max(0, other))
    due = deadline(plan, day)
    if b is None or (plan.effective and day < plan.effective):
        why = ("not_in_plan", None) if b is None else ("before_coverage", plan.effective)
        return Quote(eligible, 0, balance, "not_covered", {}, None, None, due, (why,))
    pays, reason, shares = estimate(ledger, benefit, member, day, charged, other, quantity, code)
    warnings: list[tuple[str, date | None]] = []
    if b.coverage.kind == "schedule" and not covered(b.coverage, eligible, 1, code)[2]:
        warnings.append(("item_unknown" if code else "item_missing", None))

    def left(key: tuple, limit: Limit) -> tuple[float, bool]:
        used = ledger.used(key, limit, member, day)
        return max(0, limit.value - (used or 0)), used is not None

    if b.frequency and left(("frequency", benefit), b.frequency)[0] <= 0:
        again = next_eligible(ledger, benefit, member, day)
        warnings.append(("not_again_until", again) if again else ("already_used", None))
    limits = [(limit, *left(("limit", benefit, i), limit)) for i, limit in enumerate(b.limits)]
    warnings += [("limit_used_up", None) for _, rest, _ in limits if rest <= 0]
    money = [int(rest) for limit, rest, in_window in limits if limit.unit == "cents" and in_window]
    pool = plan.pools.get(b.pool)
    pool_left = None
    if pool:
        rest, in_window = left(("pool", b.pool), pool)
        pool_left = max(0, int(rest) - pays) if pool.unit == "cents" and in_window else None
        warnings += [("pool_used_up", None)] if rest <= 0 else []
    if reason == "waiting_period":
        warnings.append(("waiting_until", add_months(plan.effective, b.waiting_months)))
    if due and today and due < today:
        warnings.append(("deadline_passed", due))
    if benefit in plan.hospital:
        warnings.append(("guide_only", None))
    return Quote(eligible, pays, balance - pays, reason, shares, max(0, min(money) - pays) if money else None, pool_left, due, tuple(warnings))


def estimate_claim(plan: PlanRules, claims: Iterable[dict], claim: dict, today: date | None = None, include_submitted: bool = True) -> list[Quote]:
    """Quotes of a claim's lines, in their order, on the ledger of all other claims. Lines see those of the same claim
    with an earlier date, or the same date and an earlier place."""
    ledger = replay(plan, (c for c in claims if c["id"] != claim["id"]), include_submitted)
    lines = claim["lines"]
    out: list[Quote | None] = [None] * len(lines)
    for i in sorted(range(len(lines)), key=lambda i: (lines[i]["day"], i)):
        x = lines[i]
        quantity = x.get("quantity") or 1
        quantity = quantity if quantity > 0 else 1
        q = quote(ledger, x["benefit"], claim["member"], x["day"], x["charged"], x.get("other", 0), quantity, x.get("code"), today)
        out[i] = q
        if x["benefit"] in plan.benefits:
            ledger.add(Entry(claim["id"], x["id"], claim["member"], x["benefit"], x["day"], quantity, q.pays, q.limited_by, q.shares))
    return out


def allocate(total: int, weights: list[int]) -> list[int]:
    """Integer parts by largest remainder, exact in sum; all to the first without any weight."""
    safe = [max(0, w) for w in weights]
    if safe and not any(safe):
        safe[0] = 1
    whole = sum(safe)
    parts = [total * w // whole for w in safe]
    order = sorted(range(len(safe)), key=lambda i: (-(total * safe[i] % whole), i))
    for i in order[: total - sum(parts)]:
        parts[i] += 1
    return parts


COUNTED = ("paid", "partially_paid", "submitted")


def replay_sorted(ledger: Ledger, claims: Iterable[dict]) -> Iterator[list[Entry]]:
    """The entries of each claim in turn, of claims that come by first service date, creation and id, with lines by date.

    A paid amount that is known replaces a claim's estimates, in their proportion, else in that of what was left to pay.
    """
    plan = ledger.plan
    for c in claims:
        if c["lines"]:
            ledger.forget(c["lines"][0]["day"])
        lines = [x for x in c["lines"] if x["benefit"] in plan.benefits]
        own = []
        for x in lines:
            args = (x["charged"], x.get("other", 0), x.get("quantity", 1), x.get("code"))
            pays, reason, shares = estimate(ledger, x["benefit"], c["member"], x["day"], *args)
            quantity = x.get("quantity") or 1
            e = Entry(c["id"], x["id"], c["member"], x["benefit"], x["day"], quantity if quantity > 0 else 1, pays, reason, shares)
            ledger.add(e)
            own.append(e)
        if c.get("paid") is not None and c["status"] != "submitted" and own:
            weights = [e.paid for e in own]
            if not any(w > 0 for w in weights):
                weights = [max(0, x["charged"] - x.get("other", 0)) for x in lines]
            for e, cents in zip(own, allocate(max(0, c["paid"]), weights)):
                ledger.repay(e, cents)
        yield own


def replay(plan: PlanRules, claims: Iterable[dict], include_submitted: bool = True) -> Ledger:
    """The ledger of a family's claims: dicts with id, member, status, created, paid (None: not known) and lines, in any
    order."""
    ledger = Ledger(plan)
    known = [c | {"lines": sorted(c["lines"], key=lambda x: x["day"])} for c in claims if c["status"] in COUNTED[: 2 + include_submitted]]
    known.sort(key=lambda c: (c["lines"][0]["day"] if c["lines"] else date.max, c["created"], c["id"]))
    for _ in replay_sorted(ledger, known):
        pass
    return ledger


#: Columns of a line beside its claim's, as the fold names them.
_LINE = {"day": "service_date", "id": "line_id", "benefit": "benefit_id", "charged": "charged_cents", "other": "other_cents", "quantity": "quantity"}


def ruled(plan: PlanRules) -> frozenset:
    """Benefits whose estimates read a ledger or count in one that others read."""
    of_ledger = lambda b: b.limits or b.frequency or b.pool in plan.pools or any(x.kind not in ("coinsurance", "copay") for x in b.shares)
    return frozenset(name for name, b in plan.benefits.items() if of_ledger(b))


def quotes_of(plan: PlanRules, claims: list[dict], today: date | None = None) -> Iterator[tuple[dict, dict, Quote]]:
    """(claim, line, quote) of a family's submitted claims, each on the ledger of the others; claims without a line that
    counts by some rule have no part in that, and need none themselves."""
    counts = ruled(plan)
    touching = [c for c in claims if any(x["benefit"] in counts for x in c["lines"])]
    ids = {c["id"] for c in touching}
    for c in claims:
        if c["status"] == "submitted":
            for x, q in zip(c["lines"], estimate_claim(plan, touching if c["id"] in ids else (), c, today)):
                yield c, x, q


_QUOTE = "claim_id bigint, line_id bigint, pays bigint, member_pays bigint, limited_by string, limit_left bigint, pool_left bigint, deadline date, warnings string"


def quote_families(df: DataFrame, plan: PlanRules, today: date | None = None, family: str = "family_id") -> DataFrame:
    """(claim_id, line_id, pays, member_pays, limited_by, limit_left, pool_left, deadline, warnings): quotes of every
    submitted claim, each on the ledger of its family's other claims. ``df``: see ``replay_families``.

    Lines are gathered by claim. Only submitted claims, and those with a line that counts by some rule of the plan, are dealt to
    their family's task and pass there in order of family; under a plan without such rules claims stay where they are.
    """
    claim = [family, "claim_id", "member_id", "status", "created", "paid_cents"]
    counts = sorted(ruled(plan), key=str)
    # by line, as the first field of a struct orders it
    lines = F.sort_array(F.collect_list(F.struct(*[F.col(_LINE[n]).alias(n) for n in ("id", *(n for n in _LINE if n != "id"))])))
    counted = F.exists("lines", lambda x: x["benefit"].isin(counts)) if counts else F.lit(False)
    claims = df.where(F.col("status").isin(*COUNTED)).groupBy(*claim).agg(lines.alias("lines"))
    claims = claims.where((F.col("status") == "submitted") | F.coalesce(counted, F.lit(False))).select(*claim, "lines")
    if counts:
        claims = claims.repartition(family).sortWithinPartitions(family, "claim_id")
    schema = pa.schema([(c.split()[0], {"bigint": pa.int64(), "date": pa.date32(), "string": pa.string()}[c.split()[1]]) for c in _QUOTE.split(", ")])

    def told(held: list[dict]) -> list[tuple]:
        return [
            (c["id"], x["id"], q.pays, q.member_pays, q.limited_by, q.limit_left, q.pool_left, q.deadline, ",".join(w for w, _ in q.warnings))
            for c, x, q in quotes_of(plan, held, today)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)
        for b in batches:
            rows = []
            for c in b.to_pylist():
                if held and (c[family] != now or not counts):
                    rows += told(held)
                    held = []
                now = c[family]
                known = [x | {"charged": x["charged"] or 0, "other": x["other"] or 0} for x in c["lines"]]
                held.append({"id": c["claim_id"], "member": c["member_id"], "status": c["status"], "created": c["created"], "paid": c["paid_cents"], "lines": known})
            yield made(rows)
        yield made(told(held))

    return claims.mapInArrow(run, _QUOTE)


_ENTRY = "claim_id bigint, line_id bigint, member_id bigint, benefit_id bigint, paid_cents bigint, limited_by string, share_cents bigint"


def replay_families(df: DataFrame, plan: PlanRules, family: str = "family_id") -> DataFrame:
    """(claim_id, line_id, member_id, benefit_id, paid_cents, limited_by, share_cents) of joined claims and lines.

    ``df``: family, claim_id, line_id, member_id, status, created, paid_cents (nullable), benefit_id, service_date,
    charged_cents, other_cents, quantity. Lines are gathered by claim; claims of a family are dealt to one task and sorted
    there, outside of memory where they don't fit, and pass in batches. What is kept of a family are totals by rule, owner
    and window, and entries as far as rolling windows reach back, however many lines it has. Families follow one another:
    a line needs all before it, so that one family is one task's work. Lines without a family have no ledger.
    """
    claim = [family, "claim_id", "member_id", "status", "created", "paid_cents"]
    lines = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in _LINE.items()])))
    claims = df.where(F.col(family).isNotNull() & F.col("status").isin(*COUNTED)).groupBy(*claim).agg(lines.alias("lines"))
    first = F.col("lines")[0]["day"]
    dealt = claims.withColumn("first", first).repartition(family).sortWithinPartitions(family, "first", "created", "claim_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ledger = None, None
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _ENTRY.split(", ")])
        for b in batches:
            rows = []
            for c in b.to_pylist():
                if ledger is None or c[family] != now:
                    now, ledger = c[family], Ledger(plan, listed=False)
                known = {"id": c["claim_id"], "member": c["member_id"], "status": c["status"], "paid": c["paid_cents"], "lines": c["lines"]}
                for own in replay_sorted(ledger, [known]):
                    rows += [(e.claim, e.line, e.member, e.benefit, e.paid, e.limited_by, sum(e.shares.values())) for e in own]
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, schema.types)], schema=schema)

    return dealt.select(*claim, "lines").mapInArrow(run, _ENTRY)
