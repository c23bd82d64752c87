"""Canonical dimensions, time windows and filters that all queries share."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNTAGGED = "(untagged)"
OTHER = "(other)"
MONEY = "decimal(20,8)"
MEASURES = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
DIMENSIONS = ("provider", "model", "project", "branch", "surface")


def _text(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def provider(c: str | Column = "provider") -> Column:
    return F.coalesce(F.nullif(_text(c), F.lit("")), F.lit("claude_code"))


def model(c: str | Column = "model") -> Column:
    c = _text(c)
    return F.when(c.isNull() | (c == "") | c.startswith("<"), UNTAGGED).otherwise(c)


def project(c: str | Column = "repo_id") -> Column:
    c = _text(c)
    return F.when(c.isNull() | c.isin("", "unknown"), UNTAGGED).otherwise(c)


def branch(c: str | Column = "git_branch") -> Column:
    c = F.regexp_replace(_text(c), "^(?i:refs/heads/)", "")
    return F.when(c.isNull() | (c == ""), UNTAGGED).otherwise(c)


def surface(c: str | Column = "surface") -> Column:
    return F.coalesce(F.nullif(F.lower(_text(c)), F.lit("")), F.lit("unknown"))


def role(c: str | Column = "role") -> Column:
    return F.coalesce(F.nullif(_text(c), F.lit("")), F.lit("assistant"))


NORMAL = {"provider": provider, "model": model, "project": project, "branch": branch, "surface": surface}


def money(c: str | Column) -> Column:
    """Cents as a decimal: sums neither drift nor depend on their order."""
    return F.coalesce(_text(c), F.lit(0.0)).cast(MONEY)


def money_sum(c: str | Column = "cents") -> Column:
    return F.coalesce(F.sum(_text(c)), F.lit(0).cast(MONEY)).cast("double")


def facts(messages: DataFrame) -> DataFrame:
    """``messages`` with d_<dimension>, d_role and cents (decimal, effective cost)."""
    return messages.withColumns({f"d_{k}": f() for k, f in NORMAL.items()} | {"d_role": role(), "cents": money("cost_cents_effective")})


@dataclass(frozen=True)
class TimeWindow:
    """[since, until); a bound that is no timestamp is refused at once."""

    since: datetime | None = None
    until: datetime | None = None

    def __post_init__(self):
        for b in (self.since, self.until):
            if b is not None and not isinstance(b, datetime):
                raise ValueError(f"{b!r} is no timestamp")

    @classmethod
    def parse(cls, since: str | None = None, until: str | None = None) -> TimeWindow:
        return cls(*(datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None) if x else None for x in (since, until)))

    def where(self, c: str | Column = "timestamp") -> Column:
        c, out = _text(c), F.lit(True)
        kind = "timestamp_ntz"
        if self.since is not None:
            out = out & (c.cast(kind) >= F.lit(self.since.isoformat(" ")).cast(kind))
        if self.until is not None:
            out = out & (c.cast(kind) < F.lit(self.until.isoformat(" ")).cast(kind))
        return out

    def aligned(self) -> str:
        """Which table serves it: day, hour or raw."""
        bounds = (self.since, self.until)
        if None not in bounds and self.since >= self.until:
            return "raw"
        known = [b for b in bounds if b is not None]
        if any(b.minute or b.second or b.microsecond for b in known):
            return "raw"
        return "hour" if any(b.hour for b in known) else "day"


ALL_TIME = TimeWindow()


@dataclass(frozen=True)
class DimFilters:
    """IN lists on normalized dimensions: trimmed, without empty and repeated values; comma lists are split."""

    providers: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    branches: tuple[str, ...] = ()
    surfaces: tuple[str, ...] = ()
    _by: dict = field(default_factory=dict, init=False, compare=False)

    def __post_init__(self):
        for name, dim in zip(("providers", "models", "projects", "branches", "surfaces"), DIMENSIONS):
            given = getattr(self, name)
            given = [given] if isinstance(given, str) else list(given)
            values = [v.strip() for g in given for v in g.split(",")]
            if dim == "surface":
                values = [v.lower() for v in values]
            if dim == "branch":
                values = [v[11:] if v.lower().startswith("refs/heads/") else v for v in values]
            object.__setattr__(self, name, tuple(dict.fromkeys(v for v in values if v)))
            self._by[dim] = getattr(self, name)

    def where(self) -> Column:
        out = F.lit(True)
        for dim, values in self._by.items():
            if values:
                out = out & F.col(f"d_{dim}").isin(*values)
        return out


NO_FILTERS = DimFilters()


def selected(messages: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS, assistant: bool = True) -> DataFrame:
    """Facts inside a window and filters; assistant rows only, unless all are asked for."""
    rows = facts(messages.where(window.where()))
    if assistant:
        rows = rows.where(F.col("d_role") == "assistant")
    return rows.where(filters.where())


def token_sums() -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]


def dollars(cents: Column) -> Column:
    """Cents rounded half away from zero, as dollars."""
    return F.round(cents) / 100


def since_of(period: str, now: datetime) -> datetime | None:
    """``today``, ``week``, ``month``, ``all``, ``Nd``, ``Nw``, ``Nm`` (calendar months, clamped) before ``now``'s day."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    named = {"today": "0d", "week": "7d", "month": "30d"}.get(period, period)
    if named == "all":
        return None
    n, unit = int(named[:-1]), named[-1]
    if unit in "dw":
        return day - timedelta(days=n * (7 if unit == "w" else 1))
    if unit != "m":
        raise ValueError(f"no such period: {period}")
    month = day.year * 12 + day.month - 1 - n
    year, month = divmod(month, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return day.replace(year=year, month=month + 1, day=min(day.day, last))


UTC = timezone.utc
