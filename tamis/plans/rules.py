"""Rule sets: their text form, validity, and the seats and guarantees that follow from them.

A rule set is a handful of rows, so it lives on the driver in exact decimals; `plan_frame` hands the plan to queries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession

from tamis.functions.hashing import text_digest

LAPSED_POOL = "OPEN_LAPSED"
RESIDENCY_MODES = ("NONE", "PRIORITY_TIER")
LAPSE_POLICIES = ("LAPSE_TO_OPEN", "CARRY_FORWARD")


class RuleError(ValueError):
    """A rule set that cannot stand."""


@dataclass(frozen=True)
class Quota:
    code: str
    label: str
    percent: Decimal

    def __post_init__(self) -> None:
        object.__setattr__(self, "percent", Decimal(self.percent))
        _plain(self.code, "code")
        _plain(self.label, "label")
        if not self.code.strip() or not 0 <= self.percent <= 100:
            raise RuleError(f"quota {self.code!r}: a code and a percentage from 0 to 100 are needed")
        if self.percent != self.percent.quantize(Decimal("0.0001")):
            raise RuleError(f"quota {self.code}: more than four decimals")

    def line(self) -> str:
        return f"{self.code}|{self.label}|{self.percent.quantize(Decimal('0.0001'))}"


def _plain(text: str, what: str) -> None:
    if "|" in text or "\n" in text or "\r" in text:
        raise RuleError(f"{what} {text!r} holds a bar or a line break")


@dataclass(frozen=True)
class Minimum:
    code: str
    seats: int


@dataclass(frozen=True)
class Vertical:
    code: str
    seats: int
    minima: tuple[Minimum, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    version: str
    scheme_code: str
    total_units: int
    open_code: str = "OPEN"
    reserved: tuple[Quota, ...] = ()
    horizontal: tuple[Quota, ...] = ()
    residency_mode: str = "NONE"
    min_years: int = 0
    lapse_policy: str = "LAPSE_TO_OPEN"
    waitlist_size: int = 0
    rules_uri: str = field(default="")

    def __post_init__(self) -> None:
        for what in ("version", "scheme_code", "open_code", "rules_uri"):
            _plain(getattr(self, what), what)
        codes = [self.open_code, *(q.code for q in self.reserved)]
        wrong = [
            (not 1 <= self.total_units <= 1_000_000, "units must be from 1 to 1,000,000"),
            (len(set(codes)) != len(codes), "a category code repeats"),
            (len({q.code for q in self.horizontal}) != len(self.horizontal), "a horizontal code repeats"),
            (sum(q.percent for q in self.reserved) > 100, "reserved quotas exceed 100 percent"),
            (sum(q.percent for q in self.horizontal) > 100, "horizontal quotas exceed 100 percent"),
            (self.waitlist_size < 0 or self.min_years < 0, "a size or a number of years is negative"),
            (self.residency_mode not in RESIDENCY_MODES, "unknown residency mode"),
            (self.lapse_policy not in LAPSE_POLICIES, "unknown lapse policy"),
        ]
        for bad, why in wrong:
            if bad:
                raise RuleError(f"rule set {self.version}: {why}")

    def encode(self) -> str:
        lines = [f"version={self.version}", f"schemeCode={self.scheme_code}", f"totalUnits={self.total_units}", f"openCode={self.open_code}"]
        lines += [f"reserved={q.line()}" for q in self.reserved] + [f"horizontal={q.line()}" for q in self.horizontal]
        lines += [f"residency={self.residency_mode}|{self.min_years}", f"lapse={self.lapse_policy}", f"waitlistSize={self.waitlist_size}", f"rulesUri={self.rules_uri}"]
        return "\n".join(lines) + "\n"

    @property
    def hash(self) -> str:
        return text_digest(self.encode())

    def minima(self, pool: str, seats: int) -> tuple[Minimum, ...]:
        """Guaranteed seats of each horizontal quota within a pool, in declared order."""
        found = tuple(Minimum(q.code, int((q.percent * seats / 100).quantize(Decimal(1), ROUND_HALF_UP))) for q in self.horizontal)
        if sum(m.seats for m in found) > seats:
            raise RuleError(f"pool {pool}: guarantees exceed its {seats} seats")
        return found

    def plan(self) -> tuple[Vertical, ...]:
        """Seats by largest remainder, ties to the category declared first; the open category comes first."""
        shares = [(self.open_code, 100 - sum((q.percent for q in self.reserved), Decimal(0)))] + [(q.code, q.percent) for q in self.reserved]
        exact = [percent * self.total_units / 100 for _, percent in shares]
        seats = [int(x.to_integral_value(ROUND_FLOOR)) for x in exact]
        spare = self.total_units - sum(seats)
        for k in sorted(range(len(shares)), key=lambda k: (-(exact[k] - seats[k]), k))[:spare]:
            seats[k] += 1
        return tuple(Vertical(code, n, self.minima(code, n)) for (code, _), n in zip(shares, seats, strict=True))


def decode(text: str) -> RuleSet:
    """The rule set of its text form; blank lines and comments are skipped, unknown directives refused."""
    one: dict[str, str] = {}
    many: dict[str, list[Quota]] = {"reserved": [], "horizontal": []}
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        if not eq or key not in ("version", "schemeCode", "totalUnits", "openCode", "reserved", "horizontal", "residency", "lapse", "waitlistSize", "rulesUri"):
            raise RuleError(f"line {number}: unknown directive {key!r}")
        if key in many:
            parts = value.split("|")
            if len(parts) != 3:
                raise RuleError(f"line {number}: {key} has three fields")
            many[key].append(Quota(parts[0], parts[1], Decimal(parts[2])))
        else:
            one[key] = value
    mode, bar, years = one.get("residency", "NONE|0").partition("|")
    if not bar:
        raise RuleError("residency has two fields")

    def number(key: str, value: str) -> int:
        try:
            return int(value)
        except ValueError:
            raise RuleError(f"{key} is not a whole number: {value!r}") from None

    try:
        return RuleSet(
            one["version"], one["schemeCode"], number("totalUnits", one["totalUnits"]), one["openCode"], tuple(many["reserved"]), tuple(many["horizontal"]),
            mode, number("residency", years), one.get("lapse", "LAPSE_TO_OPEN"), number("waitlistSize", one.get("waitlistSize", "0")), one.get("rulesUri", ""),
        )
    except KeyError as missing:
        raise RuleError(f"directive {missing} is missing") from None


def render_plan(plan: Sequence[Vertical], total_units: int) -> str:
    lines = [f"totalUnits={total_units}"] + ["|".join([f"vertical={v.code}", str(v.seats), *(f"{m.code}:{m.seats}" for m in v.minima)]) for v in plan]
    return "\n".join(lines) + "\n"


def plan_summary(plan: Sequence[Vertical]) -> str:
    return ",".join(f"{v.code}={v.seats}" for v in plan)


def plan_frame(spark: SparkSession, plan: Sequence[Vertical]) -> DataFrame:
    return spark.createDataFrame([(k, v.code, v.seats) for k, v in enumerate(plan)], "pool_ord int, pool string, seats int")


def standard(total_units: int, version: str = "RS-1", scheme: str = "SCH-T", **changes: object) -> RuleSet:
    """The rule set of the examples: three categories, four guarantees, residents first."""
    base = {
        "reserved": (Quota("CAT_A", "Category A", Decimal("15")), Quota("CAT_B", "Category B", Decimal("7.5")), Quota("CAT_C", "Category C", Decimal("27"))),
        "horizontal": (Quota("WOMEN", "Women", Decimal("30")), Quota("PWD", "Persons with disability", Decimal("5")), Quota("EX_SERVICE", "Former service", Decimal("3")), Quota("SENIOR", "Seniors", Decimal("5"))),
        "residency_mode": "PRIORITY_TIER", "min_years": 3, "waitlist_size": 150,
    }
    return RuleSet(version, scheme, total_units, **{**base, **changes})
