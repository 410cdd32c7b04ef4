"""What the requests of the interface must hold, and which rows of a table of requests do not.

A request is a row; its rules are columns, so a table of any size is checked in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import is_blank
from tamis.operators.lifecycle import PHASES
from tamis.plans.rules import LAPSE_POLICIES, RESIDENCY_MODES


@dataclass(frozen=True)
class Rule:
    """needed: not null, and not blank where it is text; most: characters; form: a pattern for the whole text."""

    name: str
    type: str = "string"
    needed: bool = False
    most: int | None = None
    form: str | None = None
    among: tuple[str, ...] = ()
    least: int | None = None
    past: bool = False

    def faults(self) -> list[Column]:
        """A sentence for each rule that the column breaks, else null; a null breaks only `needed`."""
        x = F.col(self.name)
        out = []
        if self.needed:
            out.append(F.when(is_blank(x) if self.type == "string" else x.isNull(), F.lit("is missing")))
        if self.most is not None:
            out.append(F.when(F.length(x) > self.most, F.lit(f"is longer than {self.most} characters")))
        if self.form is not None:
            out.append(F.when(~x.rlike(f"^(?:{self.form})\\z"), F.lit(f"does not have the form {self.form}")))
        if self.among:
            out.append(F.when(~x.isin(*self.among), F.lit("is none of " + ", ".join(self.among))))
        if self.least is not None:
            out.append(F.when(x < self.least, F.lit(f"is less than {self.least}")))
        if self.past:
            out.append(F.when(x >= F.col("_today"), F.lit("is not in the past")))
        return out


_CODE, _LINE = "[A-Z0-9_]+", r"[^|\r\n]*"


def _text(name: str, most: int | None = None, needed: bool = False, form: str | None = None) -> Rule:
    return Rule(name, needed=needed, most=most, form=form)


def _whole(name: str, least: int = 0) -> Rule:
    return Rule(name, "int", least=least)


#: The fields of each request and their bounds.
REQUESTS: dict[str, tuple[Rule, ...]] = {
    "create_scheme": (_text("scheme_code", 32, True), _text("name", 200, True)),
    "advance_phase": (Rule("to", needed=True, among=PHASES),),
    "quota": (_text("code", 32, True, _CODE), _text("label", 200, True, _LINE), Rule("percent", "decimal(18,6)", needed=True, least=0)),
    "publish_rules": (
        _text("version", 64, True, _LINE), _text("scheme_code", 32, True, _LINE), _whole("total_units", 1), _text("open_code", 32, True, _CODE),
        Rule("residency_mode", needed=True, among=RESIDENCY_MODES), _whole("residency_min_years"), Rule("lapse_policy", needed=True, among=LAPSE_POLICIES), _whole("waitlist_size"), _text("rules_uri", 500, form=_LINE),
    ),
    "intake": (
        _text("scheme_code", needed=True), _text("channel", needed=True), _text("batch_id", 64), _text("idempotency_key", 128), _text("full_name", 200, True), _text("relative_name", 200), _text("government_id", 32), _text("phone", 24),
        Rule("date_of_birth", "date", past=True), _text("address_line", 500), _text("ward_code", 32), _whole("residency_years"), _text("vertical_code", 32, True),
    ),
    "correction": (_text("reason", 500, True),),
    "record_check": (_text("check_code", 64, True), _text("reason", 1000), _text("evidence_ref", 300)),
    "review_link": (_text("decision", needed=True), _text("note", 1000)),
    "freeze_roll": (_text("roll_id", 64, True),),
    "commit_seed": (_text("draw_id", 64, True), _text("source", 300, True)),
    "execute_draw": (_text("public_entropy", 300, True),),
    "reason": (_text("reason", 1000, True),),
    "unit": (_text("unit_id", 32, True), _text("block", 32), _text("unit_type", 32, True), _whole("floor_number")),
}


def refused(requests: DataFrame, kind: str, key: str, today: Column | None = None) -> DataFrame:
    """key, field and fault of every rule that a request breaks; fields that the table lacks count as null.

    Other columns pass through unread, and a key column of any name or type is kept as it is; it may repeat or be null.
    """
    rules = REQUESTS[kind]
    given = set(requests.columns)
    fields = [(F.col(f"`{r.name}`") if r.name in given else F.lit(None)).cast(r.type).alias(r.name) for r in rules]
    rows = requests.select(F.col(f"`{key}`").alias("_key"), (F.current_date() if today is None else today).alias("_today"), *fields)
    faults = F.array(*[F.when(x.isNotNull(), F.struct(F.lit(r.name).alias("field"), x.alias("fault"))) for r in rules for x in r.faults()])
    return rows.select("_key", F.explode(F.array_compact(faults)).alias("f")).select(F.col("_key").alias(key), "f.field", "f.fault")
