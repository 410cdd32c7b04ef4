"""Canonical text documents: rolls, results, allotments, bundles; their digests, readers and verifier.

Lines are made in the JVM from rows; a document is its header lines, then its row lines in order of id.  A digest takes
its text in order, so one task sorts the lines (on disk where they are many) and folds them batch by batch; neither the driver nor any
row holds a whole document.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import hashing
from tamis.operators import draw as draws
from tamis.plans.rules import LAPSED_POOL, RuleSet, Vertical, decode
from tamis.sources import bundle


def stamp(at: datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def roll_header(rules: RuleSet, frozen_at: str, n: int) -> list[str]:
    return ["roll/1", f"schemeCode={rules.scheme_code}", f"ruleSetVersion={rules.version}", f"ruleSetHash={rules.hash}", f"frozenAt={frozen_at}", f"entryCount={n}"]


def roll_lines(entries: DataFrame) -> DataFrame:
    """application_id, line of entries (application_id, cluster_id, vertical_code, horizontals, residency_years, preferences)."""
    line = F.concat_ws("|", F.concat(F.lit("e="), "application_id"), "cluster_id", "vertical_code", F.array_join("horizontals", ","), F.col("residency_years").cast("string"), F.array_join("preferences", ","))
    return entries.select("application_id", line.alias("line"))


def selection_lines(selections: DataFrame) -> DataFrame:
    line = F.concat_ws(
        "|", F.concat(F.lit("sel="), "application_id"), "outcome", "pool_code", "ticket_hex", F.col("residency_tier").cast("string"), F.col("rank_in_pool").cast("string"),
        F.coalesce(F.col("waitlist_position").cast("string"), F.lit("-")), "reason_code",
    )
    return selections.select("application_id", line.alias("line"))


def allotment_lines(assigned: DataFrame) -> DataFrame:
    line = F.concat_ws("|", F.concat(F.lit("a="), "application_id"), "unit_id", "unit_type", F.col("preference_rank").cast("string"))
    return assigned.where("unit_id is not null").select("application_id", line.alias("line"))


def plan_lines(plan: Sequence[Vertical]) -> list[str]:
    return ["|".join([f"plan={v.code}", str(v.seats), *(f"{m.code}:{m.seats}" for m in v.minima)]) for v in plan]


def pool_lines(pools: DataFrame) -> list[str]:
    """A pool has one row, so all of them fit the driver."""
    return [f"pool={p.pool}|{p.vertical_code}|{p.seats}|{p.candidates}|{p.unfilled}" for p in pools.orderBy("pool_ord").collect()]


def render_pools(pools: DataFrame, notes: DataFrame) -> str:
    """Pools with their top-ups, as text; both are a few rows for each pool."""
    by: dict[str, list[str]] = {}
    for n in notes.orderBy("pool", "h_ord").collect():
        by.setdefault(n.pool, []).append(f"  topup={n.code} required={n.required} had={n.had} promoted={n.promoted} displaced={n.displaced} note={n.note}")
    return "".join(f"{x}\n" for line in pool_lines(pools) for x in [line, *by.get(line.split("|")[0].removeprefix("pool="), [])])


def document(header: Iterable[str], lines: DataFrame) -> Iterator[str]:
    """The lines of a document, each with its line end, in order of id."""
    for h in header:
        yield f"{h}\n"
    for row in lines.orderBy("application_id").toLocalIterator():
        yield f"{row.line}\n"


def _folded(batches: Iterator[pa.RecordBatch], header: list[str]) -> Iterator[pa.RecordBatch]:
    text = hashlib.sha256("".join(f"{h}\n" for h in header).encode())
    lines, size = len(header), sum(len(h.encode()) + 1 for h in header)
    for batch in batches:
        for line in batch.column("line").drop_null().to_pylist():
            raw = f"{line}\n".encode()
            text.update(raw)
            lines, size = lines + 1, size + len(raw)
    yield pa.RecordBatch.from_pydict({"hash": [text.hexdigest()], "lines": [lines], "bytes": [size]})


def ordered_digest(header: list[str], lines: DataFrame) -> DataFrame:
    """One row: hash, lines and bytes of a document."""
    lines = lines.select("application_id", "line")
    # a row without a line, so that a document of a header only has its task, too
    none = lines.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in lines.columns])
    sorted_ = lines.unionAll(none).repartition(1).sortWithinPartitions("application_id")
    return sorted_.mapInArrow(lambda b: _folded(b, header), "hash string, lines long, bytes long")


def digest_of(header: list[str], lines: DataFrame) -> str:
    return ordered_digest(header, lines).first()["hash"]


def digest(parts: Iterable[str]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()


def result_header(draw_id: str, roll_id: str, roll_hash: str, rules: RuleSet, seed_hex: str, executed_at: str, outcome: draws.Outcome) -> list[str]:
    head = ["result/1", f"drawId={draw_id}", f"rollId={roll_id}", f"rollHash={roll_hash}", f"ruleSetVersion={rules.version}", f"ruleSetHash={rules.hash}", f"seedHex={seed_hex}", f"executedAt={executed_at}", f"totalUnits={rules.total_units}"]
    return head + plan_lines(outcome.plan) + pool_lines(outcome.pools)


@dataclass(frozen=True)
class Seed:
    nonce: str
    commitment: str
    roll_hash: str
    entropy: str
    seed_hex: str

    def encode(self) -> str:
        return f"commitment={self.commitment}\nnonce={self.nonce}\nrollHash={self.roll_hash}\npublicEntropy={self.entropy}\nseedHex={self.seed_hex}\n"


def write_bundle(target: str | Path, rules: RuleSet, roll: Iterable[str], seed: Seed, result: Iterable[str], audit_head: str, draw_id: str, executed_at: str) -> dict[str, str]:
    """The five files of a bundle in a folder of the driver; documents are streamed into their files."""
    folder = Path(target)
    folder.mkdir(parents=True, exist_ok=True)
    parts = {"rules.txt": [rules.encode()], "roll.txt": roll, "seed.txt": [seed.encode()], "result.txt": result}
    hashes, lines = {}, []
    for name, content in parts.items():
        h, size = hashlib.sha256(), 0
        with open(folder / name, "wb") as f:
            for p in content:
                f.write(b := p.encode())
                h.update(b)
                size += len(b)
        hashes[name] = h.hexdigest()
        lines.append(f"file={name}|{size}|{hashes[name]}")
    head = [f"schemeCode={rules.scheme_code}", f"drawId={draw_id}", f"executedAt={executed_at}", f"ruleSetVersion={rules.version}"]
    head += [f"ruleSetHash={hashes['rules.txt']}", f"rollHash={hashes['roll.txt']}", f"resultHash={hashes['result.txt']}", f"auditHeadHash={audit_head}"]
    (folder / "MANIFEST.txt").write_text("\n".join(head + lines) + "\n")
    return hashes


def zip_bundle(folder: str | Path) -> bytes:
    """The bundle as an archive that is the same for the same files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(folder).glob("*.txt")):
            z.writestr(zipfile.ZipInfo(p.name, date_time=(1980, 1, 1, 0, 0, 0)), p.read_bytes(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def directives(lines: DataFrame) -> DataFrame:
    """key, value of the key=value lines among lines (line, bytes); comments and blanks are skipped."""
    text = lines.select(F.trim(F.col("line").cast("string")).alias("line")).where("line <> '' and not startswith(line, '#') and contains(line, '=')")
    return text.select(F.substring_index("line", "=", 1).alias("key"), F.expr("substring(line, instr(line, '=') + 1)").alias("value"))


def parse_roll(lines: DataFrame) -> DataFrame:
    """Roll entries of directives with the key e."""
    f = F.split("value", "[|]", -1)
    codes = lambda i: F.filter(F.split(f[i], ","), lambda x: x != "")
    return lines.where("key = 'e'").select(f[0].alias("application_id"), f[1].alias("cluster_id"), f[2].alias("vertical_code"), codes(3).alias("horizontals"), f[4].cast("int").alias("residency_years"), codes(5).alias("preferences"))


def parse_selections(lines: DataFrame) -> DataFrame:
    f = F.split("value", "[|]", -1)
    names = ["application_id", "outcome", "pool_code", "ticket_hex", "residency_tier", "rank_in_pool", "waitlist_position", "reason_code"]
    rows = lines.where("key = 'sel'").select(*[f[i].alias(n) for i, n in enumerate(names)])
    return rows.withColumns({"residency_tier": F.col("residency_tier").cast("int"), "rank_in_pool": F.col("rank_in_pool").cast("int"), "waitlist_position": F.expr("try_cast(waitlist_position AS int)")})


def verify_bundle(spark: SparkSession, folder: str | Path) -> DataFrame:
    """name, ok of every check: files, hashes, seed, seats, and the draw recomputed from rules, roll and seed."""
    lines = bundle.read(spark, str(folder))
    of = lambda name: lines.where(F.col("file") == name)
    # rules, seed and manifest are a few lines each
    text = {n: "".join(r.line.decode() + "\n" for r in of(n).orderBy("at").collect()) for n in ("rules.txt", "seed.txt", "MANIFEST.txt")}
    pairs = [x.split("=", 1) for x in text["MANIFEST.txt"].split("\n") if "=" in x]
    manifest = {k: v for k, v in pairs if k != "file"}
    found = dict.fromkeys(("rules.txt", "roll.txt", "seed.txt", "result.txt"), (0, "")) | {r.file: (r.bytes, r.hash) for r in bundle.digests(lines).collect()}
    checks: list[tuple[str, bool]] = []
    for v in (v for k, v in pairs if k == "file"):
        name, size, h = v.split("|")
        checks.append((f"{name} matches the manifest", found.get(name) == (int(size), h)))
    checks += [(f"{k} is the digest of {n}", manifest.get(k) == found[n][1]) for k, n in (("ruleSetHash", "rules.txt"), ("rollHash", "roll.txt"), ("resultHash", "result.txt"))]
    rules = decode(text["rules.txt"])
    seed = dict(x.split("=", 1) for x in text["seed.txt"].split("\n") if "=" in x)
    roll_file, result_file = directives(of("roll.txt")), directives(of("result.txt"))
    one = lambda df: {r.key: r.value for r in df.where("key not in ('e', 'sel', 'plan', 'pool')").collect()}
    roll_head, result_head = one(roll_file), one(result_file)
    entries = parse_roll(roll_file)
    checks += [
        ("the roll was frozen under these rules", roll_head.get("ruleSetHash") == found["rules.txt"][1]),
        ("the result was drawn from this roll", result_head.get("rollHash") == found["roll.txt"][1]),
        ("the roll declares its number of entries", int(roll_head.get("entryCount", -1)) == entries.count()),
        ("the commitment opens", hashing.text_digest(f"commit/1|{seed['nonce']}") == seed["commitment"]),
        ("the seed follows from roll, entropy and nonce", hashing.text_digest(f"seed/1|{seed['rollHash']}|{seed['publicEntropy']}|{seed['nonce']}") == seed["seedHex"]),
        ("the seed was committed against this roll", seed["rollHash"] == found["roll.txt"][1]),
        ("the result was drawn with this seed", result_head.get("seedHex") == seed["seedHex"]),
    ]
    plan = rules.plan()
    published = [r.value for r in result_file.where("key = 'plan'").collect()]
    checks.append(("seats and guarantees follow from the rules", published == [x.removeprefix("plan=") for x in plan_lines(plan)]))
    outcome = draws.execute(entries, rules, seed["seedHex"])
    checks.append(("every outcome follows from the ticket order", draws.differences(parse_selections(result_file), outcome.selections).limit(1).count() == 0))
    pools = [r.value for r in result_file.where("key = 'pool'").collect()]
    mine = [x.removeprefix("pool=") for x in pool_lines(outcome.pools)]
    checks.append(("pools follow from the draw", pools == mine))
    # seats that lapsed are offered again in the lapsed pool, so its seats are not counted twice
    filled = sum(int(p.split("|")[2]) - int(p.split("|")[4]) for p in mine)
    checks.append(("as many are selected as the pools filled", outcome.selections.where("outcome = 'SELECTED'").count() == filled))
    checks.append(("the lapsed pool takes the unfilled reserved seats", all(int(p.split("|")[2]) == sum(int(q.split("|")[4]) for q in mine if q.split("|")[0] not in (rules.open_code, LAPSED_POOL)) for p in mine if p.startswith(f"{LAPSED_POOL}|"))))
    return spark.createDataFrame(checks, "name string, ok boolean")


def to_json_lines(rows: DataFrame) -> Iterator[str]:
    """Rows of a read as JSON objects, for whatever serves them."""
    for r in rows.toLocalIterator():
        yield json.dumps(r.asDict(recursive=True), default=str)
