"""Record linkage: keys, candidate pairs, scores, components, clusters and reviews.

Applications have application_id, submitted (any ordered type), full_name, relative_name, government_id, phone,
date_of_birth, address_line and ward_code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import metrics, text
from tamis.operators import components as contraction

MAX_BLOCK = 250


@dataclass(frozen=True)
class Weights:
    name: float = 0.32
    relative: float = 0.10
    dob: float = 0.22
    phone: float = 0.18
    address: float = 0.12
    ward: float = 0.06
    auto: float = 0.93
    review: float = 0.80


def folded(apps: DataFrame) -> DataFrame:
    """apps with names and addresses squeezed, upper-cased and without accents: once for each row, in one pass through Arrow.

    Rows are dealt by their id first: texts cost far more than to read them, and a small file makes few tasks.
    """
    apps = apps.repartition("application_id")
    return apps.withColumns({c: text.strip_accents(text.upper(text.squeeze(c))) for c in ("full_name", "relative_name", "address_line") if c in apps.columns})


def keyed(apps: DataFrame) -> DataFrame:
    return identified(apps).select("application_id", "keys")


def identified(apps: DataFrame) -> DataFrame:
    """keyed, with the identifiers that settle pairs: gid, phone and dob."""
    rows = folded(apps).withColumns({"_gid": text.government_id_key("government_id"), "_phone": text.phone_key("phone"), "_tokens": text.name_tokens("full_name", True)})
    keys = text.keys_of(F.col("_gid"), F.col("_phone"), F.col("_tokens"), True)
    return rows.select("application_id", keys.alias("keys"), F.col("_gid").alias("gid"), F.col("_phone").alias("phone"), F.col("date_of_birth").alias("dob"))


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.select("application_id", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def oversized_blocks(keys: DataFrame, most: int = MAX_BLOCK) -> DataFrame:
    """The keys that are not compared, and a note for each."""
    big = block_sizes(keys).where(F.col("n") > most)
    return big.select("key", "n", F.format_string(f"block %s holds %d records, above the cap of {most}; its pairs are not compared", "key", "n").alias("note"))


def block_pairs(keys: DataFrame, most: int = MAX_BLOCK, carried: DataFrame | None = None) -> DataFrame:
    """left_id < right_id of records that share a key of 2 to most records, once each, with all keys that both have.

    A pair is made in the first key only that both records share and that is not too large, so pairs need no distinct and
    are never shuffled.  Further columns of keys come along on both sides, as l_ and r_ columns; so do those that carried has by application_id.
    """
    big = block_sizes(keys).where(F.col("n") > most).select("key")
    # blocks of at most so many records: keys of one record only, which most identifiers are, go no further
    small = keys.select("application_id", F.explode("keys").alias("key")).join(big, "key", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    used = small.groupBy("application_id").agg(F.sort_array(F.collect_set("key")).alias("used"))
    rows = keys.join(used, "application_id")
    more = [c for x in (keys, carried) if x is not None for c in x.columns if c not in ("application_id", "keys")]
    if carried is not None:
        rows = rows.join(carried, "application_id")
    rows = rows.select("application_id", "keys", "used", *more, F.explode("used").alias("key"))
    side = lambda x, p: rows.select("key", F.col("application_id").alias(f"{x}_id"), F.col("keys").alias(f"{x}_keys"), F.col("used").alias(f"{x}_used"), *[F.col(c).alias(f"{p}_{c}") for c in more])
    # both arrays are sorted, so the first key of their intersection is the least
    first = F.array_intersect("left_used", "right_used")[0]
    pairs = side("left", "l").join(side("right", "r"), "key").where((F.col("left_id") < F.col("right_id")) & (first == F.col("key")))
    return pairs.select("left_id", "right_id", F.array_intersect("left_keys", "right_keys").alias("shared_keys"), *[f"{p}_{c}" for p in "lr" for c in more])


def candidate_pairs(keys: DataFrame, most: int = MAX_BLOCK) -> DataFrame:
    """left_id, right_id and shared_keys of block_pairs."""
    return block_pairs(keys.select("application_id", "keys"), most)


def fields(apps: DataFrame) -> DataFrame:
    """The comparable form of each record, made once per record and not per pair."""
    return folded(apps).select(
        "application_id",
        text.government_id_key("government_id").alias("gid"),
        text.phone_key("phone").alias("phone"),
        F.col("date_of_birth").alias("dob"),
        text.name_key("full_name", True).alias("name"),
        text.name_key("relative_name", True).alias("relative"),
        text.address_tokens("address_line", True).alias("address"),
        F.when(~text.is_blank("ward_code"), text.upper(text.trim_to_empty("ward_code"))).alias("ward"),
        "ward_code",
    )


def compared(pairs: DataFrame, apps: DataFrame) -> DataFrame:
    """pairs with l_ and r_ fields of both records."""
    f = fields(apps)
    side = lambda p, x: f.select(*[F.col(c).alias(f"{p}_{c}" if c != "application_id" else f"{x}_id") for c in f.columns])
    return pairs.join(side("l", "left"), "left_id").join(side("r", "right"), "right_id")


def deterministic(row: str = "method") -> Column:
    """The method of a pair that identifiers settle; null for the others."""
    both = (F.col("l_gid") != "") & (F.col("r_gid") != "")
    phone = (F.length("l_phone") == 10) & (F.col("l_phone") == F.col("r_phone"))
    return F.when(both & (F.col("l_gid") == F.col("r_gid")), "DETERMINISTIC_GOVERNMENT_ID").when(~both & phone & F.coalesce(F.col("l_dob") == F.col("r_dob"), F.lit(False)), "DETERMINISTIC_PHONE_AND_DOB").alias(row)


def four_decimals(x: Column) -> Column:
    """A score from 0 to 1 as text; several times as fast as format_string, with the same rounding."""
    return x.cast("decimal(9,4)").cast("string")


def _features(w: Weights) -> list[tuple[str, float, Column, Column, Column]]:
    """Name, weight, score, availability and detail of each feature, in order of summation; the details may use the scores s0... and the availabilities a0... as columns."""
    c = F.col
    sized = F.concat(F.lit("token jaccard over "), F.size("l_address").cast("string"), F.lit(" and "), F.size("r_address").cast("string"), F.lit(" tokens"))
    quoted = lambda x: F.concat(F.lit('jaro-winkler("'), c(f"l_{x}"), F.lit('", "'), c(f"r_{x}"), F.lit('")'))
    dob, phone = metrics.dob_score(c("l_dob"), c("r_dob")), metrics.phone_score(c("l_phone"), c("r_phone"))
    dates = F.concat(c("l_dob").cast("string"), F.lit(" vs "), c("r_dob").cast("string"))
    # the texts look at columns with the scores, so that no score is worked out again in each branch
    dob_text = F.when(~c("a2"), "missing on one side").when(c("s2") == 1.0, "identical").when(c("s2") == 0.85, F.concat(F.lit("day and month transposed ("), dates, F.lit(")"))).when(c("s2") == 0.60, "same year and month").when(c("s2") == 0.30, "same year only").when(c("s2") == 0.15, "adjacent years").otherwise(dates)
    phone_text = F.when(~c("a3"), "missing on one side").when(c("s3") == 1.0, "identical").otherwise(F.concat(F.lit("edit distance "), metrics.levenshtein(c("l_phone"), c("r_phone")).cast("string")))
    ward = c("l_ward").isNotNull() & c("r_ward").isNotNull()
    return [
        ("name", w.name, c("name_score"), (c("l_name") != "") & (c("r_name") != ""), quoted("name")),
        ("relativeName", w.relative, c("relative_score"), (c("l_relative") != "") & (c("r_relative") != ""), quoted("relative")),
        ("dateOfBirth", w.dob, F.coalesce(dob, F.lit(0.0)), dob.isNotNull(), dob_text),
        ("phone", w.phone, F.coalesce(phone, F.lit(0.0)), phone.isNotNull(), phone_text),
        ("address", w.address, metrics.token_jaccard(c("l_address"), c("r_address")), (F.size("l_address") > 0) & (F.size("r_address") > 0), sized),
        ("ward", w.ward, F.when(ward & (c("l_ward") == c("r_ward")), 1.0).otherwise(0.0), ward, F.when(c("a5"), F.concat("l_ward_code", F.lit(" vs "), "r_ward_code")).otherwise("missing on one side")),
    ]


def score_pairs(pairs: DataFrame, apps: DataFrame, w: Weights = Weights()) -> DataFrame:
    """left_id, right_id, method, score, decision, features (text), rationale, shared_keys of given pairs."""
    return score_compared(compared(pairs, apps), w)


def score_blocks(keys: DataFrame, apps: DataFrame, most: int = MAX_BLOCK, w: Weights = Weights()) -> DataFrame:
    """score_pairs of all candidate pairs: the records' fields come along with their keys, so that pairs are scored where they are made."""
    return score_compared(block_pairs(keys.select("application_id", "keys"), most, fields(apps)), w)


def score_compared(rows: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Scores of pairs with the fields of both records.

    Identifier rules are settled in the JVM; only the other pairs reach the string comparison, once per pair of names.
    """
    rows = rows.withColumn("method", deterministic())
    sure = rows.where(F.col("method").isNotNull())
    gid = F.col("method") == "DETERMINISTIC_GOVERNMENT_ID"
    sure = sure.select(
        "left_id", "right_id", "method", F.when(gid, 1.0).otherwise(0.99).alias("score"), F.lit("AUTO_LINKED").alias("decision"),
        F.when(gid, "governmentId score=1.0000 weight=1.00 [identifiers are identical]").otherwise("phone score=1.0000 weight=0.50 [same ten-digit number]\ndateOfBirth score=1.0000 weight=0.50 [identical]").alias("features"),
        F.when(gid, "The government identifiers are equal.").otherwise("Phone and date of birth are equal, and no government identifiers contradict.").alias("rationale"),
        "shared_keys",
    )
    rest = rows.where(F.col("method").isNull()).withColumns({f"{x}_score": metrics.jaro_winkler_udf(f"l_{x}", f"r_{x}") for x in ("name", "relative")})
    found = _features(w)
    rest = rest.withColumns({f"s{i}": s for i, (_, _, s, _, _) in enumerate(found)} | {f"a{i}": a for i, (_, _, _, a, _) in enumerate(found)})
    part = lambda i, x: F.when(F.col(f"a{i}"), x).otherwise(0.0)
    total = weight = F.lit(0.0)
    for i, (_, x, _, _, _) in enumerate(found):
        total, weight = total + part(i, F.lit(x) * F.col(f"s{i}")), weight + part(i, F.lit(x))
    rest = rest.withColumn("weight", weight).withColumn("score", F.when(F.col("weight") == 0.0, 0.0).otherwise(F.try_divide(total, F.col("weight"))))
    both = (F.col("l_gid") != "") & (F.col("r_gid") != "")
    auto = F.col("score") >= w.auto
    decision = F.when(auto & both, "NEEDS_REVIEW").when(auto, "AUTO_LINKED").when(F.col("score") >= w.review, "NEEDS_REVIEW").otherwise("DISTINCT")
    why = (
        F.when(auto & both, "Not linked without a reviewer, since two different government identifiers are given.")
        .when(both, "Two different government identifiers are given.")
        .otherwise("No two government identifiers are given to compare.")
    )
    line = lambda i, name, x, detail: F.concat(F.lit(name), F.when(F.col(f"a{i}"), "").otherwise(" (missing, weight redistributed)"), F.lit(" score="), four_decimals(F.col(f"s{i}")), F.lit(f" weight={x:.2f} ["), detail, F.lit("]"))
    rest = rest.select(
        "left_id", "right_id", F.lit("PROBABILISTIC").alias("method"), "score", decision.alias("decision"),
        F.concat_ws("\n", *[line(i, n, x, d) for i, (n, x, _, _, d) in enumerate(found)]).alias("features"),
        F.concat(F.lit("Fields agree at "), four_decimals(F.col("score")), F.lit(f" (linked from {w.auto}, reviewed from {w.review}). "), why).alias("rationale"),
        "shared_keys",
    )
    return sure.unionByName(rest)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root (smallest node id) over edges (left_id, right_id); nodes adds those without edges."""
    labels = contraction.components(edges, "left_id", "right_id")
    return labels if nodes is None else contraction.with_others(labels, nodes)


def clusters(apps: DataFrame, labels: DataFrame) -> DataFrame:
    """application_id, cluster_id (CL-<primary>), primary_id, size; the primary is the earliest, ties by id, nulls last."""
    rows = apps.select("application_id", "submitted").join(labels.withColumnRenamed("node", "application_id"), "application_id")
    first = rows.groupBy("root").agg(F.min_by("application_id", F.struct(F.col("submitted").isNull(), "submitted", "application_id")).alias("primary_id"), F.count("*").alias("size"))
    return rows.join(first, "root").select("application_id", F.concat(F.lit("CL-"), "primary_id").alias("cluster_id"), "primary_id", "size")


def superseded(found: DataFrame) -> DataFrame:
    return found.where(F.col("application_id") != F.col("primary_id")).select("application_id", "cluster_id", F.col("primary_id").alias("superseded_by"), F.concat(F.lit("duplicate of "), "primary_id").alias("reason"))


def pending(links: DataFrame, status: DataFrame) -> DataFrame:
    """RECEIVED applications at either end of a pair that awaits a reviewer."""
    ends = links.where("decision = 'NEEDS_REVIEW'").select(F.explode(F.array("left_id", "right_id")).alias("application_id"))
    return status.where("status = 'RECEIVED'").join(ends, "application_id", "left_semi").withColumn("status", F.lit("PENDING_DUPLICATE_REVIEW"))


def cleared(links: DataFrame, status: DataFrame) -> DataFrame:
    """Pending applications that no undecided pair touches any more."""
    open_ = links.where("review_decision = 'PENDING'").select(F.explode(F.array("left_id", "right_id")).alias("application_id"))
    return status.where("status = 'PENDING_DUPLICATE_REVIEW'").join(open_, "application_id", "left_anti").withColumn("status", F.lit("RECEIVED"))


def households_if_merged(apps: DataFrame, sure: DataFrame, undecided: DataFrame) -> DataFrame:
    """One row: the clusters that would remain if reviewers accepted every undecided pair (left_id, right_id)."""
    edges = sure.select("left_id", "right_id").union(undecided.select("left_id", "right_id"))
    return components(edges, apps.select("application_id")).agg(F.countDistinct("root").alias("households"))


def merge_reviewed(apps: DataFrame, found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Clusters after the accepted pairs (left_id, right_id) join them: the earliest of all members is primary."""
    own = found.select(F.col("application_id").alias("left_id"), F.col("primary_id").alias("right_id")).where("left_id <> right_id")
    return clusters(apps, components(own.union(accepted.select("left_id", "right_id")), apps.select("application_id")))


def links_to_write(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs worth keeping as links, without those that a reviewer has decided already."""
    link = scored.where("decision <> 'DISTINCT'").withColumn("link_id", F.concat_ws(":", F.least("left_id", "right_id"), F.greatest("left_id", "right_id")))
    return link.join(stored.where("review_decision <> 'PENDING'").select("link_id"), "link_id", "left_anti")


def touching(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with either end among ids (application_id), as application_id and the link's columns."""
    ends = links.withColumn("application_id", F.explode(F.array("left_id", "right_id")))
    return ends.join(ids.select("application_id"), "application_id")
