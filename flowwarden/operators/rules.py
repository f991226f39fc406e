"""Learned routing rules: matching, overlap, insertion, compaction, consolidation, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.config import AUDIT_TRIGGER, MAX_RULES, NATIVE_RULES, RULE_FN_LIMIT, RULE_HEADROOM
from flowwarden.functions.conditions import clause_field, clause_key, clause_value, clauses, numeric_text
from flowwarden.operators.ordered import keyed_rank, seq_chunk
from flowwarden.session import materialise, rows_within

SHORT = 12
BROADCAST_RULES = 100_000
NATIVE_COUNT = len(NATIVE_RULES)
#: What a rule came from, if known.
ORIGIN = ("event_id", "mistake", "created_at")


#: Last incidents kept of a rule, and characters of their reasoning.
RECENT, SNIPPET = 3, 120


def with_clauses(rules: DataFrame) -> DataFrame:
    return rules.withColumn("clauses", clauses(F.col("condition"))).withColumn("n_clauses", F.size("clauses"))


# ---- subset keys ------------------------------------------------------------------------------

def _subset_keys() -> Column:
    """Keys of all non-empty subsets of a sorted clause array; meant for at most SHORT clauses."""
    return F.expr("""
        transform(sequence(1, shiftleft(1, size(clauses)) - 1), m ->
            array_join(filter(clauses, (c, i) -> (shiftright(m, i) & 1) = 1), ' and '))""")


def covering_pairs(broad: DataFrame, narrow: DataFrame) -> DataFrame:
    """Pairs (b_*, n_*) where every clause of the broad rule is a clause of the narrow rule.

    A narrow rule with few clauses lists its clause subsets and looks them up by equality, so only
    true pairs leave the join. A rule with more clauses than that is reached through the rarest
    clause of each broad rule instead.
    """
    b = broad.filter(F.size("clauses") > 0).withColumn("_key", clause_key(F.col("clauses")))
    b = b.select(*[F.col(c).alias(c if c == "_key" else f"b_{c}") for c in b.columns])
    n = narrow.filter(F.size("clauses") > 0)
    n_cols = [F.col(c).alias(f"n_{c}") for c in narrow.columns]
    short = n.filter(F.size("clauses") <= SHORT).select(*n_cols, F.explode(_subset_keys()).alias("_key"))
    found = b.join(short, "_key").drop("_key")
    long_rules = n.filter(F.size("clauses") > SHORT)
    rarity = broad.select(F.explode("clauses").alias("_clause")).groupBy("_clause").agg(F.count(F.lit(1)).alias("_uses"))
    anchors = b.select("_key", F.explode("b_clauses").alias("_clause")).distinct().join(rarity, "_clause").groupBy(
        "_key").agg(F.min_by("_clause", F.struct("_uses", "_clause")).alias("_clause"))
    reached = long_rules.select(*n_cols, F.explode("clauses").alias("_clause")).join(
        b.join(anchors, "_key").drop("_key"), "_clause"
    ).filter(F.size(F.array_except("b_clauses", "n_clauses")) == 0).drop("_clause")
    return found.unionByName(reached.select(*found.columns))


def overlaps(rules: DataFrame) -> DataFrame:
    """Each overlapping pair once: broader (or earlier, when equal) rule first."""
    slim = with_clauses(rules).select("id", "seq", "playbook", "clauses")
    pairs = covering_pairs(slim, slim)
    strictly = F.size("b_clauses") < F.size("n_clauses")
    return pairs.filter(strictly | ((F.size("b_clauses") == F.size("n_clauses")) & (F.col("b_seq") < F.col("n_seq")))).select(
        F.col("b_id").alias("broader"), F.col("n_id").alias("narrower"),
        (F.col("b_playbook") == F.col("n_playbook")).alias("same_playbook"))


# ---- matching ---------------------------------------------------------------------------------

def match_rules(events: DataFrame, rules: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """First learned rule (smallest ord) whose clauses all hold, as columns rule_id and rule_playbook.

    Rules are grouped by the set of fields they test. Per field set the rule side is unique on its
    values, so an event meets at most one rule there and no pair list grows with popular values.
    The number of field sets is bounded by the schema, not by the rules.
    """
    shaped = with_clauses(rules).filter(F.col("n_clauses") > 0).select(
        "id", "ord", "playbook",
        F.array_sort(F.transform("clauses", lambda c: F.struct(
            clause_field(c).alias("f"), clause_value(c).alias("v")))).alias("_fv"),
    ).withColumn("_fields", F.array_join(F.col("_fv.f"), ",")).withColumn("_values", F.to_json(F.col("_fv.v")))
    # Rules on unknown fields are left out on the executors: the sets that reach the driver are subsets of `fields`.
    known = F.forall("_fv.f", lambda f: f.isin(*fields)) & (F.size(F.array_distinct("_fv.f")) == F.size("_fv"))
    first = materialise(shaped.filter(known).groupBy("_fields", "_values").agg(
        F.min(F.struct("ord", "id", "playbook")).alias("_hit")))
    usable = sorted(r[0] for r in first.select("_fields").distinct().collect())
    small = rows_within(first, BROADCAST_RULES)
    out = events.withColumns({f"_x_{n}": numeric_text(c) for n, c in fields.items()})
    hits = []
    for i, field_set in enumerate(usable):
        names = field_set.split(",")
        side = first.filter(F.col("_fields") == field_set).select(
            F.col("_values").alias(f"_v{i}"), F.col("_hit").alias(f"_hit{i}"))
        key = F.to_json(F.array(*[F.col(f"_x_{n}") for n in names]))
        out = out.withColumn(f"_v{i}", key).join(F.broadcast(side) if small else side, f"_v{i}", "left").drop(f"_v{i}")
        hits.append(F.col(f"_hit{i}"))
    if not hits:
        best = F.lit(None).cast("struct<ord:bigint,id:string,playbook:string>")
    else:
        best = hits[0] if len(hits) == 1 else F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return out.select(
        *events.columns, best.getField("id").alias("rule_id"), best.getField("playbook").alias("rule_playbook"))


# ---- lifecycle --------------------------------------------------------------------------------

def allocate_ids(candidates: DataFrame, already: int = 0) -> DataFrame:
    """LEARNED_nnn for ALLOW rules, FN_PATCH_nnn otherwise; both draw from one counter in seq order."""
    ranked = keyed_rank(candidates, [], ["seq"], seq_chunk("seq"), "_n")
    prefix = F.when(F.col("playbook") == "ALLOW", "LEARNED_").otherwise("FN_PATCH_")
    return ranked.withColumn("id", F.concat(prefix, F.format_string("%03d", F.col("_n") + F.lit(already)))).drop("_n")


def _first_per(df: DataFrame, key: Column) -> DataFrame:
    """Earliest row per key; an aggregate, so repeats combine before the shuffle."""
    whole = F.struct(*df.columns)
    return df.groupBy(key.alias("_k")).agg(F.min_by(whole, F.struct("seq", "id")).alias("_r")).select("_r.*")


def insert_rules(existing: DataFrame, fresh: DataFrame, mode: str = "intended") -> DataFrame:
    """Rule table after inserting a batch, with `action` and `replaced_by`.

    Frames hold `id, seq, condition, playbook`; seq orders all rules, existing ones come first. Where both
    frames also hold `event_id, mistake, created_at`, these are carried along for the audit.
    action is kept (existing, stays), inserted, identical, covered or replaced. In `intended` mode a
    rule is covered by an earlier rule of its playbook whose clauses it contains, and replaced by a
    later, broader one; rules of another playbook never interfere. In `observed` mode only equal
    condition texts are detected, which is how the saved rule list came about.
    """
    cols = ["id", "seq", "condition", "playbook", *[c for c in ORIGIN if c in existing.columns and c in fresh.columns]]
    both = existing.select(*cols, F.lit(True).alias("is_old")).unionByName(
        fresh.select(*cols, F.lit(False).alias("is_old")))
    folded = both.withColumn("_text", F.lower(F.trim("condition")))
    firsts = _first_per(folded.select("id", "seq", "_text"), F.col("_text")).select(
        F.col("_text"), F.col("seq").alias("_first"))
    marked = folded.join(firsts, "_text").withColumn(
        "is_repeat", (F.col("seq") > F.col("_first")) & ~F.col("is_old")).drop("_text", "_first")
    if mode == "observed":
        return marked.select(
            *cols, F.when(F.col("is_old"), "kept").when(F.col("is_repeat"), "identical").otherwise("inserted").alias("action"),
            F.lit(None).cast("string").alias("replaced_by"))
    unique = materialise(with_clauses(marked.filter(~F.col("is_repeat"))))
    sets = unique.filter(F.col("n_clauses") > 0).groupBy(
        clause_key(F.col("clauses")).alias("_key"), "playbook").agg(
        F.min(F.struct("seq", "id")).alias("earliest"), F.first("clauses").alias("clauses"))
    slim = unique.select("id", "seq", "playbook", "clauses", "is_old")
    reach = covering_pairs(sets.select("playbook", "clauses", "earliest"), slim).filter(
        F.col("b_playbook") == F.col("n_playbook"))
    covered = reach.filter(~F.col("n_is_old") & (F.col("b_earliest.seq") < F.col("n_seq"))).select(
        F.col("n_id").alias("id")).distinct().withColumn("_covered", F.lit(True))
    judged = materialise(unique.join(covered, "id", "left").withColumn("_covered", F.coalesce("_covered", F.lit(False))))
    writers = judged.filter(~F.col("is_old") & ~F.col("_covered")).select("id", "seq", "playbook", "clauses")
    replaced = covering_pairs(writers, slim).filter(
        (F.col("b_playbook") == F.col("n_playbook")) & (F.col("b_seq") > F.col("n_seq"))
        & (F.size("b_clauses") < F.size("n_clauses"))
    ).groupBy(F.col("n_id").alias("id")).agg(F.min(F.struct(F.col("b_seq").alias("seq"), F.col("b_id").alias("id"))).alias("_by"))
    action = (
        F.when(F.col("_covered"), "covered").when(F.col("_by").isNotNull(), "replaced")
        .when(F.col("is_old"), "kept").otherwise("inserted"))
    judged = judged.join(replaced, "id", "left")
    repeats = marked.filter("is_repeat").select(
        *cols, F.lit("identical").alias("action"), F.lit(None).cast("string").alias("replaced_by"))
    done = judged.withColumn("action", action).select(
        *cols, "action", F.when(F.col("action") == "replaced", F.col("_by.id")).alias("replaced_by"))
    return done.unionByName(repeats)


def active(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("action").isin("kept", "inserted"))


def audit_rows(inserted: DataFrame) -> DataFrame:
    """Audit entry of every inserted rule: rule_id, event_id, trigger, appended_at and the first rule it replaced, if any.

    `inserted` is what `insert_rules` returns for rules with their origin; the trigger follows the mistake.
    """
    replaced = inserted.filter(F.col("action") == "replaced").groupBy(F.col("replaced_by").alias("rule_id")).agg(
        F.min_by("id", "seq").alias("replaced"))
    new = inserted.filter(F.col("action") == "inserted").select(
        F.col("id").alias("rule_id"), "event_id", F.concat(F.lit(AUDIT_TRIGGER), F.col("mistake")).alias("trigger"),
        F.col("created_at").alias("appended_at"))
    return new.join(replaced, "rule_id", "left")


def compact_rules(learned: DataFrame, native_count: int = NATIVE_COUNT, mode: str = "intended") -> DataFrame:
    """Once the list holds 30 rules, keep the newest that leave room for the native ones and five more.

    `observed` mode keeps the oldest instead. The limit is a plain top-k.
    """
    keep = max(0, MAX_RULES - native_count - RULE_HEADROOM)
    newest = F.col("seq").desc() if mode == "intended" else F.col("seq").asc()
    full = learned.agg((F.count(F.lit(1)) + F.lit(native_count) >= MAX_RULES).alias("full")).scalar()
    kept = learned.orderBy(newest).limit(keep)
    return learned.filter(~full).unionByName(kept.filter(full))


def consolidate_rules(learned: DataFrame) -> DataFrame:
    """Merge rules that share playbook, proto, state and threat class into their common clauses.

    Rules that miss one of the three fields stay as they are, and so does a list below three rules.
    Clause counts are aggregated; no rule list is gathered.
    """
    whole = with_clauses(learned)

    def value(field: str) -> Column:
        hit = F.filter("clauses", lambda c: c.startswith(f"{field}="))
        return F.get(hit, F.lit(0))

    keyed = whole.withColumns({"_p": value("proto"), "_s": value("state"), "_t": value("threat_class")})
    group = ["playbook", "_p", "_s", "_t"]
    complete = F.col("_p").isNotNull() & F.col("_s").isNotNull() & F.col("_t").isNotNull()
    mergeable = keyed.filter(complete)
    sizes = mergeable.groupBy(*group).agg(
        F.count(F.lit(1)).alias("merged"), F.min_by("id", F.struct("created_at", "id")).alias("id"),
        F.min("created_at").alias("created_at"), F.min("seq").alias("seq"))
    shared = mergeable.select(*group, F.explode("clauses").alias("_c")).groupBy(*group, "_c").agg(
        F.count(F.lit(1)).alias("_uses"))
    common = shared.join(sizes.select(*group, "merged"), group).filter(F.col("_uses") == F.col("merged")).groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list("_c")), " AND ").alias("condition"))
    merged = sizes.join(common, group).select("id", "seq", "condition", "playbook", "created_at", "merged")
    one = F.lit(1).cast("long").alias("merged")
    rest = keyed.filter(~complete).select("id", "seq", "condition", "playbook", "created_at", one)
    enough = learned.agg((F.count(F.lit(1)) >= 3).alias("e")).scalar()
    untouched = learned.select("id", "seq", "condition", "playbook", "created_at", one)
    return merged.unionByName(rest).filter(enough).unionByName(untouched.filter(~enough))


def rule_health(incidents: DataFrame, rules: DataFrame, natives: DataFrame, snippet: int = SNIPPET) -> DataFrame:
    """FN count, flag, definition and the last three incidents of every blamed rule.

    `incidents` is the whole log, earlier batches included: rule_id, event_id, reasoning, recorded_at. An incident
    that was recorded twice counts once. `rules` holds id, seq, condition, and of repeated ids the newest rule, which
    is the first of the list, gives the definition; `natives` holds ord, text.
    """
    return health_report(health_counters(incidents.dropDuplicates(["rule_id", "event_id"]), snippet), rules, natives)


def health_counters(incidents: DataFrame, snippet: int = SNIPPET) -> DataFrame:
    """What is stored of distinct incidents: rule_id, fn_count, fp_count, and the last three, newest first."""
    counts = incidents.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("fn_count"), F.lit(0).cast("long").alias("fp_count"))
    latest = W.partitionBy("rule_id").orderBy(F.col("recorded_at").desc(), F.col("event_id").desc())
    last = incidents.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= RECENT)
    line = F.concat(F.lit("[FN] Event "), F.col("event_id").cast("string"), F.lit(": "), F.substring("reasoning", 1, snippet))
    recent = last.groupBy("rule_id").agg(F.reverse(F.array_sort(F.collect_list(
        F.struct(F.col("recorded_at").cast("string").alias("recorded_at"), F.col("event_id").cast("long").alias("event_id"), line.alias("line"))))).alias("last"))
    return counts.join(recent, "rule_id")


def merge_health(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add the counters of a batch of new incidents to the stored ones; of both, the last three incidents stay.

    Work follows the two tables of counters, never the log.
    """
    both = stored.unionByName(fresh)
    counts = both.groupBy("rule_id").agg(F.sum("fn_count").alias("fn_count"), F.sum("fp_count").alias("fp_count"),
                                         F.flatten(F.collect_list("last")).alias("_all"))  # two short lists of a rule
    return counts.select("rule_id", "fn_count", "fp_count", F.slice(F.reverse(F.array_sort("_all")), 1, RECENT).alias("last"))


def health_report(stored: DataFrame, rules: DataFrame, natives: DataFrame) -> DataFrame:
    """Stored health with flag, definition and the lines of the last incidents, oldest first."""
    learned = rules.groupBy(F.col("id").alias("rule_id")).agg(F.max_by("condition", "seq").alias("definition"))
    native = natives.select(F.concat(F.lit("NATIVE_RULE_"), F.col("ord").cast("string")).alias("rule_id"),
                            F.col("text").alias("definition"))
    return stored.join(learned.unionByName(native), "rule_id", "left").select(
        "rule_id", "fn_count", "fp_count", (F.col("fn_count") >= RULE_FN_LIMIT).alias("flagged"),
        F.coalesce("definition", F.lit("<rule no longer present>")).alias("definition"),
        F.transform(F.reverse("last"), lambda s: s["line"]).alias("recent"))


def native_table(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(NATIVE_RULES)], "ord int, text string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
