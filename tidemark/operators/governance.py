"""Review, conflicts, publishing, prompts, routing and rules."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.similarity import jaccard

#: Item types that a person must review, and the confidence from which none need.
REVIEWED_TYPES, LEAST_CONFIDENCE = ("POLICY", "PRICE", "LEGAL"), 0.85
UNTITLED = "未命名条目"


def must_review(kind: Column, confidence: Column) -> Column:
    clamped = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.upper(kind).isin(*REVIEWED_TYPES), F.lit(False)) | confidence.isNull() | (clamped < LEAST_CONFIDENCE)


def item_title(title: Column, content: Column) -> Column:
    """A blank title becomes the content's first 20 characters without spaces, or a fixed name."""
    short = F.substring(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", ""), 1, 20)
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", title).when(short != "", short).otherwise(UNTITLED)


def exact_duplicates(docs: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """Rows whose group has the same text under a smaller id; blank texts are never duplicates."""
    hashed = docs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(group, id_col, F.sha2(text_col, 256).alias("hash"))
    first = hashed.groupBy(group, "hash").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(first, [group, "hash"]).where(F.col(id_col) > F.col("first")).select(group, id_col, "first")


def conflict_candidates(new: DataFrame, old: DataFrame, most: int = 10, below: float = 0.85) -> DataFrame:
    """new(id, version_id, title, content, must_review, status) against old(id, title, content) with the same title and too different a text.

    Per version the ``most`` first, by item and old item.
    """
    open_ = new.where("must_review AND status <> 'RESOLVED'").select("version_id", F.col("id").alias("item_id"), "title", F.col("content").alias("new_content"))
    pairs = open_.join(old.select(F.col("id").alias("old_id"), "title", F.col("content").alias("old_content")), "title")
    differing = pairs.withColumn("similarity", F.round(jaccard(F.col("new_content"), F.col("old_content")), 6)).where(F.col("similarity") < below)
    n = F.row_number().over(Window.partitionBy("version_id").orderBy("item_id", "old_id"))
    return differing.withColumn("n", n).where(F.col("n") <= most).select("version_id", "item_id", "old_id", "similarity")


def publish_gates(versions: DataFrame, reviews: DataFrame, conflicts: DataFrame, chunks: DataFrame, passed: DataFrame) -> DataFrame:
    """Per version(id, status): whether it may be published, and the first gate that forbids it."""
    flag = lambda df, name: df.select(F.col("version_id").alias("id")).distinct().withColumn(name, F.lit(True))
    parts = versions.join(flag(reviews.where("must_review AND status NOT IN ('APPROVED', 'REJECTED')"), "unreviewed"), "id", "left").join(flag(conflicts.where("status = 'PENDING'"), "conflict"), "id", "left").join(flag(chunks, "filled"), "id", "left").join(flag(passed, "gate"), "id", "left")
    reason = F.when(~F.col("status").isin("DRAFT", "REVIEW"), "status").when(F.col("unreviewed"), "review").when(F.col("conflict"), "conflict").when(F.col("filled").isNull(), "empty").when(F.col("gate").isNull(), "evaluation")
    return parts.select("id", reason.isNull().alias("publishable"), F.coalesce(reason, F.lit("")).alias("reason"))


def expire_others(versions: DataFrame, published: Column, same_doc: Column) -> DataFrame:
    return versions.withColumn("status", F.when(published, "PUBLISHED").when(same_doc & (F.col("status") == "PUBLISHED"), "EXPIRED").otherwise(F.col("status")))


def next_version(names: Column) -> Column:
    """V<n + 1> after the largest V<n> of a group; other names count as 0."""
    n = F.coalesce(F.regexp_extract(names, r"^V(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("V"), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string"))


def key_summary(rows: DataFrame) -> DataFrame:
    """Per prompt_key: the newest version's name, the enabled and the gray version, the gray tenants, the number of versions."""
    newest = F.max_by("name", F.struct(F.coalesce("version", F.lit(-1)), "id"))
    return rows.groupBy("prompt_key").agg(newest.alias("name"), F.max(F.when(F.col("status") == 1, F.col("version"))).alias("enabled_version"), F.max(F.when(F.col("status") == 2, F.col("version"))).alias("gray_version"), F.max(F.when(F.col("status") == 2, F.col("gray_tenants"))).alias("gray_tenants"), F.count("*").alias("versions"))


def gray_resolve(requests: DataFrame, prompts: DataFrame) -> DataFrame:
    """requests(…, prompt_key, tenant) with the version that each gets: gray for listed tenants, else enabled, else null."""
    info = key_summary(prompts).select("prompt_key", "enabled_version", "gray_version", "gray_tenants")
    gray = F.coalesce(F.array_contains(F.split("gray_tenants", ","), F.col("tenant").cast("string")), F.lit(False)) & F.col("gray_version").isNotNull()
    return requests.join(info, "prompt_key", "left").withColumn("version", F.when(gray, F.col("gray_version")).otherwise(F.col("enabled_version"))).drop("enabled_version", "gray_version", "gray_tenants")


def routes(scenarios: DataFrame, models: DataFrame) -> DataFrame:
    """Per scenario the enabled models (status 1) in the order in which they are tried; only without any of its own those of "*"."""
    live = models.where("status = 1")
    own = scenarios.join(live, "scenario").select("scenario", "id", "priority")
    common = live.where("scenario = '*'").select(F.col("scenario").alias("_star"), "id", "priority")
    other = scenarios.join(live.select("scenario").distinct(), "scenario", "left_anti").withColumn("_star", F.lit("*")).join(common, "_star")
    place = F.row_number().over(Window.partitionBy("scenario").orderBy("priority", "id"))
    return own.unionByName(other.select("scenario", "id", "priority")).withColumn("place", place).withColumn("degraded", F.col("place") > 1)


def apply_rules(facts: DataFrame, rules: list[tuple[str, int, str, str]], keys: list[str]) -> DataFrame:
    """keys, rule_key, conclusion: the first rule whose SQL condition holds; rules are (rule_key, priority, condition, conclusion).

    A condition that is null doesn't hold.  Conditions are Spark SQL over the facts' columns.
    """
    hit = F.lit(None).cast("struct<rule_key: string, conclusion: string>")
    for key, _, condition, conclusion in sorted(rules, key=lambda r: (-r[1], r[0]), reverse=False)[::-1]:
        hit = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.struct(F.lit(key).alias("rule_key"), F.lit(conclusion).alias("conclusion"))).otherwise(hit)
    return facts.select(*keys, hit.alias("_hit")).where("_hit IS NOT NULL").select(*keys, "_hit.rule_key", "_hit.conclusion")


#: Why a conversation goes to a person, by what the refusal says, in this order (fixed values).
REFUSALS = [("out of scope", ["超出"]), ("conflict", ["冲突"]), ("product mismatch", ["产品不匹配"]), ("insufficient", ["证据不足", "未检索"]), ("blocked", ["阻断", "拒绝作答"])]


def transfer_reason(evaluated: Column, refusal: Column, claim_fail: Column) -> Column:
    """unavailable if nothing was evaluated, else what the refusal says first, else claim failed, else insufficient.

    Out of scope comes before insufficient, as a blocked search's refusal names both.
    """
    told = first_match(F.coalesce(refusal, F.lit("")), REFUSALS, "")
    return F.when(~F.coalesce(evaluated, F.lit(False)), "unavailable").when(told != "", told).when(F.coalesce(claim_fail, F.lit(False)), "claim failed").otherwise("insufficient")


def distinct_union(asked: DataFrame, items: DataFrame, key: str, bases: str, base: str, pos: str, name: str) -> DataFrame:
    """key, place, base and name: the items of all of a row's bases as one list, in the order of the bases and positions.

    Of items with one name the first counts; blank and null names, and bases that come again, don't.
    """
    order = asked.select(key, F.posexplode(F.array_distinct(bases)).alias("_b", "_base"))
    # Of a base's items with one name only the first can count, whoever asks: the others don't meet the rows.
    named = items.where(F.trim(F.col(name)) != "").groupBy(F.col(base).alias("_base"), F.col(name).alias("_name")).agg(F.min(pos).alias("_pos"))
    rows = order.join(named, "_base")
    first = rows.groupBy(key, "_name").agg(F.min(F.struct("_b", "_pos", "_base")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_at._b", "_at._pos", "_name"))
    return first.select(key, place.alias("place"), F.col("_at._base").alias(base), F.col("_name").alias(name))


#: Prefixes of tables that belong to other systems (fixed values); whatever has a $ is a system's as well.
FOREIGN = ["act_", "qrtz_", "flw_", "impdp_", "all_", "hs_"]


def listed_tables(tables: DataFrame, name: str | None = None, comment: str | None = None) -> DataFrame:
    """tables(name, comment, ...) whose name and comment hold what is asked for, without other systems' tables, by name."""
    own = ~F.col("name").rlike("^(?:" + "|".join(p for x in FOREIGN for p in (x, x.upper())) + r").|.\$")
    found = tables.where(own)
    for c, asked in (("name", name), ("comment", comment)):
        if asked:
            found = found.where(F.coalesce(F.col(c), F.lit("")).contains(asked))
    return found.orderBy("name")


def rules_of(text: str) -> list[dict]:
    """Rules as JSON: a list of name, when (a Spark SQL condition over the facts), then (a list of conclusions) and salience (0 if it has none)."""
    rules = json.loads(text)
    if not isinstance(rules, list) or not all(isinstance(r, dict) and isinstance(r.get("name"), str) and isinstance(r.get("when"), str) and isinstance(r.get("then"), list) for r in rules):
        raise ValueError("rules are a list of name, when, then")
    return sorted(rules, key=lambda r: (-int(r.get("salience", 0)), r["name"]))


def check_rules(facts: DataFrame, text: str) -> list[dict]:
    """The rules, in the order in which they fire; raises what is wrong with them."""
    rules = rules_of(text)
    for r in rules:
        kind = facts.select(F.expr(r["when"]).alias("c")).schema["c"].dataType.simpleString()
        if kind != "boolean":
            raise ValueError(f"rule {r['name']}: the condition is {kind}, no boolean")
    return rules


def evaluate_rules(facts: DataFrame, texts: dict[str, str], key: str, keys: list[str]) -> DataFrame:
    """keys, place, rule, conclusion: every conclusion of every rule that fits a row of facts, by the rule text that its key names.

    Rules fire by falling salience, those of one salience by name, and a rule's conclusions in their
    order; place counts a row's from 1.  A condition that is null doesn't fit.  A text that doesn't
    compile gives nothing, as does a key without a text; ``check_rules`` tells what is wrong.
    """
    kind = "array<struct<rule: string, conclusion: string>>"
    hits = F.lit(None).cast(kind)
    for name, text in sorted(texts.items()):
        try:
            rules = check_rules(facts, text)
        except (ValueError, AnalysisException, ParseException) as e:
            logging.getLogger(__name__).warning("rules %s are left out: %s", name, str(e).strip().splitlines()[0])
            continue
        told = [F.when(F.coalesce(F.expr(r["when"]), F.lit(False)), F.array(*[F.struct(F.lit(r["name"]).alias("rule"), F.lit(str(c)).alias("conclusion")) for c in r["then"]])) for r in rules if r["then"]]
        if told:
            hits = F.when(F.col(key) == name, F.flatten(F.array_compact(F.array(*told)))).otherwise(hits)
    found = facts.select(*keys, F.posexplode(hits).alias("place", "hit"))
    return found.select(*keys, (F.col("place") + 1).alias("place"), "hit.rule", "hit.conclusion")


def latest_rules(rules: DataFrame) -> dict[str, str]:
    """rule_key -> text: the enabled (status 1) row with the highest version, then id, of rules(rule_key, version, id, status, content)."""
    last = rules.where("status = 1 AND rule_key IS NOT NULL").groupBy("rule_key").agg(F.max_by("content", F.struct("version", "id")).alias("content"))
    return {r.rule_key: r.content for r in last.collect() if r.content}  # texts that people wrote


def first_match(c: Column, groups: list[tuple[str, list[str | tuple[str, ...]]]], default: str) -> Column:
    """The first group one of whose words the text holds; of a tuple of words it holds all."""
    out = None
    for name, words in groups:
        found = F.lit(False)
        for w in words:
            held = F.lit(True)
            for x in (w,) if isinstance(w, str) else w:
                held = held & c.contains(x)
            found = found | held
        out = (F.when if out is None else out.when)(found, name)
    return out.otherwise(default)


def kb_visible(bases: DataFrame, roles: list[str] | None, now: Column, super_admin: bool = False) -> DataFrame:
    """Bases that are not expired and either have no roles or share one; without a user none."""
    if super_admin:
        return bases
    if roles is None:
        return bases.where(F.lit(False))
    listed = F.filter(F.transform(F.split(F.coalesce("visible_roles", F.lit("")), ","), lambda r: F.trim(r)), lambda r: r != "")
    mine = F.array(*[F.lit(r) for r in roles]) if roles else F.array().cast("array<string>")
    return bases.where((F.col("effective_to").isNull() | (F.col("effective_to") > now)) & ((F.size(listed) == 0) | F.arrays_overlap(listed, mine)))


def product_gate(asked: Column, owned: Column) -> Column:
    """Whether an answer is blocked: products are asked for, and none holds or is held by one of the document's."""
    related = F.exists(asked, lambda p: F.exists(owned, lambda d: d.contains(p) | p.contains(d)))
    return (F.size(asked) > 0) & ~related


def best_source(items: DataFrame, chunks: DataFrame, batch: str, least: float = 0.25) -> DataFrame:
    """Per item the chunk of its batch that shares most of the item's characters (ties to the first); none below ``least``."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""))
    pairs = items.select(batch, "item_id", letters(F.col("content")).alias("x")).join(chunks.select(batch, "chunk_id", "pos", letters(F.col("content")).alias("y")), batch)
    share = F.round(F.size(F.array_intersect("x", "y")) / F.when(F.size("x") > 0, F.size("x")), 6)
    scored = pairs.withColumn("share", F.coalesce(share, F.lit(0.0)))
    first = scored.withColumn("n", F.row_number().over(Window.partitionBy(batch, "item_id").orderBy(F.desc("share"), "pos"))).where("n = 1")
    return first.select(batch, "item_id", F.when(F.col("share") >= least, F.col("chunk_id")).alias("chunk_id"), "share")


def latest_info(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their version's and document's fields; a missing side leaves nulls."""
    return chunks.join(versions, "version_id", "left").join(documents, "doc_id", "left")


def missing_slots(definitions: Column, told: Column, filled: Column) -> Column:
    """Codes, in their order, that the model told or that are required and not filled; definitions: array<struct<code, required, sort>>."""
    wanted = F.filter(definitions, lambda s: F.array_contains(told, s["code"]) | (s["required"] & ~F.array_contains(filled, s["code"])))
    ordered = F.array_sort(F.transform(wanted, lambda s: F.struct(s["sort"].alias("sort"), s["code"].alias("code"))))
    return F.transform(ordered, lambda s: s["code"])
