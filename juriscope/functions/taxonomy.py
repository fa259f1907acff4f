"""The treatment taxonomy: a 20-row dimension and label algebra on columns.

Labels read from the cited side ("Distinguished by"); the recognized form reports
another court's act ("Distinguished as recognized by").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juriscope.functions.literals import array_of, map_of

# Label, severity tier, direct history, needs a higher court or the same one, active voice.
TREATMENTS = [
    ("Reversed by", "Stop", True, True, "Reverses"),
    ("Reversed and remanded by", "Stop", True, True, "Reverses and remands"),
    ("Vacated by", "Stop", True, True, "Vacates"),
    ("Vacated and remanded by", "Stop", True, True, "Vacates and remands"),
    ("Overruled by", "Stop", False, True, "Overrules"),
    ("Abrogated by", "Stop", False, True, "Abrogates"),
    ("Affirmed in part; Reversed in part by", "Warning", True, True, "Affirms in part; Reverses in part"),
    ("Affirmed in part; Vacated in part by", "Warning", True, True, "Affirms in part; Vacates in part"),
    ("Questioned by", "Warning", False, False, "Questions"),
    ("Disapproved by", "Warning", False, False, "Disapproves"),
    ("Limited by", "Warning", False, False, "Limits"),
    ("Remanded by", "Caution", True, True, "Remands"),
    ("Cert. granted by", "Caution", True, True, "Grants cert."),
    ("Criticized by", "Caution", False, False, "Criticizes"),
    ("Distinguished by", "Caution", False, False, "Distinguishes"),
    ("Declined to follow by", "Caution", False, False, "Declines to follow"),
    ("Dismissed by", "Neutral", True, True, "Dismisses"),
    ("Cert. denied by", "Neutral", True, True, "Denies cert."),
    ("Cited by", "Neutral", False, False, "Cites"),
    ("Affirmed by", "Neutral", True, True, "Affirms"),
]
TIERS = ["Stop", "Warning", "Caution", "Neutral"]
NEGATIVE = TIERS[:3]
SUFFIX = " as recognized by"
PLAIN = "Cited by"

# What each treatment means, with {actor} and {target} to fill.
DEFINITIONS = {
    "Reversed by": "On direct appeal, {actor} reversed {target}.",
    "Reversed and remanded by": "On direct appeal, {actor} reversed {target} and sent the case back for further proceedings.",
    "Vacated and remanded by": "On direct appeal, {actor} set aside {target}, leaving it without legal effect, and sent the case back for further proceedings.",
    "Vacated by": "On direct appeal, {actor} set aside {target}, leaving it without legal effect.",
    "Affirmed in part; Reversed in part by": "On direct appeal, {actor} affirmed part of {target} and reversed other parts of it.",
    "Affirmed in part; Vacated in part by": "On direct appeal, {actor} affirmed part of {target} and set aside other parts of it.",
    "Remanded by": "On direct appeal, {actor} sent {target} back for further proceedings.",
    "Cert. granted by": "On a petition for review, {actor} agreed to hear an appeal of {target}.",
    "Dismissed by": "On direct appeal, {actor} ended the appeal of {target} without deciding its merits.",
    "Affirmed by": "On direct appeal, {actor} affirmed {target}.",
    "Cert. denied by": "On a petition for review, {actor} refused to hear an appeal of {target}.",
    "Overruled by": "{actor} expressly overruled all or part of {target}.",
    "Abrogated by": "{actor} effectively, but not explicitly, overruled all or part of {target}.",
    "Questioned by": "{actor} questioned the continuing validity or precedential value of {target}, either because another decision implicitly undermines it or because of intervening events such as judicial or legislative overruling.",
    "Disapproved by": "{actor} expressly or implicitly disapproved all or part of {target} for its reasoning or result and reached a contrary holding, but did not overrule it.",
    "Limited by": "{actor} narrowed the scope or applicability of {target} rather than extending it or accepting it as authoritative.",
    "Criticized by": "{actor} criticized all or part of the reasoning of {target} but, unlike Disapproved, did not reach a contrary holding, or the criticism is dicta.",
    "Distinguished by": "{actor} reached a different result because its facts, procedural posture or law differ from those of {target}. Sometimes also called declined to extend.",
    "Declined to follow by": "{actor} chose not to apply the reasoning or ruling of {target}, and no more specific treatment applies.",
    "Cited by": "{actor} cited, referenced, discussed, interpreted, clarified or explained {target} without treating it negatively.",
}
# How the parties are named, for direct history and for other references.
PARTIES = {
    True: {"actor": "another court", "target": "the decision below", "reported": "another court"},
    False: {"actor": "a later case", "target": "the cited case", "reported": "another case"},
}

LABELS = [t[0] for t in TREATMENTS]
DIRECT = [t[0] for t in TREATMENTS if t[2]]
VERTICAL = [t[0] for t in TREATMENTS if t[3]]


def dim_treatment(spark: SparkSession) -> DataFrame:
    """(ord, label, severity, is_direct, is_vertical, active): one row for each label."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TREATMENTS)], "ord int, label string, severity string, is_direct boolean, is_vertical boolean, active string")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(map_of(values.items()), key)


def is_recognized(label: Column) -> Column:  # L1
    return F.contains(label, F.lit(SUFFIX))


def base(label: Column) -> Column:  # L2
    return F.replace(label, F.lit(SUFFIX), F.lit(" by"))


def _without_by(label: Column) -> Column:
    return F.regexp_replace(label, " by$", "")


def past(label: Column) -> Column:  # L3
    return _without_by(base(label))


def recognized_form(label: Column) -> Column:  # L4
    return F.concat(past(label), F.lit(SUFFIX))


def severity(label: Column) -> Column:  # L5
    return F.coalesce(_lookup({t[0]: t[1] for t in TREATMENTS}, base(label)), F.lit("Other"))


def recorded_severity(label: Column, recorded: Column) -> Column:
    """The taxonomy's tier of the label as it stands, else the recorded one, else Neutral."""
    return F.coalesce(_lookup({t[0]: t[1] for t in TREATMENTS}, label), F.nullif(recorded, F.lit("")), F.lit("Neutral"))


def rank(tier: Column) -> Column:
    """0 for the most serious tier, 4 for unknown ones."""
    return F.coalesce(F.nullif(F.array_position(array_of(TIERS), F.coalesce(tier, F.lit(""))), F.lit(0)) - 1, F.lit(4)).cast("int")


def active(label: Column) -> Column:  # L8
    named = _lookup({t[0]: t[4] for t in TREATMENTS}, label)
    return F.coalesce(named, F.when(is_recognized(label), F.concat(F.lit("Recognizes as "), F.lower(past(label)))).otherwise(_without_by(label)))


def recognizes(label: Column) -> Column:  # L9
    return F.concat(F.lit("Recognizes to be "), F.lower(past(label)))


def direction(label: Column) -> Column:  # E4
    return F.when(is_recognized(label), "Related Reference").when(F.array_contains(array_of(DIRECT), label), "Direct History").otherwise("Citing Reference")


def is_direct(label: Column) -> Column:  # P9
    return F.array_contains(array_of(DIRECT), base(label))


def has_evidence(label: Column) -> Column:  # P7
    return base(label) != PLAIN


def is_negative(tier: Column) -> Column:  # P10
    return tier.isin(NEGATIVE)


def worst(tiers: Column, default: str = "Neutral") -> Column:
    """A2: the most serious of an array of tiers; null and empty count as Neutral."""
    named = F.transform(tiers, lambda t: F.coalesce(F.nullif(t, F.lit("")), F.lit("Neutral")))
    best = F.array_min(F.transform(named, lambda t, i: F.struct(rank(t).alias("rank"), i.alias("at"), t.alias("tier"))))["tier"]
    return F.coalesce(best, F.lit(default))


def pill_states(pills: Column, expert: Column) -> Column:
    """A validation state for each pill (kind, treatment, severity), in order."""
    none = F.coalesce(expert, F.lit("")) == ""
    kind = F.when(is_recognized(expert), "recognized").otherwise("applied")
    agrees = lambda p: (p["kind"] == kind) & (p["treatment"] == base(expert))
    applied = F.filter(pills, lambda p: p["kind"] == "applied")
    close_call = (base(expert) == "Distinguished by") & F.coalesce(F.get(applied, 0)["treatment"].isin("Cited by", "Limited by"), F.lit(False))
    done = F.exists(pills, agrees) | ~is_negative(severity(expert)) | close_call
    guilty = lambda p: (p["kind"] == kind) & is_negative(F.coalesce(F.nullif(p["severity"], F.lit("")), F.lit("Neutral")))
    first_applied = F.coalesce(F.nullif(F.array_position(F.transform(pills, lambda p: p["kind"]), "applied"), F.lit(0)), F.lit(1)) - 1
    blamed = lambda p, i: F.when(F.exists(pills, guilty), guilty(p)).otherwise(i == first_applied)
    return F.transform(pills, lambda p, i: F.when(none, "unverified").when(agrees(p), "agree").when(done, "unverified").when(blamed(p, i), "disagree").otherwise("unverified"))


def row_state(states: Column) -> Column:
    """A3: any disagreement, else any agreement, else unverified."""
    return F.when(F.array_contains(states, "disagree"), "disagree").when(F.array_contains(states, "agree"), "agree").otherwise("unverified")


def definitions(spark: SparkSession) -> DataFrame:
    """(form, definition): every display form of every label but the plain
    citation, defined from the side of the opinion that shows it."""
    dim = dim_treatment(spark).filter(F.col("label") != PLAIN)
    rows = dim.select("label", _lookup(DEFINITIONS, F.col("label")).alias("text"), *[F.when(F.col("is_direct"), PARTIES[True][k]).otherwise(PARTIES[False][k]).alias(k) for k in ("actor", "target", "reported")])
    this, cited = F.lit("this case"), F.lit("the cited case")
    label = F.col("label")

    def form(name: Column, actor: Column, target: Column, lead: str = "") -> Column:
        filled = F.replace(F.replace("text", F.lit("{actor}"), actor), F.lit("{target}"), target)
        first, rest = F.substring(filled, 1, 1), F.substr(filled, F.lit(2))
        return F.struct(name.alias("form"), F.concat(F.lit(f"{lead} noted that "), F.lower(first), rest).alias("definition") if lead else F.concat(F.upper(first), rest).alias("definition"))

    forms = F.array(
        form(label, F.col("actor"), this),
        form(past(label), F.col("actor"), this),
        form(active(label), this, F.col("target")),
        form(recognized_form(label), F.col("reported"), this, "A later case"),
        form(recognizes(label), F.col("reported"), cited, "This case"),
    )
    return rows.select(F.explode(forms).alias("f")).select("f.*")


def treatment_table(spark: SparkSession) -> DataFrame:
    """(severity, direct_history, citing_reference): label lists by tier."""
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "label")))), lambda x: x["label"])
    return dim_treatment(spark).groupBy("severity").agg(ordered(F.col("is_direct")).alias("direct_history"), ordered(~F.col("is_direct")).alias("citing_reference"))
