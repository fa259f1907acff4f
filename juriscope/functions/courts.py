"""Court dimensions and the relation of a citing court to a cited one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juriscope.functions.literals import array_of, map_of

# Category, display, jurisdiction, in display order.
CATEGORIES = [
    ("scotus", "U.S. Supreme Court", "federal"),
    ("circuit", "U.S. Circuit courts", "federal"),
    ("district", "U.S. District courts", "federal"),
    ("state_supreme", "State COLR", "state"),
    ("state_appellate", "State appellate courts", "state"),
    ("state_trial", "State trial courts", "state"),
]
# Jurisdictions in display order.
JURISDICTIONS = [("federal", "Federal"), ("state", "State")]
# Courts named and classed by hand: court, display, level, category.
NAMED_COURTS = [
    ("scotus", "Supreme Court of the United States", 0, "scotus"),
    ("ca2", "Court of Appeals for the Second Circuit", 1, "circuit"),
    ("cadc", "Court of Appeals for the D.C. Circuit", 1, "circuit"),
    ("ord", "District Court, D. Oregon", 2, "district"),
    ("cand", "District Court, N.D. California", 2, "district"),
    ("lactapp", "Louisiana Court of Appeal", 2, "state_appellate"),
    ("michctapp", "Michigan Court of Appeals", 2, "state_appellate"),
    ("nysurct", "New York Surrogate's Court", 3, "state_trial"),
    ("mesuperct", "Maine Superior Court", 3, "state_trial"),
]
# The circuits in their own order; all are level 1 of category circuit.
CIRCUITS = ["ca1", "ca2", "ca3", "ca4", "ca5", "ca6", "ca7", "ca8", "ca9", "ca10", "ca11", "cadc", "cafc"]
# Jurisdiction code, category, level, court of last resort.
CLASSES = [
    ("F", "circuit", 1, False),
    ("FD", "district", 2, False),
    ("FB", "district", 2, False),
    ("FBP", "district", 2, False),
    ("FS", "district", 2, False),
    ("S", "state_supreme", 1, True),
    ("SA", "state_appellate", 2, False),
    ("ST", "state_trial", 3, False),
    ("SS", "state_trial", 3, False),
    ("SAG", "state_trial", 3, False),
]
DEFAULT_CLASS = ("state_trial", 3, False)
# Tabs of the picker with their categories.
TABS = [
    ("federal_appellate", "Federal appellate", ["scotus", "circuit"]),
    ("federal_district", "Federal district", ["district"]),
    ("state", "State", ["state_supreme", "state_appellate", "state_trial"]),
]
OTHER_GROUP = "Other courts"
# The states and territories of the United States.
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware",
    "District of Columbia", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa",
    "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah",
    "Vermont", "Virgin Islands", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
    "Puerto Rico", "Guam", "Northern Mariana Islands", "American Samoa",
]
# Reporter abbreviations of the states.
STATE_SHORT = {
    "Ala.": "Alabama", "Ariz.": "Arizona", "Ark.": "Arkansas", "Cal.": "California", "Colo.": "Colorado",
    "Conn.": "Connecticut", "Del.": "Delaware", "D.C.": "District of Columbia", "Fla.": "Florida",
    "Ga.": "Georgia", "Haw.": "Hawaii", "Ill.": "Illinois", "Ind.": "Indiana", "Kan.": "Kansas",
    "Ky.": "Kentucky", "La.": "Louisiana", "Me.": "Maine", "Md.": "Maryland", "Mass.": "Massachusetts",
    "Mich.": "Michigan", "Minn.": "Minnesota", "Miss.": "Mississippi", "Mo.": "Missouri", "Mont.": "Montana",
    "Neb.": "Nebraska", "Nev.": "Nevada", "N.H.": "New Hampshire", "N.J.": "New Jersey", "N.M.": "New Mexico",
    "N.Y.": "New York", "N.C.": "North Carolina", "Okla.": "Oklahoma", "Or.": "Oregon", "Pa.": "Pennsylvania",
    "R.I.": "Rhode Island", "S.C.": "South Carolina", "Tenn.": "Tennessee", "Tex.": "Texas", "Vt.": "Vermont",
    "Va.": "Virginia", "Wash.": "Washington", "W. Va.": "West Virginia", "Wis.": "Wisconsin", "Wyo.": "Wyoming",
    "P.R.": "Puerto Rico",
}
# Courts whose name tells no state, or a wrong one.
COURT_STATE = {"dcd": "District of Columbia"}


def dim_category(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, d, j, i) for i, (c, d, j) in enumerate(CATEGORIES)], "category string, display string, jurisdiction string, ord int")


def dim_jurisdiction(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(j, d, i) for i, (j, d) in enumerate(JURISDICTIONS)], "jurisdiction string, display string, ord int")


def jurisdiction(category: Column) -> Column:
    """The jurisdiction of a category; '' for unknown ones, which so are one of their own."""
    return F.when(category.isin([c for c, _, j in CATEGORIES if j == "federal"]), "federal").when(category.isin([c for c, _, j in CATEGORIES if j == "state"]), "state").otherwise("")


def state(court: Column, category: Column, display: Column) -> Column:
    """The state that a court sits in: by hand, none for federal appellate
    courts, else the longest name or abbreviation within its display."""
    names = array_of(sorted(STATES, key=len, reverse=True))
    named = F.get(F.filter(names, lambda n: F.contains(display, n)), F.lit(0))
    by_hand = F.element_at(map_of(COURT_STATE.items()), court)
    return F.coalesce(by_hand, F.when(F.coalesce(category, F.lit("")).isin("scotus", "circuit"), ""), named, _shorts(display))


def _shorts(display: Column) -> Column:
    """The state of the longest abbreviation in ``display``, the first listed of equal ones."""
    shorts = sorted(STATE_SHORT, key=len, reverse=True)
    hit = F.get(F.filter(array_of(shorts), lambda n: F.contains(display, n)), F.lit(0))
    return F.coalesce(F.element_at(map_of(STATE_SHORT.items()), hit), F.lit(""))


def with_state(courts: DataFrame) -> DataFrame:
    """Courts (court, display, level, category) with jurisdiction and state added."""
    return courts.withColumns({"jurisdiction": jurisdiction(F.col("category")), "state": state(F.col("court"), F.col("category"), F.coalesce("display", "court"))})


def relation(cited: str, citing: str) -> Column:
    """How the citing court stands to the cited one, from columns
    ``<prefix>court``, ``level``, ``category``, ``jurisdiction`` and ``state``."""
    c = lambda side, name: F.col(f"{side}{name}")
    level = lambda side: F.coalesce(c(side, "level"), F.lit(99))
    same_state = F.coalesce(c(cited, "state"), F.lit("")) == F.coalesce(c(citing, "state"), F.lit(""))
    here, there = F.coalesce(c(cited, "jurisdiction"), F.lit("")), F.coalesce(c(citing, "jurisdiction"), F.lit(""))
    return (
        F.when(c(cited, "court").eqNullSafe(c(citing, "court")), "equal")
        .when(c(citing, "category") == "scotus", "controlling")
        .when(c(cited, "category") == "scotus", "other")
        .when(here != there, "other")
        .when((here == "state") & ~same_state, "other")
        .when(level(citing) < level(cited), "controlling")
        .when(level(citing) == level(cited), "equal")
        .otherwise("other")
    )


def registered(payloads: DataFrame) -> DataFrame:
    """(court, display, level, category, last_resort) of every court that payloads
    name; ``load_ord`` tells which payload comes first."""
    first = payloads.filter("court <> ''").groupBy("court").agg(F.min_by(F.struct("court_full_name", "court_short_name", "court_jurisdiction"), "load_ord").alias("p"))
    pick = lambda rows, i: F.element_at(map_of((r[0], r[i]) for r in rows), F.col("court"))
    code = lambda i, default: F.coalesce(F.element_at(map_of((r[0], r[i]) for r in CLASSES), F.coalesce("p.court_jurisdiction", F.lit(""))), F.lit(default))
    circuit = F.col("court").isin(CIRCUITS)
    by_hand = F.col("court").isin([n[0] for n in NAMED_COURTS]) | circuit
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    seen = first.select(
        "court",
        F.coalesce(pick(NAMED_COURTS, 1), filled("p.court_full_name"), filled("p.court_short_name"), F.col("court")).alias("display"),
        F.coalesce(pick(NAMED_COURTS, 2), F.when(circuit, 1), code(2, DEFAULT_CLASS[1])).alias("level"),
        F.coalesce(pick(NAMED_COURTS, 3), F.when(circuit, "circuit"), code(1, DEFAULT_CLASS[0])).alias("category"),
        ((F.col("court") == "scotus") | ~by_hand & code(3, DEFAULT_CLASS[2])).alias("last_resort"),
    )
    named = payloads.sparkSession.createDataFrame([(*n, n[0] == "scotus") for n in NAMED_COURTS], "court string, display string, level int, category string, last_resort boolean")
    return seen.unionByName(named.join(seen, "court", "left_anti"))


def court_list(courts: DataFrame) -> DataFrame:
    """(ord, key, display, level, category): highest court first, then by name."""
    level = F.coalesce("level", F.lit(99))
    order = Window.orderBy(level, F.lower("display"), "court")
    return courts.select((F.row_number().over(order) - 1).alias("ord"), F.col("court").alias("key"), "display", level.alias("level"), F.coalesce("category", F.lit("other")).alias("category"))


def court_picker(courts: DataFrame) -> DataFrame:
    """O7, W7, A14, SO4: one row for each court: its tab, group, place and depth.

    The dimension has a row for each court, some thousands at most, so its windows
    over a tab stay small whatever the corpus."""
    c = with_state(courts).withColumns({"level": F.coalesce("level", F.lit(99)), "category": F.coalesce("category", F.lit("other"))})
    tab = F.lit(len(TABS))
    for i, (_, _, categories) in enumerate(TABS):
        tab = F.when(F.col("category").isin(categories), i).otherwise(tab)
    c = c.withColumn("tab_ord", tab)
    shown = F.element_at(map_of((k, d) for k, d, _ in CATEGORIES), F.col("category"))
    c = c.withColumn("group_name", F.when(F.col("tab_ord") == 0, shown).when(F.col("tab_ord") == len(TABS), OTHER_GROUP).otherwise(F.coalesce(F.nullif("state", F.lit("")), F.lit(OTHER_GROUP))))
    place = F.array_position(array_of(k for k, _, _ in CATEGORIES), F.col("category"))
    group_key = F.when(F.col("tab_ord") == 0, F.format_string("%03d", place)).otherwise(F.concat(F.when(F.col("group_name") == OTHER_GROUP, "1").otherwise("0"), "group_name"))
    circuit = F.coalesce(F.nullif(F.array_position(array_of(CIRCUITS), F.col("court")), F.lit(0)), F.lit(99))
    other = F.col("tab_ord") == len(TABS)
    in_tab, in_group = Window.partitionBy("tab_ord"), Window.partitionBy("tab_ord", "group_name")
    name = lambda i, last: F.get(F.array(*[F.lit(t[i]) for t in TABS], F.lit(last)), F.col("tab_ord"))
    return c.withColumn("group_key", group_key).select(
        name(0, "other").alias("tab"),
        name(1, "Other").alias("tab_display"),
        "tab_ord",
        F.count("*").over(in_tab).alias("n_courts"),
        (F.dense_rank().over(in_tab.orderBy("group_key")) - 1).alias("group_ord"),
        "group_name",
        (F.row_number().over(in_group.orderBy(F.when(other, 0).otherwise(F.col("level")), F.when(other, 0).otherwise(circuit), F.lower("display"), "court")) - 1).alias("court_ord"),
        F.col("court").alias("key"),
        "display",
        "level",
        F.when(other, 0).otherwise(F.dense_rank().over(in_group.orderBy("level")) - 1).alias("depth"),
    )
