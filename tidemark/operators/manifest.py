"""Roll-ups of classified screens: manifests, sections, session profiles, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that the three outputs leave out.
NO_IMAGE = ("transition", "system_tray", "app_switcher", "home_screen")
NO_ANALYSIS = (*NO_IMAGE, "unsorted")
NO_STEP = ("transition", "system_tray", "app_switcher")


def parent(label: Column) -> Column:
    return F.split(label, "/", 2)[0]


def child(label: Column) -> Column:
    return F.get(F.split(label, "/", 2), F.lit(1))


def placed(screens: DataFrame) -> DataFrame:
    """Screens that get an image, with their number within the label and the file they go to."""
    number = F.row_number().over(Window.partitionBy("job_id", "label").orderBy("idx")) - 1
    return screens.where(~F.col("label").isin(*NO_IMAGE)).withColumn("number", number.cast("long")).withColumn("path", F.concat(F.replace("label", F.lit("/"), F.lit("__")), F.lit("/"), F.format_string("%03d", "number"), F.lit(".jpg")))


def _entry(screens: DataFrame) -> Column:
    """What a manifest says of an image: where it is, and what it shows. Missing columns are empty."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in screens.columns else F.lit("") for c in ("key_text", "state")}
    parts = F.coalesce("components", F.array().cast("array<string>")) if "components" in screens.columns else F.array().cast("array<string>")
    return F.struct("idx", "path", texts["key_text"].alias("key_text"), parts.alias("components"), texts["state"].alias("state"))


def tree(screens: DataFrame) -> DataFrame:
    """One row a job: manifest, a map from parent to its own images and a map of its children's; parents and children in the order in which they first appear."""
    rows = placed(screens).select("job_id", parent(F.col("label")).alias("parent"), child(F.col("label")).alias("child"), _entry(screens).alias("image"))
    leaves = rows.groupBy("job_id", "parent", "child").agg(F.array_sort(F.collect_list("image")).alias("images")).withColumn("first", F.col("images")[0]["idx"])
    own = F.flatten(F.collect_list(F.when(F.coalesce("child", F.lit("")) == "", F.col("images"))))
    by_first = lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)
    in_order = lambda when, *columns: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("first", *columns))), by_first), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    children = F.map_from_entries(in_order(F.col("child") != "", "child", "images"))
    parents = leaves.groupBy("job_id", "parent").agg(F.struct(own.alias("images"), children.alias("children")).alias("node"), F.min("first").alias("first"))
    return parents.groupBy("job_id").agg(F.map_from_entries(in_order(F.lit(True), "parent", "node")).alias("manifest"))


def sections(manifests: DataFrame, base: str = "") -> DataFrame:
    """Back from trees to sections: position, parent with a title, and its images, its own before its children's, with URLs. Both in the order of the tree."""
    shown = manifests.select("job_id", F.posexplode("manifest").alias("position", "parent", "node")).where(~F.col("parent").startswith("_"))
    nested = F.concat(F.coalesce("node.images", F.array()), F.flatten(F.coalesce(F.map_values("node.children"), F.array())))
    url = lambda path: F.concat(F.lit(f"{base}/images/"), F.col("job_id").cast("string"), F.lit("/"), path)
    images = F.transform(nested, lambda x: F.struct(url(x["path"]).alias("url"), F.col("parent").alias("label"), x["key_text"].alias("key_text"), x["components"].alias("components"), x["state"].alias("state")))
    title = F.initcap(F.replace("parent", F.lit("_"), F.lit(" ")))
    found = shown.select("job_id", "position", "parent", title.alias("title"), images.alias("images"), F.array_sort(F.transform(nested, lambda x: x["path"])).alias("paths"))
    return found.where(F.size("images") > 0)


def view(manifests: DataFrame, base: str = "") -> DataFrame:
    """One row a job: its sections in order, and the analysis that its manifest has, null if none."""
    listed = sections(manifests, base).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("position", "title", "images"))).alias("sections"))
    analysis = F.col("analysis") if "analysis" in manifests.columns else F.lit(None).cast("map<string,string>").alias("analysis")
    nothing = F.array().cast(listed.schema["sections"].dataType)
    return manifests.select("job_id", analysis).join(listed, "job_id", "left").withColumn("sections", F.coalesce("sections", nothing))


#: Measures of a page on which sections stand side by side.
PAGE_PAD, SECTION_GAP, SECTION_PAD, CARD_WIDTH, CARD_HEIGHT, CARD_GAP, LABEL_HEIGHT = 100, 80, 40, 390, 844, 24, 52


def layout(shown: DataFrame, start: int = PAGE_PAD) -> DataFrame:
    """job_id, position, x, width, height and the x of each card of sections(), one row of cards a section, side by side from start."""
    count = F.size("images")
    width = count * (CARD_WIDTH + CARD_GAP) - CARD_GAP + 2 * SECTION_PAD
    before = Window.partitionBy("job_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum(width + SECTION_GAP).over(before), F.lit(0)) + start
    cards = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * (CARD_WIDTH + CARD_GAP) + SECTION_PAD)
    height = CARD_HEIGHT + LABEL_HEIGHT + 2 * SECTION_PAD
    return shown.select("job_id", "position", x.cast("long").alias("x"), width.cast("long").alias("width"), F.lit(height).cast("long").alias("height"), cards.alias("cards"))


def section_names(screens: DataFrame) -> DataFrame:
    """Per job: the sorted labels, without transitions and unsorted ones."""
    return screens.where(~F.col("label").isin("transition", "unsorted")).groupBy("job_id").agg(F.array_sort(F.collect_set("label")).alias("sections"))


def counters(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Per job: frames extracted, and how many of them were duplicates."""
    left = kept.groupBy("job_id").agg(F.count("*").alias("kept"))
    counted = frames.groupBy("job_id").agg(F.count("*").alias("extracted")).join(left, "job_id", "left")
    return counted.select("job_id", "extracted", (F.col("extracted") - F.coalesce("kept", F.lit(0))).alias("dupes"))


def session_list(profiles: DataFrame) -> DataFrame:
    """A line for each session: the beginning of its tier, the funnel's length, paywall and offer."""
    return profiles.select("job_id", F.substring(F.coalesce("competitive_tier", F.lit("")), 1, 80).alias("competitive_tier"), F.size("funnel_sequence").alias("funnel_length"), "paywall_position", "has_downsell")


def funnel(steps: DataFrame) -> DataFrame:
    """One row a job: its ordered steps, where the first paywall stands, onboarding steps, and whether there is an offer after."""
    shown = steps.where(~F.col("label").isin(*NO_STEP))
    numbered = shown.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("idx")).cast("long") - 1)
    return numbered.groupBy("job_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("sequence"),
        F.min(F.when(F.col("label").startswith("paywall"), F.col("place"))).alias("paywall_position"),
        F.count_if(F.col("label").startswith("onboarding")).alias("onboarding_count"),
        F.bool_or(F.col("label").startswith("special_offer")).alias("has_downsell"),
    )


def evenly(rows: DataFrame, most: int = 20) -> DataFrame:
    """At most `most` rows a job, evenly spread: place int(i * n / most) for i from 0, all if there are no more."""
    job = Window.partitionBy("job_id")
    numbered = rows.withColumns({"__place": F.row_number().over(job.orderBy("idx")).cast("long") - 1, "__n": F.count("*").over(job)})
    i = F.ceil(F.col("__place") * most / F.col("__n"))
    chosen = (F.col("__n") <= most) | (F.floor(i * F.col("__n") / most) == F.col("__place")) & (i < most)
    return numbered.where(chosen).drop("__place", "__n")


def compare(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (job_a, job_b) of profiles: lengths, shared steps, and how far apart the paywalls stand."""
    a = profiles.select(F.col("job_id").alias("job_a"), F.col("sequence").alias("seq_a"), F.col("paywall_position").alias("pay_a"))
    b = profiles.select(F.col("job_id").alias("job_b"), F.col("sequence").alias("seq_b"), F.col("paywall_position").alias("pay_b"))
    return pairs.join(a, "job_a").join(b, "job_b").select("job_a", "job_b", F.size("seq_a").cast("long").alias("steps_a"), F.size("seq_b").cast("long").alias("steps_b"), F.size(F.array_intersect("seq_a", "seq_b")).cast("long").alias("shared_kinds"), (F.col("pay_b") - F.col("pay_a")).alias("paywall_shift"))
