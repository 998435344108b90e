"""Answers of a screen classifier: parsed, padded or cut to the frames asked for, normalised, checked.

Answers are variants, as a field may come as any kind of value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import any_keyword, strip

LOW = 0.65
#: Screen types, and words that a screen of such a type is expected to show, or not to show.
PAYWALL_TYPES = ("paywall", "special_offer", "trial_offer", "subscription")
PAYWALL_WORDS = (
    "price", "$", "€", "£", "trial", "free trial", "subscribe", "subscription",
    "premium", "unlock", "continue", "yearly", "monthly", "weekly", "week",
    "month", "year", "/year", "/month", "/week", "per year", "per month",
    "per week", "lifetime", "annual", "% off", "save",
)
ONBOARDING_PRICE_WORDS = (
    "$", "€", "£", "/year", "/month", "/week", "per year", "per month",
    "free trial", "subscribe", "subscription", "premium",
)
CHECKOUT_TYPES = ("checkout", "payment", "cart")
CHECKOUT_WORDS = (
    "cart", "checkout", "payment", "order", "card", "apple pay", "google pay",
    "shipping", "delivery", "subtotal", "total", "place order", "billing",
)
SIGN_IN_TYPES = ("auth", "login", "signup", "otp_verification", "sign_in_with_apple_google")
SIGN_IN_WORDS = (
    "sign in", "sign up", "log in", "login", "email", "password",
    "continue with", "apple", "google", "phone", "code", "verify",
)
PERMISSION_TYPES = ("permission", "notification_prompt")
PERMISSION_WORDS = (
    "allow", "permission", "notifications", "camera", "microphone", "photos",
    "location", "tracking", "bluetooth", "contacts", "calendar",
)
QUIET = ("transition", "system_tray", "app_switcher", "home_screen", "loading", "splash")

#: Texts of rows that stand in for answers, and the keys that may hold the list of items.
FALLBACK_REASON = "classification_fallback"
MISSING = "missing item from Gemini response"
NO_OBJECT = "item at index %d was not an object"
LISTS = ("frames", "screens", "classifications", "items")

TEXTS = ("label", "screen_type", "key_text", "all_visible_text", "state", "review_reason", "uncertainty_reason")
FLAGS = ("is_transition", "is_scroll_state", "same_screen_as_previous", "needs_review")


def isolate(text: Column) -> Column:
    """The JSON in an answer: from the first bracket to its last counterpart, of the inside of a fence if there is one; else the text."""
    bare = strip(text)
    fenced = F.regexp_extract(bare, r"(?is)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(bare.rlike(r"(?is)```(?:json)?\s*(.*?)```"), strip(fenced)).otherwise(bare)

    def span(s: Column) -> Column:
        size = F.char_length(s)

        def between(opening: str, closing: str) -> Column:
            start, end = F.locate(opening, s), F.when(F.contains(s, F.lit(closing)), size - F.locate(closing, F.reverse(s)) + 1)
            return F.when((start > 0) & (end > start), F.struct(start.alias("start"), end.alias("end")))

        first = F.array_min(F.array_compact(F.array(between("{", "}"), between("[", "]"))))
        return F.when(first.isNull(), s).otherwise(F.substring(s, first["start"], first["end"] - first["start"] + 1))

    # A lambda binds the text once.
    return F.coalesce(F.transform(F.array(inner), span)[0], F.lit(""))


def first_object(text: Column) -> Column:
    """The widest span from a brace to its last counterpart; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def parse(text: Column) -> Column:
    """The answer's JSON as a variant: the whole text if it is JSON, else what isolate() finds; null if that is none."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(isolate(text)))


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def answers(raw: DataFrame) -> DataFrame:
    """job_id, idx, raw: adds items, an array of variants, whatever of the accepted shapes the answer has."""
    found = raw.withColumn("__v", parse(F.col("raw")))
    value = F.col("__v")
    listed = [_get(value, f"$.{k}", "array<variant>") for k in LISTS]
    alone = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.array(value))
    items = F.coalesce(_get(value, "$", "array<variant>"), *listed, alone, F.array().cast("array<variant>"))
    return found.withColumn("items", items).drop("__v")


def _is_object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def _truth(value: Column) -> Column:
    """Flags as they come: true, words for it, or a number that is not zero."""
    kind, word = F.schema_of_variant(value), F.lower(strip(_get(value, "$", "string")))
    by_word = word.isin("true", "yes", "1")
    filled = ~_get(value, "$", "string").isin("[]", "{}")
    return F.coalesce(F.when(kind == "STRING", by_word).when(kind == "BOOLEAN", _get(value, "$", "boolean")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), _get(value, "$", "double") != 0).when(kind.rlike("^(ARRAY|OBJECT)"), filled), F.lit(False))


def _components(value: Column) -> Column:
    """A list of texts: of a list its filled elements, else the one value."""
    texts = _get(value, "$", "array<string>")
    one = _get(value, "$", "string")
    found = F.coalesce(texts, F.when(one.isNotNull(), F.array(one)))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def _filled(value: Column) -> Column:
    """Whether a value is one to go by: not null, false, zero or empty."""
    kind, text = F.schema_of_variant(value), _get(value, "$", "string")
    nothing = F.when(kind == "BOOLEAN", ~_get(value, "$", "boolean")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), _get(value, "$", "double") == 0).otherwise(text.isin("", "[]", "{}"))
    return F.coalesce(~nothing, F.lit(False))


def _whole(value: Column) -> Column:
    """A number without its fraction, or a text that is a whole number; else null."""
    text = _get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))).otherwise(_get(value, "$", "double").cast("long"))


def normalise(items: DataFrame) -> DataFrame:
    """item (a variant, null if missing) and position (from 0) of each row as typed columns; any other columns stay.

    What is no object becomes a fallback row that asks for review.
    """
    item, whole = F.col("item"), _is_object(F.col("item"))
    get = lambda name: F.coalesce(_get(item, f"$.{name}", "string"), F.lit(""))
    told = lambda name: F.when(_filled(_get(item, f"$.{name}", "variant")), get(name))
    label = F.coalesce(told("label"), told("screen_type"), F.lit("unsorted"))
    found = {"label": label, "screen_type": F.coalesce(told("screen_type"), F.split(label, "/", 2)[0])}
    found |= {c: get(c) for c in TEXTS if c not in found}
    found |= {c: _truth(_get(item, f"$.{c}", "variant")) for c in FLAGS}
    found["is_scroll_state"] = found["is_scroll_state"] | (get("state") == "scrolled")
    found["conf"] = F.coalesce(_get(item, "$.conf", "double"), F.lit(0.0))
    found["components"] = _components(_get(item, "$.components", "variant"))
    found["frame_index"] = F.coalesce(_whole(_get(item, "$.frame_index", "variant")), F.col("position") + 1)
    why = F.when(item.isNull(), MISSING).otherwise(F.format_string(NO_OBJECT, "position"))
    empty = {"label": F.lit("unsorted"), "screen_type": F.lit("unsorted"), "conf": F.lit(0.0), "components": F.array().cast("array<string>"), "needs_review": F.lit(True), "review_reason": F.lit(FALLBACK_REASON), "uncertainty_reason": why, "frame_index": F.col("position") + 1}
    empty |= {c: F.lit("") for c in TEXTS if c not in empty} | {c: F.lit(False) for c in FLAGS if c not in empty}
    kept = [c for c in items.columns if c not in ("item", *found)]
    return items.select(*kept, *[F.when(whole, found[c]).otherwise(empty[c]).alias(c) for c in found])


def exactly(answered: DataFrame, expected: str) -> DataFrame:
    """answers() as one row for each of the `expected` frames: items beyond are dropped, missing ones are null."""
    padded = F.transform(F.sequence(F.lit(0), F.col(expected) - 1), lambda i: F.struct(i.cast("long").alias("position"), F.get("items", i.cast("int")).alias("item")))
    rows = answered.where(F.col(expected) > 0).withColumn("__x", F.explode(padded))
    return rows.withColumns({"position": F.col("__x.position"), "item": F.col("__x.item")}).drop("__x", "items")


def rules(screens: DataFrame) -> DataFrame:
    """Adds warnings: the checks that a screen fails, in order. screens have label, key_text, all_text, conf and may have screen_type and is_transition."""
    given = lambda c: F.col(c) if c in screens.columns else F.lit(None)
    blank = F.lit("")
    declared = F.lower(F.coalesce(given("screen_type").cast("string"), blank))
    kind = F.when(declared != "", declared).otherwise(F.split(F.lower(F.coalesce("label", blank)), "/", 2)[0])
    key, seen = F.coalesce("key_text", blank), F.coalesce("all_text", blank)
    both = F.concat(key, F.lit("\n"), seen)
    bare = lambda c: F.char_length(strip(c))
    moving = (kind == "transition") | F.coalesce(given("is_transition").cast("boolean"), F.lit(False))
    checks = [
        ("paywall_without_pricing_text", kind.isin(*PAYWALL_TYPES) & ~any_keyword(both, PAYWALL_WORDS)),
        ("onboarding_with_pricing_text", (kind == "onboarding") & any_keyword(both, ONBOARDING_PRICE_WORDS)),
        ("transition_with_content", moving & (bare(seen) > 24) & (bare(key) > 2)),
        ("empty_text_at_high_conf", (F.col("conf") >= LOW) & (bare(key) == 0) & (bare(seen) == 0) & ~kind.isin(*QUIET)),
        ("low_confidence", F.col("conf") < LOW),
        ("checkout_without_checkout_text", kind.isin(*CHECKOUT_TYPES) & ~any_keyword(both, CHECKOUT_WORDS)),
        ("auth_without_auth_text", kind.isin(*SIGN_IN_TYPES) & ~any_keyword(both, SIGN_IN_WORDS)),
        ("permission_without_permission_text", kind.isin(*PERMISSION_TYPES) & ~any_keyword(both, PERMISSION_WORDS)),
    ]
    return screens.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])))


def reasons(existing: Column, more: Column) -> Column:
    """Reasons joined by '; ', each once, the existing one first."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(F.coalesce(existing, F.lit(""))), more), lambda r: r != "")), "; ")
