"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are all matches of six patterns. Base kinds (email, ip, card, phone) are those whose match
passes an exact check, and stay whatever the method says; secrets and social-security numbers are
kinds that the method adds. Matches that fail their check are candidates too: they are what false
spans look like. Labelers vote on every candidate: regular expressions (the check, and the form that
true ones mostly have), a gazetteer (the word before), context (what stands before) and how the
characters vary; each says 1 or 0 of spans of any kind, or abstains where it has nothing to say. Expectation-maximisation over the counts of vote
patterns (a table of at most 3 ** len(LABELERS) rows) estimates how often each labeler says 1 of true
and of false spans. The posteriors then weigh the counts of a naive Bayes span classifier over
features with few values. It decides on the added kinds, and in mask() on card numbers too, as one
number in ten passes their check by chance.

Both passes read the texts row by row: there is no join, and the only shuffles are those of the
counts. Patterns use possessive repeats, so that a long run neither backtracks nor overflows.

Defined results: a null text is empty and has no spans; repeated rows are scanned one by one; spans
that start together are in order of their kinds; a text of any length is scanned whole, with memory
for its spans; other columns are ignored (mask() keeps them); an empty table gives an empty result,
and without any candidate the classifier keeps nothing beyond the base.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut
from tidemark.llm.text import whole_text

#: Kinds in the order of the report, their patterns, and a character every match has.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "secret": (r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,}+", None),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}
BASE = ("email", "ip", "card", "phone")
#: Kinds that mask() hides without asking the classifier.
SURE = ("email", "ip", "phone")
#: Words that stand before a credential or a number of a person.
GAZETTEER = ("password", "passwd", "pwd", "pass", "token", "secret", "key", "apikey", "credential", "ssn", "social", "auth", "bearer", "card", "visa", "mastercard")
#: Words that stand before a span of a base kind.
GAZETTEERS = {
    "email": ("email", "mail", "contact", "write", "address", "mailto"),
    "ip": ("ip", "host", "server", "address", "gateway", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "pay", "paid", "with"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial"),
}
#: Words that stand before numbers of things.
THINGS = ("version", "release", "section", "chapter", "page", "figure", "table", "isbn", "order", "invoice", "number", "serial", "item", "id")
#: Characters before a span that labelers may look at.
CONTEXT = 24
ROUNDS = 8
ACCEPT = 0.5


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$".replace("0*+(?:", "0*(?:"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,before:string,valid:boolean>"


def _found(kind: str, text: Column) -> Column:
    """array<SPAN> of a kind: code points, end exclusive; valid is whether it passes the kind's check."""
    pattern, must = KINDS[kind]
    nothing = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["piece"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("value"), F.substring(pair["piece"], -CONTEXT, CONTEXT).alias("before"), F.coalesce(_valid(kind, pair["match"]), F.lit(False)).alias("valid"))
        # Short numbers are no candidates of a card.
        keep = F.length(F.regexp_replace(pair["match"], "[^0-9]", "")) >= 12 if kind == "card" else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda s: s["spans"])
    return F.when(F.contains(text, F.lit(must)) if must else text.rlike("[0-9]"), spans).otherwise(nothing)


def candidates(text: Column) -> Column:
    """All candidates, by start and kind."""
    return F.array_sort(F.concat(*[_found(kind, text) for kind in KINDS]))


#: What the numbers of common card schemes begin with, and how long they are.
ISSUERS = "^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"


def _labelers(x: Column) -> dict[str, Column]:
    """name -> 1, 0 or null (abstains), of a span struct."""
    kind, value, before = x["kind"], x["value"], x["before"]
    says = lambda c: F.when(c, 1).otherwise(0)
    digits = F.regexp_replace(value, "[^0-9]", "")
    last = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    added = ~kind.isin(*BASE)
    form = (
        F.when(kind == "email", says(value.rlike(r"\.[A-Za-z]{2,}$")))
        .when(kind == "ip", says(~value.rlike(r"(?:^|\.)0[0-9]")))
        .when(kind == "card", says(digits.rlike(ISSUERS)))
        .when(kind == "phone", says(F.length(digits).between(10, 13)))
        .when(kind == "secret", says(value.rlike("^(?:AKIA|ASIA|ghp|gho|sk|pk|xox)[0-9A-Za-z]{12,}$") | value.rlike("^[0-9a-f]{16,64}$")))
        .when(kind == "ssn", says(~value.rlike("^(?:000|666|9)|-00-|-0000$")))
    )
    named = reduce(lambda c, kw: c | ((kind == kw[0]) & last.isin(*kw[1])), GAZETTEERS.items(), F.lit(False))
    # A mark says that a value follows, something joined that this is its middle; white space says nothing.
    led = F.when(before.rlike(r"[=:(\[<][\x20]?[\x22\x27]?$"), 1).when(before.rlike(r"[^\x09-\x0D\x20]$"), 0)
    varied = F.when(kind == "email", says(value.rlike("^[^@]*[A-Za-z]"))).otherwise(says(F.size(F.array_distinct(F.split(digits, ""))) >= 4))
    return {
        "check": F.when(~added, says(x["valid"])),
        "form": form,
        "gazetteer": F.when(added, F.when(last.isin(*GAZETTEER), 1).when(last != "", 0)).when(named, 1).when(last.isin(*THINGS), 0),
        "context": F.when(added, says(before.rlike(r"[=:][\x20]?[\x22\x27]?$"))).otherwise(led),
        "turns": F.when(kind == "secret", says(_turns(value) >= 3)).when(~added, varied),
    }


def _turns(value: Column) -> Column:
    """How often letters and digits take turns."""
    return F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))


LABELERS = ("check", "form", "gazetteer", "context", "turns")


def _features(x: Column) -> dict[str, Column]:
    """name -> a value of few, of a span struct."""
    value = x["value"]
    labels = _labelers(x)
    vote = lambda name: F.coalesce(labels[name].cast("string"), F.lit("-"))
    return {
        "kind": x["kind"],
        "length": F.least(F.floor(F.char_length(value) / 8), F.lit(5)).cast("string"),
        "letters": F.when(value.rlike("[A-Z]") & value.rlike("[a-z]"), "both").when(value.rlike("[A-Z]"), "upper").when(value.rlike("[a-z]"), "lower").otherwise("none"),
        "turns": F.least(_turns(value), F.lit(6)).cast("string"),
        "form": F.concat(vote("check"), vote("form")),
        "before": F.concat(vote("gazetteer"), vote("context")),
    }


@dataclass(frozen=True)
class Model:
    #: The share of true spans; for each labeler, how often it says 1 of true and of false spans.
    prior: float
    reliability: dict[str, tuple[float, float]]
    #: Feature and value -> log odds; the first is the classifier's own prior.
    bias: float
    odds: dict[tuple[str, str], float]

    def posterior(self, votes: dict[str, Column]) -> Column:
        """The probability that a span with these votes is true."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (true, false) in self.reliability.items():
            says = F.when(votes[name] == 1, math.log(true / false)).when(votes[name] == 0, math.log((1 - true) / (1 - false)))
            total = total + F.coalesce(says, F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: Column) -> Column:
        """The span classifier's probability, of a span struct."""
        total = F.lit(self.bias)
        for name, value in _features(x).items():
            known = [(v, w) for (f, v), w in sorted(self.odds.items()) if f == name]
            if known:
                total = total + F.coalesce(reduce(lambda c, vw: c.when(value == vw[0], vw[1]), known[1:], F.when(value == known[0][0], known[0][1])), F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame) -> Model:
    """Reliabilities and the span classifier, from all spans of all texts."""
    spans = docs.select(F.explode(candidates(whole_text(F.col("text")))).alias("x"))
    labels, features = _labelers(F.col("x")), _features(F.col("x"))
    # Votes and features have few values each, so their counts are a small table.
    votes = [F.col(n) for n in LABELERS]
    counted = spans.select(*[labels[n].alias(n) for n in LABELERS], *[c.alias(f"f_{n}") for n, c in features.items()]).groupBy(*LABELERS, *[f"f_{n}" for n in features]).agg(F.count("*").alias("n"))
    counted = cut(counted)
    patterns = cut(counted.groupBy(*votes).agg(F.sum("n").alias("n")))
    model = Model(0.5, {n: (0.8, 0.2) for n in LABELERS}, 0.0, {})
    smooth = lambda part, whole: (part + 1.0) / (whole + 2.0)
    for _ in range(ROUNDS):
        p = model.posterior({n: F.col(n) for n in LABELERS})
        weighed = patterns.withColumn("true", p * F.col("n")).withColumn("false", (1 - p) * F.col("n"))
        sums = weighed.agg(
            F.sum("true").alias("true"),
            F.sum("n").alias("n"),
            *[F.coalesce(F.sum(F.when(cond, F.col(side))), F.lit(0.0)).alias(f"{name}_{side}_{said}") for name in LABELERS for side in ("true", "false") for said, cond in (("one", F.col(name) == 1), ("any", F.col(name).isNotNull()))],
        ).first()
        if sums["n"] is None:
            break
        reliability = {}
        for name in LABELERS:
            true, false = (min(0.99, max(0.01, smooth(sums[f"{name}_{side}_one"], sums[f"{name}_{side}_any"]))) for side in ("true", "false"))
            reliability[name] = (true, false)
        model = Model(min(0.999, max(0.001, smooth(sums["true"], sums["n"]))), reliability, 0.0, {})
    p = model.posterior({n: F.col(n) for n in LABELERS})
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("value")) for n in features])
    table = counted.select((p * F.col("n")).alias("true"), ((1 - p) * F.col("n")).alias("false"), F.explode(each).alias("e")).groupBy("e.feature", "e.value").agg(F.sum("true").alias("true"), F.sum("false").alias("false")).collect()
    if not table:
        return Model(model.prior, model.reliability, -1.0, {})
    kinds = [r for r in table if r["feature"] == "kind"]
    true, false = sum(r["true"] for r in kinds), sum(r["false"] for r in kinds)
    odds = {(r["feature"], r["value"]): math.log((r["true"] + 0.5) / (true + 1)) - math.log((r["false"] + 0.5) / (false + 1)) for r in table}
    return Model(model.prior, model.reliability, math.log((true + 0.5) / (false + 0.5)), odds)


def spans(text: Column, model: Model, sure: tuple[str, ...] = BASE) -> Column:
    """The valid candidates of the sure kinds, and of the others those that the classifier accepts."""
    return F.filter(candidates(text), lambda x: x["valid"] & (x["kind"].isin(*sure) | (model.score(x) > ACCEPT)))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans of every row."""
    return docs.select("doc_id", spans(whole_text(F.col("text")), model).alias("spans"))


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with each span's text replaced by its kind in brackets; a span that overlaps an earlier one widens it."""

    def step(state: Column, x: Column) -> Column:
        gap = F.greatest(x["start"] - state["at"], F.lit(0))
        put = F.when(x["start"] >= state["at"], F.concat(F.substring(state["text"], state["at"] + 1, gap), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["out"], put).alias("out"), F.greatest(state["at"], x["end"]).alias("at"), state["text"].alias("text"))

    text = F.col("text").cast("string")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), text.alias("text"))
    found = spans(whole_text(text), model, SURE)
    masked = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.char_length(s["text"]))))
    return docs.withColumn("text", F.when(text.isNotNull(), masked))
