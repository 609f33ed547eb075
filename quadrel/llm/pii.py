"""Operator 9, PII: candidate spans judged by boosted trees. DataFrame functions only.

Generators propose candidates of several kinds, overlaps included. Four base kinds have rules that decide
alone for what they accept. Cards and phones that the rules turn down, and what the other generators propose,
go to boosted trees on format and context. The trees are fitted on spans of made texts; the threshold of each
kind is set on spans of texts from another grammar, which the trees have not seen. (Rules accept every email
candidate, and an address with a part over 255 is none, so the trees have nothing to add to those kinds.)
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrel.llm.base import whole_text
from quadrel.llm.boost import Boosted, precise_threshold
from quadrel.llm.pii_rows import fit_rows, held_rows

# The base patterns, by kind in the order of the output. Look-behinds (with \G, the end of
# the last match) only keep the search from trying again inside a run, and possessive repeats keep Java from
# recursing once for each round of a group; neither changes a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands before an assigned value, to be cut off its candidate.
_CUE = r"(?:password|passwd|passphrase|pass|pwd|secret|token|(?:api|access)[_-]?key)[\"']?\s*+[=:]\s*+[\"']?"
GENERATED = {
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",  # as long as IBANs get
    "ip6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):){2,7}(?:[0-9A-Fa-f]{1,4}|(?<=::))(?![0-9A-Za-z:])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+",
    "password": r"(?i)" + _CUE.removesuffix(r"[\"']?") + r"(?:\"[^\"\n]{6,}+(?=\")|'[^'\n]{6,}+(?=')|[^\s\"']{6,}+)",
}
PATTERNS = BASE | GENERATED
KINDS = list(PATTERNS)
#: Kinds that the trees judge.
LEARNED = ["card", "phone", *GENERATED]
#: A cheap sign without which a text holds no candidate of the kind.
SIGNS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "contact": lambda t: t.rlike(r"[\[(] ?(?:at|AT)"),
    "number": lambda t: t.rlike(r"[0-9]{3}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ip6": lambda t: t.rlike(r"[0-9A-Fa-f:]:[0-9A-Fa-f:]"),
    "secret": lambda t: t.rlike(r"[0-9]"),
    "password": lambda t: t.rlike(r"(?i)(?:pass|pwd|secret|token|key)[a-z]{0,6}[\"']?\s*+[=:]"),
}
#: Characters around a candidate that its features look at.
BEFORE, AFTER = 24, 8
CUES = {
    "phone_cue": r"(?i)(?:phone|tel|call|mobile|cell|fax|ring)", "card_cue": r"(?i)(?:card|visa|amex|mastercard|credit)", "id_cue": r"(?i)(?:ssn|social|iban|account|bank)",
    "key_cue": r"(?i)(?:password|passwd|pwd|passphrase|token|secret|api|key|auth)", "other_cue": r"(?i)(?:commit|sha|order|part|isbn|invoice|version|page|ticket|build|release|serial|uuid)",
}
SHAPE = ["size", "digits", "upper", "lower", "marks", "colons", "run", "hex", "luhn", "before_kind", "after_kind", "equals", "variety"]
FEATURES = [f"is_{k}" for k in LEARNED] + SHAPE + list(CUES)
#: Held-out precision that a kind's threshold must reach, and how many labelled texts are made for the trees and for the thresholds.
PRECISION, MADE, HELD, SEED = 0.99, 3000, 2400, 9


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each candidate: kind (index in KINDS), start, end, hit, before, after; row, the number of the
    row of docs, and rest, a struct of docs' other columns.

    Offsets are code points, end exclusive. Rows without candidates appear once, with kind null.
    """
    text = F.col("text")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others, *([] if others else [F.lit(0).alias("_")])).alias("rest"), whole_text(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))

    def found(kind: str) -> Column:
        pattern = PATTERNS[kind]
        gap = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.char_length(p).alias("n"), F.right(p, F.lit(BEFORE)).alias("tail"), F.left(p, F.lit(AFTER)).alias("head")))
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(hits.alias("hit"), gap.alias("gap"), F.slice(gap, 2, 1 << 30).alias("next"))

        def one(z: Column) -> Column:
            hit, tail = z["hit"], z["gap"]["tail"]
            if kind == "password":  # the cue goes to what stands before
                cue = F.regexp_extract(hit, "(?i)^" + _CUE, 0)
                hit, tail = F.substring(hit, F.char_length(cue) + 1, F.char_length(hit)), F.right(F.concat(tail, cue), F.lit(BEFORE))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (z["gap"]["n"] + F.char_length(z["hit"])).alias("step"), hit.alias("hit"), tail.alias("before"), z["next"]["head"].alias("after"))

        made = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), one)
        return F.when(SIGNS[kind](text), made).otherwise(F.array().cast("array<struct<kind:int,step:int,hit:string,before:string,after:string>>"))

    out = rows.select("rest", "row", F.posexplode_outer(F.concat(*map(found, KINDS))).alias("pos", "c")).select("rest", "row", "pos", "c.*")
    so_far = Window.partitionBy("row", "kind").orderBy("pos")
    out = out.repartition("row").withColumn("end", F.sum("step").over(so_far))  # one exchange for all that follows
    return out.withColumn("start", F.col("end") - F.char_length("hit")).drop("step", "pos")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_valid() -> Column:
    """Whether the rules of the candidate's base kind accept it."""
    hit, digits = F.col("hit"), F.regexp_replace("hit", "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    n = F.char_length(digits)
    return (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, hit.rlike(rf"^{part}(?:\.{part}){{3}}\z"))
        .when(F.col("kind") == 2, n.between(16, 19) & F.when(n.between(16, 19), luhn(digits)))
        .when(F.col("kind") == 3, n.between(8, 15))
        .otherwise(False)
    )


def with_features(rows: DataFrame) -> DataFrame:
    hit, digits = F.col("hit"), F.regexp_replace("hit", "[^0-9]", "")
    size = F.char_length(hit)
    count = lambda other: size - F.char_length(F.regexp_replace("hit", other, ""))
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)
    long_enough = F.char_length(digits).between(12, 19)
    made = {
        **{f"is_{k}": (F.col("kind") == KINDS.index(k)).cast("int") for k in LEARNED},
        "size": size, "digits": F.char_length(digits), "upper": count("[A-Z]"), "lower": count("[a-z]"), "marks": count("[^A-Za-z0-9]"), "colons": count(":"),
        "run": F.array_max(F.transform(F.split("hit", "[^0-9]"), lambda p: F.char_length(p))),
        "hex": hit.rlike(r"^[0-9a-f]+\z").cast("int"), "luhn": F.when(long_enough, luhn(digits).cast("int")).otherwise(0),
        "before_kind": side(F.right("before", F.lit(1))), "after_kind": side(F.left("after", F.lit(1))),
        "equals": F.when(F.col("before").rlike(r"=\s*[\"']?\z"), 2).when(F.col("before").rlike(r":\s*[\"']?\z"), 1).otherwise(0),
        "variety": F.size(F.array_distinct(F.split("hit", ""))),
        **{name: F.col("before").rlike(pattern).cast("int") for name, pattern in CUES.items()},
    }
    return rows.withColumns({k: v.cast("double") for k, v in made.items()})


def judged(rows: list[tuple[int, str, list[tuple[str, int, int]]]], spark: SparkSession) -> np.ndarray:
    """For each candidate of labelled texts that the trees may judge: text, kind, whether it is one of the text's spans, FEATURES.

    What is assigned to a cue may be a secret as well as a password: one word for it is as good as the other.
    """
    kind = "array<struct<name:string,start:int,end:int>>"
    made = spark.createDataFrame(rows, f"id long, text string, spans {kind}")
    names = F.array(*map(F.lit, KINDS))
    alike = lambda name: F.when(name == "password", "secret").otherwise(name)
    true = F.exists("rest.spans", lambda s: (alike(s["name"]) == alike(F.element_at(names, F.col("kind") + 1))) & (s["start"] == F.col("start")) & (s["end"] == F.col("end")))
    found = with_features(candidates(made).filter(F.col("kind").isin([KINDS.index(k) for k in LEARNED]))).filter(~base_valid())
    found = found.select(F.col("rest.id").alias("id"), "kind", true.cast("int").alias("true"), *FEATURES).orderBy("id", "kind", *FEATURES)
    return np.array(found.collect(), float).reshape(-1, 3 + len(FEATURES))  # a few rows for each made text


@cache
def _fitted(session: str) -> tuple[Boosted, dict[int, float]]:
    spark = SparkSession.getActiveSession()
    fit, held = judged(fit_rows(MADE, SEED), spark), judged(held_rows(HELD, SEED + 1), spark)
    trees = Boosted(fit[:, 3:], fit[:, 2], trees=24, depth=4)
    raw = trees.raw(held[:, 3:])
    return trees, {KINDS.index(k): precise_threshold(raw[own := held[:, 1] == KINDS.index(k)], held[own, 2], PRECISION) for k in LEARNED}


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """candidates() with base, added and name: base spans, and those that the trees add.

    An added span lies inside no base span and no other added one (of equal ones the first kind of KINDS stays). It may
    hold base spans or overlap others in part: both are listed, so nothing that the trees find is left out.
    """
    trees, limits = _fitted(docs.sparkSession.sparkContext.applicationId)
    rows = with_features(candidates(docs, text_col)).withColumn("base", F.col("kind").isNotNull() & base_valid())
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("kind"))
    rows = rows.withColumn("proposed", F.coalesce(F.col("kind").isNotNull() & ~F.col("base") & (trees.column(FEATURES) >= limit), F.lit(False)))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("base"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("base") | F.col("proposed"), F.col("end"))).over(before), F.lit(0))
    rows = rows.withColumn("added", F.col("proposed") & (reach < F.col("end")))
    return rows.withColumn("name", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)).drop(*FEATURES, "proposed")


def digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its other columns, n_email, n_ip, n_card, n_phone (base), base_list and span_list.

    The lists hold structs kind, start, end, name in the order of KINDS, then start. Null and empty texts
    have no spans. Texts are searched whole, however long. Repeated rows are searched each on its own; an empty
    table gives no rows. Other columns may have any names but those of the results, which take their place.
    """
    made = [*(f"n_{k}" for k in BASE), "base_list", "span_list"]
    others = [c for c in docs.columns if c != text_col and c not in made]
    item = F.struct("kind", "start", "end", "name")
    count = lambda k: F.count(F.when(F.col("base") & (F.col("kind") == k), 1))
    found = spans(docs, text_col).groupBy("row").agg(
        F.first("rest").alias("rest"), *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("base_list"),
        F.array_sort(F.collect_list(F.when(F.col("base") | F.col("added"), item))).alias("span_list"),
    )
    return found.select(*(F.col(f"rest.`{c}`") for c in others), *made)


def listed(column: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with every span of the text replaced by its kind in brackets.

    Spans that overlap go as one, named after the longest of them (of equal ones the first kind). Null text stays null, empty and
    clean texts stay as they are; repeated rows stay and are treated alike; a null id is an id like others;
    an empty table gives no rows. Other columns, whatever their names, are passed on.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    found = spans(rows.select("id", "mark", "text")).filter("base or added").withColumn("size", F.col("end") - F.col("start"))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    apart = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    found = found.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = found.groupBy("row", "island").agg(F.first("rest").alias("rest"), F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("name", F.struct("size", -F.col("kind"))).alias("name"))
    cuts = whole.groupBy("row").agg(F.first("rest").alias("found"), F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("cuts"))
    cuts = cuts.select(F.col("found.id").alias("own"), F.col("found.mark").alias("own_mark"), "cuts").dropDuplicates(["own", "own_mark"])
    joined = rows.join(cuts, F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")), "left")
    text, last = F.col("text"), F.element_at("cuts", -1)["end"]
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda s: s["end"]))
    zipped = F.filter(F.arrays_zip(F.col("cuts").alias("s"), ends.alias("from")), lambda z: z["s"].isNotNull())
    head = F.transform(zipped, lambda z: F.concat(F.substring(text, (z["from"] + 1).cast("int"), (z["s"]["start"] - z["from"]).cast("int")), F.lit("["), F.upper(z["s"]["name"]), F.lit("]")))
    clean = F.concat(F.array_join(head, ""), F.substring(text, (last + 1).cast("int"), F.lit(1 << 30)))
    clean = F.when(F.col("cuts").isNull(), text).otherwise(clean)
    return joined.select(*(clean.alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))
