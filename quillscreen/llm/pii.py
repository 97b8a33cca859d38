"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base detectors find e-mail addresses, IP addresses, payment cards and international phone numbers. High-recall generators then
propose further, overlapping spans: written-out addresses, national phone and identity numbers. Boosted trees over format and
context features score every proposal, and those above the calibrated threshold are added, as kind ``mail`` or ``number``, unless they
lie inside a base span. Added spans may overlap base spans and each other; redaction takes their union, so no span is lost to another.
The trees are trained on the driver from ``TRAIN_ROWS`` synthetic candidates, half of them look-alikes such as dates, versions and prices,
and scored as CASE expressions.

Offsets are code points, end exclusive. Positions come from the lengths of the text between matches (``split``) and of the
matches (``regexp_extract_all``), added up in blocks of ``BLOCK`` matches, as an array that grows by one element at a time would be copied
each time. Repeated groups are possessive, so a match of any length runs in a loop rather than in recursion. A written-out address has
at most 64 characters before ``at``, 63 in its name and 24 in its ending, the limits of such addresses.

Defined cases: a null text is empty; every row of the input gives one row; an empty table gives no rows; extra columns stay out of the
result, whatever their names.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm import boosting
from quillscreen.llm.common import documents, text_of

#: A run may begin a match only at its first character or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:[\[({]\x20?at\x20?[\])}]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}\x20?(?:[\[({]\x20?dot\x20?[\])}]|\x20dot\x20)\x20?[A-Za-z]{2,24}"
NUMBER = r"(?<![A-Za-z0-9.+-])\(?[0-9]{2,5}\)?[\x20./-]\x20?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![A-Za-z0-9])"
BASE = ("email", "ip", "card", "phone")
TRAIN_ROWS = 4000
CONTEXT = 24
#: Matches whose positions are added up together, and characters of the pieces a text is cut from.
BLOCK, PIECE = 128, 4096
ITEM = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Words that announce a number of a person, and words that announce another number.
PERSONAL = r"(?i)(?:\b(?:tel|telephone|telefon|telefono|phone|mobile|cell|call|fax|ssn|social security|passport|id no)\b)[^A-Za-z]{0,4}$"
OTHER = r"(?i)(?:\b(?:version|v|isbn|issn|order|invoice|page|pages|section|ref|date|on|eur|usd|doi)\b|[$€£#])[^A-Za-z]{0,4}$"
FEATURES = ("digits", "groups", "length", "spaces", "dots", "slashes", "dashes", "parens", "first_group", "last_group", "distinct", "personal", "other", "written")


def _pairs(text: Column, pattern: str) -> Column:
    """Array of (gap, len, value): each match with the number of characters between it and the one before. ``text`` must be a stored column."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("len"), v.alias("value")))
    return F.filter(pairs, lambda p: p["len"].isNotNull())


def _blocks(items: Column) -> Column:
    """The array cut into arrays of BLOCK elements; one empty array for none."""
    count = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def _located(blocks: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) of the matches in a stored array of blocks, in order."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    size = lambda b: F.aggregate(b, F.lit(0), lambda acc, p: acc + p["gap"] + p["len"])
    begins = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["at"] + size(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + p["len"]).alias("end"), p["value"].alias("value"))
        return F.struct((start + p["len"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    begin = lambda s: F.struct(s.alias("at"), F.array().cast(ITEM).alias("out"))
    return F.flatten(F.zip_with(blocks, begins, lambda b, s: F.aggregate(b, begin(s), step, lambda acc: acc["out"])))


def _search(docs: DataFrame, text: str, wanted: dict[str, tuple[Column, str]], kinds: dict[str, str] | None = None) -> DataFrame:
    """Adds a column of spans for each name of ``wanted`` (a cheap test that spares most texts the search, and a pattern)."""
    t, none = F.col(text), F.array().cast("array<struct<gap:int,len:int,value:string>>")
    d = docs.withColumns({f"__{k}": F.when(test, _pairs(t, pattern)).otherwise(none) for k, (test, pattern) in wanted.items()})
    d = d.withColumns({f"__{k}": _blocks(F.col(f"__{k}")) for k in wanted})
    return d.withColumns({k: _located(F.col(f"__{k}"), (kinds or {}).get(k, k)) for k in wanted}).drop(*[f"__{k}" for k in wanted])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _byte_part(p: Column) -> Column:
    part = F.ltrim(p, F.lit("0"))
    return (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255"))


def _between(c: Column, low: int, high: int) -> Column:
    return (c >= low) & (c <= high)


def base_spans(docs: DataFrame, text: str = "t") -> DataFrame:
    """Adds ``email, ip, card, phone``: arrays of spans that pass the checks. A cheap test spares most texts the search."""
    t = F.col(text)
    d = _search(docs, text, {
        "email": (F.instr(t, "@") > 0, EMAIL), "ip": (t.rlike(r"[0-9]\.[0-9]"), IP), "card": (t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD), "phone": (F.instr(t, "+") > 0, PHONE),
    })
    ip_ok = lambda s: F.forall(F.split(s["value"], r"\.", -1), _byte_part)
    card_ok = lambda s: _between(F.length(_digits(s["value"])), 13, 19) & F.call_function("luhn_check", _digits(s["value"]))
    phone_ok = lambda s: _between(F.length(_digits(s["value"])), 9, 15)
    return d.withColumns({"ip": F.filter("ip", ip_ok), "card": F.filter("card", card_ok), "phone": F.filter("phone", phone_ok)})


def _features(value: Column, before: Column) -> dict[str, Column]:
    count = lambda p: F.length(value) - F.length(F.translate(value, p, ""))
    groups = F.filter(F.split(value, "[^0-9]+", -1), lambda g: g != "")
    return {
        "digits": count("0123456789"), "groups": F.size(groups), "length": F.length(value), "spaces": count(" "), "dots": count("."), "slashes": count("/"),
        "dashes": count("-"), "parens": count("()"), "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        "distinct": F.size(F.array_distinct(F.split(_digits(value), ""))), "personal": before.rlike(PERSONAL).cast("int"), "other": before.rlike(OTHER).cast("int"),
        "written": value.rlike("[A-Za-z]").cast("int"),
    }


def features_of(value: str, before: str) -> list[int]:
    """The same features of one training candidate."""
    groups, digits = re.findall("[0-9]+", value), re.sub("[^0-9]", "", value)
    count = lambda p: sum(c in p for c in value)
    return [
        len(digits), len(groups), len(value), count(" "), count("."), count("/"), count("-"), count("()"), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        len(set(digits)) or 1, int(bool(re.search(PERSONAL, before))), int(bool(re.search(OTHER, before))), int(bool(re.search("[A-Za-z]", value))),
    ]


def training_rows(n: int = TRAIN_ROWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``n`` synthetic candidates with their label, made from templates (d: digit, y: year part, w: word)."""
    rng = np.random.default_rng(seed)
    yes = ["(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "0d dd dd dd dd", "ddd-dd-dddd", "(0dd) dddd dddd", "0dddd ddd ddd", "www.ww [at] wwww [dot] com", "www (at) wwww (dot) org", "www at wwww dot com"]
    no = ["20dd-dd-dd", "dd/dd/20dd", "dd.dd.20dd", "dd.dd.dd", "ddd ddd ddd", "20dd/dd/dddd", "dd dd dd", "978-dd-ddddd-dd", "dd.ddd.ddd", "dddd-dddd-dddd", "dd-dd dd-dd", "ddddd-ddd-dd", "20dd 20dd 20dd", "dd/dd/dd", "dddd dddd dddd"]
    say_yes, say_no = ["phone: ", "Tel. ", "call ", "mobile ", "SSN "], ["version ", "ISBN ", "invoice ", "ref ", "on ", "$ "]
    plain = ["the ", "and of ", "words, ", ". "]
    rows, labels = [], []
    for i in range(n):
        good = i // 2 % 2 == 0
        pick = lambda xs: xs[rng.integers(len(xs))]
        # A bare template is a person's only with its own shape; a shape both kinds share is told by its context.
        value, told = pick(yes if good else no), rng.random() < 0.6
        fill = lambda c: str(rng.integers(10)) if c == "d" else pick(string.ascii_lowercase) if c == "w" else c
        rows.append(features_of("".join(map(fill, value)), (pick(say_yes) if good else pick(say_no)) if told else pick(plain)))
        labels.append(good)
    return np.array(rows, float), np.array(labels, float)


@functools.cache
def model(n: int = TRAIN_ROWS, seed: int = 5) -> boosting.Boosted:
    return boosting.fit(FEATURES, *training_rows(n, seed))


def _inside(span: Column, spans: str) -> Column:
    """Whether ``span`` lies inside one of a stored array of disjoint spans in order: the last one that starts no later decides, found by bisection."""
    halve = lambda acc, _: F.when(acc["low"] >= acc["high"], acc).otherwise(_halved(acc, span, spans))
    whole = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(31)), whole, halve, lambda acc: F.get(F.col(spans), acc["low"] - 1))
    return (F.size(spans) > 0) & F.coalesce(last["end"] >= span["end"], F.lit(False))


def _halved(acc: Column, span: Column, spans: str) -> Column:
    mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
    starts = F.get(F.col(spans), mid)["start"] <= span["start"]
    return F.struct(F.when(starts, mid + 1).otherwise(acc["low"]).alias("low"), F.when(starts, acc["high"]).otherwise(mid).alias("high"))


def added_spans(docs: DataFrame, text: str = "t") -> DataFrame:
    """Adds ``added``: proposals above the threshold that do not lie inside a base span, in order of their starts."""
    t, m = F.col(text), model()
    d = _search(docs, text, {
        "__mail": (t.rlike(r"(?:[\[({\x20]\x20?)at[\x20\])}]"), MAIL), "__number": (t.rlike(r"[0-9]{2,5}\)?[\x20./-]\x20?[0-9]{2,5}[\x20./-][0-9]{2}"), NUMBER),
    }, {"__mail": "mail", "__number": "number"})
    d = d.withColumn("proposed", F.concat("__mail", "__number")).drop("__mail", "__number")
    # The text in pieces, as the start of a substring is searched from the start of its string.
    d = d.withColumn("__pieces", F.when(F.size("proposed") > 0, _pieces(t)))
    before = lambda s: _cut(F.col("__pieces"), F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
    # Features first, as a struct: a tree names a feature many times, and each name would be its computation.
    told = F.transform("proposed", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.struct(*[v.alias(k) for k, v in _features(s["value"], before(s)).items()]).alias("x")))
    d = d.withColumn("told", F.when(F.size("proposed") > 0, told))
    rank = F.transform("told", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), m.column({k: s["x"][k] for k in FEATURES}).alias("score")))
    d = d.withColumn("scored", F.when(F.size("proposed") > 0, rank)).withColumn("base", F.concat(*BASE))
    covered = lambda s: functools.reduce(Column.__or__, [_inside(s, k) for k in BASE])
    good = F.filter("scored", lambda s: (s["score"] >= m.threshold) & ~covered(s))
    return d.withColumn("added", F.coalesce(F.sort_array(good), F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>"))).drop("__pieces")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a stored array of pieces; only the pieces they lie in are touched."""
    first = F.floor(start / PIECE).cast("int")
    many = F.floor(F.greatest(end - 1, start) / PIECE).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, many), ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t`` (the text), the four base arrays and ``added``."""
    return added_spans(base_spans(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))))


def redacted(found: DataFrame) -> DataFrame:
    """find_pii() with ``redacted``: the text with each run of overlapping spans replaced by ``[KIND]`` of its first span.

    A span begins a run if it starts at or after the end of all spans before it. The furthest ends so far are taken in blocks, as positions are.
    """
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    d = found.withColumn("__spans", F.sort_array(F.concat(*[bare(F.col(c)) for c in (*BASE, "added")]))).withColumn("__blocks", _blocks(F.col("__spans")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    furthest = lambda b: F.aggregate(b, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
    reach = F.aggregate("__blocks", zero, lambda acc, b: F.struct(F.greatest(acc["at"], furthest(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), acc["at"].alias("before"), (s["start"] >= acc["at"]).alias("first"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    begin = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<start:int,kind:string,before:int,first:boolean>>").alias("out"))
    told = F.flatten(F.zip_with("__blocks", reach, lambda b, at: F.aggregate(b, begin(at), step, lambda acc: acc["out"])))
    d = d.withColumns({"__runs": F.filter(told, lambda s: s["first"]), "__pieces": F.when(F.size("__spans") > 0, _pieces(F.col("t"))), "__end": furthest(F.col("__spans"))})
    parts = F.transform("__runs", lambda s: F.concat(_cut(F.col("__pieces"), s["before"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    done = F.concat(F.array_join(parts, ""), _cut(F.col("__pieces"), F.col("__end"), F.length("t")))
    return d.withColumn("redacted", F.when(F.size("__spans") > 0, done).otherwise(F.col("t"))).drop("__spans", "__blocks", "__runs", "__pieces", "__end")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; all other columns, and null texts, stay as they are."""
    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    found = redacted(find_pii(keep, "row", "text"))
    cols = [F.when(F.col(f"doc_id.`{c}`").isNotNull(), F.col("redacted")).alias(c) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns]
    return found.select(*cols)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of every document."""
    base, found = _joined(F.col("base")), find_pii(docs, id_col, text_col)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(_joined(F.col("added")), F.lit(""))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return pii_report(documents(spark, sf_dir))
