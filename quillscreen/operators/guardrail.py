"""Domain guardrail: whether a paper is in scope of a contract, with the reasons, as one projection over the papers.

The concepts that a text holds are found in batches of texts (``functions.matcher``), and negation is looked for around the hits
only; the conditions then test small arrays of numbers. The projection is narrow: it never shuffles, whatever the number of papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import text as tx
from quillscreen.plans import contract as ct
from quillscreen.plans.contract import Contract

CENTRALITY = {"groups": 0.45, "focus": 0.30, "aspects": 0.15, "context": 0.10}
TEXT_FIELDS = ("title", "abstract", "venue", "fields_of_study", "publication_types", "tldr", "source_provider")


def is_user_seed(d: DataFrame) -> Column:
    """Exact or manual seeds of the user; tables without stages have none."""
    out = F.lit(False)
    if "source_stage" in d.columns:
        stages = F.transform(F.split(tx.text("source_stage"), ";"), F.trim)
        out = F.arrays_overlap(stages, F.array(F.lit("seed_exact"), F.lit("manual_seed")))
    if "seed_relation" in d.columns:
        out = out | (tx.text("seed_relation") == "self")
    return out


def joined_text(d: DataFrame, fields: tuple[str, ...]) -> Column:
    """The fields that exist, arrays joined by spaces, absent ones empty."""
    kinds = dict(d.dtypes)
    part = lambda c: F.lit("") if c not in kinds else F.coalesce(F.array_join(c, " "), F.lit("")) if kinds[c].startswith("array") else tx.text(c)
    return F.concat_ws(" ", *[part(c) for c in fields])


def _any(terms: tuple[str, ...] | list[str], test) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | test(t)
    return out


def _found(terms: list[str], test) -> Column:
    """The terms that pass, in order."""
    hits = [F.when(test(t), F.lit(t)) for t in terms]
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")


def _share(flags: list[Column], empty: Column | float) -> Column:
    return sum((f.cast("int") for f in flags), F.lit(0)) / F.lit(float(len(flags))) if flags else (F.lit(empty) if isinstance(empty, float) else empty)


class Spellings:
    """The concepts that the guardrail looks for in one text column: every one gets a number, and one function finds those that a text holds."""

    def __init__(self, where: str) -> None:
        self.where, self.numbers = where, {}

    def _held(self, spelled: list[str], loose: tuple = ()) -> Column:
        needles = tuple(n for n in spelled if n.strip())
        if not needles:
            return F.lit(False)
        return F.array_contains(F.col(f"{self.where}_s"), self.numbers.setdefault((needles, loose), len(self.numbers)))

    def concept(self, term: str) -> Column:
        """tx.has_concept() of the column."""
        cleaned = " ".join(term.lower().split())
        words = sorted(set(tx.py_tokens(cleaned)))
        need = words if len(words) < 2 else tx.py_folded(cleaned)
        return self._held(tx.variants(cleaned), tuple((w, tuple(tx.forms(w))) for w in need))

    def strict(self, marker: str) -> Column:
        """A spelling of four characters or more stands somewhere without a negation around it."""
        return self._held([v for v in tx.variants(tx.py_domain_text(marker)) if len(v) >= 4])

    def chemistry(self, marker: str) -> Column:
        """Element symbols need boundaries, element names are concepts, other markers need one of their spellings."""
        cleaned = tx.py_domain_text(marker)
        if cleaned in ct.SYMBOLS:
            return F.col(self.where).rlike(f"(?<![a-z0-9]){cleaned}(?![a-z0-9])")
        return self.concept(cleaned) if cleaned in ct.ELEMENTS else self.strict(cleaned)

    def column(self) -> Column:
        """The concepts held, once all are known; the text is made comparable where it is searched."""
        return matcher.held(F.col(f"{self.where}_raw"), list(self.numbers))


def _broad_overview(title: Column) -> Column:
    compact = F.trim(F.regexp_replace(title, r"^[ .:\-]+|[ .:\-]+$", ""))
    names = compact.contains("lithium-ion batteries") | compact.contains("lithium ion batteries")
    own = _any(["sei", "solid electrolyte", "interphase", "interface"], compact.contains)
    return compact.isin("lithium-ion batteries", "lithium ion batteries", "lithium batteries") | compact.startswith("beyond lithium-ion") | compact.startswith("beyond lithium ion") | (names & ~own & (F.size(tx.tokens(compact)) <= 6))


def assess(papers: DataFrame, contract: Contract, keep: bool = False) -> DataFrame:
    """The assessment of every paper, with all scores at four decimals; ``keep`` adds it to the paper's own columns."""
    # Fields that do not exist would only add white space, which a comparable text has evened out.
    raw = {c: F.make_valid_utf8(joined_text(papers, tuple(f for f in fields if f in papers.columns))) for c, fields in (("x", TEXT_FIELDS), ("xt", ("title",)), ("xa", ("abstract", "tldr")))}
    base = papers.select(
        *([F.col(c).alias(f"__own_{c}") for c in papers.columns] if keep else []),
        "paper_id", is_user_seed(papers).alias("is_seed"), *[v.alias(f"{c}_raw") for c, v in raw.items()], *[tx.domain_text(raw[c]).alias(c) for c in ("x", "xt")],
    )
    asked: dict[tuple[str, str], str] = {}
    spelled = {c: Spellings(c) for c in ("x", "xt", "xa")}

    def has(term: str, c: str = "x") -> Column:
        """A concept that several lists name is searched once, as a column."""
        return F.col(asked.setdefault((c, " ".join(term.lower().split())), f"__has{len(asked)}"))

    must, optional = contract.required_groups(), contract.optional_groups()
    flags = {f"req_{i}": _any(terms, has) for i, (_, terms) in enumerate(must)} | {f"opt_{i}": _any(terms, has) for i, (_, terms) in enumerate(optional)}
    flags |= {f"reqt_{i}": _any(terms, lambda t: has(t, "xt")) for i, (_, terms) in enumerate(must)} | {f"reqa_{i}": _any(terms, lambda t: has(t, "xa")) for i, (_, terms) in enumerate(must)}
    required = [f"{name}: " + " OR ".join(terms) for name, terms in must] or tx.unique([*contract.must_include, *contract.required_concepts, *contract.must_terms], 14)
    lithium = contract.wants_lithium()
    chem = spelled["x"].chemistry
    nothing = F.array().cast("array<string>")
    target = tx.unique([*contract.terms_of("target_chemistry_group"), *ct.TARGET_CONTEXT])
    beside = tx.unique([*contract.terms_of("negative_context_group"), *ct.BESIDE_CONTEXT])
    lists = {
        "missing": F.filter(F.array(*[F.when(~F.col(f"req_{i}"), F.lit(required[i])) for i in range(len(must))]), lambda v: v.isNotNull()) if must else _found(required, lambda t: ~has(t)),
        "target": _found(target, has) if lithium else nothing,
        "beside": F.array_distinct(F.concat(_found(beside, chem), F.when(F.col("x").rlike(r"\bbeyond\s+li\s*-?\s*ion\b"), F.array(F.lit("beyond li-ion"))).otherwise(nothing))) if lithium else nothing,
        "negative": _found(tx.unique(list(contract.negative), 20), has), "forbidden": _found(tx.unique([*contract.must_exclude, *contract.forbidden], 20), has),
        "positive": _found(tx.unique([*contract.positive, *required, *(t for _, terms in must for t in terms), *contract.synonyms], 40), has),
        "markers": _found(list(ct.DRIFT), chem) if lithium else nothing,
    }
    found = {name: spelled[c].concept(term) for (c, term), name in asked.items()}
    base = base.withColumns({f"{c}_s": s.column() for c, s in spelled.items() if s.numbers})
    d = base.withColumns(found).withColumns(flags).withColumns(lists) if found else base.withColumns(flags | lists)
    reqs, opts = [F.col(f"req_{i}") for i in range(len(must))], [F.col(f"opt_{i}") for i in range(len(optional))]
    drift = F.array_distinct(F.concat("markers", "beside"))
    coverage = (len(required) - F.size("missing")) / F.lit(float(len(required))) if required else F.lit(0.5)
    core = [i for i, (n, terms) in enumerate(must) if "core" in n.lower() or any(tx.py_domain_text(t) in ("sei", "solid electrolyte interphase") for t in terms)]
    in_title, in_full = _any([str(i) for i in core], lambda i: F.col(f"reqt_{i}")), _any([str(i) for i in core], lambda i: F.col(f"req_{i}"))
    focus = tx.clamp(
        0.45 * _share([F.col(f"reqt_{i}") for i in range(len(must))], 0.0) + 0.25 * _share([F.col(f"reqa_{i}") for i in range(len(must))], 0.0) + 0.20 * _share(reqs, 0.0)
        + 0.10 * F.when(in_title, 1.0).when(in_full, 0.35).otherwise(0.0)
    )
    off_target = F.size("beside") > 0
    focus = F.when(_broad_overview(F.col("xt")), F.least(focus, F.lit(0.38))).otherwise(focus)
    focus = F.when(off_target, F.least(focus, F.lit(0.55))).otherwise(focus) if must else F.lit(0.55)
    target_score = F.when(off_target, F.when(F.size("target") > 0, 0.2).otherwise(0.0)).when(F.size("target") > 0, 1.0).otherwise(0.35) if lithium else F.lit(1.0)
    d = d.withColumns({"coverage": coverage, "drift": drift, "focus": focus, "context": target_score})
    d = d.withColumns({"groups": _share(reqs, F.col("coverage")), "n_missing_groups": sum(((~f).cast("int") for f in reqs), F.lit(0)), "penalty": F.least(F.lit(0.55), F.size("beside") * 0.22)})
    d = d.withColumn("aspects", _share(opts, 0.0) if optional else F.col("groups"))
    lacking = (F.size("target") == 0) if lithium else F.lit(False)
    d = d.withColumn("peripheral", F.when(off_target, "negative_or_beyond_target_chemistry_context").when(lacking, "missing_target_lithium_context").when(F.col("focus") < 0.45, "low_topic_focus").otherwise(""))
    central = tx.clamp(sum((w * F.col(k) for k, w in CENTRALITY.items()), F.lit(0.0)) - F.col("penalty"))
    drifted = (F.size("drift") > 0) | off_target
    central = F.when(drifted, F.least(central, F.lit(0.45))).otherwise(central)
    central = F.when(F.col("peripheral") != "", F.least(central, F.lit(0.62))).otherwise(central)
    signal = F.least(F.lit(1.0), F.size("positive") / F.lit(float(max(3, len(required) or 3))))
    strong = (F.size("positive") > 0) & ((F.col("coverage") >= 0.5) | (F.size("positive") >= 2))
    punish = F.when(strong, 0.0).otherwise(F.least(F.lit(0.35), F.size("negative") * 0.12)) + F.least(F.lit(0.75), F.size("forbidden") * 0.35)
    d = d.withColumns({"central": central, "strong": strong, "drifted": drifted}).withColumn("raw", tx.clamp(0.70 * F.col("central") + 0.20 * signal - 0.55 * punish))
    some = F.size("positive") > 0
    cases = [
        (F.size("forbidden") > 0, 0.29, F.lit("out_of_scope")),
        (F.lit(bool(must)) & (F.size("missing") > 0), 0.58, F.when(some & (F.col("groups") >= 0.5), "borderline").otherwise("out_of_scope")),
        (F.col("drifted"), 0.42, F.lit("borderline")),
        ((F.col("peripheral") != "") & (F.col("focus") < 0.5), 0.56, F.lit("borderline")),
        ((F.size("negative") > 0) & ~F.col("strong") & (F.col("raw") < 0.40), 0.44, F.when(some, "borderline").otherwise("out_of_scope")),
    ]
    r, decided, capped = F.col("raw"), None, None
    for when, cap, told in cases:
        decided = F.when(when, told) if decided is None else decided.when(when, told)
        capped = F.when(when, F.least(r, F.lit(cap))) if capped is None else capped.when(when, F.least(r, F.lit(cap)))
    decided = decided.when(r >= 0.75, "in_scope").when((r >= 0.65) & (F.size("missing") == 0), "in_scope").when((r >= 0.45) & some, "borderline").when(r >= 0.55, "borderline").otherwise("out_of_scope")
    d = d.withColumns({"score": capped.otherwise(r), "decision": decided})
    listed = lambda c: F.array_join(F.slice(c, 1, 5), ", ")
    lead = lambda s: F.lit(s)
    reason = (
        F.when(F.size("forbidden") > 0, F.concat(lead(f"Forbidden concept(s) found for {contract.domain}: "), listed("forbidden"), lead(".")))
        .when(F.size("negative") > 0, F.concat(lead(f"Negative domain signal(s) found for {contract.domain}: "), listed("negative"), lead(".")))
        .when((F.col("decision") == "borderline") & (F.size("missing") > 0), F.concat(lead("Missing some required concept(s): "), listed("missing"), lead(".")))
        .when((F.col("decision") == "out_of_scope") & (F.size("missing") > 0), F.concat(lead("Insufficient domain evidence; missing required concept(s): "), listed("missing"), lead(".")))
        .when(F.col("decision") == "in_scope", "Paper matches the search contract domain.").otherwise("Weak domain match.")
    )
    pairs = lambda prefix, groups: F.map_from_arrays(F.array(*[F.lit(n) for n, _ in groups]), F.array(*[F.col(f"{prefix}_{i}") for i in range(len(groups))])) if groups else F.create_map().cast("map<string,boolean>")
    told = [F.concat(F.lit(f"{kind}:{n}:"), F.when(F.col(f"{p}_{i}"), "matched").otherwise("missing")) for kind, p, gs in (("required", "req", must), ("optional", "opt", optional)) for i, (n, _) in enumerate(gs)]
    tagged = lambda c, s: F.transform(c, lambda v: F.concat(F.lit(s), v))
    explain = F.concat(
        F.array(*told) if told else nothing, F.when(F.col("drifted"), tagged("drift", "downrank:non_target_battery_context:")).otherwise(nothing), tagged("target", "target_context:"), tagged("beside", "negative_context:"),
        F.array(F.concat(F.lit("topic_focus_score:"), F.format_string("%.4f", "focus"))), F.when(F.col("peripheral") != "", F.array(F.concat(F.lit("peripheral_context_reason:"), "peripheral"))).otherwise(nothing),
    )
    names = lambda want: F.filter(F.array(*[F.when(F.col(f"req_{i}") == want, F.lit(n)) for i, (n, _) in enumerate(must)]), lambda v: v.isNotNull()) if must else nothing
    four = lambda c: F.round(c, 4)
    seed = F.array(F.lit("user_seed"))
    own = {
        "domain_match_score": (four("score"), F.lit(1.0)), "domain_decision": (F.col("decision"), F.lit("in_scope")), "off_topic_reason": (reason, F.lit("User-provided seed paper retained as an in-scope anchor.")),
        "positive_domain_matches": (F.col("positive"), seed), "negative_domain_matches": (F.col("negative"), nothing), "missing_required_concepts": (F.col("missing"), nothing), "forbidden_concepts_found": (F.col("forbidden"), nothing),
        "required_group_matches": (pairs("req", must), F.create_map(F.lit("user_seed"), F.lit(True))), "optional_group_matches": (pairs("opt", optional), F.create_map().cast("map<string,boolean>")),
        "intent_centrality_score": (four("central"), F.lit(1.0)), "required_group_coverage_score": (four("groups"), F.lit(1.0)), "missing_required_group_count": (F.col("n_missing_groups"), F.lit(0)),
        "group_coverage_explanation": (explain, F.array(F.lit("user_seed: matched"))), "matched_groups": (names(True), seed), "missing_groups": (names(False), nothing), "target_context_match": (F.col("target"), seed),
        "negative_context_match": (F.col("beside"), nothing), "topic_focus_score": (four("focus"), F.lit(1.0)), "aspect_match_score": (four("aspects"), F.lit(1.0)), "target_context_score": (four("context"), F.lit(1.0)),
        "negative_context_penalty": (four("penalty"), F.lit(0.0)), "peripheral_context_reason": (F.col("peripheral"), F.lit("")),
    }
    return d.select(*([F.col(f"__own_{c}").alias(c) for c in papers.columns] if keep else ["paper_id"]), *[F.when(F.col("is_seed"), s).otherwise(v).alias(k) for k, (v, s) in own.items()])


def neutral(papers: DataFrame) -> DataFrame:
    """The assessment of a run with the guardrail switched off: everything is in scope and complete."""
    return papers.select("paper_id", F.lit(1.0).alias("domain_match_score"), F.lit("in_scope").alias("domain_decision"), F.lit(1.0).alias("intent_centrality_score"), F.lit(1.0).alias("required_group_coverage_score"), F.lit(0).alias("missing_required_group_count"), F.lit(1.0).alias("topic_focus_score"))


def priority_limited(d: DataFrame) -> Column:
    """Context or group coverage that keeps a paper from include and must_read."""
    context_missing = F.exists(F.map_entries("required_group_matches"), lambda e: ~e["value"] & F.lower(e["key"]).rlike("context|spin|oer"))
    drift = F.exists("group_coverage_explanation", lambda s: F.lower(s).contains("non_target_battery_context"))
    return F.coalesce(drift | (F.size("negative_context_match") > 0) | (F.col("peripheral_context_reason") != "") | context_missing, F.lit(False))
