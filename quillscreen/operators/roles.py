"""Paper roles: multi-label text rules, a primary role, and the share of papers a role covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.store import exploded

#: Roles in order of precedence.
PRIORITY = (
    "theory_mechanism", "characterization_method", "in_situ_operando", "ex_situ_post_mortem", "application_performance", "failure_limitation", "controversy_debate",
    "peripheral_background", "out_of_scope", "theory_origin", "conceptual_framework", "nanoscale_readout", "experimental_proof", "direct_probe_method", "surface_probe_method",
    "interface_screening", "material_case", "device_application", "application_bridge", "frontier_extension", "limitation_or_challenge", "review_background",
)
#: Rules of (role, markers) that hold in every domain; domains pass further ones.
GENERIC_RULES = (
    ("review_background", ("review", "survey", "perspective", "overview", "roadmap")),
    ("theory_mechanism", ("theory", "mechanism", "model", "descriptor", "electronic structure", "orbital occupancy")),
    ("characterization_method", ("characterization", "spectroscopy", "microscopy", "measurement", "TEM", "STEM", "XPS", "XAS", "RIXS")),
    ("in_situ_operando", ("in situ", "operando", "real-time", "real time")),
    ("ex_situ_post_mortem", ("ex situ", "post mortem")),
    ("material_case", ("case study", "representative material", "catalyst", "oxide", "anode", "perovskite", "mof")),
    ("application_performance", ("application", "performance", "activity", "accuracy", "recall", "capacity", "efficiency")),
    ("failure_limitation", ("failure", "limitation", "degradation", "aging", "stability", "reconstruction")),
    ("controversy_debate", ("controversy", "debate", "competing mechanism", "open question")),
)
OVERBROAD_SHARE = 0.30


def classify(papers: DataFrame, rules=GENERIC_RULES, links: DataFrame | None = None, into: str | None = None) -> DataFrame:
    """``paper_id, title, roles, primary_role, confidence, reasons``; ``links`` adds ``linked_lenses`` and ``linked_query_families``.

    All rules are one projection; the links, if any, are one left join. With ``into`` the papers keep their own columns, and their roles,
    primary role and the rest become a struct of that name.
    """
    d = papers.withColumns({f"__own_{c}": F.col(c) for c in papers.columns}) if into else papers
    kept = [f"__own_{c}" for c in papers.columns] if into else []
    d = d.withColumn("__low", F.lower(F.concat_ws(" ", tx.text("title"), tx.text("abstract"))))
    hits = {}
    for i, (_, markers) in enumerate(rules):
        found = [F.when(tx.has_marker(F.col("__low"), m), F.lit(m)) for m in markers]
        hits[f"__m{i}"] = F.filter(F.array(*found), lambda v: v.isNotNull())
    d = d.withColumns(hits)
    order = sorted(range(len(rules)), key=lambda i: (PRIORITY.index(rules[i][0]) if rules[i][0] in PRIORITY else len(PRIORITY), i))
    roles = F.array_distinct(F.filter(F.array(*[F.when(F.size(f"__m{i}") > 0, F.lit(rules[i][0])) for i in order]), lambda v: v.isNotNull()))
    told = [F.when(F.size(f"__m{i}") > 0, F.concat(F.lit(f"{role}: matched "), F.array_join(F.slice(f"__m{i}", 1, 3), ", "))) for i, (role, _) in enumerate(rules)]
    reasons = F.array_distinct(F.filter(F.array(*told), lambda v: v.isNotNull()))
    none = F.array().cast("array<string>")
    if links is not None:
        d = d.join(links, "paper_id", "left").withColumns({c: F.coalesce(c, none) for c in ("linked_lenses", "linked_query_families")})
    else:
        d = d.withColumns({"linked_lenses": none, "linked_query_families": none})
    d = d.select(*kept, "paper_id", "title", roles.alias("roles"), reasons.alias("reasons"), "linked_lenses", "linked_query_families")
    linked = (F.size("linked_lenses") > 0) | (F.size("linked_query_families") > 0)
    d = d.withColumn("reasons", F.when(linked, F.concat("reasons", F.array(F.lit("retrieval_lane: linked query family/lens recorded as provenance only")))).otherwise(F.col("reasons")))
    score = 0.42 + 0.08 * F.least(F.size("roles"), F.lit(4)) + 0.04 * F.least(F.size("reasons"), F.lit(5))
    score = score + F.when(F.size("linked_lenses") > 0, 0.02).otherwise(0.0) + F.when(F.size("linked_query_families") > 0, 0.02).otherwise(0.0)
    d = d.select(
        *kept, "paper_id", "title", "roles", F.when(F.size("roles") > 0, F.get("roles", F.lit(0))).otherwise("unclassified").alias("primary_role"),
        F.when(F.size("roles") == 0, 0.1).otherwise(F.round(F.least(score, F.lit(0.95)), 3)).alias("confidence"), "reasons", "linked_lenses", "linked_query_families",
        F.array_distinct(F.concat("linked_query_families", "linked_lenses")).alias("retrieval_lanes"),
    )
    told = [c for c in d.columns if c not in ("paper_id", "title", *kept)]
    return d.select(*[F.col(f"__own_{c}").alias(c) for c in papers.columns], F.struct(*told).alias(into)) if into else d


def role_counts(roles: DataFrame) -> DataFrame:
    return exploded(roles, "roles", "role").groupBy("role").agg(F.count("*").alias("n_papers"))


def mark_overbroad(roles: DataFrame) -> DataFrame:
    """Adds ``overbroad_roles``: a paper's roles that more than 30 % of all papers have. The role table has a row per rule, so it is broadcast."""
    total = roles.agg(F.count("*").alias("total"))
    broad = role_counts(roles).join(F.broadcast(total)).filter((F.col("total") > 1) & (F.col("n_papers") / F.col("total") > OVERBROAD_SHARE))
    broad = broad.agg(F.collect_set("role").alias("broad"))
    d = roles.join(F.broadcast(broad)).withColumn("overbroad_roles", F.filter("roles", lambda r: F.array_contains("broad", r))).drop("broad")
    text = "Role appears on more than 30% of papers; treat as broad context, not a decisive role: "
    return d.withColumn("overbroad_role_warning", F.when(F.size("overbroad_roles") > 0, F.concat(F.lit(text), F.array_join("overbroad_roles", ", "))).otherwise(""))
