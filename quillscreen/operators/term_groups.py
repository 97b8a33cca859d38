"""Groups of terms that name one thing: aliases by containment or initialism, and the required and optional groups of a contract.

Two terms are aliases if one holds the other or is the other's initials. Over a table of terms neither is looked for in all pairs: a term
meets its parts by an equality join of its substrings, of the lengths that terms have, with the terms, and its initials by one of its own; so only true links are made.
The groups are the components of these links; a group is required if one of its terms is.

Defined cases: terms are compared in lower case with single spaces; blank and null terms are left out; repeated terms are one; a term without an alias is
a group of its own; an empty table gives no groups; a term that many others hold makes them one group. Substrings grow with the square of a term's
length, so terms of over LONGEST characters are only linked by equality of their whole and their initials, and as holders of nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.anchors import Frame
from quillscreen.operators.store import checkpointed, exploded, join_aggregate
from quillscreen.plans.contract import BESIDE_CONTEXT, TARGET_CONTEXT, Group

#: Terms are phrases of a few words; longer texts are no terms.
LONGEST = 120
#: Context words that do not count beside stronger ones, and marks of a property that is no object.
WEAK_CONTEXT = ("interface", "surface", "system", "material")
PROPERTY_MARKS = ("activity", "accuracy", "recall", "performance", "composition", "structure", "evolution", "pore size", "functional group", "water stability", "stability")
LITHIUM_MARKS = ("lithium", "li-ion", "锂")


# ---- one contract, on the driver -------------------------------------------------------------------------------------


def cleaned(term: str) -> str:
    return " ".join(term.lower().split())


def initials(term: str) -> str:
    """First letters of a term of several words, hyphens between them included."""
    words = term.replace("-", " ").split()
    return "".join(w[0] for w in words).lower() if len(words) > 1 else ""


def aliases(left: str, right: str) -> bool:
    a, b = cleaned(left), cleaned(right)
    return bool(a and b) and (a in b or b in a or a == initials(b) or b == initials(a))


def core_groups(frame: Frame) -> list[list[str]]:
    """The research objects in groups of aliases, each object with the first group whose first term it is an alias of; properties join, but found no group."""
    found: list[list[str]] = []
    for term in tx.unique(list(frame.research_object or frame.core_terms), 8):
        home = next((g for g in found if aliases(term, g[0])), None)
        if home is None:
            found.append([term])
        else:
            home.append(term)
    for term in tx.unique(list(frame.target_process_or_property), 8):
        home = next((g for g in found if any(aliases(term, t) for t in g)), None)
        if home is not None and not any(m in cleaned(term) for m in PROPERTY_MARKS):
            home.append(term)
    return [tx.unique(g, 8) for g in found]


def context_terms(terms: Sequence[str]) -> list[str]:
    """Context without its weak words, unless there are no others."""
    every = tx.unique(list(terms), 12)
    strong = [t for t in every if cleaned(t) not in WEAK_CONTEXT]
    return strong if len(every) > 1 and strong else every


def groups_of(frame: Frame, question: str = "") -> list[Group]:
    """Constraint groups of a frame: objects and context are required, the other parts optional; a lithium question on an interphase gets its chemistry."""
    cores = core_groups(frame)
    out = [Group("core_object_group" if len(cores) == 1 else f"core_object_group_{i}", tuple(terms)) for i, terms in enumerate(cores, 1)]
    dropped = {cleaned(t) for t in frame.downweighted_terms}
    parts = {
        "domain_context_group": context_terms(frame.domain_context), "process_or_property_group": frame.target_process_or_property, "method_group": frame.method_terms, "mechanism_group": frame.mechanism_terms,
        "material_or_case_group": frame.material_or_case_terms, "application_or_metric_group": frame.application_or_metric_terms, "failure_or_limitation_group": frame.failure_or_limitation_terms, "controversy_group": frame.controversy_terms,
    }
    for name, terms in parts.items():
        kept = tx.unique([t for t in terms if cleaned(t) not in dropped], 24)
        if kept:
            out.append(Group(name, tuple(kept), required=name == "domain_context_group"))
    asked = f" {question.lower()}"
    if any(m in asked for m in LITHIUM_MARKS) and any(m in asked for m in (" sei", "solid electrolyte interphase", "solid-electrolyte interphase", "界面")):
        out += [Group("target_chemistry_group", TARGET_CONTEXT), Group("negative_context_group", BESIDE_CONTEXT, required=False)]
    return out


# ---- tables of terms --------------------------------------------------------------------------------------------------


def distinct_terms(terms: DataFrame, term_col: str = "term", required_col: str | None = None) -> DataFrame:
    """``term, required`` of the cleaned terms."""
    need = F.coalesce(F.col(required_col).cast("boolean"), F.lit(False)) if required_col else F.lit(False)
    d = terms.select(F.lower(tx.collapsed(term_col)).alias("term"), need.alias("required")).filter("term <> ''")
    return d.groupBy("term").agg(F.bool_or("required").alias("required"))


def alias_links(terms: DataFrame) -> DataFrame:
    """``a, b``: a distinct term and another that holds it or that it is the initials of. ``terms`` has the distinct column ``term``."""
    one = terms.select("term")
    # The lengths of terms are few, and only parts of these lengths can be terms.
    lengths = one.filter(F.length("term") <= LONGEST).agg(F.array_sort(F.collect_set(F.length("term")))).first()[0] or []
    size = F.length("term")
    starts = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("term"), i, F.lit(n)))
    none = F.array().cast("array<string>")
    parts = [F.when(size > n, starts(n)).otherwise(none) for n in lengths]
    held = exploded(one.filter(size <= LONGEST).withColumnRenamed("term", "b").withColumn("term", F.col("b")), F.array_distinct(F.concat(*parts)) if parts else none, "a", "b")
    words = F.filter(F.split(F.replace("term", F.lit("-"), F.lit(" ")), " "), lambda w: w != "")
    short = one.select(F.col("term").alias("b"), F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).alias("a")).filter("a IS NOT NULL AND a <> b")
    both = held.unionByName(short, allowMissingColumns=False)
    return join_aggregate(both, one.withColumnRenamed("term", "a"), ["a"]).select("a", "b").distinct()


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``term, label``: the smallest term that each can reach.

    A round takes the least label among neighbours and then that label's own label, so labels travel twice as far each time. Both are minima with map-side combine
    and joins whose hot terms AQE can split; every round is checkpointed.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")))
    label = checkpointed(nodes.select("term", F.col("term").alias("label")))
    for _ in range(max_rounds):
        near = join_aggregate(both.withColumnRenamed("b", "term"), label, ["term"]).groupBy("a").agg(F.min("label").alias("least"))
        met = label.join(near.withColumnRenamed("a", "term"), "term", "left").select("term", "label", F.least("label", "least").alias("new"))
        up = label.select(F.col("term").alias("new"), F.col("label").alias("above"))
        moved = checkpointed(join_aggregate(met, up, ["new"]).select("term", "label", F.least("new", "above").alias("new")))
        if not moved.filter("label <> new").limit(1).count():
            return moved.select("term", F.col("new").alias("label"))
        label = moved.select("term", F.col("new").alias("label"))
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def alias_groups(terms: DataFrame, term_col: str = "term", required_col: str | None = None) -> DataFrame:
    """``term, required, label, group_required``: the group of every distinct term, named by its smallest one."""
    nodes = checkpointed(distinct_terms(terms, term_col, required_col))
    label = components(nodes, alias_links(nodes))
    d = checkpointed(nodes.join(label, "term"))
    groups = d.groupBy("label").agg(F.bool_or("required").alias("group_required"))
    return join_aggregate(d, groups, ["label"]).select("term", "required", "label", "group_required")
