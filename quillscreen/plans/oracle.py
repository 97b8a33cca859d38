"""SQL text of the screening plan for DuckDB, put together from common table expressions.

Each part is written from the definitions, not from the plan: sorting, counting and set operations stand where the DataFrame
code uses array expressions.
"""

from __future__ import annotations

from collections import Counter

from quillscreen.functions import scoring as sc
from quillscreen.functions import text as tx
from quillscreen.operators import aspects, roles
from quillscreen.operators.evidence import EVIDENCE_FUNCTIONS
from quillscreen.plans import papers as pp
from quillscreen.plans.papers import CONTRACT, NOW_YEAR, QUESTION, quoted, sql_clamp, sql_collapsed, sql_overlap, sql_sentences, sql_title_key, sql_tokens


def lit(v: str) -> str:
    return quoted([v])


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


# ---- evidence -----------------------------------------------------------------------------------------------------------

EVIDENCE = f"""
sent AS (SELECT paper_id, unnest(s) AS s, unnest(range(len(s))) AS pos FROM (SELECT paper_id, {sql_sentences('abstract')} AS s FROM papers)),
best AS (
  SELECT paper_id, s AS evidence_sentence, CAST(pos AS INT) AS sentence_no, ov AS keyword_overlap FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ov DESC, pos) AS n FROM (SELECT *, {sql_overlap(sql_tokens('s'))} AS ov FROM sent)) WHERE n = 1),
ev AS (
  SELECT p.*, coalesce(b.evidence_sentence, '') AS evidence_sentence, b.sentence_no, coalesce(b.keyword_overlap, 0.0) AS keyword_overlap,
         CASE WHEN abstract = '' THEN 'missing_abstract' WHEN b.paper_id IS NULL THEN 'missing_evidence' ELSE 'strict_support' END AS support_level,
         CASE WHEN b.paper_id IS NULL THEN 0.0 ELSE 1.0 END AS confidence
  FROM papers p LEFT JOIN best b USING (paper_id))"""

#: Venue diversity in two passes; ``scored`` needs final_of(diversity) as columns base0 (without diversity) and w_div.
def ranked(final: str, floor: bool = True) -> str:
    """``ranked``: two-pass rank of ``scored``; ``final`` is the score as SQL with ``diversity``."""
    seed = "CASE source_stage WHEN 'seed_exact' THEN 0.995 WHEN 'manual_seed' THEN 0.985 ELSE -1e9 END" if floor else "-1e9"
    return f"""
pass1 AS (SELECT *, greatest({final}, {seed}) AS final0, CASE WHEN {sql_title_key('venue')} = '' THEN 'unknown' ELSE {sql_title_key('venue')} END AS vkey FROM (SELECT *, 0.5 AS diversity FROM scored)),
pass2 AS (SELECT * EXCLUDE (diversity), 1.0 / row_number() OVER (PARTITION BY vkey ORDER BY final0 DESC, input_ord) AS diversity FROM pass1),
pass3 AS (SELECT *, greatest({final}, {seed}) AS final FROM pass2),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY final DESC, final0 DESC, input_ord) AS INT) AS rank FROM pass3)"""


RECENCY = f"CAST(CASE WHEN year IS NULL OR year = 0 THEN 0.3 WHEN {NOW_YEAR} - year <= 1 THEN 1.0 WHEN {NOW_YEAR} - year <= 3 THEN 0.9 WHEN {NOW_YEAR} - year <= 5 THEN 0.75 WHEN {NOW_YEAR} - year <= 10 THEN 0.5 ELSE 0.25 END AS DOUBLE)"
QUALITY = sql_clamp(f"0.75 * {sql_clamp('log10(greatest(0, citation_count) + 1) / 3.0')} + 0.25 * CASE WHEN venue <> '' THEN 1.0 ELSE 0.3 END")
EVIDENCE_SCORE = sql_clamp("0.6 * confidence + 0.4 * keyword_overlap")


def weighted(profile: str = "balanced") -> str:
    w = sc.weights(profile)
    return "(" + " + ".join(f"{w[p]} * {sql_clamp(p)}" for p in sc.PARTS) + ")"


SIMPLE_SCORED = f"""
scored AS (
  SELECT *, {sql_overlap(sql_tokens("title || ' ' || abstract || ' ' || evidence_sentence || ' ' || evidence_sentence"))} AS relevance, {EVIDENCE_SCORE} AS evidence, {RECENCY} AS recency, {QUALITY} AS quality FROM ev)"""

# ---- similarity ---------------------------------------------------------------------------------------------------------


def sql_words(e: str) -> str:
    """Word characters are Unicode letters, digits, marks and connectors, two or more."""
    return f"list_filter(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}'), lambda k: k NOT IN ({quoted(tx.STOPWORDS)}))"


def sql_tfidf(words: str, query: str) -> str:
    """Cosine by the definition: document frequency over the two texts, idf = ln(3 / (1 + df)) + 1."""
    import re

    q = Counter(w for w in re.findall(r"\b\w\w+\b", query.lower()) if w not in tx.STOPWORDS)
    if not q:
        return "0.0"
    keys, vals = f"[{quoted(sorted(q))}]", "[" + ", ".join(f"{float(q[t])}" for t in sorted(q)) + "]"
    idf = lambda t, n: f"(CASE WHEN list_position({keys}, {t}) IS NOT NULL AND list_position({n}, {t}) IS NOT NULL THEN 1.0 ELSE ln(1.5) + 1 END)"
    count = f"(len(list_filter({words}, lambda k: k = t)))"
    dot = f"list_sum(list_transform({keys}, lambda t: {vals}[list_position({keys}, t)] * {count}))"
    nq = f"sqrt(list_sum(list_transform({keys}, lambda t: pow({vals}[list_position({keys}, t)] * {idf('t', words)}, 2))))"
    nt = f"sqrt(list_sum(list_transform(map_entries(list_histogram({words})), lambda e: pow(e.value * (CASE WHEN list_contains({keys}, e.key) THEN 1.0 ELSE ln(1.5) + 1 END), 2))))"
    return f"CASE WHEN len({words}) = 0 THEN 0.0 ELSE {sql_clamp(f'({dot}) / (({nq}) * ({nt}))')} END"


WORDS = f"""
worded AS (
  SELECT *, {sql_words('title')} AS wt, {sql_words('abstract')} AS wa, {sql_words("evidence_sentence || ' ' || evidence_sentence")} AS we, {sql_words('lang')} AS wf,
         {sql_tokens("title || ' ' || abstract || ' ' || evidence_sentence || ' ' || evidence_sentence")} AS tok FROM ev)"""
_FIELD = " ".join([*CONTRACT.core_terms, *CONTRACT.must_terms, *CONTRACT.optional_terms])
_MUST = " + ".join(f"(len(list_intersect(list_distinct(tok), [{quoted(sorted(set(tx.py_tokens(t))))}])) = {len(set(tx.py_tokens(t)))})::INT" for t in CONTRACT.must_terms)
SIMILAR = f"""
simil AS (
  SELECT * EXCLUDE (wt, wa, we, wf, tok), {sql_tfidf('wt', QUESTION)} AS title_similarity, {sql_tfidf('wa', QUESTION)} AS abstract_similarity, {sql_tfidf('we', QUESTION)} AS evidence_similarity,
         CASE WHEN api_relevance_score <= 1 THEN greatest(0.0, api_relevance_score) ELSE api_relevance_score / (api_relevance_score + 1) END AS api_relevance,
         ({_MUST}) / {float(len(CONTRACT.must_terms))} AS must_term_coverage, {sql_tfidf('wf', _FIELD)} AS field_match FROM worded),
hybrid AS (SELECT *, {sql_clamp(' + '.join(f'{w} * {sql_clamp(k)}' for k, w in sc.HYBRID.items()))} AS hybrid_relevance FROM simil)"""

# ---- concepts -----------------------------------------------------------------------------------------------------------


def sql_domain_text(e: str) -> str:
    v = e
    for name, char in tx.ENTITIES.items():
        v = f"replace({v}, {lit(name)}, {lit(char)})"
    v = f"regexp_replace(regexp_replace({v}, '(?i)</?\\s*(sub|sup)\\s*>', '', 'g'), '<[^>]+>', ' ', 'g')"
    v = f"translate({v}, '{tx.DASHES}' || chr(160), '{'-' * len(tx.DASHES)} ')"
    return f"lower(regexp_replace(regexp_replace({v}, '(?i)([a-z])-\\s+([a-z])', '\\1-\\2', 'g'), '\\s+', ' ', 'g'))"


def sql_negated(x: str, needle: str) -> str:
    """Every occurrence has a marker in the 28 characters before or the 36 after; occurrences are found by cutting the text at the needle."""
    n, cut = lit(needle), f"string_split({x}, {lit(needle)})"
    before, after = f"right(array_to_string(list_slice({cut}, 1, i), {n}), {tx.BEFORE_CHARS})", f"left(array_to_string(list_slice({cut}, i + 1, len({cut})), {n}), {tx.AFTER_CHARS})"
    hit = " OR ".join([*(f"contains({before}, {lit(m)})" for m in tx.NEGATED_BEFORE), *(f"contains({after}, {lit(m)})" for m in tx.NEGATED_AFTER)])
    return f"(contains({x}, {n}) AND len(list_filter(range(1, len({cut})), lambda i: NOT ({hit}))) = 0)"


def sql_concept(x: str, folded: str, concept: str) -> str:
    cleaned = " ".join(concept.lower().split())
    spell = tx.variants(cleaned)
    found = " OR ".join(f"contains({x}, {lit(v)})" for v in spell)
    clear = " OR ".join(f"(contains({x}, {lit(v)}) AND NOT {sql_negated(x, v)})" for v in spell)
    distinct = sorted(set(tx.py_tokens(cleaned)))
    if not distinct:
        return f"({clear})"
    need = distinct if len(distinct) == 1 else tx.py_folded(cleaned)
    loose = " AND ".join([*(f"list_contains({folded}, {lit(w)})" for w in need), *(f"NOT {sql_negated(x, w)}" for w in need)])
    return f"(CASE WHEN {found} THEN {clear} ELSE {loose} END)"


def sql_folded(tok: str) -> str:
    one = "CASE WHEN k LIKE '%ies' AND length(k) > 4 THEN left(k, length(k) - 3) || 'y' WHEN k LIKE '%s' AND length(k) > 3 THEN left(k, length(k) - 1) ELSE k END"
    return f"list_concat({tok}, list_transform({tok}, lambda k: {one}))"


def guard() -> str:
    """``guard``: the assessment of every paper under CONTRACT, which has no chemistry context."""
    must, opt = CONTRACT.required_groups(), CONTRACT.optional_groups()
    required = [f"{n}: " + " OR ".join(t) for n, t in must]
    any_of = lambda terms, x: "(" + " OR ".join(sql_concept(x, f"{x}_f", t) for t in terms) + ")"
    flags = [f"{any_of(t, x)} AS {p}{i}" for p, x in (("r", "x"), ("t", "xt"), ("a", "xa")) for i, (_, t) in enumerate(must)] + [f"{any_of(t, 'x')} AS o{i}" for i, (_, t) in enumerate(opt)]
    found = lambda terms: "list_filter([" + ", ".join(f"CASE WHEN {sql_concept('x', 'x_f', t)} THEN {lit(t)} END" for t in terms) + "], lambda v: v IS NOT NULL)" if terms else "CAST([] AS VARCHAR[])"
    total = lambda p, n: "(" + " + ".join(f"{p}{i}::INT" for i in range(n)) + f") / {float(n)}"
    n, core = len(must), [i for i, (g, _) in enumerate(must) if "core" in g.lower()]
    hit = lambda p: " OR ".join(f"{p}{i}" for i in core) or "false"
    positive = tx.unique([*CONTRACT.positive, *required, *(t for _, g in must for t in g)], 40)
    missing = "list_filter([" + ", ".join(f"CASE WHEN NOT r{i} THEN {lit(required[i])} END" for i in range(n)) + "], lambda v: v IS NOT NULL)"
    seed = "(source_stage IN ('seed_exact', 'manual_seed'))"
    r4 = lambda e: f"round({e}, 4)"
    five = lambda text, c: f"'{text}: ' || array_to_string({c}[1:5], ', ') || '.'"
    reason = f"""CASE WHEN {seed} THEN 'User-provided seed paper retained as an in-scope anchor.' WHEN len(forbidden) > 0 THEN {five(f'Forbidden concept(s) found for {CONTRACT.domain}', 'forbidden')}
       WHEN len(negative) > 0 THEN {five(f'Negative domain signal(s) found for {CONTRACT.domain}', 'negative')} WHEN decision = 'borderline' AND len(missing) > 0 THEN {five('Missing some required concept(s)', 'missing')}
       WHEN decision = 'out_of_scope' AND len(missing) > 0 THEN {five('Insufficient domain evidence; missing required concept(s)', 'missing')} WHEN decision = 'in_scope' THEN 'Paper matches the search contract domain.' ELSE 'Weak domain match.' END"""
    return f"""
g0 AS (SELECT paper_id, source_stage, {sql_domain_text("title || ' ' || abstract || ' ' || venue || ' ' || lang || ' ' || source_provider")} AS x, {sql_domain_text('title')} AS xt, {sql_domain_text("abstract")} AS xa FROM papers),
g1 AS (SELECT *, {sql_folded('x_k')} AS x_f, {sql_folded('xt_k')} AS xt_f, {sql_folded('xa_k')} AS xa_f FROM (SELECT *, {sql_tokens('x')} AS x_k, {sql_tokens('xt')} AS xt_k, {sql_tokens('xa')} AS xa_k FROM g0)),
g2 AS (SELECT paper_id, source_stage, {', '.join(flags)}, {found(list(CONTRACT.forbidden))} AS forbidden, {found(list(CONTRACT.negative))} AS negative, {found(positive)} AS positive FROM g1),
g3 AS (SELECT *, {missing} AS missing, {total('r', n)} AS cov, {sql_clamp(f"0.45 * {total('t', n)} + 0.25 * {total('a', n)} + 0.20 * {total('r', n)} + 0.10 * CASE WHEN {hit('t')} THEN 1.0 WHEN {hit('r')} THEN 0.35 ELSE 0.0 END")} AS focus, {total('o', len(opt))} AS asp FROM g2),
g4 AS (SELECT *, CASE WHEN focus < 0.45 THEN 'low_topic_focus' ELSE '' END AS peripheral FROM g3),
g5 AS (SELECT *, CASE WHEN peripheral <> '' THEN least(c, 0.62) ELSE c END AS central, len(positive) > 0 AND (cov >= 0.5 OR len(positive) >= 2) AS strong FROM (SELECT *, {sql_clamp('0.45 * cov + 0.30 * focus + 0.15 * asp + 0.10 * 1.0')} AS c FROM g4)),
g6 AS (SELECT *, {sql_clamp(f"0.70 * central + 0.20 * least(1.0, len(positive) / {float(max(3, n))}) - 0.55 * (CASE WHEN strong THEN 0.0 ELSE least(0.35, len(negative) * 0.12) END + least(0.75, len(forbidden) * 0.35))")} AS raw FROM g5),
g7 AS (SELECT *,
  CASE WHEN len(forbidden) > 0 THEN least(raw, 0.29) WHEN len(missing) > 0 THEN least(raw, 0.58) WHEN peripheral <> '' AND focus < 0.5 THEN least(raw, 0.56) WHEN len(negative) > 0 AND NOT strong AND raw < 0.40 THEN least(raw, 0.44) ELSE raw END AS score,
  CASE WHEN len(forbidden) > 0 THEN 'out_of_scope' WHEN len(missing) > 0 THEN CASE WHEN len(positive) > 0 AND cov >= 0.5 THEN 'borderline' ELSE 'out_of_scope' END
       WHEN peripheral <> '' AND focus < 0.5 THEN 'borderline' WHEN len(negative) > 0 AND NOT strong AND raw < 0.40 THEN CASE WHEN len(positive) > 0 THEN 'borderline' ELSE 'out_of_scope' END
       WHEN raw >= 0.75 THEN 'in_scope' WHEN raw >= 0.65 THEN 'in_scope' WHEN raw >= 0.45 AND len(positive) > 0 THEN 'borderline' WHEN raw >= 0.55 THEN 'borderline' ELSE 'out_of_scope' END AS decision FROM g6),
guard AS (SELECT paper_id, {seed} AS is_seed, CASE WHEN {seed} THEN 1.0 ELSE {r4('score')} END AS domain_match_score, CASE WHEN {seed} THEN 'in_scope' ELSE decision END AS domain_decision,
  CASE WHEN {seed} THEN 1.0 ELSE {r4('central')} END AS intent_centrality_score, CASE WHEN {seed} THEN 1.0 ELSE {r4('cov')} END AS required_group_coverage_score, CASE WHEN {seed} THEN 1.0 ELSE {r4('focus')} END AS topic_focus_score,
  CAST(CASE WHEN {seed} THEN 0 ELSE len(missing) END AS INT) AS missing_required_group_count, CASE WHEN {seed} THEN '' ELSE peripheral END AS peripheral_context_reason, CASE WHEN {seed} THEN 'user_seed' ELSE array_to_string(positive, ';') END AS positive_matches,
  CASE WHEN {seed} THEN '' ELSE array_to_string(negative, ';') END AS negative_matches, CASE WHEN {seed} THEN '' ELSE array_to_string(forbidden, ';') END AS forbidden_found, {reason} AS off_topic_reason, CASE WHEN {seed} THEN 0 ELSE len(missing) END AS n_missing,
  NOT {seed} AND ({' OR '.join(f"NOT r{i}" for i, (g, _) in enumerate(must) if any(w in g for w in ("context", "spin", "oer"))) or 'false'} OR peripheral <> '') AS limited
  FROM g7)"""


def aspect_sql() -> str:
    flags = []
    for i, a in enumerate(CONTRACT.aspects):
        _, terms = aspects.parse(a)
        tests = []
        for t in terms:
            wanted = sorted(set(tx.py_tokens(t)))
            own = f" OR len(list_intersect(list_distinct(tok), [{quoted(wanted)}])) = {len(wanted)}" if wanted else ""
            tests.append(f"contains(low, {lit(t.lower())}){own} OR {sql_tfidf('words', t)} >= {aspects.SIMILAR}")
        flags.append(f"({' OR '.join(tests)}) AS a{i}")
    label = [aspects.parse(a)[0] for a in CONTRACT.aspects]
    pick = lambda neg: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {neg} a{i} THEN {lit(v)} END" for i, v in enumerate(label)) + "], lambda v: v IS NOT NULL), ';')"
    whole = "title || ' ' || abstract || ' ' || lang || ' ' || evidence_sentence || ' ' || evidence_sentence"
    return f"""
as0 AS (SELECT paper_id, lower({whole}) AS low, {sql_tokens(whole)} AS tok, {sql_words(whole)} AS words FROM ev),
as1 AS (SELECT paper_id, {', '.join(flags)} FROM as0),
aspect AS (SELECT paper_id, {pick('')} AS covered, {pick('NOT')} AS missing_aspects, ({' + '.join(f'a{i}::INT' for i in range(len(flags)))}) / {float(len(flags))} AS aspect_coverage_score FROM as1)"""


def role_sql() -> str:
    flags, rules = [], pp.ROLE_RULES
    for i, (_, markers) in enumerate(rules):
        tests = []
        for m in markers:
            low = m.lower()
            short = (m.upper() == m and 2 <= len(m) <= 8) or (len(low) <= 5 and low.replace("-", "").isalnum())
            tests.append(f"regexp_matches(low, '(^|[^a-z0-9]){low}($|[^a-z0-9])')" if short else f"contains(low, {lit(low)})")
        flags.append(f"({' OR '.join(tests)}) AS m{i}")
    order = sorted(range(len(rules)), key=lambda i: roles.PRIORITY.index(rules[i][0]))
    listed = "list_filter([" + ", ".join(f"CASE WHEN m{i} THEN {lit(rules[i][0])} END" for i in order) + "], lambda v: v IS NOT NULL)"
    return f"""
rl0 AS (SELECT paper_id, lower(title || ' ' || abstract) AS low FROM papers),
rl1 AS (SELECT paper_id, {', '.join(flags)} FROM rl0),
role AS (SELECT paper_id, roles, coalesce(roles[1], 'unclassified') AS primary_role, CAST(CASE WHEN len(roles) = 0 THEN 0.1 ELSE round(least(0.42 + 0.08 * least(len(roles), 4) + 0.04 * least(len(roles), 5), 0.95), 3) END AS DOUBLE) AS confidence FROM (SELECT paper_id, {listed} AS roles FROM rl1)),
broad AS (SELECT r AS role FROM (SELECT unnest(roles) AS r FROM role) GROUP BY r HAVING count(*) > 0.30 * (SELECT count(*) FROM role) AND (SELECT count(*) FROM role) > 1)"""


GUARD, ASPECT, ROLE = guard(), aspect_sql(), role_sql()
FULL_FINAL = f"(CASE WHEN multiplier IS NULL THEN 1.0 ELSE multiplier END) * {sql_clamp(f'0.68 * {sql_clamp("centrality")} + 0.32 * {weighted()}')}"
FULL_SCORED = f"""
scored AS (
  SELECT h.*, g.* EXCLUDE (paper_id), a.covered, a.missing_aspects, a.aspect_coverage_score, g.intent_centrality_score AS centrality, CAST(CASE g.domain_decision WHEN 'out_of_scope' THEN 0.3 WHEN 'borderline' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS multiplier,
         CASE WHEN a.aspect_coverage_score <> 0 THEN {sql_clamp('0.85 * h.hybrid_relevance + 0.15 * a.aspect_coverage_score')} ELSE h.hybrid_relevance END AS relevance, {EVIDENCE_SCORE} AS evidence, {RECENCY} AS recency, {QUALITY} AS quality
  FROM hybrid h JOIN guard g USING (paper_id) JOIN aspect a USING (paper_id))"""
_role_case = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in {"theory_mechanism": 0.012, "characterization_method": 0.012, "in_situ_operando": 0.014, "ex_situ_post_mortem": 0.010, "material_case": 0.008, "application_performance": 0.008, "failure_limitation": 0.010, "controversy_debate": 0.010, "review_background": 0.003, "peripheral_background": -0.004, "out_of_scope": -0.02}.items())
_role_known = quoted(list(roles.PRIORITY[:9]) + ["material_case", "review_background"])
ADJUSTED = f"""
adj AS (
  SELECT r.*, ro.roles, CAST(CASE WHEN EXISTS (SELECT 1 FROM broad b WHERE list_contains(ro.roles, b.role)) THEN 0.0 WHEN NOT list_has_any(ro.roles, [{_role_known}]) THEN 0.015 ELSE list_max(list_transform(ro.roles, lambda k: CASE k {_role_case} ELSE 0.0 END)) END AS DOUBLE) AS role_adjustment,
         CAST(CASE WHEN is_seed THEN 0.03 ELSE 0.0 END AS DOUBLE) AS lane_adjustment, CAST(CASE WHEN is_seed THEN 0.05 WHEN {' OR '.join(f"contains({sql_collapsed('lower(title)')}, {lit(t)})" for t in CONTRACT.seed_titles)} THEN 0.035 ELSE 0.0 END AS DOUBLE) AS seed_boost,
         CAST(CASE domain_decision WHEN 'out_of_scope' THEN 0.05 WHEN 'borderline' THEN 0.015 ELSE 0.0 END AS DOUBLE) AS false_positive_penalty
  FROM ranked r JOIN role ro USING (paper_id)),
adj2 AS (SELECT * EXCLUDE (final, rank), rank AS rank_before, {sql_clamp('final + role_adjustment + lane_adjustment + seed_boost - false_positive_penalty')} AS final FROM adj),
items AS (SELECT *, CAST(row_number() OVER (ORDER BY final DESC, rank_before) AS INT) AS rank FROM adj2)"""
DECIDED = """
dc0 AS (
  SELECT *, list_filter(list_concat(
    [CASE WHEN domain_decision = 'out_of_scope' THEN 'off_topic_domain' END], CASE WHEN forbidden_found <> '' THEN ['off_topic_domain'] ELSE [] END,
    [CASE WHEN n_missing > 0 THEN 'missing_required_concept' END, CASE WHEN missing_required_group_count > 0 THEN 'missing_required_group' END, CASE WHEN limited THEN 'missing_context_or_non_target_context' END,
     CASE WHEN peripheral_context_reason <> '' THEN peripheral_context_reason END, CASE WHEN abstract = '' THEN 'missing_abstract' END, CASE WHEN support_level = 'missing_evidence' THEN 'weak_evidence_grounding' END],
    CASE WHEN missing_aspects <> '' THEN ['missing_required_concept'] ELSE [] END, [CASE WHEN final < 0.2 THEN 'low_metadata_quality' END]), lambda v: v IS NOT NULL) AS rs FROM items),
dc1 AS (SELECT *, list_filter(rs, lambda v, i: list_position(rs, v) = i) AS own FROM dc0),
dc2 AS (
  SELECT *,
    CASE WHEN domain_decision = 'out_of_scope' THEN 'exclude' WHEN support_level IN ('missing_abstract', 'missing_evidence') THEN CASE WHEN final >= 0.35 THEN 'maybe' ELSE 'exclude' END
         WHEN missing_required_group_count > 0 THEN CASE WHEN final >= 0.35 THEN 'maybe' ELSE 'exclude' END WHEN limited THEN 'maybe' WHEN domain_decision = 'borderline' THEN 'maybe'
         WHEN final >= 0.55 AND aspect_coverage_score >= 0.4 THEN 'include' WHEN final >= 0.45 THEN 'maybe' WHEN final < 0.25 THEN 'exclude' ELSE 'maybe' END AS decision,
    CASE WHEN domain_decision = 'out_of_scope' THEN 'off_topic_domain' WHEN support_level = 'missing_abstract' THEN 'missing_abstract' WHEN support_level = 'missing_evidence' THEN 'weak_evidence_grounding'
         WHEN missing_required_group_count > 0 THEN 'missing_required_group' WHEN limited THEN 'missing_context_or_non_target_context' WHEN domain_decision = 'borderline' THEN CASE WHEN len(own) > 0 THEN 'off_topic_domain' ELSE 'borderline_domain' END
         WHEN final >= 0.55 AND aspect_coverage_score >= 0.4 THEN 'high_score_in_scope_grounded_evidence' WHEN final >= 0.45 THEN 'partial_match_needs_inspection' WHEN final < 0.25 THEN 'low_metadata_quality' ELSE 'partial_match_needs_inspection' END AS primary_reason FROM dc1),
decided AS (
  SELECT * EXCLUDE (decision, primary_reason, own, rs),
    CASE WHEN is_seed THEN 'include' ELSE decision END AS decision,
    CASE WHEN is_seed THEN CASE source_stage WHEN 'seed_exact' THEN 'seed_exact_match' ELSE 'user_seed' END ELSE primary_reason END AS primary_reason,
    CASE WHEN is_seed THEN CAST([] AS VARCHAR[]) WHEN primary_reason NOT IN ('high_score_in_scope_grounded_evidence', 'partial_match_needs_inspection', 'borderline_domain') AND NOT list_contains(own, primary_reason) THEN list_concat([primary_reason], own) ELSE own END AS reasons,
    CASE WHEN is_seed THEN 'must_read' WHEN decision = 'exclude' THEN 'exclude' WHEN missing_required_group_count > 0 OR limited THEN 'optional'
         WHEN decision = 'include' AND domain_decision = 'in_scope' AND support_level = 'strict_support' AND rank <= 12 AND final >= 0.72 AND peripheral_context_reason = '' AND required_group_coverage_score >= 0.85 AND intent_centrality_score >= 0.78 AND topic_focus_score >= 0.65 THEN 'must_read'
         WHEN decision = 'include' THEN 'read_later' WHEN domain_decision = 'borderline' THEN 'optional' ELSE 'read_later' END AS reading_priority,
    CASE WHEN is_seed THEN 0.98 ELSE greatest(0.0, least(1.0, CASE decision WHEN 'include' THEN 0.35 * final + 0.30 * domain_match_score + 0.20 * evidence + 0.15 * aspect_coverage_score
         WHEN 'exclude' THEN 0.35 * (1 - multiplier) + 0.25 * (1 - final) + 0.25 * (1 - domain_match_score) + 0.15 * (1 - evidence) ELSE 0.45 + 0.25 * (1 - abs(final - 0.5)) + 0.15 * (1 - abs(domain_match_score - 0.5)) END)) END AS decision_confidence,
    CASE WHEN is_seed OR decision = 'include' THEN 'include' WHEN decision = 'exclude' THEN 'exclude' WHEN abstract = '' OR support_level IN ('missing_abstract', 'unverified', 'weak_support') THEN 'inspect_full_text' ELSE 'uncertain' END AS suggested_action
  FROM dc2)"""
EVIDENCE_FN = "CASE WHEN trim(low) = '' THEN 'unknown' " + " ".join(f"WHEN {' OR '.join(f'contains(low, {lit(m)})' for m in ms)} THEN {lit(n)}" for n, ms in EVIDENCE_FUNCTIONS) + " ELSE 'unknown' END"
FULL = with_(pp.PAPERS, EVIDENCE, WORDS, SIMILAR, GUARD, ASPECT, FULL_SCORED, ranked(FULL_FINAL))
DECISIONS = with_(pp.PAPERS, EVIDENCE, WORDS, SIMILAR, GUARD, ASPECT, FULL_SCORED, ranked(FULL_FINAL), ROLE, ADJUSTED, DECIDED)
