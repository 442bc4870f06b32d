"""DuckDB SQL text for the oracle side of every registered query.

Each helper mirrors one column expression of ``papyra.functions.text`` /
``papyra.functions.vectors`` so the two engines compute the same values. The
regular expressions are the same strings on both sides (see the module notes
in ``papyra.functions.text``).
"""

from __future__ import annotations

from papyra.functions import text as T
from papyra.operators import papers as P


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS_RUN = q(T.WS_RUN)
NON_WS_RUN = q(T.NON_WS_RUN)
EDGE_WS = q(rf"\A{T.WS_RUN}|{T.WS_RUN}\z")


def strip(x: str) -> str:
    return f"trim({x}, {q(T.WS_CHARS)})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {WS_RUN}, ' ', 'g'))"


def is_blank(x: str) -> str:
    return "(" + strip("coalesce(" + x + ", '')") + " = '')"


def clean_text(x: str) -> str:
    t = f"coalesce({x}, '')"
    for p in (T.LATEX_COMMAND, T.INLINE_MATH, T.DISPLAY_MATH, T.URL_RULE, T.EMAIL_RULE):
        t = f"regexp_replace({t}, {q(p)}, '', 'g')"
    return f"trim(regexp_replace({t}, {WS_RUN}, ' ', 'g'))"


def split_categories(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array(coalesce({x}, ''), {WS_RUN}), lambda e: e <> '')"
    return f"list_filter({parts}, lambda e, i: list_position({parts}, e) = i)"


def parse_authors(parsed: str, authors: str, cap: int = 10) -> str:
    last = strip("coalesce(a[1], '')")
    first = strip("coalesce(a[2], '')")
    one = (f"CASE WHEN len(a) < 2 THEN NULL WHEN {last} <> '' AND {first} <> '' "
           f"THEN {first} || ' ' || {last} WHEN {last} <> '' THEN {last} END")
    from_parsed = f"list_filter(list_transform({parsed}, lambda a: {one}), lambda e: e IS NOT NULL)"
    from_string = (f"list_filter(list_transform(string_split(coalesce({authors}, ''), ','), "
                   f"lambda e: {strip('e')}), lambda e: e <> '')")
    return (f"list_slice(CASE WHEN {parsed} IS NOT NULL AND len({parsed}) > 0 "
            f"THEN {from_parsed} ELSE {from_string} END, 1, {cap})")


def parse_date(x: str) -> str:
    return (f"CASE WHEN coalesce({x}, '') <> '' THEN coalesce(try_strptime({x}, '%Y-%m-%d'), "
            f"try_strptime(left({x}, 10), '%Y-%m-%d')) END")


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), {NON_WS_RUN})) AS INTEGER)"


def length(x: str) -> str:
    return f"CAST(length({x}) AS INTEGER)"


def detect_language(x: str) -> str:
    tokens = f"regexp_split_to_array(lower(left({x}, {P.LANGUAGE_SAMPLE_CHARS})), {q(P.LETTER_SPLIT)})"
    langs = sorted(P.STOPWORDS)
    hits = {lang: ("len(list_filter(" + tokens + ", lambda t: list_contains(["
                   + ", ".join(q(w) for w in P.STOPWORDS[lang]) + "], t)))") for lang in langs}
    best = "greatest(" + ", ".join(hits.values()) + ")"
    cases = " ".join(f"WHEN {hits[lang]} = {best} AND {hits[lang]} > 0 THEN {q(lang)}" for lang in langs)
    return f"(CASE {cases} END)"


def is_english(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    d = detect_language(s)
    return f"(length({s}) < {P.LANGUAGE_MIN_CHARS} OR {d} IS NULL OR {d} = 'en')"


def reject_reason(language: str | None = None, categories=None) -> str:
    a = strip("coalesce(abstract, '')")
    parts = [f"WHEN {strip('coalesce(id, ' + q('') + ')')} = '' THEN 'missing_id'",
             f"WHEN {strip('coalesce(title, ' + q('') + ')')} = '' THEN 'missing_title'",
             f"WHEN {a} = '' THEN 'missing_abstract'",
             f"WHEN length({a}) < {P.MIN_ABSTRACT_LENGTH} THEN 'abstract_too_short'",
             f"WHEN length({a}) > {P.MAX_ABSTRACT_LENGTH} THEN 'abstract_too_long'"]
    if language == "en":
        parts.append(f"WHEN NOT {is_english('abstract')} THEN 'not_english'")
    if categories:
        lst = "[" + ", ".join(q(c) for c in categories) + "]"
        parts.append(f"WHEN NOT list_has_any({split_categories('categories')}, {lst}) "
                     "THEN 'category_excluded'")
    return "CASE " + " ".join(parts) + " END"


def raw_cte() -> str:
    day = "strftime(DATE '2023-01-01' + CAST(doc_id % 730 AS INTEGER), '%Y-%m-%d')"
    return f"""raw AS (
  SELECT doc_id,
    printf('%02d%02d.%05d', 15 + doc_id % 10, 1 + doc_id % 12, doc_id) AS id,
    split_part(text, chr(10), 1) AS title,
    text AS abstract,
    concat_ws(' ', lang, source, lang) AS categories,
    CASE WHEN doc_id % 2 = 1 THEN printf('Author %d, Author %d, Author %d', doc_id % 97, doc_id % 89, doc_id % 83) END AS authors,
    CASE WHEN doc_id % 2 = 0 THEN [['L' || (doc_id % 97), 'F' || (doc_id % 53)], ['L' || (doc_id % 89), '']] END AS authors_parsed,
    CASE WHEN doc_id % 50 = 0 THEN 'bad' WHEN doc_id % 50 = 1 THEN {day} || 'T00:00:00' ELSE {day} END AS update_date,
    CAST(NULL AS VARCHAR) AS submitter, CAST(NULL AS VARCHAR) AS doi, CAST(NULL AS VARCHAR) AS "journal-ref"
  FROM documents)"""


def flagged_cte(language: str | None = None, categories=None, source: str = "raw") -> str:
    return f"flagged AS (SELECT *, {reject_reason(language, categories)} AS reject_reason FROM {source})"


def papers_cte(source: str = "flagged") -> str:
    return f"""papers0 AS (
  SELECT doc_id, {strip('id')} AS id, {clean_text('title')} AS title, {clean_text('abstract')} AS abstract,
    {parse_authors('authors_parsed', 'authors')} AS authors,
    {split_categories('categories')} AS categories,
    {parse_date('update_date')} AS update_date,
    submitter, doi, "journal-ref" AS journal_ref
  FROM {source} WHERE reject_reason IS NULL),
papers AS (
  SELECT doc_id, id, title, abstract, title || '. ' || abstract AS combined_text, authors, categories,
    update_date, submitter, doi, journal_ref,
    {length("title || '. ' || abstract")} AS text_length,
    {word_count("title || '. ' || abstract")} AS word_count
  FROM papers0)"""


def with_papers(language: str | None = None, categories=None, extra: str = "") -> str:
    """``WITH raw, flagged, papers0, papers[, extra]`` prefix."""
    ctes = [raw_cte(), flagged_cte(language, categories), papers_cte()]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- vectors ---------------------------------------------------------------

def vectors_cte(model: str = "m64", name: str = "vectors") -> str:
    if model == "m64":
        vec = "CAST(embedding AS DOUBLE[])"
    else:
        e = "CAST(embedding AS DOUBLE[])"
        v = (f"list_transform(list_zip(list_slice({e}, 1, 32), list_slice({e}, 33, 64)), lambda x: x[1] + x[2])")
        vec = normalize(v)
    return f"{name} AS (SELECT vec_id AS id, '{model}' AS model, {vec} AS vec, label FROM embeddings)"


def norm(v: str) -> str:
    return f"sqrt(list_reduce(list_transform({v}, lambda x: x * x), lambda a, b: a + b, 0.0))"


def normalize(v: str) -> str:
    n = norm(v)
    return (f"CASE WHEN {n} > 0 THEN list_transform({v}, lambda x: x / {n}) "
            f"ELSE list_transform({v}, lambda x: x * 0.0) END")


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / (({norm(a)} + 1e-8) * ({norm(b)} + 1e-8)))"


def blend(a: str, b: str, wa: float, wb: float) -> str:
    z = f"list_transform({a}, lambda x, i: x * {wa} + ({b})[i] * {wb})"
    return normalize(z)


# ---- text results -----------------------------------------------------------

def last_period(t: str) -> str:
    return f"(CASE WHEN strpos({t}, '.') > 0 THEN length(regexp_extract({t}, '(?s)^(.*)\\.', 1)) ELSE -1 END)"


def snippet(a: str, summary: str | None = None, n: int = 200) -> str:
    a = f"coalesce({a}, '')"
    cut = f"left({a}, {n})"
    lp = last_period(cut)
    body = (f"CASE WHEN length({a}) <= {n} THEN {a} WHEN {lp} > {0.7 * n} THEN left({cut}, {lp} + 1) "
            f"ELSE {cut} || '...' END")
    if summary is None:
        return f"({body})"
    return f"(CASE WHEN coalesce({summary}, '') <> '' THEN {summary} ELSE {body} END)"


def rule_summary(a: str, budget: int = 200) -> str:
    a = f"coalesce({a}, '')"
    parts = f"string_split({a}, '.')"
    s = [strip(f"{parts}[{i}]") for i in (1, 2, 3)]
    t1 = f"(coalesce({s[0]}, '') <> '' AND length({s[0]}) < {budget})"
    t2 = f"({t1} AND coalesce({s[1]}, '') <> '' AND length({s[0]}) + length({s[1]}) < {budget})"
    t3 = (f"({t2} AND coalesce({s[2]}, '') <> '' AND "
          f"length({s[0]}) + length({s[1]}) + length({s[2]}) < {budget})")
    joined = (f"CASE WHEN {t3} THEN {s[0]} || '. ' || {s[1]} || '. ' || {s[2]} "
              f"WHEN {t2} THEN {s[0]} || '. ' || {s[1]} ELSE {s[0]} END || '.'")
    fallback = f"CASE WHEN length({a}) > 150 THEN left({a}, 150) || '...' ELSE {a} END"
    return f"(CASE WHEN {t1} THEN {joined} ELSE {fallback} END)"


def extract_arxiv_id(x: str) -> str:
    y = x
    for p in T.ID_PREFIXES:
        y = f"replace({y}, {q(p)}, '')"
    new = f"nullif(regexp_extract({y}, {q(T.NEW_STYLE_ID)}, 1), '')"
    old = f"nullif(regexp_extract({y}, {q(T.OLD_STYLE_ID)}, 1), '')"
    return f"(CASE WHEN coalesce({x}, '') <> '' THEN coalesce({new}, {old}) END)"


def validate_arxiv_id(x: str) -> str:
    y = f"coalesce({x}, '')"
    return (f"({y} <> '' AND (regexp_matches({y}, {q(T.VALID_NEW_ID)}) OR "
            f"regexp_matches({y}, {q(T.VALID_OLD_ID)})))")


def clamp01(x: str) -> str:
    return f"greatest(0.0, least({x}, 1.0))"


def cache_key(title: str, abstract: str) -> str:
    return f"md5(coalesce({title}, '') || '|' || left(coalesce({abstract}, ''), 500))"


# ---- encoder / expansion / scorer ---------------------------------------------

def tokens(x: str) -> str:
    from papyra.functions import encode as E
    return (f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {q(E.TOKEN_SPLIT)}), "
            f"lambda t: t <> '')")


def encode_cte(name: str, source: str, key: str, text: str, dim: int | None = None) -> str:
    """``name(key, vec)``: hashed bag of words, unit length, dense."""
    from papyra.functions import encode as E
    dim = dim or E.ENCODER_DIM
    return f"""{name}_tok AS (
  SELECT {key} AS k, unnest({tokens(text)}) AS t FROM {source}),
{name}_cnt AS (
  SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c FROM {name}_tok GROUP BY ALL),
{name}_raw AS (
  SELECT s.{key} AS k, list(coalesce(c.c, 0.0) ORDER BY r.i) AS v
  FROM {source} s CROSS JOIN range({dim}) r(i) LEFT JOIN {name}_cnt c ON c.k = s.{key} AND c.b = r.i
  GROUP BY s.{key}),
{name} AS (SELECT k AS {key}, {normalize('v')} AS vec FROM {name}_raw)"""


def expand_query(x: str) -> str:
    from papyra.functions import encode as E
    toks = f"string_split(lower(coalesce({x}, '')), ' ')"
    grams = (f"list_concat({toks}, list_transform(generate_series(1, len({toks}) - 1), "
             f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]))")
    lit = "[" + ", ".join("{'term': " + q(t) + ", 'expansion': " + q(e) + "}" for t, e in E.EXPANSIONS) + "]"
    exp = f"list_transform(list_filter({lit}, lambda e: list_contains({grams}, e.term)), lambda e: e.expansion)"
    return (f"(CASE WHEN len({exp}) > 0 THEN coalesce({x}, '') || ' ' || array_to_string({exp}, ' ') "
            f"ELSE coalesce({x}, '') END)")


def overlap_score(query: str, text: str) -> str:
    qt = f"list_distinct({tokens(query)})"
    return (f"round(coalesce(CAST(len(list_intersect({qt}, {tokens(text)})) AS DOUBLE) / "
            f"nullif(len({qt}), 0), 0.0), 6)")


def rerank_text(title: str, abstract: str) -> str:
    return f"(coalesce({title}, '') || ' ' || left(coalesce({abstract}, ''), 500))"
