"""Column expressions for text: cleaning, parsing, formatting, snippets.

Every function here takes and returns ``pyspark.sql.Column`` objects built
from built-in functions only, so they stay inside whole-stage codegen (or the
JVM-side higher-order-function evaluator) and never leave the JVM.

Regular expressions are written so that Java's engine and RE2 read them the
same way: whitespace is an explicit class (Java's ``\\s`` misses U+00A0 and
U+001C..U+001F, which Python's ``str.split`` treats as space), ends of input are
``\\A`` / ``\\z`` (Java's ``$`` also matches before a final line break), and
digits are ``[0-9]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference behaviour for equal results.
# ---------------------------------------------------------------------------
# Characters Python's str.split()/str.strip()/re "\s" treat as whitespace.
WS_CLASS = (r"[\t\n\x0b\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NON_WS_CLASS = WS_CLASS.replace("[", "[^", 1)
# Cleaning rules, applied in this order.
LATEX_COMMAND = r"\\[a-zA-Z]+\{[^}]*\}"
INLINE_MATH = r"\$[^$]*\$"
DISPLAY_MATH = r"\$\$[^$]*\$\$"
URL_RULE = rf"http{NON_WS_CLASS}+|www{NON_WS_CLASS}+|https{NON_WS_CLASS}+"
EMAIL_RULE = rf"{NON_WS_CLASS}+@{NON_WS_CLASS}+"
# Identifier prefixes removed before matching, in this order.
ID_PREFIXES = ["http://arxiv.org/abs/", "https://arxiv.org/abs/",
               "http://arxiv.org/pdf/", "https://arxiv.org/pdf/", "arXiv:", ".pdf"]
NEW_STYLE_ID = r"(?i)^([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?\n?\z"
OLD_STYLE_ID = r"(?i)^([a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(v[0-9]+)?\n?\z"
VALID_NEW_ID = r"(?i)^[0-9]{4}\.[0-9]{4,5}\n?\z"
VALID_OLD_ID = r"(?i)^[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}\n?\z"
ABS_URL_PREFIX = "https://arxiv.org/abs/"
PDF_URL_PREFIX = "https://arxiv.org/pdf/"
PDF_URL_SUFFIX = ".pdf"
FILENAME_BAD_CHARS = r'[<>:"/\\|?*]'
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
INDIVIDUAL_SUMMARY_PROMPT = """
Summarize this research paper in 5-6 concise sentences focusing on:
1. Main contribution/finding
2. Methodology used
3. Practical implications

Title: {title}
Abstract: {abstract}

Summary:"""
BATCH_SUMMARY_PROMPT = """
Based on these {count} research papers related to "{query}", provide a brief overview highlighting:
1. Common themes and research directions
2. Key methodologies being used
3. Notable trends or gaps

Papers: {papers_info}

Overview:"""
# ---------------------------------------------------------------------------

WS_RUN = WS_CLASS + "+"
NON_WS_RUN = NON_WS_CLASS + "+"
# The same whitespace set as literal characters, for trim(str, chars).
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
# EMAIL_RULE can only ever match a whole non-space run with an '@' that has a
# character on both sides, so for Java's backtracking engine it is written as
# "at a run start, if the run has such an '@', take the whole run": the same
# matches in linear time. (RE2 on the oracle side runs the rule as written.)
EMAIL_RULE_LINEAR = (rf"(?<!{NON_WS_CLASS})(?={NON_WS_CLASS}*{NON_WS_CLASS}@{NON_WS_CLASS})"
                     rf"{NON_WS_CLASS}+")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (a character-set trim that only looks at the two ends)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def squeeze(c) -> Column:
    """Python ``' '.join(s.split())``: collapse whitespace runs, trim ends."""
    return F.trim(F.regexp_replace(_c(c), WS_RUN, " "))


def is_blank(c) -> Column:
    """True for null, empty or whitespace-only strings."""
    return strip(F.coalesce(_c(c), F.lit(""))) == ""


def clean_text(c) -> Column:
    """The ordered cleaning chain for titles and abstracts; null -> ''.

    The five removal rules only run on texts that contain a character one of
    them needs. Removals never create a backslash, '$' or '@', and a new
    "http"/"www" can only appear after a LaTeX or math removal (which needs a
    backslash or '$'), so testing the original text is exact. Each rule
    refers to the previous step once, so nothing is evaluated twice.
    """
    t = F.coalesce(_c(c), F.lit(""))
    needs = None
    for n in ("\\", "$", "@", "http", "www"):
        h = F.instr(t, n) > 0
        needs = h if needs is None else (needs | h)
    chain = t
    for pattern in (LATEX_COMMAND, INLINE_MATH, DISPLAY_MATH, URL_RULE, EMAIL_RULE_LINEAR):
        chain = F.regexp_replace(chain, pattern, "")
    # whitespace runs -> one space, then trim; only spaces remain at the edges
    return F.trim(F.regexp_replace(F.when(needs, chain).otherwise(t), WS_RUN, " "))


def split_categories(c) -> Column:
    """Whitespace split, order-preserving distinct, case kept; null -> []."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), WS_RUN)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def authors_from_parsed(parsed) -> Column:
    """``[last, first, ...]`` entries -> "first last"; last only -> last.

    Entries with fewer than two elements and entries without a last name
    are dropped.
    """
    def one(a):
        last = strip(F.coalesce(F.get(a, 0), F.lit("")))
        first = strip(F.coalesce(F.get(a, 1), F.lit("")))
        return (F.when(F.size(a) < 2, F.lit(None))
                .when((last != "") & (first != ""), F.concat_ws(" ", first, last))
                .when(last != "", last))
    return F.filter(F.transform(_c(parsed), one), lambda x: x.isNotNull())


def authors_from_string(c) -> Column:
    """Comma split of the free-text author field, stripped, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def parse_authors(parsed, authors, cap: int = 10) -> Column:
    """Structured field first (when non-empty), else the string field; capped."""
    p = _c(parsed)
    use_parsed = p.isNotNull() & (F.size(p) > 0)
    chosen = F.when(use_parsed, authors_from_parsed(p)).otherwise(authors_from_string(authors))
    return F.slice(chosen, 1, cap)


def parse_date(c) -> Column:
    """``%Y-%m-%d`` on the whole string, else on its first 10 characters."""
    d = _c(c)
    full = F.try_to_timestamp(d, F.lit("yyyy-M-d"))
    head = F.try_to_timestamp(F.left(d, F.lit(10)), F.lit("yyyy-M-d"))
    return F.when(F.coalesce(d, F.lit("")) != "", F.coalesce(full, head))


def word_count(c) -> Column:
    """``len(s.split())``: pieces of the stripped text split on whitespace runs."""
    s = strip(F.coalesce(_c(c), F.lit("")))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WS_RUN)))


def snippet(abstract, ai_summary=None, max_length: int = 200) -> Column:
    """Summary if present; else the abstract if short; else cut at the last
    '.' when it lies past 70 % of the budget; else cut and add '...'."""
    a = F.coalesce(_c(abstract), F.lit(""))
    cut = F.left(a, F.lit(max_length))
    # 0-based index of the last '.' (length of the text before it); -1 = none
    last_period = F.when(F.instr(cut, ".") > 0,
                         F.length(F.regexp_extract(cut, r"(?s)^(.*)\.", 1))).otherwise(F.lit(-1))
    shortened = (F.when(last_period > F.lit(0.7 * max_length), F.left(cut, last_period + 1))
                 .otherwise(F.concat(cut, F.lit("..."))))
    body = F.when(F.length(a) <= max_length, a).otherwise(shortened)
    if ai_summary is None:
        return body
    s = _c(ai_summary)
    return F.when(s.isNotNull() & (s != ""), s).otherwise(body)


def rule_summary(abstract, budget: int = 200, max_sentences: int = 3,
                 fallback_chars: int = 150) -> Column:
    """Extractive summary: leading '.'-sentences while the running length
    stays under ``budget``; stop at the first blank or over-budget one."""
    a = F.coalesce(_c(abstract), F.lit(""))
    sentences = F.transform(F.slice(F.split(a, r"\.", -1), 1, max_sentences), strip)
    init = F.struct(F.lit(False).alias("done"), F.lit(0).alias("n"),
                    F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        take = (~acc["done"]) & (s != "") & ((acc["n"] + F.length(s)) < budget)
        return F.struct(
            (~take).alias("done"),
            F.when(take, acc["n"] + F.length(s)).otherwise(acc["n"]).alias("n"),
            F.when(take, F.array_append(acc["parts"], s)).otherwise(acc["parts"]).alias("parts"))

    parts = F.aggregate(sentences, init, step)["parts"]
    fallback = F.when(F.length(a) > fallback_chars,
                      F.concat(F.left(a, F.lit(fallback_chars)), F.lit("..."))).otherwise(a)
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise(fallback)


def cache_key(title, abstract) -> Column:
    """md5 of ``title|abstract[:500]``."""
    return F.md5(F.concat(F.coalesce(_c(title), F.lit("")), F.lit("|"),
                          F.left(F.coalesce(_c(abstract), F.lit("")), F.lit(500))))


def extract_arxiv_id(c) -> Column:
    """Identifier without URL prefix, ``arXiv:``, ``.pdf`` and version; else null."""
    x = _c(c)
    for p in ID_PREFIXES:
        x = F.replace(x, F.lit(p), F.lit(""))
    new = F.nullif(F.regexp_extract(x, NEW_STYLE_ID, 1), F.lit(""))
    old = F.nullif(F.regexp_extract(x, OLD_STYLE_ID, 1), F.lit(""))
    return F.when(F.coalesce(_c(c), F.lit("")) != "", F.coalesce(new, old))


def validate_arxiv_id(c) -> Column:
    x = F.coalesce(_c(c), F.lit(""))
    return (x != "") & (x.rlike(VALID_NEW_ID) | x.rlike(VALID_OLD_ID))


def abstract_url(arxiv_id) -> Column:
    return F.concat(F.lit(ABS_URL_PREFIX), _c(arxiv_id))


def pdf_url(arxiv_id) -> Column:
    return F.concat(F.lit(PDF_URL_PREFIX), _c(arxiv_id), F.lit(PDF_URL_SUFFIX))


def clamp01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(c), F.lit(1.0)))


def display_score(c) -> Column:
    """UI rescale: scores above 1 are divided by 10, then clamped to [0, 1]."""
    s = _c(c)
    return clamp01(F.when(s > 1.0, F.least(s / 10.0, F.lit(1.0))).otherwise(s))


def score_band(c) -> Column:
    s = display_score(c)
    return F.when(s > 0.7, "High Match").when(s > 0.5, "Good Match").otherwise("Fair Match")


def sanitize_filename(c, max_len: int = 100) -> Column:
    x = F.regexp_replace(_c(c), FILENAME_BAD_CHARS, "_")
    x = F.regexp_replace(x, WS_RUN, "_")
    x = F.regexp_replace(x, r"\A[. ]+|[. ]+\z", "")
    return F.left(x, F.lit(max_len))


def download_name(arxiv_id, title, max_len: int = 50) -> Column:
    """``{id}_{title}.pdf`` with the title reduced to alnum, space, '-', '_'."""
    t = F.regexp_replace(F.coalesce(_c(title), F.lit("")), r"[^\p{L}\p{N} _-]", "")
    t = F.left(strip(t), F.lit(max_len))
    return F.when(F.coalesce(_c(title), F.lit("")) != "",
                  F.concat(_c(arxiv_id), F.lit("_"), t, F.lit(".pdf"))
                  ).otherwise(F.concat(_c(arxiv_id), F.lit(".pdf")))


def display_text(c, max_length: int = 100) -> Column:
    t = squeeze(F.coalesce(_c(c), F.lit("")))
    return F.when(F.length(t) > max_length,
                  F.concat(F.left(t, F.lit(max_length - 3)), F.lit("..."))).otherwise(t)


def _format_list(arr, limit: int, empty: str, more) -> Column:
    a = _c(arr)
    head = F.array_join(F.slice(a, 1, limit), ", ")
    return (F.when(a.isNull() | (F.size(a) == 0), F.lit(empty))
            .when(F.size(a) <= limit, F.array_join(a, ", "))
            .otherwise(F.concat(head, more(a))))


def format_authors(arr, limit: int = 3) -> Column:
    return _format_list(arr, limit, "Unknown authors", lambda a: F.lit(", et al."))


def format_categories(arr, limit: int = 3) -> Column:
    return _format_list(arr, limit, "No categories",
                        lambda a: F.format_string(", +%d more", F.size(a) - limit))


def format_file_size(c) -> Column:
    """1024-step units with two decimals (half-even, like Python's round)."""
    n = _c(c).cast("double")
    i = F.least(F.floor(F.log(1024.0, n)).cast("int"), F.lit(len(SIZE_UNITS) - 1))
    value = F.bround(n / F.pow(F.lit(1024.0), i), 2)
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), i + 1)
    return F.when(n == 0, F.lit("0B")).otherwise(F.concat(value.cast("string"), F.lit(" "), unit))


def truncate_tokens(c, max_tokens: int = 512) -> Column:
    """Whitespace-token truncation used before encoding."""
    return F.array_join(F.slice(F.split(squeeze(_c(c)), " "), 1, max_tokens), " ")


def individual_prompt(title, abstract, abstract_chars: int = 1000) -> Column:
    head, rest = INDIVIDUAL_SUMMARY_PROMPT.split("{title}")
    mid, tail = rest.split("{abstract}")
    return F.concat(F.lit(head), F.coalesce(_c(title), F.lit("")), F.lit(mid),
                    F.left(F.coalesce(_c(abstract), F.lit("")), F.lit(abstract_chars)), F.lit(tail))


def bibtex_entry(arxiv_id, title, authors, update_date) -> Column:
    year = F.when(_c(update_date).isNotNull(),
                  F.format_string("  year = {%d},\n", F.year(_c(update_date)))).otherwise(F.lit(""))
    return F.concat(
        F.lit("@article{"), F.coalesce(_c(arxiv_id), F.lit("None")), F.lit(",\n"),
        F.lit("  title = {"), _c(title), F.lit("},\n"),
        F.lit("  author = {"), F.array_join(F.slice(_c(authors), 1, 3), " and "), F.lit("},\n"),
        year,
        F.lit("  arxiv = {"), F.coalesce(_c(arxiv_id), F.lit("None")), F.lit("}\n}\n"))
