"""Text functions as Column expressions: they stay in the JVM and inside whole-stage codegen where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section labels, number words, suffixes, keyword lists and patterns of the answer format.
SECTIONS = ("Answer", "Evidence", "Count", "Supporting row_ids", "Notes")
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "twenty-one": 21, "twenty two": 22, "twenty-two": 22, "twenty three": 23, "twenty-three": 23, "twenty four": 24, "twenty-four": 24,
    "twenty five": 25, "twenty-five": 25, "twenty six": 26, "twenty-six": 26, "twenty seven": 27, "twenty-seven": 27, "twenty eight": 28,
    "twenty-eight": 28, "twenty nine": 29, "twenty-nine": 29, "thirty": 30,
}
# Suffixes with dots aren't listed: norm() has taken the dots before they are looked for.
BROAD_SUFFIXES = "inc|incorporated|llc|co|corp|corporation|ltd|company|americas|america|usa|manufacturing|mfg|group|holdings?|gmbh"
NARROW_SUFFIXES = "inc|incorporated|llc|co|corp|corporation|ltd|company|holdings?|gmbh"
COMPANY_PHRASE = (
    r"\b([A-Z][A-Za-z0-9&.'()/-]*(?:\s+[A-Z][A-Za-z0-9&.'()/-]*){0,7}\s+"
    r"(?:Inc\.?|LLC|L\.L\.C\.?|Corp\.?|Corporation|Co\.?|Company|Group|Holdings?|Manufacturing|Systems|Industries|America|Americas|USA|U\.S\.A\.?))\b"
)
COMPANY_LIKE = (
    r"(?i)\b(inc|incorporated|llc|l\.l\.c|co|corp|corporation|ltd|company|holdings?|gmbh|group|industries|systems|manufacturing|mfg|"
    r"technologies|technology|plastics|steel|automotive|motors|materials)\b"
)
GENERIC_PHRASES = (
    "", "company", "various", "various companies", "multiple", "multiple companies", "suppliers", "companies", "see above", "see evidence", "n a",
    "na", "none", "not found", "not found in the data", "tier", "unknown", "other", "others", "the company", "various suppliers", "all suppliers",
    "supplier",
)
NEGATIVE_PHRASES = "not found in the data|no matching|no rows|none can be|there are no|there is no"
INTERPRETIVE_TERMS = (
    "risk", "dependency", "fragility", "could be", "suitable", "suggesting", "reflecting", "emerging", "transition readiness", "potential",
    "opportunity", "innovation", "dual platform", "strategic", "import substitution",
)
QUESTION_TYPES = (
    ("aggregation_ranking", ("highest", "largest", "top", "rank", "total employment", "combined employment")),
    ("count", ("how many", "number of")),
    ("list_multi_filter", ("show all", "list all", "identify all", "map all", "which companies", "find ")),
    ("lookup", ("which company", "which county", "which area")),
)
FIELD_KEYWORDS = (
    ("Category", ("tier", "category", "classified", "classification")),
    ("EV Supply Chain Role", ("ev supply chain role", "role", "battery cell", "battery pack")),
    ("Product / Service", ("product", "service", "produce", "producing", "manufacture")),
    ("Primary OEMs", ("primary oem", "oem", "sole-sourced", "customer base", "rivian", "hyundai", "kia")),
    ("Employment", ("employment", "employees", "worker", "workforce", "size")),
    ("Primary Facility Type", ("facility type", "r&d", "research", "development", "distribution")),
    ("Location", ("location", "area", "county", "where")),
    ("Industry Group", ("industry group", "industry")),
    ("EV / Battery Relevant", ("ev relevant", "battery relevant", "indirectly relevant")),
)
INLINE_THINKING = r"(?i)<think>|</think>|\blet'?s think\b|\bwe need to\b"
FUZZY_THRESHOLD = 0.82
FUZZY_MIN_LENGTH = 5
CELL_LIMIT = 32767


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nfkc(c: Column) -> Column:
    """NFKC form; null as "". Spark SQL has no such function; the ICU library that Spark's collations come with has, and
    is called in the JVM for texts beyond ASCII only."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def norm(c: Column) -> Column:
    """NFKC, lower case, & as " and ", runs of other than a-z, 0-9 and space as one space, trimmed; null as ""."""
    lowered = F.regexp_replace(F.lower(nfkc(c)), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9 ]+", " "), r" +", " "))


def norm_company(c: Column) -> Column:
    return squeeze(F.regexp_replace(norm(c), rf"\b(?:{BROAD_SUFFIXES})\b", " "))


def canonical_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(norm(c), rf"\b(?:{NARROW_SUFFIXES})\b", " "))


def clean_text(c: Column) -> Column:
    """Trimmed; blank as null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def number_text(c: Column) -> Column:
    """A double as text: whole numbers without a fraction; NaN as null."""
    return F.when(F.isnan(c), None).when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def number_value(c: Column) -> Column:
    """Digits (commas dropped) or a number word up to thirty; else null."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    plain = F.regexp_replace(F.lower(F.trim(c)), ",", "")
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("int")).otherwise(F.try_element_at(words, plain))


# The number and the prose forms of a stated count.
_NUMBER = (
    r"([0-9,]+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    r"twenty(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?|thirty)"
)
# Spark gives no position of a match, so each form is kept as what stands before and after its number: the lead is
# captured too and tested for "tier". Forms in the order they are tried.
_PROSE = (
    (r"\bthere\s+(?:are|were)\s+(?:only\s+)?", r"\b"),
    (r"\bthere\s+is\s+(?:only\s+)?", r"\b"),
    (r"\bhas\s+", r"\s+(?:operating\s+entries|entries|locations|sites)\b"),
    (r"\btop\s+", r"\b"),
    (r"\bthe\s+", r"\s+(?:companies|company|suppliers|areas|facilities)\b"),
    (r"\b", r"\s+(?:distinct\s+)?(?:companies|company|records|suppliers|areas|facilities|entries|oems)\b"),
)


def extract_count(c: Column, strict_line: bool = False) -> Column:
    """The number an answer states: its Count label, else 0 for a negative phrase, else the first prose form.

    strict_line: a value on the line after an empty label doesn't count. A number shortly after "tier" doesn't."""
    raw = F.coalesce(c, F.lit(""))
    gap = r"[ \t]*" if strict_line else r"\s*"
    labelled = number_value(F.regexp_extract(F.regexp_extract(raw, rf"(?im)^\s*Count:{gap}([0-9,]+|[a-z -]+)", 1), r"(\S+)", 1))

    def prose(text: Column) -> Column:
        found = []
        for before, after in _PROSE:
            pattern = rf"^(.*?{before}){_NUMBER}{after}"
            lead, number = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
            found.append(F.when(~F.right(lead, F.lit(12)).contains("tier"), number_value(number)))
        return F.when(text.rlike(rf"\b(?:{NEGATIVE_PHRASES})\b"), F.lit(0)).otherwise(F.coalesce(*found))

    return F.coalesce(labelled, let(norm(raw), prose))


def extract_numbers(c: Column) -> Column:
    """Distinct numbers of a text as digit strings."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b\d[\d,]*\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\D", "")))


def sorted_numbers(a: Column) -> Column:
    """Digit strings in the order of length, then text."""
    keyed = F.array_sort(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def supporting_ids(c: Column) -> Column:
    """Numbers of 1 to 3 digits on the Supporting row_ids line, repeats kept."""
    line = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?im)^\s*Supporting row_ids:\s*([^\n]+)", 1)
    return F.transform(F.regexp_extract_all(line, F.lit(r"\b\d{1,3}\b"), F.lit(0)), lambda x: x.cast("int"))


def any_of(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def judge_recommended(question: Column) -> Column:
    return any_of(norm(question), INTERPRETIVE_TERMS)


def question_type(question: Column) -> Column:
    def chosen(q: Column) -> Column:
        kind = F.lit("list_or_lookup")
        for name, terms in reversed(QUESTION_TYPES):
            kind = F.when(any_of(q, terms), F.lit(name)).otherwise(kind)
        return F.concat(kind, F.when(any_of(q, INTERPRETIVE_TERMS), F.lit("_judge_recommended")).otherwise(F.lit("")))

    return let(norm(question), chosen)


def requested_fields(question: Column) -> Column:
    """Fields a question asks for, in the fixed order; "supplier" asks for the role too."""

    def chosen(q: Column) -> Column:
        named = F.filter(F.array(*[F.when(any_of(q, terms), F.lit(name)) for name, terms in FIELD_KEYWORDS]), lambda x: x.isNotNull())
        return F.when(q.contains("supplier"), F.array_union(named, F.array(F.lit("EV Supply Chain Role")))).otherwise(named)

    return let(norm(question), chosen)


def numbers_said(answer: Column) -> Column:
    """Runs of digits of a text, as tokens."""
    return F.split(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\D", " "), r"\s+")


def plain_value(value: Column) -> Column:
    """A value without commas and the space around it: digits, if it is a number."""
    return F.regexp_replace(F.trim(value.cast("string")), ",", "")


def match_score(plain: Column, normed: Column, said: Column, numbers: Column, numeric: bool | Column = False, tokens: Column | None = None) -> Column:
    """value_match_score from what is worked out once a value (plain_value, norm) and once an answer (norm,
    numbers_said; tokens: those of the answer, or of them those that any value has)."""

    def shared(parts: Column) -> Column:
        mine = F.filter(parts, lambda t: F.length(t) > 2)
        return let(F.split(said, " ") if tokens is None else tokens, lambda theirs: F.when(F.size(mine) > 0, F.size(F.filter(mine, lambda t: F.array_contains(theirs, t))) / F.size(mine)))

    numeric = F.lit(numeric) if isinstance(numeric, bool) else numeric
    return (
        F.when(normed.isNull() | (normed == ""), None).when(said.contains(normed), 1.0)
        .when(numeric | plain.rlike(r"^\d+$"), F.when(F.array_contains(numbers, plain), 1.0).otherwise(0.0)).otherwise(let(F.split(normed, " "), shared))
    )


def value_match_score(value: Column, answer: Column, numeric: bool = False) -> Column:
    """How far an answer holds a value: 1 if contained (normalised), digits all or nothing, else the share of its
    tokens of over two letters that are tokens of the answer; null if there is nothing to look for."""
    both = F.struct(plain_value(value).alias("plain"), norm(value.cast("string")).alias("normed"), norm(answer).alias("said"), numbers_said(answer).alias("numbers"))
    return F.when(value.isNotNull(), let(both, lambda b: match_score(b["plain"], b["normed"], b["said"], b["numbers"], numeric)))


def inline_thinking(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(INLINE_THINKING)


def section_flags(c: Column) -> Column:
    """Struct of booleans, one a section; core: all but Notes."""
    text = F.coalesce(c, F.lit(""))
    core = F.lit(True)
    for s in SECTIONS[:-1]:
        core = core & text.contains(f"{s}:")
    return F.struct(*[text.contains(f"{s}:").alias("has_" + s.lower().replace(" ", "_")) for s in SECTIONS], core.alias("format_core_ok"))


def ns_to_seconds(c: Column) -> Column:
    """Nanoseconds (over a million) as seconds; smaller numbers as they are; anything else null."""
    n = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.when(n > 1e6, n / 1e9).otherwise(n)


def truthy(c: Column, kind: str = "string") -> Column:
    """Null for what counts as absent: null, empty text, 0, false, NaN stays. kind: text, number, boolean or array."""
    if kind == "array":
        return F.when(F.size(c) > 0, c)
    if kind == "boolean":
        return F.when(c, c)
    return F.when(c != (F.lit("") if kind == "string" else F.lit(0)), c)


def normalize_bool(c: Column) -> Column:
    """true, yes, y and numbers other than 0 as true; null and the rest as false."""
    t = F.lower(F.trim(c.cast("string")))
    return F.coalesce(t.isin("true", "yes", "y") | (t.try_cast("double") != 0), F.lit(False))


def strip_think(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def json_body(c: Column) -> Column:
    """From the first { to the last } of a text without thinking blocks and code fences; the whole without braces."""
    plain = F.regexp_replace(F.regexp_replace(strip_think(c), r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return let(plain, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"(?s)\{.*\}", 0), F.lit("")), p))


def safe_name(c: Column, dots: bool = False) -> Column:
    """A model's name as a file name."""
    return F.translate(c, ":/ ." if dots else ":/ ", "____" if dots else "___")


def capped_cell(c: Column, suffix: str = "\n...[truncated for Excel]", spare: int = 30, limit: int = CELL_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - spare)), F.lit(suffix))).otherwise(c)


def natural_key(c: Column) -> Column:
    """A text whose order is the natural order: runs of digits padded to 20 places."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.concat_ws("", F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)))


def natural_sorted(a: Column) -> Column:
    keyed = F.array_sort(F.transform(a, lambda x: F.struct(natural_key(x).alias("k"), x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def county(location: Column) -> Column:
    """Text after the first comma, trimmed; null without one."""
    return F.nullif(F.trim(F.regexp_extract(location, r"(?s),(.*)$", 1)), F.lit(""))


def approx_tokens(prompt: Column) -> Column:
    return F.floor(F.length(prompt) / 4).cast("int")
