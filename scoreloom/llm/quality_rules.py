"""Operator 1, quality rules: a table of thresholds compiled into one native projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

SYMBOLS = "#*$%&|<>"
#: What SPACE matches, one by one.
WHITE = " \t\n\x0b\f\r"
WINDOW = 8
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was what with "
    "au aux avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "als auf aus das dem den der des die ein eine für ist mit nicht sich und von zu "
    "al con de del el en es esta la las lo los no para por que se su un una y"
).split()
BULLETS = ("-", "*", "•", "‣", "·")


@dataclass(frozen=True)
class Rule:
    """low <= part / whole <= high, compared in whole numbers; a bound that is None is not tested.

    low and high are thousandths. Where whole is 0 the rule holds."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def broken(self, m: Column) -> Column:
        part, whole = m[self.part] * 1000, m[self.whole]
        out = F.lit(False)
        if self.low is not None:
            out = out | (part < whole * self.low)
        if self.high is not None:
            out = out | (part > whole * self.high)
        return out

    def broken_sql(self) -> str:
        tests = []
        if self.low is not None:
            tests.append(f"{self.part} * 1000 < {self.whole} * {self.low}")
        if self.high is not None:
            tests.append(f"{self.part} * 1000 > {self.whole} * {self.high}")
        return "(" + (" OR ".join(tests) or "FALSE") + ")"


#: The production table. "one" is the constant 1, for rules on a count.
RULES = (
    Rule("long_enough", "n_words", "one", low=20_000),
    Rule("word_length", "word_chars", "n_words", low=2_000, high=15_000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "one", low=1_000),
    Rule("stop_word_share", "n_stop_words", "n_words", low=20),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300),
    Rule("repeated_words", "n_repeat_words", "n_words", high=300),
)


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; hashes: by window's first word."""

    def spans(pairs: Column) -> Column:
        n = F.size(pairs)
        twin = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: ((j > 0) & (pairs[j]["h"] == F.get(pairs, j - 1)["h"])) | ((j < n - 1) & (pairs[j]["h"] == F.get(pairs, j + 1)["h"])),
        )
        starts = F.array_sort(F.transform(twin, lambda j: pairs[j]["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, first, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, spans))


def _repeat_words(words: Column) -> Column:
    def windows(wh: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(wh) - WINDOW), lambda i: F.xxhash64(*[wh[i + k] for k in range(WINDOW)]))
        return let(hashes, _covered)

    short = F.size(words) < 2 * 1 + WINDOW - 1  # fewer than two windows
    return F.when(short, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def verdict(text: Column, rules=RULES) -> Column:
    """A struct of counts, base_failed, kept and failed_rules (names joined by a comma), in one native expression."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    trimmed = lambda x: F.btrim(x, F.lit(WHITE))
    # Each line with a word, and the same without white space around it: trimmed once.
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), trimmed(x).alias("bare"))), lambda x: x["bare"] != "")
    long = lambda c, name: c.cast("long").alias(name)

    def counts(t: Column, w: Column, ln: Column) -> Column:
        return F.struct(
            F.lit(1).cast("long").alias("one"),
            long(F.size(w), "n_words"),
            long(F.length(F.array_join(w, "")), "word_chars"),
            long(F.regexp_count(t, F.lit(f"[{SYMBOLS}]")), "n_symbols"),
            long(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))), "n_stop_words"),
            long(F.size(ln), "n_lines"),
            long(F.size(ln) - F.size(F.array_distinct(ln["raw"])), "n_dup_lines"),
            long(F.size(F.filter(ln["bare"], lambda x: F.left(x, F.lit(1)).isin(*BULLETS))), "n_bullet_lines"),
            long(F.size(F.filter(ln["bare"], lambda x: x.endswith("...") | x.endswith("…"))), "n_ellipsis_lines"),
            long(_repeat_words(w), "n_repeat_words"),
        )

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 20) | (m["n_repeat_words"] * 100 > m["n_words"] * 30)
        failed = F.concat_ws(",", *[F.when(r.broken(m), F.lit(r.name)) for r in rules])
        any_broken = F.lit(False)
        for r in rules:
            any_broken = any_broken | r.broken(m)
        return F.struct(*[m[c].alias(c) for c in COUNTS], base.alias("base_failed"), (~base & ~any_broken).alias("kept"), failed.alias("failed_rules"))

    return let(let(text, lambda t: let(words, lambda w: let(lines, lambda ln: counts(t, w, ln)))), judged)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def quality_rules(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """df with the counts, base_failed, kept and failed_rules of each row's whole text.

    A null text counts as empty (not kept: fewer than 20 words). Result columns replace input columns of the
    same name. Rows are neither dropped nor reordered; an empty table stays empty. No shuffle, no Python."""
    names = [*COUNTS, "base_failed", "kept", "failed_rules"]
    own = [df[f"`{c}`"] for c in df.columns if c not in names]
    # The array of one is exploded, so that the verdict is worked out once and no name of df can clash with it.
    return df.select(*own, F.inline(F.array(verdict(df[text_col], rules))))


def passing(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that the rules keep, with df's columns."""
    return df.filter(verdict(df[text_col], rules)["kept"])


def oracle_sql() -> str:
    """DuckDB SQL for op1's rows, by relations instead of arrays."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bullets = ", ".join(f"'{b}'" for b in BULLETS)
    broken = " OR ".join(r.broken_sql() for r in RULES)
    names = ", ".join(f"CASE WHEN {r.broken_sql()} THEN '{r.name}' END" for r in RULES)
    space = r"[ \t\n\x0B\f\r]+"
    trim = rf"regexp_replace(x, '^{space}|{space}$', '', 'g')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k),
v AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM r WHERE c >= 2),
rep AS (SELECT doc_id, sum(n) AS n FROM v GROUP BY doc_id),
m AS (SELECT w.doc_id, 1 AS one, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ls, lambda x: left({trim}, 1) IN ({bullets}))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(ls, lambda x: {trim} LIKE '%...' OR {trim} LIKE '%…')) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, {', '.join(COUNTS)}, base_failed, (NOT base_failed AND NOT ({broken})) AS kept,
  concat_ws(',', {names}) AS failed_rules FROM b
"""
