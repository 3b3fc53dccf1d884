"""Quality rules, line first: drop bad lines, then reject documents that lost too much.

Everything here is DataFrame functions: a row is judged in one pass over its own
text, without a shuffle, so a hot source or a very long document moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
SEPARATED = "[\\x20\\x09][|»›•·][\\x20\\x09]"
# What ends a sentence, in Latin and other scripts; letters of scripts that put no blanks between words.
ENDED = r"[.!?:;…\"'”’»)。！？；：」』）】؟۔।॥։።][\x20\x09-\x0D]*\z"
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
ITEM = r"\A[\x20\x09]*(?:[-*•–‣·]|[0-9]{1,2}[.)])[\x20\x09]"

# Phrases of page furniture, matched as whole words in lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "enable javascript",
    "forgot password",
    "javascript is disabled",
    "skip to content",
    "subscribe to our",
    "alle rechte vorbehalten",
    "tous droits réservés",
    "todos los derechos reservados",
)
# Phrases that prose has too, so they count only in lines that hold little else.
BUTTONS = (
    "back to top",
    "click here",
    "cookie policy",
    "leave a comment",
    "log in",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "sign up",
    "terms of service",
    "terms of use",
    "use of cookies",
    "weiterlesen",
    "lire la suite",
    "leer más",
)

#: A document needs so many words, and at most this share (percent) of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Lines of fewer words (or letters of unspaced scripts) must end a sentence; boilerplate phrases and those of buttons count in lines of fewer words.
SHORT_WORDS, SHORT_LETTERS, BOILERPLATE_WORDS, BUTTON_WORDS = 10, 20, 30, 5
#: A list is content if one of its neighbouring items has so many words, the bullet included.
ITEM_WORDS = 4
#: A line fails with at least so many separators between blanks (none if it has an opening guillemet), with more symbols
#: than a third of its words, or with at least so many capitals and no small letter.
SEPARATORS, CAPITALS = 3, 5
#: A document must keep this share (percent) of its characters.
MIN_KEPT_PERCENT = 50


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _has_words(n: int) -> str:
    """A pattern of lines with ``n`` words or more."""
    return r"\A[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (n - 1)


def _whole(phrases: tuple[str, ...]) -> str:
    """A pattern of the phrases between what isn't a letter or digit."""
    return r"(?:\A|[^\p{L}\p{N}])(?:%s)(?:[^\p{L}\p{N}]|\z)" % "|".join(phrases)


#: What a line is: without words, passed, failed for itself; and what ends no sentence: another short line, an item of a list, a longer item.
BLANK, PASSED, FAILED, OPEN, SHORT_ITEM, ITEM_OF_WORDS = range(6)


def line_code(line: Column) -> Column:
    """What a line is by itself.

    Tests that stop at the first match come first, counts only where a symbol occurs at all.
    """
    n_symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    unfinished = ~line.rlike(ENDED) & ~line.rlike(_has_words(SHORT_WORDS)) & ~line.rlike(r"(?:%s[^\n]*?){%d}" % (UNSPACED, SHORT_LETTERS))
    navigation = line.rlike(r"(?:%s.*){%d}" % (SEPARATED, SEPARATORS)) & ~line.contains("«")
    symbols = line.rlike(SYMBOLS) & (n_symbols * 3 > F.regexp_count(line, F.lit(NOT_SPACE + "+")))
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"(?:\p{Lu}[^\p{Lu}]*){%d}" % CAPITALS)
    low = F.lower(line)
    boilerplate = low.rlike(_whole(BOILERPLATE)) & ~line.rlike(_has_words(BOILERPLATE_WORDS))
    button = ~line.rlike(_has_words(BUTTON_WORDS)) & low.rlike(_whole(BUTTONS))
    item = F.when(line.rlike(ITEM), F.when(line.rlike(_has_words(ITEM_WORDS)), ITEM_OF_WORDS).otherwise(SHORT_ITEM)).otherwise(OPEN)
    return F.when(~line.rlike(NOT_SPACE), BLANK).when(shouting | navigation | symbols | boilerplate | button, FAILED).when(unfinished, item).otherwise(PASSED)


def stays(code: Column, before: Column, after: Column) -> Column:
    """Whether a line stays beside the worded lines before and after it (null at the text's ends).

    Of those that end no sentence, items stay in a list that has an item of some words beside or in them; another line stays as a heading,
    alone between what passed, or the start, and what passed or is such an item.
    """
    item = code.isin(SHORT_ITEM, ITEM_OF_WORDS)
    listed = F.coalesce(before.isin(SHORT_ITEM, ITEM_OF_WORDS), F.lit(False)) | F.coalesce(after.isin(SHORT_ITEM, ITEM_OF_WORDS), F.lit(False))
    worded = (code == ITEM_OF_WORDS) | F.coalesce(before == ITEM_OF_WORDS, F.lit(False)) | F.coalesce(after == ITEM_OF_WORDS, F.lit(False))
    heads = F.coalesce(after.isin(PASSED, ITEM_OF_WORDS), F.lit(False)) & F.coalesce(before.isin(PASSED, SHORT_ITEM, ITEM_OF_WORDS), F.lit(True))
    return code.isin(BLANK, PASSED) | item & listed & worded | (code == OPEN) & heads


def repeated_words(words: Column, windows: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    ``windows`` holds a hash of each window.  Only documents with a repeat sort them:
    equal hashes become neighbours, and the words they cover are counted once.
    """
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        same = F.filter(
            pairs, lambda x, j: (x["h"] == _at(pairs, j - 1)["h"]) | (x["h"] == _at(pairs, j + 1)["h"])
        )
        starts = F.transform(same, lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.array(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2)))))

    # The sorted array is bound once by a one-element transform, so that it isn't sorted for each use.
    counted = F.element_at(F.transform(F.array(tagged), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(F.lit(0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure and judge every row of ``docs``; all its columns stay.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed, kept`` (boolean) and ``clean_text``, the lines that no rule fails.
    Words are runs of other than white space; lines are split at newlines.  A document
    is rejected with too few words, too many of them in repeated three-word windows, or
    less than half of its characters in lines that stay.  A line's neighbours are the lines beside it, beyond a blank one.

    Defined cases: a null or empty text has no words, so it is rejected with all counts 0
    and a clean_text that is null or empty; repeated rows are judged alike; a column of the input
    that has the name of a new one is replaced; an empty table gives an empty result.
    """
    taken = docs.columns
    t, words, lines, windows = (fresh(taken, x) for x in ("t_", "words_", "lines_", "windows_"))
    kept_lines, full, codes = fresh(taken, "kept_lines_"), fresh(taken, "full_lines_"), fresh(taken, "codes_")

    def beside(i: Column, step: int) -> Column:
        near = F.get(codes, i + step)
        return F.when(near == BLANK, F.get(codes, i + 2 * step)).otherwise(near)

    n = F.size(words)
    at = docs.withColumns({t: F.coalesce(F.col(text_col), F.lit(""))})
    at = at.withColumns({words: words_of(F.col(t)), lines: F.split(t, "\n")})
    at = at.withColumns({
        windows: F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(_at(F.col(words), i), _at(F.col(words), i + 1), _at(F.col(words), i + 2)))).otherwise(F.array().cast("array<bigint>")),
        codes: F.transform(lines, line_code),
        full: F.filter(lines, lambda x: x.rlike(NOT_SPACE)),
    })
    # The codes are a column of their own, so that each line is tested once; most lines pass without a look at their neighbours.
    alone = F.forall(codes, lambda c: c.isin(BLANK, PASSED))
    at = at.withColumn(kept_lines, F.when(alone, F.col(lines)).otherwise(F.filter(lines, lambda x, i: stays(F.get(codes, i), beside(i, -1), beside(i, 1)))))
    at = at.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words), F.col(windows)).cast("long"),
        "clean_text": F.when(F.col(text_col).isNotNull(), F.array_join(kept_lines, "\n")),
    })
    lost = F.length(F.array_join(kept_lines, "\n")) * 100 < F.length(t) * MIN_KEPT_PERCENT
    at = at.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    at = at.withColumn("kept", ~(F.col("base_failed") | lost))
    return at.drop(t, words, lines, windows, kept_lines, full, codes)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with its columns.

    The row number keeps the optimizer from pushing the verdict below the columns that it is
    made of, which would write each of their expressions out again wherever it is used.
    """
    at = judge(docs, id_col, text_col)
    number = fresh(at.columns, "row_")
    return at.withColumn(number, F.monotonically_increasing_id()).filter(F.col("kept") & (F.col(number) >= 0)).drop(number)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), keyed AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM win
), twice AS (
  SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), parts AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM w
), coded AS (
  SELECT doc_id, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
         CASE WHEN NOT regexp_matches(line, '[^\x20\x09-\x0D]') THEN 0
              WHEN (regexp_matches(line, '(?:[\x20\x09][|»›•·][\x20\x09].*){3}') AND NOT contains(line, '«'))
           OR (NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '(?:\p{Lu}[^\p{Lu}]*){5}'))
           OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]+', '', 'g'))) * 3 > len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))
           OR (NOT regexp_matches(line, '@@LONG@@') AND regexp_matches(lower(line), '@@BOILERPLATE@@'))
           OR (NOT regexp_matches(line, '@@FEW@@') AND regexp_matches(lower(line), '@@BUTTONS@@')) THEN 2
              WHEN regexp_matches(line, '@@ENDED@@') OR regexp_matches(line, '@@SHORT@@') OR length(line) - length(regexp_replace(line, '@@UNSPACED@@', '', 'g')) >= 20 THEN 1
              WHEN NOT regexp_matches(line, '@@ITEM@@') THEN 3 WHEN regexp_matches(line, '@@WORDED@@') THEN 5 ELSE 4 END AS code
  FROM parts
), beside AS (
  SELECT *, CASE WHEN lag(code) OVER w = 0 THEN lag(code, 2) OVER w ELSE lag(code) OVER w END AS before, CASE WHEN lead(code) OVER w = 0 THEN lead(code, 2) OVER w ELSE lead(code) OVER w END AS after
  FROM coded WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), judged AS (
  SELECT *, NOT (code IN (0, 1) OR (code IN (4, 5) AND coalesce(greatest(before, after), 0) >= 4 AND greatest(code, before, after) = 5)
    OR (code = 3 AND coalesce(after, 2) IN (1, 5) AND coalesce(before, 1) IN (1, 4, 5))) AS broken
  FROM beside
), lines AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (worded AND broken)), '') AS clean,
         count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup
  FROM judged GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         n_dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(clean) * 100 < length(t) * 50 AS lost
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR lost) AS kept
FROM m
"""
for _name, _pattern in {
    "SHORT": _has_words(SHORT_WORDS), "LONG": _has_words(BOILERPLATE_WORDS), "FEW": _has_words(BUTTON_WORDS), "BOILERPLATE": _whole(BOILERPLATE), "BUTTONS": _whole(BUTTONS),
    "ENDED": ENDED.replace("'", "''"), "UNSPACED": UNSPACED, "ITEM": ITEM, "WORDED": _has_words(ITEM_WORDS),
}.items():
    ORACLE_SQL = ORACLE_SQL.replace(f"@@{_name}@@", _pattern)
